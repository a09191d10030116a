import hashlib
import random
import re

from graphloom.llm import personal

REGEX = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(REGEX):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_equals_brute_force(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "00255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (499) 555-6503", "+", "5", " ", "\n", "é", "🙂", "_", "-", "a", "99", "(", "\x01", "\x02", "4984250489669609", "c.d"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 200_000 + "@"), (1003, "1 " * 30_000), (1004, "1.2.3.4 " * 3000), (1004, "a@b.c_d@e.f"), (None, "x@y.z")]
    got = [tuple(r) for r in personal.personal_data(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")).collect()]
    want = []
    for d, t in rows:
        base = brute(t)
        want.append((d, *(sum(s.startswith(k) for s in base) for k, _ in REGEX), hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted((r[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        spans = r[6].split(",") if r[6] else []
        assert len(spans) >= sum(r[1:5])


def test_bootstrapping_finds_unseen_identifiers(spark):
    names = ["ann", "bob", "cid", "dora", "eve", "finn", "gus", "hal", "ida", "jon", "kim", "leo"]
    rows = [(k, f"the mail of staff : {n}@firm.org for questions") for k, n in enumerate(names)]
    rows += [(100, "the mail of staff : mia77(at)firm.org for questions"), (101, "a random token mia77(at)firm.org elsewhere"), (102, "Licensed under version 2.0.11 only")]
    got = {r.doc_id: r.spans for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "email:20:37"
    assert got[101] == got[102] == ""
    assert got[0] == "email:20:32"


def test_rounds_go_on_and_candidates_may_have_spaces(spark):
    """Numbers of several groups, addresses without a digit or dot, and a chain of patterns longer than two rounds."""
    number = lambda kind, j: f"{kind}30 {100 + j // 50} {1000 + j}"  # noqa: E731  three groups, no base phone
    rows = [(j, f"please call +{10 + j % 80} {100 + j} 55{j % 10} 7654 now") for j in range(160)]
    rows += [(1000 + j, f"write to {n}@firm.org today") for j, n in enumerate(("ann", "bob", "cid", "dora", "eve", "finn", "gus", "hal", "ida", "jon"))] + [(1100, "write to anna@localhost today")]
    chain, many = ["please call", "ring up", "dial the", "reach at"], [48, 15, 4]
    for k, n in enumerate(many):  # what one pattern finds supports the next one, a round later
        rows += [(2000 + 100 * k + j, f"{chain[k]} {number(k + 1, j)} now") for j in range(n)]
        rows += [(3000 + 100 * k + j, f"{chain[k + 1]} {number(k + 1, j)} here") for j in range(n)]
    got = {}
    for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.spans)
    assert got[1100] == ["email:9:23"]
    for k, n in enumerate(many):
        assert all(got[2000 + 100 * k + j][0].startswith(f"phone:{len(chain[k]) + 1}:") for j in range(n))


def test_empty(spark):
    assert personal.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
