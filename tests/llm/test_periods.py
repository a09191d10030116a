import hashlib
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import periods as P


def brute(words):
    """Every run of a list by trying each period and stretch."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            smaller = any(all(own[k] == own[k + r] for k in range(len(own) - r)) for r in range(1, q))
            if len(own) >= max(12, 2 * q) and not smaller:
                out.append((i, len(own), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples(rng, most):
    kinds = rng.choice([1, 2, 3, 5, 50])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(most))]
    if words and rng.random() < 0.6:
        at = rng.randrange(len(words))
        p = rng.randrange(1, max(2, (len(words) - at) // 2 + 1))
        words = words[:at] + [words[at + (i - at) % p] for i in range(at, len(words))]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "odd"
    return words


@pytest.mark.parametrize("coarse", [False, True])
def test_runs_equal_brute_force(monkeypatch, coarse):
    if coarse:  # the sampled planes, on texts that brute force can take
        monkeypatch.setattr(P, "COARSE", 4)
        monkeypatch.setattr(P, "COARSE_LAG", 32)
        monkeypatch.setattr(P, "COARSE_WORDS", 64)
    rng = random.Random(7)
    for _ in range(600):
        words = samples(rng, 180)
        assert P.find_runs(P.number_words([w.encode() for w in words])) == brute(words)


def test_long_texts_with_production_parameters():
    rng = np.random.default_rng(5)
    period = rng.integers(0, 900, 700)
    ids = np.concatenate([rng.integers(1000, 9000, 5000), np.tile(period, 5)[:3001], rng.integers(1000, 9000, 4000)])
    assert P.find_runs(ids) == [(5000, 3001, 700)]
    assert P.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def digest(doc_id, text):
    """The contract's row, by brute force."""
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digest_of_edge_cases_and_planted_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(samples(rng, 120))) for i in range(300)]
    rows += [(1, None), (2, ""), (None, "a b " * 9), (3, " \t\n"), (4, "ä ö\x0bä ö " * 8), (4, "ä ö\x0bä ö " * 8), (5, "x y " * 14), (6, "a " * 3000)]
    docs = spark.createDataFrame([(t, i, "z", 7) for i, t in rows], "text string, doc_id long, runs string, `start` int")
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[:300])
    assert sorted(map(tuple, P.run_digest(docs).collect()), key=key) == sorted((digest(i, t) for i, t in rows), key=key)
    assert P.run_digest(docs.limit(0)).collect() == []


def test_digest_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = {r.doc_id: digest(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 700}
    found = {r.doc_id: tuple(r) for r in P.run_digest(docs).collect()}
    assert len(found) == docs.count() and len(short) > 100
    assert {i: found[i] for i in short} == short


def test_spans_and_collapsed_texts_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "go " * 12 + "on", "k"), (2, "a b  c", None), (3, None, "n")], "doc_id long, text string, runs string")
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in P.run_spans(docs).orderBy("doc_id").collect()] == [(1, 13, [(0, 12, 1)]), (2, 3, []), (3, 0, [])]
    assert [tuple(r) for r in P.collapse_runs(docs).orderBy("doc_id").collect()] == [(1, "go on", "k"), (2, "a b  c", None), (3, None, "n")]
