import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import lines as L
from graphloom.llm import textops as T


def test_lines_equal_split():
    texts = ["a b\n\n c d \nx", "", None, "one", "\n", "tail\n", " \n \n"]
    hashes, count, per = L.split_lines(*T.text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        parts = t.split("\n") if t else []
        assert per[k + 1] - per[k] == len(parts)
        assert count[per[k] : per[k + 1]].tolist() == [len(p.split()) for p in parts]
    names = {}
    flat = [p.strip(" ") for t in texts if t for p in t.split("\n")]
    for h, p in zip(hashes.tolist(), flat, strict=True):
        assert names.setdefault(p, h) == h
    assert len(set(names.values())) == len(names)


def test_patience_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in "ab")
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert L.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert L.patience([1, 9, 2, 3], [8, 1, 2, 7, 3]) == [(0, 1), (2, 2), (3, 4)]


def plain_patience(a, b):
    """Aligned places of two lists, recursively: common head and tail, then the longest ascending run of values that both hold once."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(k, k) for k in range(head)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    once = [(x.index(v), j) for j, v in enumerate(y) if x.count(v) == 1 and y.count(v) == 1]
    runs = []
    for i, j in once:  # as the operator's: of equally long runs the one whose ends are least
        at = next((k for k, r in enumerate(runs) if r[-1][0] >= i), len(runs))
        run = [*(runs[at - 1] if at else []), (i, j)]
        runs[at : at + 1] = [run]
    chain = runs[-1] if runs else []
    if chain:
        for (i, j), (k, m) in zip([(-1, -1), *chain], [*chain, (len(x), len(y))]):
            out += [(head + i + 1 + p, head + j + 1 + q) for p, q in plain_patience(x[i + 1 : k], y[j + 1 : m])]
        out += [(head + i, head + j) for i, j in chain]
    return sorted(out)


def plain_deletions(a, b, anchor):
    gone, block, last = set(), [], None
    for i, j in [*plain_patience(a, b), (-9, -9)]:
        if last != (i - 1, j - 1):
            gone |= set(block) if any(anchor[k] for k in block) else set()
            block = []
        block.append(j)
        last = (i, j)
    return gone


def brute(rows):
    """Deleted lines of each document, aligned with every earlier one that shares an anchor line: whole, and by the lines of more than RARE documents alone."""
    every = sorted({(d, t) for d, t in rows if d is not None and t}, key=lambda r: r[0])
    first = {}
    for r in every:
        first.setdefault(r[1], r)
    anchors = lambda t: {p.strip(" ") for p in t.split("\n") if len(p.split()) >= 5}
    docs = [r for r in every if first[r[1]] == r]
    held = {}
    for r in docs:
        for p in anchors(r[1]):
            held.setdefault(p, []).append(r)
    out = {}
    for r in every:
        own = r[1].split("\n")
        if first[r[1]] != r:
            out[r] = tuple(range(len(own))) if anchors(r[1]) else ()
            continue
        partners = set()
        for p in anchors(r[1]):
            partners |= set(held[p][: held[p].index(r)])
        gone = set()
        strip = lambda ps: [p.strip(" ") for p in ps]
        for o in partners:
            theirs, mark = strip(o[1].split("\n")), [len(p.split()) >= 5 for p in own]
            gone |= plain_deletions(theirs, strip(own), mark)
            gone |= plain_deletions([None if len(p.split()) >= 5 and len(held[p]) <= L.RARE else p for p in theirs], strip(own), mark)
        out[r] = tuple(sorted(gone))
    return out


def agree(rows, got):
    """The lines of five words or more are those of all pairs; shorter ones that went are among them."""
    want = brute(rows)
    for r in want:
        own, mine = r[1].split("\n") if r[1] else [], set(got.get(r, ()))
        assert mine <= set(want[r]), r
        assert all(len(own[k].split()) < 5 for k in set(want[r]) - mine), r


def found(rows, frame):
    got = {}
    for r in frame.collect():
        for text in {t for d, t in rows if d == r.line_doc and t}:
            got[(r.line_doc, text)] = tuple(sorted({int(x) for g in r.gone for x in L.X.unpack(g, np.int64)}))
    return got


def test_three_documents_keep_no_link_apart(spark):
    """The third is a copy of the second, which crosses the first; the fourth holds the second's order among other lines."""
    x, y = "one line of more than five words", "another line of more than five words"
    rows = [(1, f"{y}\n{x}"), (2, f"{x}\n{y}"), (3, f"{x}\n{y}"), (4, f"own words here\n{x}\n{y}\nand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(rows, L.deleted_lines(docs))
    assert got[(3, rows[2][1])] == (0, 1) and got[(4, rows[3][1])] == (1, 2)
    assert {r: got.get(r, ()) for r in rows} == brute(rows)


@pytest.mark.parametrize(("seed", "rare"), [(3, None), (3, 1), (40, 6), (41, 15)])
def test_equals_alignment_of_all_pairs(spark, monkeypatch, seed, rare):
    """Half of the lines from a pool of 30, so that lines have dozens of holders in all orders; with production parameters and with more lines counted as frequent."""
    monkeypatch.setattr(L, "RARE", rare or L.RARE)
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))
    pool = [line(rng.choice([1, 2, 6, 8])) for _ in range(30)]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.5 else line(rng.choice([2, 7])) for _ in range(rng.randrange(1, 9)))) for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    agree(rows, found(rows, L.deleted_lines(docs)))


def test_a_far_holder_takes_what_nearer_ones_leave(spark):
    """Document 2 alone has the order of document 7; five others that cross it hold the line nearer by."""
    x, y = "one line of more than five words", "another line of more than five words"
    own = lambda k: f"the own filler line of document number {k}"
    rows = [(k, f"{y}\n{own(k)}\n{x}") for k in (1, 3, 4, 5, 6)] + [(2, f"{x}\n{y}\n{own(2)}"), (7, f"{x}\n{y}\n{own(7)}")]
    got = found(rows, L.deleted_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[(7, rows[-1][1])] == (0, 1)
    assert {r: got.get(r, ()) for r in rows} == brute(rows)


def test_like_holders_are_one_class(spark, monkeypatch):
    """A line that stands twice in each of 200 documents, among lines of their own, is never aligned: one class meets itself, once for all pairs."""
    hot = "the separator line that stands everywhere twice"
    rows = [(d, f"first own line of document {d}\n{hot}\nsecond own line of document {d}\n{hot}\nthird own line of document {d}") for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts, kept = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: counts.setdefault(name, kept(df, name)))
    assert found(rows, L.deleted_lines(docs)) == {r: () for r in rows[1:]}
    assert {k: counts[k].count() for k in ("line-pairs", "line-heads", "line-taken")} == {"line-pairs": 199, "line-heads": 1, "line-taken": 0}


def test_a_short_line_of_its_own_keeps_no_document_out_of_a_class(spark, monkeypatch):
    """As before, but each document also has short lines that no other one has, so that all documents differ in their short lines."""
    hot = "the separator line that stands everywhere twice"
    rows = [(d, f"head {d}\n{hot}\nan own line of document {d}\nsub {d}\n{hot}\nanother own line of document {d}") for d in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts, kept = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: counts.setdefault(name, kept(df, name)))
    assert found(rows, L.deleted_lines(docs)) == {r: () for r in rows[1:]}
    assert counts["line-heads"].count() == 1


def test_classes_apart_by_lines_of_few_meet_as_kinds(spark, monkeypatch):
    """Pairs of documents share a short line, so that there are about as many classes as pairs; the common lines stand in five orders, with or without a gap at the end."""
    rng = random.Random(5)
    hot = [f"common line number {k} of all documents" for k in range(3)]
    rows = []
    for d in range(160):
        common = rng.choice([[hot[0], hot[0]], [hot[0], hot[1]], [hot[1], hot[0]], [hot[0], hot[0], hot[1]], [hot[1], hot[2], hot[1], hot[0], hot[0]]])
        text = [p for k, h in enumerate(common) for p in (f"an own line of document {d} before {k}", h)]
        text.insert(rng.randrange(len(text) + 1), f"pair {d // 2}")
        rows.append((d, "\n".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts, kept = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: counts.setdefault(name, kept(df, name)))
    agree(rows, found(rows, L.deleted_lines(docs)))
    n = {k: f.count() for k, f in counts.items()}
    assert n["line-heads"] > 100 and n["line-tops"] <= 10 and n["line-barred"] > 0
    assert n["line-near"] <= 2 * n["line-heads"] + 5 * L.RARE and n["line-aligned"] <= 100


def test_a_frequent_line_is_taken_by_a_class(spark):
    """The first holder crosses the line; a later one among 100 others, which hold it twice, has it in order."""
    x, y = "one line of more than five words", "another line of more than five words"
    own = lambda k: f"the own filler line of document number {k}"
    rows = [(0, f"{y}\n{own(0)}\n{x}")] + [(k, f"{own(k)}\n{x}\n{own(-k)}\n{x}\n{y}\n{own(1000 + k)}\n{y}") for k in range(1, 60)]
    rows += [(200, f"{own(200)}\n{x}\n{y}\n{own(201)}"), (300, f"{x}\n{y}\n{own(300)}")]
    got = found(rows, L.deleted_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[(300, rows[-1][1])] == (0, 1)
    agree(rows, got)


def test_equals_brute_force(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))
    pool = [line(rng.choice([1, 2, 6, 8])) for _ in range(30)]
    rows = []
    for d in range(120):
        rows.append((d, "\n".join(rng.choice(pool) if rng.random() < 0.2 else line(rng.choice([2, 7])) for _ in range(rng.randrange(1, 9)))))
    rows += [(200 + k, rows[7][1]) for k in range(20)] + [(300, None), (301, ""), (None, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, line_gone_ string").repartition(3)
    agree(rows, found(rows, L.deleted_lines(docs)))
    kept = L.dedup_lines(docs).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "line_gone_"]
    ids = [r.doc_id for r in kept]
    assert ids.count(7) == 2 and ids.count(None) == 1 and not any(200 <= (i or 0) < 220 for i in ids) and {300, 301} <= set(ids)
    assert L.line_digest(docs).count() == len(rows)
    assert L.line_digest(docs.limit(0)).collect() == []


def test_frequent_lines_go_beside_rarer_ones(spark):
    """A line of 100 documents leaves each later one, though each also shares a rarer line with another first holder."""
    hot = "this very common line stands in all documents"
    rows = [(d, f"own words of document {d} here\nthe line of pair number {d} only") for d in range(100)]
    rows += [(100 + d, f"own words of document {100 + d} here\n{hot}\nagain own words of document {d}\nthe line of pair number {d} only") for d in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.line_doc: sorted({int(x) for g in r.gone for x in L.X.unpack(g, np.int64)}) for r in L.deleted_lines(docs).collect()}
    assert {r[0]: list(brute(rows)[r]) for r in rows} == {d: got.get(d, []) for d, _ in rows}
    assert got == {100: [3]} | {d: [1, 3] for d in range(101, 200)}
    assert {r.doc_id: r.n_deleted for r in L.line_digest(docs).collect()} == {d: len(got.get(d, [])) for d, _ in rows}
