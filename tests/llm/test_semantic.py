import random

import numpy as np
import pyarrow as pa

from graphloom.llm import semantic as S
from graphloom.llm import textops as T
from graphloom.runtime import table


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_bit_alignment_equals_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 80))] for _ in "ab")
        assert S.common(S.Items._mask(a), b) == lcs(a, b)


def test_singular_vectors_equal_a_dense_svd(spark):
    """Leading values and vectors of the whole matrix, however it is partitioned."""
    rng = np.random.default_rng(3)
    subjects = [rng.choice(150, 12, replace=False) for _ in range(6)]
    texts = [" ".join(f"w{x}" for x in rng.choice(subjects[k % 6], rng.integers(1, 200))) for k in range(300)] + [None, ""]
    feature, owner, n = S._passages(pa.array(texts))
    used, column = np.unique(feature, return_inverse=True)
    dense = np.zeros((n, len(used)))
    np.add.at(dense, (owner, column), 1)
    weight = np.log((n + 1) / ((dense > 0).sum(0) + 1)) ** 2
    _, size, right = np.linalg.svd(dense * weight, full_matrices=False)
    for parts in (1, 7):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        vectors, values, own = S.singular_vectors(docs, 12)
        assert np.allclose(own[used], weight)
        assert np.allclose(values[:6], size[:6], rtol=0.05)
        assert (np.linalg.norm(right[:6] @ vectors[used], axis=1) > 0.95).all()


def brute(rows, items):
    """All pairs of a text and an item by the longest common subsequence over every region of the operator's reach."""
    trim = lambda t: [h for h in S.item_words(*T.text_bytes(pa.array([t])))[0].tolist()]
    out = set()
    for b, x in items:
        own = trim(x)
        ends = np.flatnonzero(S.item_words(*T.text_bytes(pa.array([x])))[2])
        ends = ends[ends < len(own) - S.ANSWER]
        answer = own[int(ends[-1]) + 1 if len(ends) else max(0, len(own) - 2 * S.ANSWER) :]
        for d, t in rows:
            words = trim(t)
            for at in range(0, max(1, len(words)), 4):
                region = words[max(0, at - S.REACH) : at + max(2 * S.REACH, len(own)) + S.REACH]
                if lcs(own, region) >= S.COVER * len(own) and 2 * lcs(answer, region) >= len(answer):
                    out.add((d, b))
                    break
    return out


def test_equals_all_pairs_alignment(spark):
    """Every pair that the alignment accepts anywhere is found, in a small corpus with paraphrases, and no other."""
    folder = "/root/testdata/sf0.01"
    docs, bench = table(spark, folder, "documents").toPandas(), table(spark, folder, "benchmark").toPandas().head(8)
    rng, rows = random.Random(4), []
    short = [t for t in docs.text if t and 60 <= len(t.split()) <= 200][:60]
    for k, base in enumerate(short):
        words = base.split()
        if k % 3 == 0:
            item = bench.text[(k // 3) % len(bench)].split()
            for i in rng.sample(range(len(item)), int(len(item) * rng.choice([0, 0.1, 0.2]))):
                item[i] = "changed"
            words[40:40] = item
        rows.append((k, " ".join(words)))
    items = [(int(b), x) for b, x in zip(bench.item_id, bench.text)]
    want = brute(rows, items)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in S.matches(frame, spark.createDataFrame(items, "item_id long, text string"), 0.2).collect()}
    assert got == want
    assert len(want) >= 15


def test_long_text_in_pieces(spark, monkeypatch):
    """Items at the borders of a long text's pieces are found."""
    bench = table(spark, "/root/testdata/sf0.01", "benchmark").toPandas()
    space = np.random.default_rng(1).normal(size=(S.FEATURES, 8)).astype(np.float32)
    items = S.Items(list(range(len(bench))), bench.text.tolist(), space)
    monkeypatch.setattr(S, "PIECE", 97)
    words = [f"word{k}" for k in range(500)]
    for k in range(0, len(bench), 7):
        text = " ".join([*words[: 60 + k], bench.text[k], *words[60 + k :]])
        assert k in {i for _, i, _ in S._find(items, space, *T.text_bytes(pa.array([text])), 0.99)}


def test_finds_inserted_items_and_paraphrases(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = table(spark, folder, "documents").toPandas(), table(spark, folder, "benchmark").toPandas()
    rng = random.Random(2)
    held = {(int(d), int(b)) for d, t in zip(docs.doc_id, docs.text) for b, x in zip(bench.item_id, bench.text) if x in t}
    clean = sorted(set(docs.doc_id.tolist()) - {d for d, _ in held})
    rows, planted = [(int(d), t) for d, t in zip(docs.doc_id, docs.text)], set()
    for k, (b, x) in enumerate(zip(bench.item_id, bench.text)):
        words = x.split()
        for _ in range(len(words) // 10):
            words[rng.randrange(len(words))] = "replaced"
        base = docs.text[clean[3 * k]].split()
        at = rng.randrange(len(base) + 1)
        rows.append((10_000 + k, " ".join(base[:at] + words + base[at:])))
        planted.add((10_000 + k, int(b)))
    frame = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, cover double")
    items = spark.createDataFrame([(int(b), x) for b, x in zip(bench.item_id, bench.text)] + [(900, None), (901, ""), (902, "word")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in S.matches(frame, items).collect()}
    assert held <= got
    assert len(planted & got) >= 0.9 * len(planted)
    assert len(got - held - planted) <= 2
    kept = S.keep_clean(frame, items)
    assert kept.columns == ["doc_id", "text", "cover"]
    assert kept.count() == len(rows) - len({d for d, _ in got})


def test_finds_items_at_every_offset(spark):
    """Word for word, wherever an item stands to the windows; shared runs alone suffice."""
    folder = "/root/testdata/sf0.01"
    docs, bench = table(spark, folder, "documents").toPandas(), table(spark, folder, "benchmark").toPandas()
    clean = [t.split() for t in docs.text if t and 150 <= len(t.split()) <= 2000 and not any(x in t for x in bench.text)]
    rows = []
    for k, x in enumerate(bench.text):
        for at in range(16):
            base = clean[(16 * k + at) % len(clean)]
            rows.append((16 * k + at, " ".join([*base[: 64 + at], x, *base[64 + at :]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for cosine in (S.COSINE, 2.0):
        got = {(r.doc_id, r.item_id) for r in S.matches(frame, table(spark, folder, "benchmark"), cosine).collect()}
        assert {(16 * k + at, int(b)) for k, b in enumerate(bench.item_id) for at in range(16)} <= got


def test_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "x")], "doc_id long, text string")
    assert S.matches(docs, items).collect() == []
    assert S.keep_clean(docs, items).count() == 3
    assert S.matches(docs.limit(0), items).collect() == []
    assert S.matches(docs, items.limit(0)).collect() == []


def test_bounds_count_numbered_words_each_as_often_as_in_both():
    from collections import Counter

    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 30, n)) for n in (12, 40, 3)]
    items = S.Items([1, 2, 3], texts, np.ones((S.FEATURES, 4), np.float32))
    words = [f"w{x}" for x in r.integers(0, 60, 300)]
    hashes, _, _ = S.item_words(*T.text_bytes(pa.array([" ".join(words)])))
    lo = np.array([0, 50, 120, 299])
    hi = np.array([40, 50, 300, 300])
    for k, text in enumerate(texts):
        want = [(Counter(text.split()) & Counter(words[a:b])).total() for a, b in zip(lo, hi, strict=True)]
        assert items.bound(k, items.numbered(hashes), lo, hi).tolist() == want
    assert S.Items([1], [""], np.ones((S.FEATURES, 4), np.float32)).numbered(hashes).tolist() == [0] * 300


def test_bound_leaves_out_regions_with_too_few_of_an_items_words():
    """Those get the number of the item's words, however often: no less than the bound, and still below what is needed."""
    items = S.Items([1], ["a b c d e f g h"], np.ones((S.FEATURES, 4), np.float32))
    hashes, _, _ = S.item_words(*T.text_bytes(pa.array(["a b c d e f g h x y a a a x x x"])))
    words, lo, hi = items.numbered(hashes), np.array([0, 8, 4]), np.array([8, 16, 12])
    assert items.bound(0, words, lo, hi).tolist() == [8, 1, 5]
    assert items.bound(0, words, lo, hi, 5).tolist() == [8, 3, 5]
    assert items.bound(0, words, lo, hi, 9).tolist() == [8, 3, 6]
