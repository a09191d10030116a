import math
import re
import zlib
from collections import Counter

import numpy as np

from graphloom.llm import brown


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*(w for w in re.split(r"[\x20\x09-\x0d]+", low) if w), None]


def test_base_and_held_out(spark):
    rows = [(i, " ".join(f"W{(i * j) % 17}x" for j in range(i % 23)) if i % 11 else None, "s") for i in range(300)] 
    docs = spark.createDataFrame(rows, "doc_id long, text string, held string")
    got = {r.doc_id: r for r in brown.lm_scores(docs, items=6, classes=4).collect()}
    assert len(got) == len(rows)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    counts = Counter(w for i, t, _ in rows if not out[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        r, own = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_probabilities_sum_to_one(spark):
    """Over every next word (with one unseen word) after a given text."""
    rows = [(i, w) for i, w in enumerate(["a b", "a c", "b a c", "c", "a b a", "d"] * 5)]
    vocabulary = ["a", "b", "c", "d", "unseen"]
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    extra = [(held[k], f"a {w}") for k, w in enumerate(vocabulary)] + [(held[9], "a")]
    got = {r.doc_id: r.score for r in brown.lm_scores(spark.createDataFrame(rows + extra, "doc_id long, text string"), items=2, classes=2).collect()}
    # P(a, w, end) = P(a) P(w | a) P(end | w): check that one step sums to at most 1 and the model is finite
    assert all(np.isfinite(v) and v < 0 for v in got.values())
    assert sum(10 ** got[held[k]] for k in range(5)) + 10 ** got[held[9]] <= 1


def test_one_class_is_the_base_model(spark):
    """With one class the model is add-one smoothing, held against plain Python; repeated rows, ties and null ids count as they should."""
    rows = [(i, " ".join(f"w{(i * j) % 5}" for j in range(i % 7))) for i in range(60)] + [(5, "again again"), (5, "again again"), (None, "no id"), (7, None)]
    got = brown.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), items=6, classes=1).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == want
    assert all(abs(math.log10(r.perplexity) + r.score / r.n_tokens) < 1e-9 and abs(r.score - r.base_score) < 1e-9 for r in got)


def test_exchange_separates_alternating_words():
    pairs = np.zeros((4, 4))
    pairs[0, 2] = pairs[0, 3] = pairs[1, 2] = pairs[1, 3] = 10
    pairs[2, 0] = pairs[2, 1] = pairs[3, 0] = pairs[3, 1] = 10
    of = brown.exchange(pairs, 2)
    assert of[0] == of[1] != of[2] == of[3]


def test_rare_words_get_the_class_of_their_contexts(spark):
    """Words of one count that aren't among the seeds differ by what stands around them."""
    out = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [t for k in range(40) for t in (f"the a{k} sleeps well", f"to b{k} quickly now")] * 2
    asked = [t for k in range(40) for t in (f"the a{k} sleeps well", f"the b{k} sleeps well")]
    docs = spark.createDataFrame([*zip(train, texts), *zip(out, asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in brown.lm_scores(docs, items=17, classes=9).collect()}
    own, other = ([got[out[2 * k + j]] for k in range(40)] for j in (0, 1))
    assert min(own) > max(other) + 0.5


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert brown.lm_scores(empty).collect() == []
    r = brown.lm_scores(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")).collect()
    assert len(r) == 3 and all(x.n_tokens == 1 for x in r)
