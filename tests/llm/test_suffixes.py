import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import suffixes
from graphloom.llm import textops as T


def passages(rows, length):
    texts = [[w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] for _, t in rows]
    count = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    return [sum(any(count[tuple(w[i : i + length])] > 1 for i in range(max(0, k - length + 1), min(k, len(w) - length) + 1)) for k in range(len(w))) for w in texts]


def brute(rows, length, words=0):
    covered = passages(rows, words) if words else [0] * len(rows)
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r, n in zip(rows, raws, covered):
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest(), n))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdéf \n") for _ in range(n))
    passages = [text(n) for n in (38, 40, 41, 55, 90, 200)]
    out = []
    for _ in range(80):
        t = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            t += rng.choice(passages) + text(rng.randrange(0, 60))
        out.append(t)
    base = text(300)
    for _ in range(40):
        b = list(base)
        for _ in range(rng.randrange(5)):
            b[rng.randrange(len(b))] = "#"
        out.append("".join(b))
    out += ["ab" * 100, "ab" * 61, "x" * 150, "x" * 39, base, base, None, ""]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (3, out[90]), (None, base)]


@pytest.mark.parametrize("seed,group", [(1, 1 << 15), (2, 1 << 15), (3, 3)])
def test_equals_brute_force(spark, seed, group):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_hash string").repartition(3)
    got = sorted((tuple(r) for r in suffixes.repeat_digest(docs, 40, 8, group, 9).collect()), key=str)
    assert got == brute(rows, 40, 9)


def test_long_text_in_pieces(spark, monkeypatch):
    """A text of many pieces is judged as a whole."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = text(300)
    rows = [(1, text(700) + shared + text(900) + shared[40:220]), (2, shared + text(40))]
    monkeypatch.setattr(suffixes, "PIECE", 128)
    data, offsets = T.text_bytes(pa.array([t for _, t in rows]))
    small = suffixes._sampled(data, offsets, 40, 8)
    monkeypatch.setattr(suffixes, "PIECE", 1 << 20)
    for a, b in zip(small, suffixes._sampled(data, offsets, 40, 8), strict=True):
        assert np.array_equal(a, b)


def test_whole_tables_at_the_contracts_length(spark):
    """sf0.01 at 400 bytes, with groups split at four occurrences as well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected = brute(rows, 400)
    for group in (1 << 15, 4):
        got = sorted((tuple(r) for r in suffixes.repeat_digest(docs, group=group, passage=0).collect()), key=str)
        assert got == expected


def test_empty(spark):
    assert suffixes.repeat_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
