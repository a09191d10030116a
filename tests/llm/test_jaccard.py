import random
import re

import pytest

from graphloom.llm import jaccard


def brute(rows):
    def grams(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", low) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: rows[i][0])
    for i in order:
        for j in order:
            if rows[i][0] <= rows[j][0] and i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    lo, hi = sorted((a, b), key=lambda k: rows[k][0])
                    root[hi] = lo
    return sorted(((rows[i][0], len(sets[i]), None if rows[i][0] is None else rows[find(i)][0]) for i in range(len(rows))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstu")
    text = lambda n: [word() for _ in range(n)]
    base = [text(rng.choice([3, 5, 9, 40, 120])) for _ in range(60)]
    passage = text(30)
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.choice([0, 0, 1, 4])):
            c = list(b)
            for _ in range(rng.choice([0, 1, 2, 4])):
                c[rng.randrange(len(c))] = word()
            out.append(c)
    out += [passage + text(rng.choice([2, 5, 8, 20])) for _ in range(60)]
    centre = text(60)
    for _ in range(150):
        c = list(centre)
        for _ in range(rng.choice([1, 2, 3])):
            c[rng.randrange(len(c))] = word()
        out.append(c)
    rng.shuffle(out)
    rows = [(k * 3 + 1, " ".join(w).title() if k % 4 else "\n".join(w)) for k, w in enumerate(out)]
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (1, rows[0][1])]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "OUTSIDERS", max(4, block // 4))
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, id long").repartition(3)
    got = sorted((tuple(r) for r in jaccard.shingle_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert jaccard.shingle_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
