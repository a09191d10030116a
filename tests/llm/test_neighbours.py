import numpy as np

from graphloom.llm import neighbours
from graphloom.runtime import table


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = neighbours.nearest(rows).collect()
    data = rows.toPandas()
    ids, x = data.vec_id.to_numpy(), np.array(data.embedding.tolist(), float)
    want = brute(ids, x)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    spot = {v: k for k, v in enumerate(ids)}
    hits = 0
    for q, near in want.items():
        own = sorted(by[q])
        assert [r for r, *_ in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(s == np.sqrt(((x[spot[v]] - x[spot[q]]) ** 2).sum()) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for v, _ in near})
    assert hits / (10 * len(want)) >= 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (100, [1.0, 0.0], "x"), (5, None, "x"), (6, [0.0, 0.0], "x"), (7, [1.0, None], "x"), (8, [nan, 1.0], "x"), (9, [inf, 1.0], "x"), (None, [1.0, 1.0], "x"), (3, [1.0, 2.0, 3.0], "x"), (2, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (200, [0.0, 0.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in neighbours.nearest(frame).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0)]
    assert neighbours.nearest(frame.limit(0)).collect() == []


def test_hot_vector_keeps_least_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(500, 0, -1)] + [(1000 + i, [float(i), 1.0, 0.0, 2.0]) for i in range(100)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11))


def test_repeated_ids_are_candidates(spark):
    """Every row but the query's own: two more rows of the query's id, one of them equal to it."""
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [3.0, 0.0]), (1, [0.0, 1.0])]
    got = sorted(tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(100, 1, 100, 0.0), (100, 2, 1, 2**0.5), (100, 3, 100, 2.0)]
    crowd = spark.createDataFrame([(100, [1.0, 0.0])] * 30 + [(k, [1.0, 0.0]) for k in range(200, 240)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(crowd).where("query_id = 100").collect()
    assert [r.vec_id for r in got] == [100] * 10
