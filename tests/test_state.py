import random

import pytest
from pyspark.sql import functions as F

from graphloom import state as S
from graphloom.graph import Graph
from graphloom.operators import paths, patterns, primitives
from tests.graphs import make, pairs, random_edges


@pytest.fixture
def shuffled(spark):
    """No broadcast joins, as with tables that are large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_round_moves_no_edge(shuffled):
    g = make(shuffled, random_edges(60, 200, 1))
    log = S.StateLog(paths.seeds(g, 0, 0).withColumn("dist", F.lit(0)), "t")
    step = S.frontier_edges(g.edges, log.last(), "dist")
    assert "Exchange" not in plan(step) and "Bucketed: true" in plan(step)
    log.append(step.select(F.col("dst").alias("id"), F.lit(1).alias("dist")).distinct())
    assert "Exchange" not in plan(log.current())
    offers = S.frontier_edges(g.edges, log.last(), "dist").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
    rounds = plan(paths._improved(offers, log.current(), F.col("new") < F.col("dist")))
    assert rounds.count("Exchange hashpartitioning") == 1  # of the offers alone
    assert "Exchange" not in plan(g.edges.groupBy("src").count())


def test_edges_are_bucketed_once_for_a_loop(spark):
    g = make(spark, random_edges(30, 60, 2))
    assert S.keyed(g.edges, "src", "e") == (g.edges, False)
    edges, own = S.keyed(g.edges.where("src > 3"), "src", "e")
    assert own and sorted(map(tuple, edges.collect())) == sorted(map(tuple, g.edges.where("src > 3").collect()))


def test_log_keeps_each_last_row_through_compaction(spark):
    rng, want = random.Random(5), {}
    log = None
    for k in range(15):
        rows = {rng.randrange(40): (k, None if rng.random() < 0.2 else rng.random()) for _ in range(rng.randrange(0, 6))}
        frame = spark.createDataFrame([(i, *v) for i, v in rows.items()], "id long, a long, b double")
        if log is None:
            log = S.StateLog(frame, "t")
        else:
            assert log.append(frame) == len(rows)
        assert {r.id: (r.a, r.b) for r in log.last().collect()} == rows
        want |= rows
        if k % 7 == 0:
            assert {r.id: (r.a, r.b) for r in log.current().collect()} == want, k
    assert {r.id: (r.a, r.b) for r in log.close().collect()} == want


def test_buckets_come_in_order_beyond_the_window(spark, monkeypatch):
    monkeypatch.setattr(S.PriorityBuckets, "WINDOW", 4)
    rng = random.Random(3)
    b, waiting = S.PriorityBuckets(spark, "t"), set()

    def add(rows):
        b.add(spark.createDataFrame([*rows, (99, None)], "id long, bucket long"))
        waiting.update(rows)

    assert b.pop() is None
    add([(k, rng.choice([3, 5, 20, 60])) for k in range(30)])
    for k in range(12):
        taken = b.pop()
        if taken is None:
            break
        least = min(x for _, x in waiting)
        assert taken[0] == least and {r.id for r in taken[1].collect()} == {i for i, x in waiting if x == least}
        waiting.difference_update([r for r in waiting if r[1] == least])
        if k < 3:
            add([(100 + 10 * k + j, least + rng.choice([0, 1, 7, 30])) for j in range(4)])
    assert not waiting and b.pop() is None
    b.close()


def test_moves_alone_are_written(spark, monkeypatch):
    written = []
    append = S.StateLog.append
    monkeypatch.setattr(S.StateLog, "append", lambda self, rows: written.append(append(self, rows)) or written[-1])
    g = make(spark, [(i, i + 1) for i in range(9)])
    assert pairs(paths.bfs_distance(g, 0)) == {i: i for i in range(10)}
    assert sum(written) == 10
    written.clear()
    assert pairs(paths.sssp(g, 0, delta=4)) == {i: i for i in range(10)}
    assert sum(written) == 10
    written.clear()
    found = {r.id: r.core for r in patterns.degeneracy_order(g).collect()}
    assert found == dict.fromkeys(range(10), 1)
    assert sum(written) <= 10 * 3  # a start, at most one move of each before it leaves, and its leaving


def test_balanced_loads_equal_plain_python(spark):
    edges = random_edges(25, 60, 4)
    g = make(spark, edges, 27)
    load = {v: 6 * c for v, c in pairs(patterns.core_numbers(g)).items()}
    for _ in range(6):
        new = dict(load)
        for a, b, _ in edges:
            for x, y in ((a, b), (b, a)):
                new[x] += 2 if load[x] < load[y] else load[x] == load[y]
        load = new
    assert pairs(patterns.balanced_loads(g, 6)) == load
    order = sorted(load, key=lambda v: (-load[v], v))
    best = max(sum(a in top and b in top for a, b, _ in edges) / len(top) for k in range(1, 28) for top in [set(order[:k])])
    assert patterns.densest_greedy_plus(g, 6).first().density == pytest.approx(best)
    empty = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert patterns.densest_greedy_plus(empty, 2).first().density == 0.0


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(9), 1) for k in rng.sample(range(-500, 500), 200)]
    got = sorted(map(tuple, primitives.prefix_sums(spark.createDataFrame(rows, "key long, n long, m long").repartition(7), "n", "m").collect()))
    assert got == [(k, sum(n for j, n, _ in rows if j <= k), sum(j <= k for j, *_ in rows)) for k in sorted(j for j, *_ in rows)]
