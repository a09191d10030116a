"""Strong and biconnected components whose rounds don't follow the graph's depth, and the index of similarities."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clustering, connectivity
from graphloom.runtime import new_folder
from tests.graphs import SCAN_TWO, make, neighbours, pairs, random_edges


def closure(n, edges):
    near = neighbours(edges, True)
    ahead = {}
    for v in range(n):
        seen, work = {v}, [v]
        while work:
            for x in near.get(work.pop(), {}):
                if x not in seen:
                    seen.add(x)
                    work.append(x)
        ahead[v] = seen
    return ahead


@pytest.mark.parametrize("seed", [1])
def test_strong_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)} - {(k, k) for k in range(40)})
    ahead = closure(40, edges)
    want = {v: min(u for u in ahead[v] if v in ahead[u]) for v in range(40)}
    assert pairs(connectivity.strongly_connected(make(spark, edges, 40, True), seed)) == want


def test_phases_on_a_chain_of_two_cycles(spark):
    """Each pair is a component, and a colouring by least ids would find one of them a round."""
    n = 6
    edges = [e for k in range(n) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k))] + [(2 * k + 1, 2 * k + 2) for k in range(n - 1)]
    phases = []
    got = pairs(connectivity.strongly_connected(make(spark, edges, directed=True), phases=phases))
    assert got == {v: v - v % 2 for v in range(2 * n)}
    assert len(phases) <= math.ceil(math.log2(2 * n)) + 1


def test_list_ranks_double(spark):
    order = random.Random(4).sample(range(300), 300)
    lists = [order[:200], order[200:299], order[299:]]
    rows = [(a, b) for x in lists for a, b in zip(x, [*x[1:], None])]
    rounds = []
    got = pairs(connectivity.list_ranks(spark.createDataFrame(rows, "a long, next long"), rounds))
    assert got == {a: len(x) - 1 - k for x in lists for k, a in enumerate(x)}
    assert len(rounds) <= 9


def test_euler_tour_nests_subtrees(spark):
    rng = random.Random(6)
    tree = [(rng.randrange(v) if v != 30 else None, v) for v in range(1, 45)]
    tree = [(a if a is None or (a < 30) == (v < 30) else (30 if v > 30 else 0), v) for a, v in tree]
    tree = [(a, v) for a, v in tree if a is not None]
    label = spark.createDataFrame([(v, 0 if v < 30 else 30) for v in range(45)], "id long, label long")
    frame = spark.createDataFrame([(min(e), max(e)) for e in tree], "src long, dst long")
    tour = {r.id: r for r in connectivity.euler_tour(frame, label).collect()}
    assert {v: r.parent for v, r in tour.items()} == {v: a for a, v in tree} | {0: 0, 30: 30}
    below = {v: {v} for v in range(45)}
    for a, v in reversed(tree):
        below[a] |= below[v]
    for v, x in itertools.product(range(45), repeat=2):
        if tour[v].root == tour[x].root:
            assert (tour[v].first <= tour[x].first <= tour[v].last) == (x in below[v])
    own = spark.createDataFrame([(v, 1000 - v * v % 97, v * v % 89) for v in range(45)], "id long, low long, high long")
    got = {r.id: (r.low, r.high) for r in connectivity.subtree_extremes(spark.createDataFrame([tuple(r) for r in tour.values()], "id long, parent long, root long, first long, last long"), own).collect()}
    assert got == {v: (min(1000 - x * x % 97 for x in below[v]), max(x * x % 89 for x in below[v])) for v in range(45)}


def test_biconnected_rounds_on_a_path(spark):
    """A path of 100 vertices and a cycle at its end."""
    edges = [(k, k + 1) for k in range(100)] + [(90, 100)]
    rounds = []
    got = {(r.src, r.dst): (r.first_src, r.first_dst) for r in connectivity.biconnected(make(spark, edges), rounds).collect()}
    assert got == {e: (90, 91) if e[0] >= 90 else e for e in edges}
    assert len(rounds) <= math.ceil(math.log2(200)) + 1


@pytest.mark.parametrize("edges", [SCAN_TWO, random_edges(30, 90, 3)])
def test_index_answers_every_setting(spark, edges):
    g = make(spark, edges)
    sims = clustering.similarities(g)
    index = clustering.ScanIndex.build(g, sims, new_folder(spark, "test-index"))
    again = clustering.ScanIndex(spark, index.folder)  # by another session, from the folder alone
    for mu, eps in [(1, 0.5), (3, 0.6), (4, 0.35), (3, 0.0)]:
        assert pairs(again.scan(mu, eps)) == pairs(clustering.scan(g, sims, mu, eps)), (mu, eps)
    order = index.spark.read.parquet(f"{index.folder}/neighbours").orderBy("src", "rank").collect()
    for src, rows in itertools.groupby(order, key=lambda r: r.src):
        rows = list(rows)
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(-r.sim, r.dst) for r in rows] == sorted((-r.sim, r.dst) for r in rows)


def test_index_reads_partitions_of_its_prefix(spark):
    g = make(spark, random_edges(30, 90, 3))
    index = clustering.ScanIndex.build(g, clustering.similarities(g), new_folder(spark, "test-index"))
    near = index.near(0.6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in near and ">= 12)" in near
    core = index.cores(3, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "(power" in core and "= 1)" in core and ">= 12)" in core
    assert index.near(0.6).where(F.col("sim") < 0.6).isEmpty()


def test_part_pairs_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    """Ten times the lines are dealt to ten times the tasks, with the same counts as a plain loop's."""
    from collections import Counter
    from itertools import combinations

    from graphloom.sources import graphs

    monkeypatch.setattr(graphs, "LINES", 20)
    for orders in (100, 1000):
        lines = [(o, (o * k * 7 + k) % 23) for o in range(orders) for k in range(1 + o % 5)]
        found = graphs.part_pairs(spark.createDataFrame(lines, "l_orderkey long, l_partkey long"))
        assert found.rdd.getNumPartitions() >= len(lines) // 20
        baskets = {}
        for o, p in lines:
            baskets.setdefault(o, set()).add(p)
        want = Counter(e for own in baskets.values() for e in combinations(sorted(own), 2))
        assert {(r.src, r.dst): r.w for r in found.collect()} == {e: n for e, n in want.items() if n >= 2}


def test_decomposition_appends_its_state(spark, monkeypatch):
    """Whatever the number of rounds is, no round writes the state whole."""
    from graphloom.graph import Graph
    from graphloom.operators import paths

    written, whole = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, name: written.append(name) or whole(df, name))
    g = Graph.from_edges(spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")).store()
    found = paths.low_diameter_decomposition(g, 0.6).collect()
    assert sorted(r.id for r in found) == list(range(13)) and len(written) == 1
    cluster = {r.id: r.cluster for r in found}
    assert all(r.parent == r.id == r.cluster or abs(r.parent - r.id) == 1 and cluster[r.parent] == r.cluster for r in found)
