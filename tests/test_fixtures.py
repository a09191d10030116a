"""Answers of small graphs, by hand."""

import math

import pytest

from graphloom.operators import clustering, connectivity, covering, paths, patterns, ranking
from tests.graphs import CLIQUES, SCAN_SIX, SCAN_TWO, SEVEN, TEN, make, pairs


def test_breadth_first(spark):
    g = make(spark, SEVEN, 7)
    assert pairs(paths.bfs(g, 1)) == {0: 1, 1: 1}
    assert pairs(paths.bfs(g, 2)) == {2: 2, 3: 2, 4: 3, 5: 3, 6: 5}
    assert pairs(paths.bfs_distance(make(spark, [], 3), 1)) == {1: 0}


def test_components_and_cores(spark):
    eight = make(spark, SEVEN, 8)
    assert pairs(connectivity.components(eight)) == {0: 0, 1: 0, **dict.fromkeys(range(2, 7), 2), 7: 7}
    assert pairs(patterns.core_numbers(eight)) == dict(enumerate([1, 1, 1, 2, 2, 2, 1, 0]))
    assert {r.id: r.core for r in patterns.degeneracy_order(eight).collect()} == dict(enumerate([1, 1, 1, 2, 2, 2, 1, 0]))
    assert {r.id for r in covering.independent_set(eight).collect()} == {0, 2, 4, 6, 7}
    assert pairs(connectivity.components(make(spark, [], 3))) == {0: 0, 1: 1, 2: 2}
    assert pairs(patterns.core_numbers(make(spark, [], 3))) == {0: 0, 1: 0, 2: 0}


@pytest.mark.parametrize(
    "edges,n,options,want",
    [
        (SEVEN, 7, {}, [0.1428571429, 0.1428571429, 0.0802049539, 0.2074472351, 0.1389813363, 0.2074472351, 0.0802049539]),
        (SEVEN, 7, {"sources": [0, 4]}, [0.2702716450, 0.2297283550, 0.0384308511, 0.1356382979, 0.1518617021, 0.1356382979, 0.0384308511]),
        ([(0, 1), (1, 2)], 4, {"max_iters": 0}, [0.25] * 4),
        ([(0, 1), (1, 2)], 3, {}, [0.2567570878, 0.4864858243, 0.2567570878]),
        ([], 2, {"sources": [0]}, [1, 0]),
        ([(0, 1), (1, 2), (2, 3)], 4, {"sources": [0]}, [0.3022241274, 0.3581756964, 0.2383155317, 0.1012846445]),
    ],
)
def test_pagerank(spark, edges, n, options, want):
    got = pairs(ranking.pagerank(make(spark, edges, n), **options))
    assert all(abs(got[k] - x) < 1e-4 for k, x in enumerate(want))


def test_weighted_pagerank(spark):
    got = pairs(ranking.pagerank(make(spark, [(0, 1, 1), (1, 3, 3), (1, 4, 5), (2, 1, 2), (3, 1, 4)], 5, True), weighted=True))
    assert all(abs(got[k] - x / 30348) < 1e-4 for k, x in enumerate([2333, 11360, 2333, 5954, 8368]))
    got = pairs(ranking.pagerank(make(spark, [(0, 1, 2), (0, 3, 1), (1, 2, 1), (2, 1, 0), (2, 3, 0)], 4, True), weighted=True))
    assert all(abs(got[k] - x / 3709) < 1e-4 for k, x in enumerate([600, 940, 1399, 770]))


def test_bad_parameters(spark):
    g = make(spark, [(0, 1)], 2)
    for bad in ({"eps": -1.0}, {"damping": -0.1}, {"damping": 1.0}, {"damping": 1.5}):
        with pytest.raises(ValueError):
            ranking.pagerank(g, **bad)
    with pytest.raises(paths.NegativeCycleError):
        paths.sssp(make(spark, [(0, 1, -2), (1, 0, 1)], 2, True), 0)


def test_cosimrank_of_itself(spark):
    g = make(spark, [(0, 1), (1, 2)], 3)
    # walks from 0: 1; {0, 2}; 1
    assert abs(ranking.cosimrank(g, 0, 0, 0.5, 3).first()[0] - (1 + 0.5 + 0.25 * 0.5 + 0.125)) < 1e-9


def test_similarity_and_scan(spark):
    g = make(spark, SCAN_SIX, 6)
    cosine = {(r.src, r.dst): r.sim for r in clustering.similarities(g).collect()}
    want = {(0, 1): 2 / math.sqrt(8), (1, 2): 3 / math.sqrt(20), (1, 3): 3 / 4, (2, 3): 4 / math.sqrt(20), (2, 4): 3 / math.sqrt(15), (2, 5): 2 / math.sqrt(10), (3, 4): 3 / math.sqrt(12)}
    assert all(abs(cosine[a, b] - x) < 1e-9 and abs(cosine[b, a] - x) < 1e-9 for (a, b), x in want.items())
    jaccard = {(r.src, r.dst): r.sim for r in clustering.similarities(g, "jaccard").collect()}
    assert [round(jaccard[e], 9) for e in sorted(want)] == [0.5, 0.5, 0.6, 0.8, 0.6, 0.4, 0.75]
    sims = clustering.similarities(g)
    for mu, eps, members in ((2, 0.5, {0, 1, 2, 3, 4, 5}), (2, 0.7, {0, 1, 2, 3, 4}), (2, 0.73, {1, 2, 3, 4}), (2, 0.95, set()), (4, 0.7, {1, 2, 3, 4})):
        assert {k for k, c in pairs(clustering.scan(g, sims, mu, eps)).items() if c is not None} == members


def test_hub_between_two_clusters(spark):
    g = make(spark, SCAN_TWO, 9)
    found = clustering.scan(g, clustering.similarities(g), 2, 0.73)
    assert pairs(found) == {0: None, 1: 1, 2: 1, 3: 1, 4: None, 5: 5, 6: 5, 7: 5, 8: None}
    assert {k for k, r in pairs(clustering.roles(g, found)).items() if r == "hub"} == {4}


def test_modularity(spark):
    g = make(spark, TEN, 10)
    q = lambda of: clustering.modularity(g, spark.createDataFrame(list(enumerate(of)), "id long, cluster long")).first()[0]
    assert abs(q([0, 0, 0, 0, 1, 1, 1, 2, 2, 2]) - 0.48958333) < 1e-6
    assert abs(q([0, 0, 0, None, 1, None, None, 2, 2, 2]) - 0.28472222) < 1e-6
    empty = make(spark, [], 3)
    assert clustering.modularity(empty, empty.vertices.selectExpr("id", "id as cluster")).first()[0] == 0


def test_cliques(spark):
    g = make(spark, CLIQUES, 11)
    assert patterns.count_cliques(g, 3).first()[0] == 13
    assert patterns.count_cliques(g, 4).first()[0] == 5
    assert patterns.count_cliques(make(spark, [], 10), 4).first()[0] == 0
    assert {k: c for k, c in pairs(patterns.clique_cores(g, 3)).items() if c >= 6} == dict.fromkeys(range(5), 6)
    assert abs(patterns.densest_greedy(g).first()[0] - 2.0) < 1e-9


def test_weights_of_parallel_edges(spark):
    from graphloom.graph import Graph

    rows = spark.createDataFrame([(0, 1, 5), (1, 0, 3), (2, 2, 1), (4, 3, 2)], "src long, dst long, w long")
    g = Graph.from_edges(rows, dense=True)
    assert sorted(map(tuple, g.und().collect())) == [(0, 1, 3), (3, 4, 2)]
    assert g.vertices.count() == 5
