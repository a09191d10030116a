"""Seeded random graphs against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clustering, connectivity, covering, paths, patterns, primitives
from tests.graphs import dijkstra, make, neighbours, pairs, random_edges, reach

N, EDGES = 40, random_edges(40, 60, 5)


@pytest.fixture(scope="module")
def graph(spark):
    return make(spark, EDGES, N)


def test_distances(graph, spark):
    assert pairs(paths.sssp(graph, 0)) == dijkstra(EDGES, [0])
    assert pairs(paths.sssp(graph, [1, 2], delta=3)) == dijkstra(EDGES, [1, 2])
    assert pairs(paths.bfs_distance(graph, 3)) == dijkstra([(a, b) for a, b, _ in EDGES], [3])
    state = paths.DynamicPaths(graph, 0)
    state.insert(spark.createDataFrame([(0, 30, 1)], "src long, dst long, w long"))
    assert pairs(state.state) == dijkstra([e for e in EDGES if (e[0], e[1]) != (0, 30)] + [(0, 30, 1)], [0])


def test_widest_path(graph):
    near, want = neighbours(EDGES), {0: (1 << 31) - 1}
    for _ in range(N):
        for v, width in list(want.items()):
            for u, w in near.get(v, {}).items():
                want[u] = max(want.get(u, 0), min(width, w))
    assert pairs(paths.widest_path(graph, 0)) == want


def test_forests(graph):
    forest = connectivity.spanning_forest(graph)
    assert connectivity.is_spanning_forest(graph, forest)
    tree, root = 0, list(range(N))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, w in sorted(EDGES, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree += w
    found = connectivity.minimum_spanning_forest(graph)
    assert connectivity.is_spanning_forest(graph, found.select("src", "dst"))
    assert sum(r.w for r in found.collect()) == tree


def test_strongly_connected(spark):
    edges = [(a, b) for a, b, _ in random_edges(30, 50, 8)] + [(b, a) for a, b, _ in random_edges(30, 20, 9)]
    near = neighbours(edges, True)
    ahead = {v: reach(near, v) for v in range(30)}
    want = {v: min(u for u in range(30) if u in ahead[v] and v in ahead[u]) for v in range(30)}
    assert pairs(connectivity.strongly_connected(make(spark, edges, 30, True))) == want


def test_biconnected(graph):
    near, und = neighbours(EDGES), [(a, b) for a, b, _ in EDGES]
    root = {e: e for e in und}

    def find(e):
        while root[e] != e:
            e = root[e]
        return e

    for v in range(N):  # two edges at v are of one part if their other ends meet without v
        for a, b in itertools.combinations(near.get(v, {}), 2):
            if b in reach(near, a, v):
                x, y = find((min(v, a), max(v, a))), find((min(v, b), max(v, b)))
                root[max(x, y)] = min(x, y)
    got = connectivity.biconnected(graph)
    assert {(r.src, r.dst): (r.first_src, r.first_dst) for r in got.collect()} == {e: find(e) for e in und}
    cut = {v for v in range(N) if any(b not in reach(near, a, v) for a, b in itertools.combinations(near.get(v, {}), 2))}
    assert {r.id for r in connectivity.articulation_points(got).collect()} == cut


def test_incremental_components(graph, spark):
    state = connectivity.IncrementalComponents(graph.vertices)
    rows = [(a, b, "insert") for a, b, _ in EDGES[:30]] + [(0, 1, "query"), (2, 3, "query")]
    got = {(r.u, r.v): r.connected for r in state.process(spark.createDataFrame(rows, "u long, v long, op string")).collect()}
    near = neighbours(EDGES[:30])
    assert got == {(0, 1): 1 in reach(near, 0), (2, 3): 3 in reach(near, 2)}


def test_covers(graph):
    near = neighbours(EDGES)
    for order in ("id", "hash"):
        assert covering.is_maximal_independent(graph, covering.independent_set(graph, order))
    matching = covering.maximal_matching(graph)
    assert covering.is_maximal_matching(graph, matching)
    for order in ("id", "degree"):
        colours = covering.colouring(graph, order)
        assert covering.colour_conflicts(graph, colours).first()[0] == 0
        assert all(c <= len(near.get(v, {})) for v, c in pairs(colours).items())
    chosen = {r.id for r in covering.set_cover(graph, 0.2).collect()}
    assert all(any(u in chosen for u in near[v]) for v in near)
    local = {r.id: r.status for r in covering.local_status(graph, graph.vertices.where("id < 5").select("id")).collect()}
    first = {r.id for r in covering.independent_set(graph, "hash").collect()}
    assert local == {v: "in" if v in first else "out" for v in range(5)}


def test_counts(graph):
    near = neighbours(EDGES)
    three = sum(b in near[a] and c in near[a] and c in near[b] for a, b, c in itertools.combinations(sorted(near), 3))
    assert patterns.count_cliques(graph, 3).first()[0] == three
    for k in (2, 4, 5):
        assert patterns.count_cliques(graph, k).first()[0] == patterns.cliques(graph, k).count()

    def cycles(path):
        if len(path) == 5:
            return int(path[0] in near[path[-1]])
        return sum(cycles([*path, u]) for u in near[path[-1]] if u > path[0] and u not in path)

    assert patterns.five_cycles(graph).first()[0] == sum(cycles([v]) for v in near) // 2


def test_centres(graph):
    got = clustering.k_centres(graph, 3).collect()
    chosen = [got[0].id]
    for r in got[1:]:
        dist = dijkstra(EDGES, chosen)
        far = min(range(N), key=lambda v: (v in dist, -dist.get(v, 0), v))
        assert r.id == far
        chosen.append(far)
    dist = dijkstra(EDGES, chosen)
    assert tuple(clustering.centre_quality(graph, chosen).first()) == (max(dist.values()), N - len(dist))


def test_candidates_apart(graph):
    for step, radius in ((3, 4), (2, 0), (N, 5)):
        chosen = [v for v in range(0, N, step)]
        want = {v for v in chosen if not any(0 <= dijkstra(EDGES, [u]).get(v, radius + 1) <= radius for u in chosen if u != v)}
        assert {r.id for r in clustering.apart(graph, graph.vertices.where(F.col("id") % step == 0), radius).collect()} == want
    assert clustering.apart(graph, graph.vertices.where("id < 0"), 3).isEmpty()


def test_cover_by_samples_on_a_path(spark):
    """Some 13 centres would take as many relaxations one by one."""
    path = make(spark, [(k, k + 1) for k in range(29)])
    runs = []
    centres = clustering._cover_within(path, 1, 20, 0, True, runs)
    assert len(centres) >= 10 and len(runs) <= 10 and all(abs(a - b) > 1 for a in centres for b in centres if a != b)
    assert all(any(abs(v - c) <= 1 for c in centres) for v in range(30))
    assert clustering._cover_within(path, 1, 2, 0, True) is None


@pytest.mark.parametrize("directed", [False, True])
def test_held_distances_on_long_paths(spark, directed):
    """A relaxation of the whole path would take 16 rounds; without its paths the graph has next to no edges."""
    edges = [(k, k + 1, k % 3) for k in range(16)] + [(8, 20, 2), (20, 21, 1), (21, 8, 5), (12, 4, 4), (22, 23, 3)]
    path = make(spark, edges, 25, directed)
    held = paths.HeldDistances(path)
    some = [3, 9, 21, 22]
    assert held.apart(some, 8) == [v for v in some if not any(0 <= dijkstra(edges, [u], directed).get(v, 9) <= 8 for u in some if u != v)]
    assert len(held.levels) <= 8 and held.core.edges.count() <= 6
    for sources, radius in (([3], 9), ([3, 21], 5), ([22], 100)):
        near = dijkstra(edges, sources, directed)
        assert {r.id for r in held.beyond(sources, radius).collect()} == {v for v in range(25) if near.get(v, radius + 1) > radius}
    assert held.runs == 1


def test_components_from_samples(spark, graph):
    want = pairs(connectivity.components(graph))
    for algorithm in ("bfs", "ldd"):
        assert pairs(connectivity.components(graph, algorithm)) == want
        split = make(spark, [(0, 1), (2, 3), (3, 4), (9, 7)], 11, directed=True)
        assert pairs(connectivity.components(split, algorithm)) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 7: 7, 9: 7, 5: 5, 6: 6, 8: 8, 10: 10}
        assert pairs(connectivity.components(make(spark, [(0, 1)]).filter_edges(lambda a, b, w: a == b), algorithm)) == {0: 0, 1: 1}


@pytest.mark.parametrize("measure", ["jaccard", "cosine"])
def test_low_degrees_have_exact_similarities(graph, measure):
    table = lambda rows: {(r.src, r.dst): round(r.sim, 9) for r in rows.collect()}
    exact, rough = table(clustering.similarities(graph, measure)), table(clustering.approximate_similarities(graph, measure))
    degree = {v: len(x) for v, x in neighbours(EDGES).items()}
    most = sorted(degree.values())[len(degree) // 2]
    got = table(clustering.approximate_similarities(graph, measure, threshold=most))
    assert got == {(a, b): (exact if min(degree[a], degree[b]) < most else rough)[a, b] for a, b in exact}
    assert table(clustering.approximate_similarities(graph, measure, threshold=10**6)) == exact


def test_decomposition_and_spanner(graph):
    part = paths.low_diameter_decomposition(graph, 0.8)
    rows = part.collect()
    near = neighbours(EDGES)
    assert sorted(r.id for r in rows) == list(range(N))
    of = {r.id: r.cluster for r in rows}
    assert all(r.id == r.cluster if r.id == r.parent else r.parent in near[r.id] and of[r.parent] == of[r.id] for r in rows)
    kept = paths.spanner(graph, 2)
    assert kept.join(graph.und(), ["src", "dst"], "left_anti").isEmpty()
    thin = neighbours([tuple(r) for r in kept.collect()])
    assert all(reach(thin, v) == reach(near, v) for v in range(0, N, 7))


def test_orders(graph):
    ranks = pairs(primitives.random_order(graph, 3))
    assert sorted(ranks.values()) == list(range(N))
    degree = pairs(graph.degrees())
    assert pairs(primitives.degree_order(graph)) == {v: k for k, v in enumerate(sorted(range(N), key=lambda v: (degree[v], v)))}
