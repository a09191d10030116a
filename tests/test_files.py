import struct

import pytest

from graphloom.operators import connectivity
from graphloom.sources import files, generators
from graphloom.streaming import incremental
from tests.graphs import make

BROKEN = [(k, k + 1) for k in range(10) if k not in (1, 2)] + [(0, 10), (1, 10)]


def edges(graph):
    return sorted(map(tuple, graph.edges.select("src", "dst", "w").collect()))


def test_edge_list(spark, tmp_path):
    (tmp_path / "list").write_text("# a comment\n0 1\n0 1\n\n3 2 \n2 2\n")
    g = files.read_edge_list(spark, str(tmp_path / "list"), directed=True)
    assert edges(g) == [(0, 1, 1), (3, 2, 1)] and g.vertices.count() == 4
    (tmp_path / "weights").write_text("5 1 2.5\n1 5 1.5\n")
    assert edges(files.read_edge_list(spark, str(tmp_path / "weights"), weighted=True)) == [(1, 5, 1.5), (5, 1, 1.5)]
    files.write_edge_list(g, str(tmp_path / "out"))
    assert edges(files.read_edge_list(spark, str(tmp_path / "out"), directed=True)) == edges(g)


@pytest.mark.parametrize("weighted", [False, True])
def test_adjacency(spark, tmp_path, weighted):
    g = make(spark, [(a, b, a + b + 1 if weighted else 1) for a, b in BROKEN], 11)
    files.write_adjacency(g, str(tmp_path / "adj"), weighted)
    lines = [x for p in sorted((tmp_path / "adj").glob("part-*")) for x in p.read_text().split()]
    assert lines[:3] == ["WeightedAdjacencyGraph" if weighted else "AdjacencyGraph", "11", str(2 * len(BROKEN))]
    back = files.read_adjacency(spark, str(tmp_path / "adj"))
    assert edges(back) == edges(g) and back.vertices.count() == 11
    assert [d for _, d in sorted(map(tuple, back.degrees().collect()))] == [2, 2, 0, 1, 2, 2, 2, 2, 2, 2, 3]
    (tmp_path / "one").write_text(" ".join(lines))
    assert edges(files.read_adjacency(spark, str(tmp_path / "one"))) == edges(g)


def test_binary_and_parquet(spark, tmp_path):
    (tmp_path / "bin").write_bytes(struct.pack("<3q", 3, 3, 0) + struct.pack("<4q", 0, 2, 2, 3) + struct.pack("<3I", 1, 2, 0))
    g = files.read_binary(spark, str(tmp_path / "bin"), directed=True)
    assert edges(g) == [(0, 1, 1), (0, 2, 1), (2, 0, 1)] and g.vertices.count() == 3
    files.write_parquet(g, str(tmp_path / "pq"))
    assert edges(files.read_parquet(spark, str(tmp_path / "pq"), True)) == edges(g)


@pytest.mark.parametrize("span", [1, 2, 7, 1000])
def test_binary_in_spans(spark, tmp_path, span):
    """A hub over several spans, vertices without edges at the start, between and at the end."""
    near = {2: [(5, -3), (6, 4)], 3: [(k, k) for k in range(20)], 9: [(1, 7)]}
    rows = [(a, b, w) for a, found in near.items() for b, w in found]
    offsets = [sum(len(near.get(u, [])) for u in range(v)) for v in range(13)]
    raw = struct.pack("<3q", 12, len(rows), 0) + struct.pack("<13q", *offsets) + b"".join(struct.pack("<Ii", b, w) for _, b, w in rows)
    (tmp_path / "bin").write_bytes(raw)
    g = files.read_binary(spark, str(tmp_path / "bin"), directed=True, weighted=True, span=span)
    assert edges(g) == sorted(rows) and g.vertices.count() == 12
    (tmp_path / "none").write_bytes(struct.pack("<4q", 0, 0, 0, 0))
    assert files.read_binary(spark, str(tmp_path / "none")).vertices.count() == 0


def test_binary_skips_blocks_of_lone_vertices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 4)
    g = make(spark, [(0, 1), (0, 2), (25, 26), (25, 27), (1, 30)], 40)
    files.write_binary(g, str(tmp_path / "rows"))
    raw = struct.pack("<3q", 40, 10, 0) + struct.pack("<41q", *[sum(1 for a, _, _ in edges(g) if a < v) for v in range(41)]) + b"".join(struct.pack("<I", b) for _, b, _ in edges(g))
    (tmp_path / "one").write_bytes(raw)
    for place in ("rows", "one"):
        assert edges(files.read_binary(spark, str(tmp_path / place), span=3)) == edges(g)


def test_weight_sample(spark):
    g = make(spark, [(0, k, k) for k in range(1, 40)])
    sample = files.weight_sample(g, 10).collect()
    assert sample == files.weight_sample(g, 10).collect() and len(sample) == 10
    got = {r.part: r for r in files.weight_summary(g, 10).collect()}
    assert (got["all"].n, got["all"].least, got["all"].greatest, got["all"].mean) == (78, 1, 39, 20.0)
    assert got["sample"].least == min(r.w for r in sample) and got["sample"].n == 10
    assert files.weight_sample(g, 1000).count() == 78


def test_parts_of_vertices_as_a_file(spark, tmp_path):
    g = make(spark, BROKEN, 11)
    parts = connectivity.biconnected(g)
    rows = connectivity.vertex_parts(g, parts)
    files.write_parts(rows, str(tmp_path / "parts"))
    back = {tuple(r) for r in files.read_parts(spark, str(tmp_path / "parts")).collect()}
    assert back == {tuple(r) for r in rows.collect()}
    of = {(r.src, r.dst): (r.first_src, r.first_dst) for r in parts.collect()}
    assert {(0, None, None, None), (2, None, None, None)} <= back and len(back) == 11
    assert all(of[min(v, p), max(v, p)] == (a, b) for v, p, a, b in back if p is not None)


def test_cleaning(spark):
    g = files.cleaned(make(spark, [(3, 7, 4), (7, 9, 2)], 12))
    assert edges(g) == [(0, 1, 4), (1, 0, 4), (1, 2, 2), (2, 1, 2)]


def test_generators(spark):
    g = generators.barabasi_albert(spark, 60, 2)
    assert g.vertices.count() == 60 and all(r.src > r.dst for r in g.edges.where("src > dst").collect())
    assert generators.rmat(spark, 5, 100).vertices.count() == 32
    weights = generators.erdos_renyi(spark, 50, 100, 7).edges
    assert weights.where("w < 1 or w > 7").isEmpty()
    assert weights.alias("a").join(weights.alias("b"), "src").count() > 0


def test_rmat_makes_its_edges_once(spark):
    """Neither direction of the edges holds a hash to evaluate, and they are those of a plain loop."""
    import hashlib

    g = generators.rmat(spark, 4, 40)
    assert "md5" not in g.edges._jdf.queryExecution().toString()
    made = set()
    for k in range(40):
        x = y = 0
        for level in range(1, 5):
            u = int(hashlib.md5(f"{k}|{level}|0".encode()).hexdigest()[:15], 16) % (1 << 30) / (1 << 30)
            x, y = 2 * x + (u >= 0.6), 2 * y + (0.5 <= u < 0.6 or u >= 0.5 + 0.1 + 0.1)
        made |= {(x, y), (y, x)} if x != y else set()
    assert {(r.src, r.dst) for r in g.edges.collect()} == made


def test_transit_and_roads(spark):
    stops = spark.createDataFrame([("t", 1, 10, "08:00:00", "08:01:00"), ("t", 2, 11, "08:05:30", "08:06:00"), ("t", 3, 12, "25:00:00", "25:00:00"), ("u", 1, 10, "9:00:00", "9:00:00"), ("u", 2, 11, "9:03:00", "9:03:00")], "trip_id string, stop_sequence int, stop_id long, arrival_time string, departure_time string")
    assert sorted(map(tuple, generators.transit_edges(stops).collect())) == [(10, 11, 180), (11, 12, 25 * 3600 - (8 * 3600 + 6 * 60))]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, [1, 2], None), (2, [2, 3], "yes")], "way_id long, nodes array<long>, oneway string")
    got = {(r.src, r.dst): r.w for r in generators.road_edges(nodes, ways).collect()}
    assert set(got) == {(1, 2), (2, 1), (2, 3)} and abs(got[1, 2] - 111195) <= 1


def test_streams(spark, tmp_path):
    g = make(spark, [(0, 1), (2, 3)], 5)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(0, 1, "insert"), (1, 2, "insert"), (0, 2, "query"), (0, 3, "query")], "u long, v long, op string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    answers = []
    updates = spark.readStream.schema("u long, v long, op string").json(str(tmp_path / "in"))
    stream, state = incremental.stream_components(updates, g.vertices, lambda k, q: answers.extend(map(tuple, q.collect())), str(tmp_path / "c"))
    stream.processAllAvailable()
    stream.stop()
    assert sorted(answers) == [(0, 2, True), (0, 3, False)]
    (tmp_path / "e").mkdir()
    spark.createDataFrame([(1, 4, 2)], "src long, dst long, w long").coalesce(1).write.mode("append").json(str(tmp_path / "e"))
    stream, paths = incremental.stream_paths(spark.readStream.schema("src long, dst long, w long").json(str(tmp_path / "e")), g, 0, lambda k, rows: None, str(tmp_path / "p"))
    stream.processAllAvailable()
    stream.stop()
    assert {r.id: r.dist for r in paths.state.collect()} == {0: 0, 1: 1, 4: 3}
