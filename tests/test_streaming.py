"""Streams that stop and start again, and batches that come twice."""

import shutil

import pytest

from graphloom.operators.paths import DynamicPaths
from graphloom.streaming.incremental import stream_components, stream_paths
from tests.graphs import dijkstra, make, pairs, random_edges

EDGES = random_edges(24, 40, 3)


def fed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("again", [False, True])
def test_components_survive_a_restart(spark, tmp_path, again):
    graph = make(spark, [], 24)
    source, check, answers = str(tmp_path / "in"), str(tmp_path / "check"), {}

    def put(rows):
        spark.createDataFrame(rows, "u long, v long, op string").coalesce(1).write.mode("append").parquet(source)

    def run():
        query, state = stream_components(fed(spark, source, "u long, v long, op string"), graph.vertices, lambda n, df: answers.__setitem__(n, {(r.u, r.v): r.connected for r in df.collect()}), check)
        query.processAllAvailable()
        query.stop()
        return state

    put([(a, b, "insert") for a, b, _ in EDGES[:20]] + [(0, 1, "query")])
    run()
    put([(a, b, "insert") for a, b, _ in EDGES[20:]] + [(40, 41, "insert"), (0, 1, "query"), (0, 40, "query")])
    state = run()
    want = {v: min(dijkstra([(a, b) for a, b, _ in EDGES], [v])) for v in range(24)} | {40: 40, 41: 40}
    assert pairs(state.labels) == want
    if again:  # the last batch is not committed: it comes once more after the restart
        shutil.rmtree(tmp_path / "check" / "commits" / "1", ignore_errors=True)
        for name in (tmp_path / "check" / "commits").iterdir():
            if name.name.strip(".").startswith("1"):
                name.unlink()
        answers.pop(1)
        state = run()
        assert pairs(state.labels) == want
    assert answers[1] == {(0, 1): want[0] == want[1], (0, 40): False}


def test_paths_survive_a_restart(spark, tmp_path):
    graph = make(spark, EDGES[:20], 24)
    source, check, seen = str(tmp_path / "in"), str(tmp_path / "check"), []

    def put(rows):
        spark.createDataFrame(rows, "src long, dst long, w long").coalesce(1).write.mode("append").parquet(source)

    def run():
        query, state = stream_paths(fed(spark, source, "src long, dst long, w long"), graph, 0, lambda n, df: seen.append(n), check)
        query.processAllAvailable()
        query.stop()
        return state

    put(EDGES[20:30])
    run()
    put(EDGES[30:])
    assert pairs(run().state) == dijkstra(EDGES, [0])
    assert pairs(run().state) == dijkstra(EDGES, [0])
    assert seen == [0, 1]


def test_sources_and_compaction_survive_a_new_object(spark, tmp_path, monkeypatch):
    """A new object on the folder has every inserted source and edge; folders that a compaction replaces are gone."""
    monkeypatch.setattr(DynamicPaths, "COMPACT", 2)
    folder = (tmp_path / "paths").as_uri()
    graph = make(spark, EDGES[:12], 24)
    steps = [("edges", EDGES[12:18]), ("source", 3), ("edges", EDGES[18:25]), ("source", 9), ("edges", EDGES[25:])]
    have, sources = EDGES[:12], [0]
    for number, (kind, what) in enumerate(steps):
        state = DynamicPaths(graph, 0, folder)
        if kind == "source":
            state.insert_source(what, number=number)
            sources.append(what)
        else:
            state.insert(spark.createDataFrame(what, "src long, dst long, w long"), number=number)
            have = have + what
        want = dijkstra(have, sources)
        again = DynamicPaths(graph, 0, folder)
        assert pairs(again.state) == pairs(state.state) == want
        tight = sorted((a, b, w) for x, y, w in have for a, b in ((x, y), (y, x)) if a in want and b in want and want[a] + w == want[b])
        assert sorted(map(tuple, again.support().collect())) == tight
    assert not (tmp_path / "paths" / "dist" / "0").exists() and not (tmp_path / "paths" / "whole-dist" / "-1").exists()
    again.insert(spark.createDataFrame(EDGES[25:], "src long, dst long, w long"), number=4)  # the last batch comes again
    assert pairs(again.state) == want
    with pytest.raises(ValueError, match="settled"):
        again.insert(spark.createDataFrame(EDGES[:1], "src long, dst long, w long"), number=0)
