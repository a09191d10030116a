"""Graph files: edge lists, adjacency text, binary compressed rows, Parquet; and cleaning.

The adjacency text format is a header (AdjacencyGraph or WeightedAdjacencyGraph), n, m, n offsets, m targets and, if
weighted, m weights, one token a line or any white space between. Positions come from line numbers within file parts, so
no task holds a whole file of one token a line.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.primitives import degree_order, dense_ranks
from graphloom.functions.scalars import hash_priority
from graphloom.runtime import forget, stored

BLOCK = 1 << 16
SPAN, MOST = 1 << 22, 10_000  # edges of a binary file in a task; tasks at once


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, directed: bool = False, dense: bool = True) -> Graph:
    """Lines "u v" or "u v w", # comments; duplicates and loops are dropped, the least weight of parallel edges stays."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("not startswith(trim(value), '#') and trim(value) <> ''")
    w = parts[2].cast("double") if weighted else F.lit(1).cast("long")
    return Graph.from_edges(lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), w.alias("w")), directed, dense=dense)


def write_edge_list(graph: Graph, path: str, weighted: bool = False) -> None:
    rows = graph.edges if graph.directed else graph.und()
    rows.select(F.concat_ws(" ", "src", "dst", *(["w"] if weighted else []))).write.text(path)


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(place, token): all tokens of a text file in order, numbered from 0 by part and place."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.explode(F.array_compact(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: F.when(x != "", x)))).alias("token"))
    lines = stored(lines.select("line", "token", F.monotonically_increasing_id().alias("spot")), "tokens")
    return dense_ranks(lines.select(F.col("spot").alias("id"))).join(lines.select(F.col("spot").alias("id"), "token"), "id").select(F.col("new").alias("place"), "token")


def read_adjacency(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """A graph from the adjacency text format, weighted or not by its header."""
    tokens = stored(_tokens(spark, path), "adjacency")
    head = {r.place: r.token for r in tokens.where("place < 3").collect()}
    kind, n, m = head[0], int(head[1]), int(head[2])
    if kind not in ("AdjacencyGraph", "WeightedAdjacencyGraph"):
        raise ValueError(f"unknown header {kind}")
    number = tokens.where("place >= 3").select((F.col("place") - 3).alias("place"), F.col("token").cast("double").alias("x"))
    offsets = number.where(F.col("place") < n).select(F.col("place").alias("id"), F.col("x").cast("long").alias("begin"))
    targets = number.where((F.col("place") >= n) & (F.col("place") < n + m)).select((F.col("place") - n).alias("e"), F.col("x").cast("long").alias("dst"))
    # a vertex with edges begins where no later one does; ends follow from the next beginning
    begins = offsets.groupBy("begin").agg(F.max("id").alias("src")).where(F.col("begin") < m)
    marked = targets.select("e", "dst", F.lit(None).cast("long").alias("src")).union(begins.select(F.col("begin").alias("e"), F.lit(None).cast("long"), F.col("src")))
    block = F.floor(F.col("e") / 65536)
    # within blocks of positions the last beginning carries on; a block without one takes that of the blocks before
    inside = Window.partitionBy("b").orderBy("e", F.col("src").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("b", block).withColumn("s", F.last("src", True).over(inside))
    last = filled.groupBy("b").agg(F.max("src").alias("x"))
    carry = last.select("b", F.max("x").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))  # a row for each block
    edges = filled.where("dst is not null").join(carry, "b").select("e", F.coalesce("s", "carry").alias("src"), "dst")
    if kind.startswith("Weighted"):
        weights = number.where(F.col("place") >= n + m).select((F.col("place") - n - m).alias("e"), F.col("x").alias("w"))
        whole = weights.where("w <> floor(w)").isEmpty()
        edges = edges.join(weights.select("e", F.col("w").cast("long" if whole else "double").alias("w")), "e")
    else:
        edges = edges.withColumn("w", F.lit(1).cast("long"))
    vertices = spark.range(n).select("id", F.lit(None).cast("double").alias("weight"))
    return Graph(vertices, stored(edges.select("src", "dst", "w"), "adjacency"), directed)


def write_adjacency(graph: Graph, path: str, weighted: bool = False, by_degree: bool = False) -> None:
    """The text format for vertices 0 to n - 1, one token a line, as the parts of a folder in order. by_degree: renamed by degree, then id."""
    if by_degree:
        graph = graph.relabelled(degree_order(graph)).store()
    n, m = graph.vertices.count(), graph.edges.count()
    order = graph.edges.select("src", "dst", "w")
    degrees = graph.degrees()
    ranks = dense_ranks(order.select(F.struct("src", "dst").alias("id"), "w"), [F.col("id")])
    per = degrees.repartitionByRange("id").sortWithinPartitions("id")
    upto = _running(per.select("id", "degree"))
    head = graph.vertices.sparkSession.createDataFrame([(0, 0, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph"), (0, 1, str(n)), (0, 2, str(m))], "a int, b long, token string")
    rows = head.union(upto.select(F.lit(1), "id", F.col("before").cast("string"))).union(ranks.select(F.lit(2), "new", F.col("id.dst").cast("string")))
    if weighted:
        rows = rows.union(ranks.join(order.select(F.struct("src", "dst").alias("id"), "w"), "id").select(F.lit(3), "new", F.col("w").cast("string")))
    rows.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("token").write.text(path)


def _running(rows: DataFrame) -> DataFrame:
    """(id, before): the sum of degrees of lesser ids, by blocks of ids."""
    blocked = rows.withColumn("b", F.floor(F.col("id") / 65536))
    sums = blocked.groupBy("b").agg(F.sum("degree").alias("n"))
    carry = sums.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    inside = F.sum("degree").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return blocked.withColumn("own", F.coalesce(inside, F.lit(0))).join(carry, "b").select("id", (F.col("own") + F.col("carry")).alias("before"))


def write_binary(graph: Graph, path: str, weighted: bool = False) -> None:
    """Compressed rows of vertices 0 to n - 1 in files rows-<first>.bin of BLOCK vertices each: three 64-bit integers (n, m and the file's size), n + 1
    64-bit offsets, and m 32-bit targets, each followed by its 32-bit weight if weighted. A task holds one block's edges."""
    n = graph.vertices.count()
    top = graph.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    if top is not None and top >= min(n, 1 << 32):
        raise ValueError("ids from 0 to the number of vertices and below 2 ** 32 are needed: relabel the graph first")

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by([("src", "ascending"), ("dst", "ascending")])
        src, dst, w = (group.column(c).to_numpy() for c in ("src", "dst", "w"))
        first = int(group.column("block")[0].as_py()) * BLOCK
        size, real = min(BLOCK, n - first), dst >= 0
        src, dst, w = src[real], dst[real], w[real]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(src - first, minlength=size))]).astype("<i8")
        body = np.stack([dst.astype("<u4"), w.astype("<i4").view("<u4")], axis=1) if weighted else dst.astype("<u4")
        raw = offsets.tobytes() + body.tobytes()
        system, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/rows-{first}.bin", compression=None) as sink:
            sink.write(struct.pack("<3q", size, len(dst), 24 + len(raw)) + raw)
        return pa.table({"first": pa.array([first], pa.int64())})

    every = graph.edges.select("src", "dst", F.col("w").cast("long").alias("w")).union(graph.vertices.sparkSession.range(0, max(1, n), BLOCK).select("id", F.lit(-1), F.lit(0)))
    every.withColumn("block", F.floor(F.col("src") / BLOCK)).groupBy("block").applyInArrow(write, "first long").collect()  # a row for each file


def _opened(path: str):
    system, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return system.open_input_file(base)


def read_binary(spark: SparkSession, path: str, directed: bool = False, weighted: bool = False, span: int = SPAN) -> Graph:
    """Compressed rows as write_binary() makes them, or one file of a whole graph.

    A task reads span edges of a file by their byte range: it finds their first vertex by bisection of the file's offsets and walks on from
    there, a piece at a time, so neither a file nor a vertex of very many edges has to fit into a task."""
    wide = 4 * (1 + weighted)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = re.search(r"rows-([0-9]+)\.bin$", name)
                with _opened(name) as source:
                    n, m, _ = struct.unpack("<3q", source.read_at(24, 0))
                least = np.arange(0, max(m, 1), span)
                cells = [pa.array([name] * len(least)), *(pa.array(np.full(len(least), x), pa.int64()) for x in (int(found[1]) if found else 0, n, m)), pa.array(least)]
                yield pa.RecordBatch.from_arrays(cells, ["path", "first", "n", "m", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n, m, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(name) as source:
                    yield from edges(source, first, n, least, min(m, least + span))

    def edges(source, first: int, n: int, at: int, end: int) -> Iterator[pa.RecordBatch]:
        offset = lambda v: struct.unpack("<q", source.read_at(8, 24 + 8 * v))[0]
        low, high = 0, n  # the last vertex whose edges begin at this place or before
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if offset(mid) <= at else (low, mid)
        while at < end:
            known = np.frombuffer(source.read_at(8 * (min(n, low + BLOCK) + 1 - low), 24 + 8 * low), "<i8")
            stop = min(end, int(known[-1]), at + BLOCK)
            body = np.frombuffer(source.read_at(wide * (stop - at), 24 + 8 * (n + 1) + wide * at), "<u4").reshape(stop - at, 1 + weighted)
            owner = low + np.searchsorted(known, np.arange(at, stop), "right") - 1
            w = body[:, 1].astype("<u4").view("<i4").astype(np.int64) if weighted else np.ones(len(body), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owner + first), pa.array(body[:, 0].astype(np.int64)), pa.array(w)], ["src", "dst", "w"])
            at = stop
            low += int(np.searchsorted(known, at, "right")) - 1 if at < known[-1] else len(known) - 1

    names = spark.read.format("binaryFile").load(path).select("path")  # the files' contents are not read here
    parts = stored(names.mapInArrow(spans, "path string, first long, n long, m long, least long"), "binary")
    n = parts.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
    dealt = parts.repartition(max(1, min(parts.count(), MOST)), "path", "least")
    rows = stored(dealt.mapInArrow(run, "src long, dst long, w long"), "binary")
    forget(parts)
    return Graph(spark.range(n).select("id", F.lit(None).cast("double").alias("weight")), rows, directed)


def write_parquet(graph: Graph, path: str) -> None:
    graph.vertices.write.parquet(f"{path}/vertices")
    graph.edges.write.parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), directed)


def cleaned(graph: Graph) -> Graph:
    """Without loops, parallel edges (the least weight stays) and isolated vertices, renamed densely by id."""
    g = Graph.from_edges(graph.edges, graph.directed)
    return g.relabelled(dense_ranks(g.vertices.select("id")))


def write_parts(rows: DataFrame, path: str) -> None:
    """The biconnected components by vertex, as connectivity.vertex_parts() gives them: lines "id parent src dst", src and dst naming the component of the edge to the parent; an id alone is a root."""
    rows.select(F.concat_ws(" ", "id", "parent", "first_src", "first_dst")).write.text(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent, first_src, first_dst) of such lines."""
    cells = F.split("value", " ")
    return spark.read.text(path).select(*(F.get(cells, F.lit(k)).cast("long").alias(c) for k, c in enumerate(("id", "parent", "first_src", "first_dst"))))


def weight_sample(graph: Graph, k: int = 100, seed: int = 42) -> DataFrame:
    """(src, dst, w): k edges, the first in hashed order, the same ones each time; partitions keep their first k, no task sorts all edges."""
    return graph.edges.orderBy(hash_priority("src", "dst", seed=seed), "src", "dst").limit(k).select("src", "dst", "w")


def weight_summary(graph: Graph, k: int = 100, seed: int = 42) -> DataFrame:
    """(part, n, least, mean, greatest) of all weights and of those in the sample."""
    stats = lambda rows, part: rows.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.min("w").alias("least"), F.avg("w").alias("mean"), F.max("w").alias("greatest"))
    return stats(graph.edges, "all").union(stats(weight_sample(graph, k, seed), "sample"))


def summary(graph: Graph) -> DataFrame:
    """(vertices, edges, isolated, least_degree, mean_degree, greatest_degree, least_w, mean_w, greatest_w)."""
    d = graph.degrees().agg(F.count("*").alias("vertices"), F.sum("degree").alias("edges"), F.count_if(F.col("degree") == 0).alias("isolated"), F.min("degree").alias("least_degree"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("greatest_degree"))
    return d.join(graph.edges.agg(F.min("w").alias("least_w"), F.avg("w").alias("mean_w"), F.max("w").alias("greatest_w")))
