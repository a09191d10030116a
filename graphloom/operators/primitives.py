"""Neighbourhood primitives: frontiers are DataFrames (id, ...), edge maps are joins, reductions are grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.graph import Graph
from graphloom.runtime import stored


def vertex_map(frontier: DataFrame, **columns: Column) -> DataFrame:
    """New columns for each vertex of the frontier."""
    return frontier.withColumns(columns)


def vertex_filter(frontier: DataFrame, keep: Column) -> DataFrame:
    return frontier.where(keep)


def edge_map(graph: Graph, frontier: DataFrame, value: Column | None = None, reduce: Callable[[Column], Column] = F.min, seen: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """(id, value): for each target of the frontier's edges the reduction of value over them. seen (id): targets left out.

    value may use src, dst, w and the frontier's columns; by default the source, so that the least source wins."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    hit = graph.edges.join(frontier.withColumnRenamed("id", a), a)
    if seen is not None:
        hit = hit.join(seen.select(F.col("id").alias(b)), b, "left_anti")
    return hit.groupBy(F.col(b).alias("id")).agg(reduce(F.col(a) if value is None else value).alias("value"))


def edge_map_induced(graph: Graph, frontier: DataFrame, direction: str = "out", distinct: bool = False) -> DataFrame:
    """(id): the multiset of the frontier's neighbours along or (direction "in") against the edges, or the set of them."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    hit = graph.edges.join(frontier.select(F.col("id").alias(a)), a).select(F.col(b).alias("id"))
    return hit.distinct() if distinct else hit


def edge_map_count(graph: Graph, frontier: DataFrame) -> DataFrame:
    """(id, value): how many of the frontier's edges reach each vertex."""
    return edge_map(graph, frontier.select("id"), F.lit(1), F.count)


def src_count(graph: Graph, frontier: DataFrame, keep: Column) -> DataFrame:
    """(id, value): for each vertex of the frontier, how many of its edges pass."""
    own = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count_if(keep).alias("value"))
    return frontier.select("id").join(own, "id", "left").select("id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def reduce_edges(graph: Graph, **aggregates: Column) -> DataFrame:
    return graph.edges.agg(*(c.alias(k) for k, c in aggregates.items()))


def adjacency(graph: Graph) -> DataFrame:
    """(id, neighbours): sorted neighbour lists; for bounded degrees only, as a hub's list is one row."""
    return graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def ith_neighbour(graph: Graph, i: int) -> DataFrame:
    """(id, neighbour): the i-th neighbour (from 0) of each vertex that has one."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return graph.edges.withColumn("i", rank - 1).where(F.col("i") == i).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))


def first_neighbours(graph: Graph, k: int) -> DataFrame:
    """The edges to each vertex's k least neighbours."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return graph.edges.withColumn("i", rank).where(F.col("i") <= k).drop("i")


def common_neighbours(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(src, dst, common): the number of neighbours that both ends of each pair have, by joins on the third vertex."""
    one = pairs.select("src", "dst").join(graph.edges.select("src", F.col("dst").alias("x")), "src")
    both = one.join(graph.edges.select(F.col("src").alias("dst"), F.col("dst").alias("x")), ["dst", "x"])
    return pairs.select("src", "dst").join(both.groupBy("src", "dst").agg(F.count("*").alias("common")), ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0).cast("long")).alias("common"))


def contract(graph: Graph, clusters: DataFrame) -> tuple[Graph, DataFrame]:
    """The quotient by clusters (id, cluster), densely renamed from 0: loops, parallel edges and lone clusters go. Also (cluster, new)."""
    a, b = (clusters.select(F.col("id").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    e = graph.edges.join(a, "src").join(b, "dst").where("c_src <> c_dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.min("w").alias("w"))
    kept = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    names = dense_ranks(kept)
    return Graph(kept.withColumn("weight", F.lit(None).cast("double")), e, graph.directed).relabelled(names), names.select(F.col("id").alias("cluster"), "new")


def dense_ranks(ids: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """(id, new): 0-based ranks in the given order (by id), without gathering all rows in one task: ranks within ranges of the order, then each range's offset."""
    key = order or [F.col("id")]
    # stored, as two branches read it and must agree on places even where a task is run again
    dealt = stored(ids.repartitionByRange(*key).sortWithinPartitions(*key).select("id", F.monotonically_increasing_id().alias("spot")), "ranks")
    # the upper 31 bits are the partition, the lower 33 the place in it
    placed = dealt.select("id", F.shiftright("spot", 33).alias("part"), F.col("spot").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("place")).alias("new"))  # a row for each partition


def prefix_sums(rows: DataFrame, *values: str) -> DataFrame:
    """(key, values): sums of the values over all rows with a key up to this one's, keys being unique. Sums are made within ranges of the keys; then each range's offset, a row for each range, is added."""
    dealt = stored(rows.repartitionByRange("key").select("key", *values, F.spark_partition_id().alias("part")), "prefix")
    before = dealt.groupBy("part").agg(*(F.sum(v).alias(f"before_{v}") for v in values))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("part", *(F.coalesce(F.sum(f"before_{v}").over(earlier), F.lit(0)).alias(f"before_{v}") for v in values))
    within = Window.partitionBy("part").orderBy("key")
    inside = dealt.select("key", "part", *(F.sum(v).over(within).alias(v) for v in values))
    return inside.join(F.broadcast(before), "part").select("key", *((F.col(v) + F.col(f"before_{v}")).alias(v) for v in values))


def degree_order(graph: Graph) -> DataFrame:
    """(id, new): rank by degree, then id."""
    return dense_ranks(graph.degrees(), [F.col("degree"), F.col("id")])


def random_order(graph: Graph, seed: int = 0) -> DataFrame:
    """(id, new): a repeatable shuffle."""
    return dense_ranks(graph.vertices.select("id"), [hash_priority("id", seed=seed), F.col("id")])


def most_frequent(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): the value that most rows have, the least of equals; counted from all rows, by partial sums."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(1)


def lightest_edges(graph: Graph, k: int) -> DataFrame:
    """(src, dst, w): the k undirected edges of least weight, ties by ends. An approximate quantile a little beyond k keeps the heavier edges out of the ranking; where it lies too low all edges are ranked."""
    und = graph.und().select("src", "dst", "w")
    m = und.count()
    if k >= m:
        return und
    bound = und.agg(F.percentile_approx("w", F.lit(min(1.0, (1.1 * k + 1000) / m)), F.lit(1000))).first()[0]
    few = und.where(F.col("w") <= bound)
    few = few if few.count() >= k else und
    return dense_ranks(few.select(F.struct("w", "src", "dst").alias("id"))).where(F.col("new") < k).select("id.src", "id.dst", "id.w")


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value): sum of products of two vectors (id, value)."""
    return a.join(b.select("id", F.col("value").alias("other")), "id").agg(F.coalesce(F.sum(F.col("value") * F.col("other")), F.lit(0.0)).alias("value"))


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select("id", F.col("value").alias("other")), "id", "full")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))), F.lit(0.0)).alias("value"))
