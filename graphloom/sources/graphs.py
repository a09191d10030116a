"""Graphs over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.runtime import stored, table

SUPPLIER_OFFSET = 1_000_000_000
#: Rows of lineitem for each task that pairs them.
LINES = 1 << 18


def part_pairs(lineitem: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, w): parts src < dst bought together in at least that many different orders.

    Orders, and then the pairs, are dealt to tasks of about LINES lines, however many there are: pairs hardly repeat, so a task holds nearly all
    that it gets. Counting before they are dealt would hold them twice; a pair that many orders have is a count in the task that gets it."""
    tasks = max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // LINES))
    item = lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).repartition(tasks, "o").distinct()
    both = item.withColumnRenamed("p", "src").join(item.withColumnRenamed("p", "dst"), "o").where("src < dst").select("src", "dst")
    return both.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("w")).where(F.col("w") >= least)


def part_graph(spark: SparkSession, sf_dir: str, isolated: bool = False) -> Graph:
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")) if isolated else None
    # written once: vertices and both directions of the edges are made from the pairs
    return Graph.from_edges(stored(part_pairs(table(spark, sf_dir, "lineitem")), "pairs"), vertices=vertices, parallel=None)


def user_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: from the user of a purchase to that of the next one of its day; w counts.

    Purchases are ordered within minutes; the last one of a minute is followed by the first one of the day's next minute that has any, found
    among the minutes' first ones. So no task orders a day, whatever its number of events is."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"), F.date_trunc("minute", "ts").alias("minute"))
    placed = bought.withColumn("next", F.lead(F.struct("user_id")).over(Window.partitionBy("day", "minute").orderBy("ts", "event_id")))
    heads = bought.groupBy("day", "minute").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("head"))
    ahead = F.lead("head.user_id").over(Window.partitionBy("day").orderBy("minute"))  # a row for each minute of a day
    heads = heads.select("day", "minute", ahead.alias("dst"))
    inside = placed.where("next is not null").select(F.col("user_id").alias("src"), F.col("next.user_id").alias("dst"))
    across = placed.where("next is null").join(heads, ["day", "minute"]).select(F.col("user_id").alias("src"), "dst")
    flow = inside.union(across).where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return Graph.from_edges(stored(flow, "flow"), directed=True, parallel=None)


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite: customers and the suppliers they bought from; supplier ids are shifted by SUPPLIER_OFFSET."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("src"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("dst"))
    return Graph.from_edges(stored(orders.join(lines, "k").groupBy("src", "dst").agg(F.count("*").alias("w")), "bought"), parallel=None)
