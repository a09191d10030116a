"""Connected components by alternating star contraction: every round is two aggregations and two equi-joins.

A vertex's edges move to the least vertex it sees, so a component of any shape becomes one star around its least id in a
logarithmic number of rounds. A hub is never gathered in one task: its minimum is a partial aggregate and its rows
stay plain join rows, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).union(edges)
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).distinct()


def star_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): every endpoint of the edges (src, dst) with the least id it is connected to. Loops and nulls make no edge."""
    state = stored(edges.select(F.greatest("src", "dst").cast("long").alias("src"), F.least("src", "dst").cast("long").alias("dst")).where("src is not null and src <> dst").distinct(), "cc")
    mark = None
    for _ in range(most):
        last, state = state, stored(_small_star(_large_star(state)), "cc")
        forget(last)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components haven't settled after {most} rounds")
    return state.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(state.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
