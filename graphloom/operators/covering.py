"""Independent sets, matchings, colourings, set cover: deterministic rounds in which every local minimum of an order acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.graph import Graph
from graphloom.runtime import forget, stored


def _order(kind: str, seed: int) -> Column:
    return F.struct(F.col("id").alias("k"), F.col("id").alias("t")) if kind == "id" else F.struct(hash_priority("id", seed=seed).alias("k"), F.col("id").alias("t"))


def independent_set(graph: Graph, order: str = "id", seed: int = 0) -> DataFrame:
    """(id): the first maximal independent set in the order (id, or hash): a vertex joins once no undecided neighbour comes before it."""
    rank = graph.vertices.select("id", _order(order, seed).alias("r"))
    edges = graph.edges.select("src", "dst").join(rank.select(F.col("id").alias("src"), F.col("r").alias("r_src")), "src").join(rank.select(F.col("id").alias("dst"), F.col("r").alias("r_dst")), "dst")
    edges, open_ = stored(edges, "mis"), stored(graph.vertices.select("id"), "mis")
    chosen = None
    while not open_.isEmpty():
        blocked = edges.where("r_dst < r_src").select(F.col("src").alias("id")).distinct()
        new = stored(open_.join(blocked, "id", "left_anti"), "mis")
        chosen = new if chosen is None else chosen.union(new)
        gone = new.union(edges.join(new.select(F.col("id").alias("src")), "src", "left_semi").select("dst")).distinct()
        last = open_, edges
        open_ = stored(open_.join(gone, "id", "left_anti"), "mis")
        edges = stored(edges.join(open_.select(F.col("id").alias("src")), "src", "left_semi").join(open_.select(F.col("id").alias("dst")), "dst", "left_semi"), "mis")
        forget(*last)
    return graph.vertices.select("id").limit(0) if chosen is None else chosen


def is_maximal_independent(graph: Graph, chosen: DataFrame) -> bool:
    mine, theirs = chosen.select(F.col("id").alias("src")), chosen.select(F.col("id").alias("dst"))
    inside = graph.edges.where("src <> dst").join(mine, "src", "left_semi").join(theirs, "dst", "left_semi")
    covered = chosen.select("id").union(graph.edges.join(mine, "src", "left_semi").select("dst"))
    return inside.isEmpty() and graph.vertices.join(covered, "id", "left_anti").isEmpty()


def local_status(graph: Graph, ids: DataFrame, cutoff: int | None = None, order: str = "hash", seed: int = 0) -> DataFrame:
    """(id, status in, out or unknown, work): membership of single vertices in the order's first independent set, exploring only earlier neighbours, at most cutoff vertices each. What was explored settles it, as a vertex depends on earlier ones alone."""
    rank = graph.vertices.select("id", _order(order, seed).alias("r"))
    down = graph.edges.join(rank.select(F.col("id").alias("src"), F.col("r").alias("a")), "src").join(rank.select(F.col("id").alias("dst"), F.col("r").alias("b")), "dst").where("b < a").select("src", "dst")
    down = stored(down, "local")
    seen = stored(ids.select(F.col("id").alias("root"), "id"), "local")
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(down.withColumnRenamed("src", "id"), "id").select("root", F.col("dst").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        frontier = stored(step, "local")
        seen = stored(seen.union(frontier), "local")
        if cutoff is not None:
            over = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > cutoff).select("root")
            frontier = stored(frontier.join(over, "root", "left_anti"), "local")
    work = seen.groupBy("root").agg(F.count("*").alias("work"))
    met = stored(seen.select("id").distinct(), "local")
    inner = down.join(met.select(F.col("id").alias("src")), "src", "left_semi").join(met.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    chosen = independent_set(Graph(met, inner.union(inner.select("dst", "src")).withColumn("w", F.lit(1)), False), order, seed).withColumn("hit", F.lit(True))
    known = F.lit(True) if cutoff is None else F.col("work") <= cutoff
    return work.withColumnRenamed("root", "id").join(chosen, "id", "left").select("id", F.when(~known, "unknown").when(F.col("hit"), "in").otherwise("out").alias("status"), "work")


def maximal_matching(graph: Graph, order: str = "id", seed: int = 0) -> DataFrame:
    """(src, dst): the first maximal matching in the order of edges (by ends, or hashed): edges that are first at both ends join."""
    key = F.struct("src", "dst") if order == "id" else F.struct(hash_priority("src", "dst", seed=seed).alias("h"), "src", "dst")
    edges = stored(graph.und().select("src", "dst", key.alias("k")), "matching")
    chosen = None
    while not edges.isEmpty():
        best = edges.select(F.col("src").alias("id"), "k").union(edges.select("dst", "k")).groupBy("id").agg(F.min("k").alias("best"))
        a, b = (best.select(F.col("id").alias(x), F.col("best").alias(f"b_{x}")) for x in ("src", "dst"))
        new = stored(edges.join(a, "src").join(b, "dst").where("k = b_src and k = b_dst").select("src", "dst"), "matching")
        chosen = new if chosen is None else chosen.union(new)
        used = new.select("src").union(new.select("dst")).distinct()
        edges = stored(edges.join(used, "src", "left_anti").join(used.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst", "k"), "matching")
    return graph.und().select("src", "dst").limit(0) if chosen is None else chosen


def local_matching(graph: Graph, edges: DataFrame | None = None, cutoff: int | None = None, seed: int = 0) -> DataFrame:
    """(src, dst, status in, out or unknown, work): whether single edges (src < dst; by default all) are in the hash order's first maximal matching, exploring only earlier edges at their ends, at most cutoff edges each."""
    und = stored(graph.und().select("src", "dst", hash_priority("src", "dst", seed=seed).alias("h")), "local")
    at = und.select(F.col("src").alias("v"), "src", "dst", "h").union(und.select(F.col("dst").alias("v"), "src", "dst", "h"))
    roots = und if edges is None else und.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")
    seen = stored(roots.select(F.struct("src", "dst").alias("root"), "src", "dst", "h"), "local")
    frontier = seen
    while not frontier.isEmpty():
        ends = frontier.select("root", F.struct("h", "src", "dst").alias("k"), F.explode(F.array("src", "dst")).alias("v"))
        step = ends.join(at, "v").where(F.struct("h", "src", "dst") < F.col("k")).select("root", "src", "dst", "h").distinct().join(seen, ["root", "src", "dst"], "left_anti")
        frontier = stored(step.select("root", "src", "dst", "h"), "local")
        seen = stored(seen.union(frontier), "local")
        if cutoff is not None:
            over = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > cutoff).select("root")
            frontier = stored(frontier.join(over, "root", "left_anti"), "local")
    met = seen.select("src", "dst").distinct().withColumn("w", F.lit(1))
    chosen = maximal_matching(Graph(graph.vertices, met, True), "hash", seed).withColumn("hit", F.lit(True))
    work = seen.groupBy("root").agg(F.count("*").alias("work")).select("root.src", "root.dst", "work")
    known = F.lit(True) if cutoff is None else F.col("work") <= cutoff
    return work.join(chosen, ["src", "dst"], "left").select("src", "dst", F.when(~known, "unknown").when(F.col("hit"), "in").otherwise("out").alias("status"), "work")


def is_maximal_matching(graph: Graph, chosen: DataFrame) -> bool:
    ends = chosen.select(F.col("src").alias("id")).union(chosen.select("dst"))
    twice = ends.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    free = graph.und().join(ends.select(F.col("id").alias("src")), "src", "left_anti").join(ends.select(F.col("id").alias("dst")), "dst", "left_anti")
    return twice.isEmpty() and free.isEmpty() and chosen.join(graph.und(), ["src", "dst"], "left_anti").isEmpty()


def colouring(graph: Graph, order: str = "id") -> DataFrame:
    """(id, color): the least free colour in the order: id, or degree (largest first, then id)."""
    rank = graph.degrees().select("id", F.struct(F.lit(0).cast("long").alias("k"), F.col("id").alias("t")).alias("r")) if order == "id" else graph.degrees().select("id", F.struct((-F.col("degree")).alias("k"), F.col("id").alias("t")).alias("r"))
    a, b = (rank.select(F.col("id").alias(x), F.col("r").alias(f"r_{x}")) for x in ("src", "dst"))
    earlier = stored(graph.edges.where("src <> dst").select("src", "dst").join(a, "src").join(b, "dst").where("r_dst < r_src").select("src", "dst"), "colour")
    left, done = stored(graph.vertices.select("id"), "colour"), None
    while not left.isEmpty():
        waiting = earlier.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        ready = left.join(waiting, "id", "left_anti")
        if done is None:
            new = ready.select("id", F.lit(0).cast("long").alias("color"))
        else:
            used = earlier.join(ready.select(F.col("id").alias("src")), "src", "left_semi").join(done.select(F.col("id").alias("dst"), "color"), "dst").select("src", "color").distinct()
            place = F.row_number().over(Window.partitionBy("src").orderBy("color"))
            # colours 0, 1, 2, ... without a gap hold their own place; the first that doesn't is free
            run = used.withColumn("place", place - 1).where("color = place").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("color"))
            new = ready.join(run, "id", "left").select("id", F.coalesce("color", F.lit(0).cast("long")).alias("color"))
        new = stored(new, "colour")
        done = new if done is None else stored(done.union(new), "colour")
        left = stored(left.join(new, "id", "left_anti"), "colour")
    return graph.vertices.select("id", F.lit(0).cast("long").alias("color")).limit(0) if done is None else done


def colour_conflicts(graph: Graph, colours: DataFrame) -> DataFrame:
    """(n): edges whose ends share a colour."""
    a, b = (colours.select(F.col("id").alias(x), F.col("color").alias(f"c_{x}")) for x in ("src", "dst"))
    return graph.und().join(a, "src").join(b, "dst").where("c_src = c_dst").agg(F.count("*").alias("n"))


def set_cover(graph: Graph, epsilon: float = 0.01) -> DataFrame:
    """(id): vertices whose neighbourhoods cover every vertex with a neighbour. Sets of the largest (1 + epsilon) bucket compete; an element goes to the least set, and a set that wins enough joins."""
    import math

    left, chosen = stored(graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("e")).where("id <> e").distinct(), "cover"), None
    while not left.isEmpty():
        sizes = stored(left.groupBy("id").agg(F.count("*").alias("n")), "cover")
        most = sizes.agg(F.max("n")).first()[0]
        bucket = math.floor(math.log(most) / math.log1p(epsilon))
        need = max(1, math.ceil((1 + epsilon) ** (bucket - 1)))
        top = sizes.where(F.floor(F.log("n") / math.log1p(epsilon)) >= bucket)
        won = left.join(top.select("id"), "id", "left_semi").groupBy("e").agg(F.min("id").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= need)
        new = stored(won.select("id"), "cover")
        chosen = new if chosen is None else chosen.union(new)
        gone = left.join(new, "id", "left_semi").select("e").distinct()
        left = stored(left.join(gone, "e", "left_anti").select("id", "e"), "cover")
    return graph.vertices.select("id").limit(0) if chosen is None else chosen
