"""PageRank in its forms, and CoSimRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.runtime import forget, stored
from graphloom.state import bucketed, frontier_edges


def _check(damping: float, eps: float, max_iters: int) -> None:
    if not 0 <= damping < 1 or eps < 0 or max_iters < 0:
        raise ValueError("0 <= damping < 1, 0 <= eps and 0 <= max_iters are needed")


def _shares(graph: Graph, weighted: bool) -> DataFrame:
    """(src, dst, share): what part of its rank a vertex sends along each edge; vertices without weight send none."""
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    edges = graph.edges.select("src", "dst", w.alias("w"))
    total = edges.groupBy("src").agg(F.sum("w").alias("total")).where("total > 0")
    return bucketed(edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "src", "rank")


def _start(graph: Graph, sources: list[int] | None) -> tuple[DataFrame, int]:
    """(id, home): where random jumps and dangling rank land, summing to 1."""
    ids = graph.vertices.select("id")
    if sources is None:
        n = ids.count()
        return ids.withColumn("home", F.lit(1.0 / max(1, n))), n
    chosen = F.col("id").isin([int(s) for s in set(sources)])
    k = ids.where(chosen).count()
    return ids.withColumn("home", F.when(chosen, F.lit(1.0 / max(1, k))).otherwise(F.lit(0.0))), ids.count()


def pagerank(graph: Graph, damping: float = 0.85, eps: float = 1e-6, max_iters: int = 100, sources: list[int] | None = None, weighted: bool = False) -> DataFrame:
    """(id, rank): with sources, jumps and dangling rank go to them only. Stops when the change sums to less than eps * n, or after max_iters."""
    _check(damping, eps, max_iters)
    shares = _shares(graph, weighted)
    home, n = _start(graph, sources)
    sends = shares.select(F.col("src").alias("id")).distinct().withColumn("sends", F.lit(True))
    state = bucketed(home.join(sends, "id", "left").select("id", "home", F.coalesce("sends", F.lit(False)).alias("sends"), F.col("home").alias("rank")), "id", "rank")
    dangling = F.coalesce(F.sum(F.when(~F.col("sends"), F.col("rank"))), F.lit(0.0)).alias("lost")
    lost = state.agg(dangling).first()[0]
    for _ in range(max_iters):
        # shares and ranks are bucketed alike: what travels are the sums for each target
        got = frontier_edges(shares, state, "rank").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.col("home") * (1 - damping + damping * lost) + damping * F.coalesce("got", F.lit(0.0))
        moved, seen = state.join(got, "id", "left").select("id", "home", "sends", F.col("rank").alias("old"), rank.alias("rank")), Observation()
        moved = moved.observe(seen, dangling, F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)).alias("change"))
        last, state = state, bucketed(moved.drop("old"), "id", "rank")
        forget(last)
        lost = seen.get["lost"]
        if eps > 0 and seen.get["change"] < eps * n:
            break
    forget(shares)
    return state.select("id", "rank")


def pagerank_delta(graph: Graph, damping: float = 0.85, eps: float = 1e-6, local_eps: float = 0.01, max_iters: int = 100) -> DataFrame:
    """(id, rank): only vertices whose rank changed by more than local_eps of it send their change on. Dangling rank stays where it is lost."""
    _check(damping, eps, max_iters)
    shares = _shares(graph, False)
    home, n = _start(graph, None)
    state = stored(home.select("id", F.lit(0.0).alias("rank"), F.col("home").alias("delta")), "delta")
    for i in range(max_iters):
        active = state if i == 0 else state.where(F.abs("delta") > local_eps * F.col("rank"))
        got = shares.join(active.select(F.col("id").alias("src"), "delta"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("delta") * F.col("share")).alias("got"))
        new, last = damping * F.coalesce("got", F.lit(0.0)), state
        if i == 0:  # the first change is measured from 1 / n
            new = new + (1 - damping) / max(1, n)
            state = stored(state.join(got, "id", "left").select("id", new.alias("rank"), (new - F.col("delta")).alias("delta")), "delta")
        else:
            state = stored(state.join(got, "id", "left").select("id", (F.col("rank") + new).alias("rank"), new.alias("delta")), "delta")
        forget(last)
        if (state.agg(F.sum(F.abs("delta"))).first()[0] or 0.0) < eps * max(1, n):
            break
    return state.select("id", "rank")


def cosimrank(graph: Graph, u: int, v: int, c: float = 0.85, iters: int = 10) -> DataFrame:
    """(sim): sum over i of c^i times the inner product of the i-step walks from u and v; 1 more if they are one vertex."""
    _check(c, 0.0, iters)
    shares = _shares(graph, False)
    spark = shares.sparkSession
    a, b = (spark.createDataFrame([(int(x), 1.0)], "id long, p double").join(graph.vertices.select("id"), "id", "left_semi") for x in (u, v))
    total = 1.0 if u == v else 0.0
    for i in range(1, iters + 1):
        walk = lambda p: stored(shares.join(p.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("p")), "cosim")
        a, b = walk(a), walk(b)
        total += c**i * (a.join(b.withColumnRenamed("p", "q"), "id").agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0.0)
    return spark.createDataFrame([(float(total),)], "sim double")
