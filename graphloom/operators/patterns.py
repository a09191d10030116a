"""Triangles, cliques, cycles, cores, trusses and densest subgraphs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.graph import Graph
from graphloom.operators.primitives import dense_ranks, prefix_sums
from graphloom.runtime import forget, stored
from graphloom.state import PriorityBuckets, StateLog, bucketed, frontier_edges, keyed


def oriented(graph: Graph, order: DataFrame | None = None) -> DataFrame:
    """(src, dst): each undirected edge from its lower to its higher end by degree, then id (or by a given order (id, new)), so that a hub's out-degree stays small."""
    und = graph.und().select("src", "dst")
    if order is None:
        rank = Graph(graph.vertices, und.union(und.select("dst", "src")).withColumn("w", F.lit(1)), False).degrees().withColumnRenamed("degree", "r")
    else:
        rank = order.select("id", F.col("new").alias("r"))
    a, b = (rank.select(F.col("id").alias(x), F.col("r").alias(f"r_{x}")) for x in ("src", "dst"))
    up = (F.col("r_src") < F.col("r_dst")) | ((F.col("r_src") == F.col("r_dst")) & (F.col("src") < F.col("dst")))
    return und.join(a, "src").join(b, "dst").select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def cliques(graph: Graph, k: int = 3, order: DataFrame | None = None) -> DataFrame:
    """(v1 .. vk): every k-clique once, k >= 2, vertices in orientation order; each step extends cliques by a common out-neighbour."""
    if k < 2:
        raise ValueError("k >= 2")
    und = graph.und()
    if k > 3:  # a member has k - 1 neighbours at least
        both = und.select(F.col("src").alias("id")).union(und.select("dst")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k - 1)
        und = und.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    edges = stored(oriented(Graph(graph.vertices, und, True), order), "cliques")
    out = edges.select(F.col("src").alias("v1"), F.col("dst").alias("v2"))
    for n in range(3, k + 1):
        out = out.join(edges.select(F.col("src").alias("v1"), F.col("dst").alias(f"v{n}")), "v1")
        for m in range(2, n):
            out = out.join(edges.select(F.col("src").alias(f"v{m}"), F.col("dst").alias(f"v{n}")), [f"v{m}", f"v{n}"])
    return out.select(*(f"v{m}" for m in range(1, k + 1)))


def count_cliques(graph: Graph, k: int = 3, order: DataFrame | None = None) -> DataFrame:
    """(n): the number of k-cliques, k >= 2, without a row for any clique or part of one.

    Edges are oriented, so a vertex has few out-neighbours (at most the square root of twice the number of edges when by degree), kept as one sorted array. The
    arrays of a vertex's out-neighbours meet at the vertex, are cut to its own array as bit sets, and cliques among them are counted there.
    """
    if k < 2:
        raise ValueError("k >= 2")
    edges = oriented(graph, order)
    if k == 2:
        return edges.agg(F.count("*").alias("n"))
    edges = stored(edges, "cliques")
    near = bucketed(edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("near")), "src", "cliques")
    # a vertex without out-neighbours closes cliques of its in-neighbours: their own arrays name it
    ends = edges.join(near.select(F.col("src").alias("dst"), F.col("near").alias("theirs")), "dst").select("src", "theirs", "dst")
    own = near.where(F.size("near") >= k - 1)
    met = own.select("src", F.lit(None).cast("array<bigint>").alias("theirs"), F.lit(None).cast("bigint").alias("dst"), "near")
    met = met.unionByName(ends.join(own.select("src"), "src", "left_semi"), allowMissingColumns=True)
    # a vertex's own array comes before those of its neighbours
    dealt = met.repartition("src").sortWithinPartitions("src", F.col("dst").asc_nulls_first()).select("src", "dst", "near", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mine, bits = 0, np.zeros(0, np.int64), {}
        for batch in batches:
            for dst, near_, theirs in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if dst is None:
                    total += _inside(bits, len(mine), k - 1)
                    mine, bits = near_.values.to_numpy(), {}
                else:
                    found = np.flatnonzero(np.isin(mine, theirs.values.to_numpy(), assume_unique=True))
                    if len(found):
                        mask = np.zeros(len(mine), np.uint8)
                        mask[found] = 1
                        bits[int(np.searchsorted(mine, dst))] = int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")
        total += _inside(bits, len(mine), k - 1)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def _inside(bits: dict[int, int], n: int, k: int) -> int:
    """The k-cliques among n members, k >= 2, whose oriented neighbours are the set bits."""

    def extend(among: int, size: int) -> int:
        if size == 1:
            return among.bit_count()
        count, rest = 0, among
        while rest:
            low = rest & -rest
            rest ^= low
            count += extend(among & bits.get(low.bit_length() - 1, 0), size - 1)
        return count

    return extend((1 << n) - 1, k) if bits else 0


def members(found: DataFrame) -> DataFrame:
    """(id, n): how many of the cliques hold each vertex."""
    return found.select(F.explode(F.array(*found.columns)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def edge_triangles(graph: Graph) -> DataFrame:
    """(src, dst, common): how many neighbours the ends of each edge share, in both directions. Triangles are found once, along edges that lead to the
    higher degree, and counted for their three edges; a hub's neighbours are never paired with each other."""
    t = cliques(graph, 3)
    side = lambda a, b: t.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    held = side("v1", "v2").union(side("v1", "v3")).union(side("v2", "v3")).groupBy("src", "dst").agg(F.count("*").alias("common"))
    both = held.union(held.select("dst", "src", "common"))
    return graph.edges.select("src", "dst").join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0).cast("long")).alias("common"))


def sparsified(graph: Graph, colours: int = 0, share: float = 1.0, seed: int = 0) -> Graph:
    """Edges whose ends share a hashed colour (colours > 0), or a hashed share of the edges, for approximate counts."""
    if colours:
        of = lambda c: hash_priority(c, seed=seed) % colours
        return graph.filter_edges(lambda s, d, w: of(s) == of(d))
    return Graph(graph.vertices, graph.sample_edges(share, seed), graph.directed)


def five_cycles(graph: Graph) -> DataFrame:
    """(n): simple cycles of five vertices, each counted from its least vertex in one direction. Two-step paths above the least vertex are made once and joined end to end."""
    e = stored(graph.edges.where("src <> dst").select("src", "dst").distinct(), "cycles")
    # i - a - b and i - d - c with b - c, all above i
    two = e.select(F.col("src").alias("i"), F.col("dst").alias("a")).where("a > i").join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a").where("b > i")
    left = two.select("i", "a", "b")
    right = two.select("i", F.col("a").alias("d"), F.col("b").alias("c"))
    closed = left.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").join(right, ["i", "c"])
    return closed.where("a < d and a <> c and b <> d and b <> c").agg(F.count("*").alias("n"))


def core_numbers(graph: Graph) -> DataFrame:
    """(id, core): fixpoint of the h-index of neighbours' values, from degrees. Neighbours are counted by value first, so a hub's window has one row for each value.

    Values are bucketed as the edges are and travel along them: a round moves one number for each value next to a vertex."""
    edges, own = keyed(graph.edges, "src", "edges")
    plain = edges.where("src <> dst").select("src", "dst")
    state = bucketed(_degrees(graph, plain).select("id", F.col("degree").alias("core")), "id", "core")
    while True:
        new = _h_index(frontier_edges(plain, state, F.col("core").alias("v")).select(F.col("dst").alias("id"), "v"))
        moved = state.join(new, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0).cast("long"))).alias("core"), F.col("core").alias("old"))
        marked = Observation()
        last, state = state, bucketed(moved.observe(marked, F.count_if(F.col("core") != F.col("old")).alias("n")).drop("old"), "id", "core")
        forget(last)
        if not marked.get["n"]:
            if own:
                forget(edges)
            return state


def _h_index(values: DataFrame) -> DataFrame:
    """(id, h): the greatest h such that h of the values v are h at least."""
    counts = values.groupBy("id", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("id").orderBy(F.col("v").desc()))
    return counts.withColumn("upto", upto).groupBy("id").agg(F.max(F.least("v", "upto")).alias("h"))


def degeneracy_order(graph: Graph) -> DataFrame:
    """(id, round, core): exact peeling; all vertices whose remaining degree is at most the current core leave in one round. The order is (round, id).

    Vertices wait in priority buckets by remaining degree. A round takes the least bucket's, leaves out those that have moved on or left, and
    appends the new degrees of their neighbours: what it writes is what moves.
    """
    edges, own = keyed(graph.edges, "src", "edges")
    plain = edges.where("src <> dst").select("src", "dst")
    state = StateLog(_degrees(graph, plain).select("id", "degree", F.lit(None).cast("int").alias("round"), F.lit(None).cast("long").alias("core")), "peel")
    buckets = PriorityBuckets(edges.sparkSession, "peel")
    buckets.add(state.last().select("id", F.col("degree").alias("bucket")))
    k, number = 0, 0
    while (taken := buckets.pop()) is not None:
        k = max(k, taken[0])
        inside = state.current().where("core is null")
        gone = bucketed(inside.where(F.col("degree") <= k).join(taken[1], "id", "left_semi").select("id", "degree"), "id", "peel")
        lost = frontier_edges(plain, gone).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        left = inside.join(gone, "id", "left_anti").join(lost, "id").select("id", (F.col("degree") - F.col("n")).alias("degree"), F.lit(None).cast("int").alias("round"), F.lit(None).cast("long").alias("core"))
        out = gone.select("id", "degree", F.lit(number).alias("round"), F.lit(k).cast("long").alias("core"))
        moved = state.append(left.union(out))
        forget(gone)
        if moved:
            number += 1
            buckets.add(state.last().where("core is null").select("id", F.greatest(F.col("degree"), F.lit(k)).alias("bucket")))
    buckets.close()
    if own:
        forget(edges)
    return state.close().select("id", "round", "core")


def _degrees(graph: Graph, plain: DataFrame) -> DataFrame:
    """(id, degree) of every vertex over edges bucketed by src."""
    counts = plain.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def approximate_order(graph: Graph, epsilon: float = 0.1, rule: str = "share") -> DataFrame:
    """(id, round, core): rounds of at most logarithmic number. share: the 1 / (2 + epsilon) of lowest degree; threshold: all up to (1 + epsilon) times twice the mean degree."""

    def limit(rows: DataFrame) -> int | None:
        if rule == "share":
            return rows.agg(F.percentile_approx("degree", F.lit(1 / (2 + epsilon)), F.lit(10000))).first()[0]
        mean = rows.agg(F.avg("degree")).first()[0]
        return None if mean is None else math.ceil((1 + epsilon) * mean)

    edges, own = keyed(graph.edges, "src", "edges")
    plain, number, done = edges.where("src <> dst").select("src", "dst"), 0, []
    rows = bucketed(_degrees(graph, plain), "id", "order")
    while (k := limit(rows)) is not None:
        gone = bucketed(rows.where(F.col("degree") <= k).select("id", F.lit(number).alias("round"), F.lit(k).cast("long").alias("core")), "id", "order")
        done.append(gone)
        # vertices that left earlier are no rows any more, so all edges can stay
        lost = frontier_edges(plain, gone).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        last, rows = rows, bucketed(rows.join(gone, "id", "left_anti").join(lost, "id", "left").select("id", (F.col("degree") - F.coalesce("n", F.lit(0).cast("long"))).alias("degree")), "id", "order")
        forget(last)
        number += 1
    if own:
        forget(edges)
    if not done:
        return graph.vertices.select("id", F.lit(0).alias("round"), F.lit(0).cast("long").alias("core")).limit(0)
    return reduce(DataFrame.union, done)


def clique_cores(graph: Graph, k: int = 3) -> DataFrame:
    """(id, core): the greatest c such that the vertex is in a subgraph whose every vertex is in c of its k-cliques; an h-index fixpoint over cliques listed once."""
    found = cliques(graph, k).withColumn("c", F.monotonically_increasing_id())
    rows = stored(found.select("c", F.explode(F.array(*(f"v{m}" for m in range(1, k + 1)))).alias("id")), "clique-core")
    state = stored(graph.vertices.select("id").join(rows.groupBy("id").agg(F.count("*").alias("core")), "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core")), "clique-core")
    while True:
        valued = rows.join(state, "id")
        # the least value of a clique's other members: the least of all, or the second least where the vertex holds the least alone
        sides = valued.groupBy("c").agg(F.array_sort(F.collect_list("core")).alias("v"))
        others = valued.join(sides, "c").select("id", F.when(F.col("core") == F.col("v")[0], F.col("v")[1]).otherwise(F.col("v")[0]).alias("v"))
        moved = stored(state.join(_h_index(others), "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0).cast("long"))).alias("core"), F.col("core").alias("old")), "clique-core")
        state = moved.drop("old")
        if moved.where("core <> old").isEmpty():
            return state


def truss(graph: Graph, k: int = 3) -> DataFrame:
    """(src, dst): the edges of the k-truss (each in k - 2 triangles of it). An extra beyond the surveyed operators."""
    edges = stored(graph.und().select("src", "dst"), "truss")
    while True:
        t = cliques(Graph(graph.vertices, edges.withColumn("w", F.lit(1)), True), 3)
        pair = lambda a, b: t.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))  # noqa: B023, E731
        held = pair("v1", "v2").union(pair("v1", "v3")).union(pair("v2", "v3")).groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") >= k - 2)
        kept = stored(edges.join(held, ["src", "dst"], "left_semi") if k > 2 else edges, "truss")
        same = kept.count() == edges.count()
        forget(edges)
        if same:
            return kept
        edges = kept


def densest_peeling(graph: Graph, epsilon: float = 0.1) -> DataFrame:
    """(density): the best edges-to-vertices ratio over rounds that drop every vertex of degree at most 2 (1 + epsilon) times the current ratio."""
    best, edges = 0.0, stored(graph.edges.where("src <> dst").select("src", "dst"), "dense")
    left = graph.vertices.select("id")
    while True:
        rows = stored(Graph(left, edges.withColumn("w", F.lit(1)), False).degrees(), "dense")
        n, m = rows.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0))).first()
        if not n:
            return edges.sparkSession.createDataFrame([(best,)], "density double")
        best = max(best, m / 2 / n)
        left = stored(rows.where(F.col("degree") > (1 + epsilon) * m / n).select("id"), "dense")
        edges = stored(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "dense")


def suffix_density(graph: Graph, order: DataFrame) -> DataFrame:
    """(density): the best ratio over what is left before each round of an order (id, round): edges fall with their first end."""
    a, b = (order.select(F.col("id").alias(x), F.col("round").alias(f"r_{x}")) for x in ("src", "dst"))
    edges = graph.und().join(a, "src").join(b, "dst").groupBy(F.least("r_src", "r_dst").alias("round")).agg(F.count("*").alias("m"))
    rounds = order.groupBy("round").agg(F.count("*").alias("n")).join(edges, "round", "left")
    upto = prefix_sums(rounds.select((-F.col("round")).alias("key"), "n", F.coalesce("m", F.lit(0).cast("long")).alias("m")), "n", "m")
    return upto.select((F.col("m") / F.col("n")).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("density"))


def densest_greedy(graph: Graph) -> DataFrame:
    """(density): the best ratio along the exact peeling, half the optimum at least."""
    return suffix_density(graph, degeneracy_order(graph))


def balanced_loads(graph: Graph, rounds: int = 20) -> DataFrame:
    """(id, load): loads start at rounds times the core number; in each round every edge gives two units to its end of lesser load, or one to each of equal ends.

    Loads approach the fractional orientation of least greatest load, whose heaviest vertices are the densest subgraph; core numbers put them in
    its order at once. A round is one job with one exchange: the loads of the sources, bucketed as the edges are, travel to the other ends.
    """
    edges, own = keyed(graph.edges, "src", "edges")
    plain = edges.where("src <> dst").select("src", "dst")
    load = bucketed(core_numbers(Graph(graph.vertices, edges, graph.directed)).select("id", (rounds * F.col("core")).alias("load")), "id", "load")
    for _ in range(rounds):
        sent = frontier_edges(plain, load, "load").select(F.col("dst").alias("id"), F.col("load").alias("other")).groupBy("id", "other").agg(F.count("*").alias("n"))
        units = F.when(F.col("load") < F.col("other"), 2 * F.col("n")).when(F.col("load") == F.col("other"), F.col("n")).otherwise(0)
        # every vertex has a row of its own, so one without edges stays
        got = load.join(sent, "id", "left").groupBy("id", "load").agg(F.sum(units).alias("units"))
        last, load = load, bucketed(got.select("id", (F.col("load") + F.coalesce("units", F.lit(0).cast("long"))).alias("load")), "id", "load")
        forget(last)
    if own:
        forget(edges)
    return load


def densest_greedy_plus(graph: Graph, rounds: int = 20) -> DataFrame:
    """(density): the best edges-to-vertices ratio among the vertices of greatest load, after that many rounds of load balancing; equals by id.

    Peeling again and again with the loads of earlier peelings, as the greedy method does, needs a job for every level of every peeling;
    here the first peeling is the core numbers, and each further one is a round over all edges at once."""
    ranks = dense_ranks(balanced_loads(graph, rounds).select("id", "load"), [F.col("load").desc(), F.col("id")])
    order = stored(ranks.select("id", (-F.col("new")).alias("round")), "greedy")  # what has the least load falls first
    return suffix_density(graph, order).select(F.col("density").cast("double").alias("density"))


def densest_by_cliques(graph: Graph, k: int = 3, epsilon: float = 0.1) -> DataFrame:
    """(density): the best ratio of k-cliques to vertices over rounds that drop vertices in at most k (1 + epsilon) times the ratio of them."""
    found = stored(cliques(graph, k).withColumn("c", F.monotonically_increasing_id()), "clique-dense")
    left, best = stored(graph.vertices.select("id"), "clique-dense"), 0.0
    names = [f"v{m}" for m in range(1, k + 1)]
    while True:
        n, m = left.count(), found.count()
        if not n:
            return left.sparkSession.createDataFrame([(best,)], "density double")
        best = max(best, m / n)
        held = members(found.select(*names))
        left = stored(left.join(held, "id").where(F.col("n") > k * (1 + epsilon) * m / n).select("id"), "clique-dense")
        for v in names:
            found = found.join(left.withColumnRenamed("id", v), v, "left_semi")
        found = stored(found.select("c", *names), "clique-dense")
