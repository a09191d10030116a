"""Structural clustering (SCAN), modularity, label propagation and k-centre."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.graph import Graph
from graphloom.operators.components import star_components
from graphloom.operators.covering import independent_set
from graphloom.operators.paths import DynamicPaths, HeldDistances, labelled_distances, relax, seeds, sssp
from graphloom.operators.patterns import edge_triangles
from graphloom.operators.primitives import common_neighbours, dense_ranks
from graphloom.runtime import forget, stored
from graphloom.state import bucketed, frontier_edges, keyed

PLANE = 48
#: Centres up to which all candidates' distances are held.
HELD = 16


def similarities(graph: Graph, measure: str = "cosine") -> DataFrame:
    """(src, dst, sim) of every directed edge over closed neighbourhoods: cosine, weighted (cosine with weights, own weight 1) or jaccard."""
    edges = graph.edges.where("src <> dst")
    if measure == "weighted":
        e = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
        norm = graph.vertices.select("id").join(e.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("w")).alias("s")), "id", "left").select("id", F.sqrt(1 + F.coalesce("s", F.lit(0.0))).alias("norm"))
        third = e.join(e.select(F.col("src"), F.col("dst").alias("x"), F.col("w").alias("wx")), "src").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("x"), F.col("w").alias("wy")), ["dst", "x"]).groupBy("src", "dst").agg(F.sum(F.col("wx") * F.col("wy")).alias("dot"))
        a, b = (norm.select(F.col("id").alias(x), F.col("norm").alias(f"n_{x}")) for x in ("src", "dst"))
        return e.join(third, ["src", "dst"], "left").join(a, "src").join(b, "dst").select("src", "dst", ((F.coalesce("dot", F.lit(0.0)) + 2 * F.col("w")) / (F.col("n_src") * F.col("n_dst"))).alias("sim"))
    deg = edges.groupBy("src").agg(F.count("*").alias("d"))
    c = common_neighbours(graph, edges) if graph.directed else edge_triangles(Graph(graph.vertices, edges, False))
    rows = c.join(deg.withColumnRenamed("d", "d1"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    if measure == "cosine":
        sim = (F.col("common") + 2) / F.sqrt((F.col("d1") + 1) * (F.col("d2") + 1))
    elif measure == "jaccard":
        sim = (F.col("common") + 2) / (F.col("d1") + F.col("d2") - F.col("common"))
    else:
        raise ValueError("measure is cosine, weighted or jaccard")
    return rows.select("src", "dst", sim.alias("sim"))


def approximate_similarities(graph: Graph, measure: str = "jaccard", hashes: int = 128, seed: int = 0, threshold: int = 0) -> DataFrame:
    """(src, dst, sim) from sketches: one-permutation MinHash for jaccard (equal filled slots over slots filled in either), SimHash for cosine.

    Edges with an end of fewer neighbours than the threshold have their exact similarity, for which that end's neighbours are looked
    up, fewer than threshold an edge; only vertices of the other edges have sketches."""
    edges = graph.edges.where("src <> dst").select("src", "dst")
    if threshold <= 0:
        return _sketched(graph, edges, measure, hashes, seed)
    deg = stored(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "similar")
    a, b = (deg.select(F.col("id").alias(x), F.col("d").alias(f"d_{x}")) for x in ("src", "dst"))
    sized = stored(edges.join(a, "src").join(b, "dst", "left").na.fill(0, ["d_dst"]), "similar")  # a directed graph's ends may have no edges
    low = F.least("d_src", "d_dst") < threshold
    return _exact(graph, edges, sized.where(low), measure).union(_sketched(graph, sized.where(~low).select("src", "dst"), measure, hashes, seed))


def _exact(graph: Graph, edges: DataFrame, sized: DataFrame, measure: str) -> DataFrame:
    """(src, dst, sim) of the edges (src, dst, d_src, d_dst), by a look at the neighbours of the end that has fewer."""
    few, other = F.when(F.col("d_src") <= F.col("d_dst"), F.col("src")).otherwise(F.col("dst")), F.when(F.col("d_src") <= F.col("d_dst"), F.col("dst")).otherwise(F.col("src"))
    pairs = sized.select("src", "dst", few.alias("few"), other.alias("other"))
    seen = pairs.join(edges.select(F.col("src").alias("few"), F.col("dst").alias("x")), "few")
    both = seen.join(edges.select(F.col("src").alias("other"), F.col("dst").alias("x")), ["other", "x"]).groupBy("src", "dst").agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0)) + 2
    sim = c / F.sqrt((F.col("d_src") + 1) * (F.col("d_dst") + 1)) if measure == "cosine" else c / (F.col("d_src") + F.col("d_dst") + 2 - c)
    return sized.join(both, ["src", "dst"], "left").select("src", "dst", sim.alias("sim"))


def _sketched(graph: Graph, edges: DataFrame, measure: str, hashes: int, seed: int) -> DataFrame:
    """(src, dst, sim) of the edges (src, dst) from sketches of their ends."""
    closed = graph.edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("x")).union(graph.vertices.select("id", F.col("id").alias("x")))
    closed = closed.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_semi")
    if measure == "jaccard":
        h = hash_priority("x", seed=seed)
        sketch = stored(closed.groupBy("id", (h % hashes).alias("slot")).agg(F.min(h).alias("v")), "sketch")
        filled = sketch.groupBy("id").agg(F.count("*").alias("n"))
        both = edges.join(sketch.withColumnRenamed("id", "src"), "src").join(sketch.select(F.col("id").alias("dst"), "slot", F.col("v").alias("u")), ["dst", "slot"]).groupBy("src", "dst").agg(F.count("*").alias("both"), F.count_if(F.col("u") == F.col("v")).alias("same"))
        rows = edges.join(both, ["src", "dst"], "left").join(filled.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(filled.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst").na.fill(0, ["both", "same"])
        return rows.select("src", "dst", (F.col("same") / (F.col("a") + F.col("b") - F.col("both"))).alias("sim"))
    # PLANE signs from one hash; a vertex's signs are sums over its neighbours, packed into one long for each hash
    planes = range(-(-hashes // PLANE))
    bits = lambda k: range(min(PLANE, hashes - k * PLANE))
    hashed = closed.select("id", *(hash_priority("x", seed=seed + k).alias(f"h{k}") for k in planes))
    signs = hashed.groupBy("id").agg(*(F.sum(F.shiftright(f"h{k}", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"s{k}_{b}") for k in planes for b in bits(k)))
    word = lambda k: sum((F.when(F.col(f"s{k}_{b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in bits(k)), F.lit(0).cast("long"))
    sketch = stored(signs.select("id", *(word(k).alias(f"w{k}") for k in planes)), "sketch")
    side = lambda x: sketch.select(F.col("id").alias(x), *(F.col(f"w{k}").alias(f"{x}{k}") for k in planes))
    apart = sum((F.bit_count(F.col(f"src{k}").bitwiseXOR(F.col(f"dst{k}"))) for k in planes), F.lit(0)) / hashes
    return edges.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", F.cos(F.lit(3.141592653589793) * apart).alias("sim"))


def cores(graph: Graph, sims: DataFrame, mu: int, eps: float) -> DataFrame:
    """(id): vertices whose closed neighbourhood has mu members of similarity eps at least (themselves included)."""
    if mu <= 1:
        return graph.vertices.select("id")
    return sims.where(F.col("sim") >= eps).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= mu - 1).select("id")


def scan(graph: Graph, sims: DataFrame, mu: int, eps: float) -> DataFrame:
    """(id, cluster): cores connect through similar cores; a border vertex joins its most similar core's cluster (ties: least core); null is unclustered. A cluster is named by its least core."""
    return _clusters(graph.vertices.select("id"), stored(cores(graph, sims, mu, eps), "scan"), sims.where(F.col("sim") >= eps))


def _clusters(ids: DataFrame, core: DataFrame, near: DataFrame) -> DataFrame:
    inner = near.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
    label = core.join(star_components(inner.select("src", "dst")), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    label = stored(label, "scan")
    offers = near.join(core.select(F.col("id").alias("dst")), "dst", "left_anti").join(label.select(F.col("id").alias("src"), "cluster"), "src")
    best = F.min(F.struct((-F.col("sim")).alias("s"), "src", "cluster")).alias("b")
    border = offers.groupBy(F.col("dst").alias("id")).agg(best).select("id", "b.cluster")
    return ids.join(label.union(border), "id", "left")


class ScanIndex:
    """Similarities stored so that clusterings for any mu and eps read prefixes of them.

    Neighbour order: each vertex's neighbours by falling similarity, with their rank, in partitions by band of similarity, so
    those of at least eps are in the bands from eps on. Core order: for each mu the vertices with their mu-th greatest similarity (their
    own, 1, included), in partitions by the power of two of mu and by band of that similarity. Ranks are counted within a vertex, whose
    rows are split by band first: a hub's neighbours are ordered band by band and no task orders them all.
    """

    BANDS = 20

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, graph: Graph, sims: DataFrame, folder: str) -> ScanIndex:
        """Write the index of similarities (src, dst, sim) to a folder that all executors share."""
        index = cls(sims.sparkSession, folder)
        band = F.least(F.floor(F.col("sim") * cls.BANDS), F.lit(cls.BANDS)).cast("int")
        rows = stored(sims.select("src", "dst", "sim", band.alias("band")), "scan-index")
        counts = rows.groupBy("src", "band").agg(F.count("*").alias("n"))
        higher = F.sum("n").over(Window.partitionBy("src").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1))  # a row for each band
        before = counts.select("src", "band", F.coalesce(higher, F.lit(0)).alias("before"))
        inside = F.row_number().over(Window.partitionBy("src", "band").orderBy(F.col("sim").desc(), "dst"))
        ranked = rows.withColumn("inside", inside).join(before, ["src", "band"]).select("src", "dst", "sim", (F.col("inside") + F.col("before")).alias("rank"), "band")
        graph.vertices.select("id").write.mode("overwrite").parquet(f"{index.folder}/vertices")
        ranked.sortWithinPartitions("band", "src", "rank").write.mode("overwrite").partitionBy("band").parquet(f"{index.folder}/neighbours")
        # with rank r, a vertex has r + 1 members of its closed neighbourhood at this similarity
        cores = spark_read(index, "neighbours", NEIGHBOUR_ORDER).select((F.col("rank") + 1).alias("mu"), F.col("src").alias("id"), F.col("sim").alias("threshold"), "band")
        cores = cores.withColumn("power", F.floor(F.log2(F.col("mu").cast("double"))).cast("int"))
        cores.sortWithinPartitions("power", "band", "mu", F.col("threshold").desc()).write.mode("overwrite").partitionBy("power", "band").parquet(f"{index.folder}/cores")
        forget(rows)
        return index

    def near(self, eps: float) -> DataFrame:
        """(src, dst, sim): the prefix of every vertex's neighbour order with similarity of eps at least."""
        rows = spark_read(self, "neighbours", NEIGHBOUR_ORDER).where((F.col("band") >= self._band(eps)) & (F.col("sim") >= eps))
        return rows.select("src", "dst", "sim")

    def cores(self, mu: int, eps: float) -> DataFrame:
        """(id): the prefix of the core order of mu."""
        if mu <= 1:
            return self.spark.read.schema("id long").parquet(f"{self.folder}/vertices")
        rows = spark_read(self, "cores", CORE_ORDER).where((F.col("power") == mu.bit_length() - 1) & (F.col("band") >= self._band(eps)))
        return rows.where((F.col("mu") == mu) & (F.col("threshold") >= eps)).select("id")

    def _band(self, eps: float) -> int:
        return min(self.BANDS, math.floor(eps * self.BANDS))

    def scan(self, mu: int, eps: float) -> DataFrame:
        """(id, cluster) as scan() gives it."""
        return _clusters(self.spark.read.schema("id long").parquet(f"{self.folder}/vertices"), stored(self.cores(mu, eps), "scan"), self.near(eps))


NEIGHBOUR_ORDER, CORE_ORDER = "src long, dst long, sim double, rank long, band int", "mu long, id long, threshold double, power int, band int"


def spark_read(index: ScanIndex, part: str, schema: str) -> DataFrame:
    return index.spark.read.schema(schema).parquet(f"{index.folder}/{part}")


def scan_sweep(graph: Graph, sims: DataFrame, mu: int, eps: Iterable[float], callback: Callable[[float, DataFrame], None] | None = None) -> Iterator[tuple[float, DataFrame]]:
    """Clusterings for several eps over one table of similarities."""
    for e in eps:
        out = scan(graph, sims, mu, e)
        if callback:
            callback(e, out)
        yield e, out


def scan_overlapping(graph: Graph, sims: DataFrame, mu: int, eps: float) -> DataFrame:
    """(id, clusters): every cluster that a vertex is a core of or borders, sorted."""
    core = stored(cores(graph, sims, mu, eps), "scan")
    near = sims.where(F.col("sim") >= eps)
    inner = near.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
    label = core.join(star_components(inner.select("src", "dst")), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    label = stored(label, "scan")
    border = near.join(core.select(F.col("id").alias("dst")), "dst", "left_anti").join(label.select(F.col("id").alias("src"), "cluster"), "src").select(F.col("dst").alias("id"), "cluster")
    both = label.union(border).groupBy("id").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))
    return graph.vertices.select("id").join(both, "id", "left").select("id", F.coalesce("clusters", F.array().cast("array<bigint>")).alias("clusters"))


def roles(graph: Graph, clusters: DataFrame) -> DataFrame:
    """(id, role): member, hub (neighbours in two clusters) or outlier."""
    near = graph.edges.join(clusters.where("cluster is not null").select(F.col("id").alias("dst"), F.col("cluster").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("c").alias("n"))
    return clusters.join(near, "id", "left").select("id", F.when(F.col("cluster").isNotNull(), "member").when(F.col("n") >= 2, "hub").otherwise("outlier").alias("role"))


def modularity(graph: Graph, clusters: DataFrame, weighted: bool = False) -> DataFrame:
    """(q): unclustered vertices are clusters of their own; 0 without edges."""
    named = clusters.select("id", F.when(F.col("cluster").isNull(), F.struct(F.lit(1).alias("a"), F.col("id").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.col("cluster").alias("b"))).alias("c"))
    a, b = (named.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    per = graph.edges.join(a, "src").join(b, "dst").groupBy("c_src").agg(F.sum(w).alias("k"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), w).otherwise(0.0)).alias("inside"))
    total = per.agg(F.sum("k").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.select(F.when(F.col("m") > 0, F.col("i") / F.col("m") - F.col("kk") / (F.col("m") * F.col("m"))).otherwise(0.0).alias("q"))


def cluster_stats(graph: Graph, clusters: DataFrame) -> DataFrame:
    """(clusters, clustered, crossing): number of clusters, their members, and undirected edges between different ones."""
    a, b = (clusters.where("cluster is not null").select(F.col("id").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    cross = graph.und().join(a, "src").join(b, "dst").where("c_src <> c_dst").agg(F.count("*").alias("crossing"))
    return clusters.agg(F.count_distinct("cluster").alias("clusters"), F.count("cluster").alias("clustered")).join(cross)


def label_propagation(graph: Graph, rounds: int = 100) -> DataFrame:
    """(id, label): synchronous; every vertex takes the label of greatest weight among its neighbours, the largest of equals; isolated ones keep their own.

    What it gives is the state after so many rounds; labels that no longer change, or that swap between two states for ever, need no more of them."""
    edges, own = keyed(graph.transpose().edges if graph.directed else graph.edges, "src", "edges")
    state = bucketed(graph.vertices.select("id", F.col("id").alias("label"), F.lit(None).cast("long").alias("before")), "id", "lpa")
    for done in range(1, rounds + 1):
        votes = frontier_edges(edges, state, "label").groupBy(F.col("dst").alias("id"), "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.max(F.struct("w", "label")).alias("b")).select("id", F.col("b.label").alias("new"))
        new, seen = F.coalesce("new", "label"), Observation()
        moved = state.join(best, "id", "left").select("id", new.alias("label"), F.col("label").alias("before"), F.col("before").alias("older"))
        moved = moved.observe(seen, F.count_if(F.col("label") != F.col("before")).alias("n"), F.count_if(~F.col("label").eqNullSafe(F.col("older"))).alias("m"))
        last, state = state, bucketed(moved.drop("older"), "id", "lpa")
        forget(last)
        if not seen.get["n"] or not seen.get["m"]:
            if (rounds - done) % 2:
                state = state.select("id", F.col("before").alias("label"))
            break
    if own:
        forget(edges)
    return state.select("id", "label")


def centre_quality(graph: Graph, centres: list[int]) -> DataFrame:
    """(radius, unreachable): the greatest finite distance to a centre, and the vertices that reach none."""
    dist = sssp(graph, centres)
    return graph.vertices.select("id").join(dist, "id", "left").agg(F.max("dist").alias("radius"), F.count_if(F.col("dist").isNull()).alias("unreachable"))


def k_centres(graph: Graph, k: int, first: int | None = None, epsilon: float | None = None, seed: int = 0) -> DataFrame:
    """(position, id, radius): farthest-point centres, unreachable vertices first; radius is the greatest finite distance once the centre is in.

    With epsilon the next centre is any vertex of the farthest bucket of ratio 1 + epsilon / 2, by hash. Distances follow each new centre by repair."""
    import math

    start = graph.vertices.agg(F.min("id")).first()[0] if first is None else first
    if start is None:
        return graph.vertices.sparkSession.createDataFrame([], "position int, id long, radius double")
    paths, out = DynamicPaths(graph, start, support=False), []
    for position in range(k):
        radius = paths.state.agg(F.max("dist")).first()[0]
        out.append((position, int(start), float(radius)))
        if position == k - 1:
            break
        every = graph.vertices.select("id").join(paths.state, "id", "left")
        if epsilon is None:
            far = every.agg(F.min(F.struct(F.col("dist").isNotNull().alias("r"), (-F.col("dist")).alias("d"), "id")).alias("x")).first().x
            done = far.d == 0 and far.r
        else:
            bucket = F.when(F.col("dist").isNull(), F.lit(float("inf"))).when(F.col("dist") <= 0, F.lit(-1.0)).otherwise(F.ceil(F.log("dist") / math.log1p(epsilon / 2)).cast("double"))
            far = every.agg(F.min(F.struct((-bucket).alias("d"), hash_priority("id", seed=seed).alias("h"), "id")).alias("x")).first().x
            done = far.d == 1
        if done:
            break
        start = far.id
        paths.insert_source(int(start))
    return graph.vertices.sparkSession.createDataFrame(out, "position int, id long, radius double")


def apart(graph: Graph, candidates: DataFrame, radius: float) -> DataFrame:
    """(id): the candidates (id) that no other one reaches within the radius.

    A separating family settles it: candidates are numbered, and two numbers differ in some bit. For each bit and value the distances
    from the candidates that have it are a column of one relaxation, two for each bit of the greatest number; a candidate is apart
    if the opposite column is empty at it for every bit."""
    numbered = stored(dense_ranks(candidates.select("id").join(graph.vertices.select("id"), "id", "left_semi").distinct()), "apart")
    bits = range(max(numbered.count() - 1, 0).bit_length())
    if not bits:
        return numbered.select("id")
    bit = lambda k: F.shiftright("new", k).bitwiseAND(F.lit(1))
    zero = F.lit(0).cast(graph.edges.schema["w"].dataType)
    start = numbered.select("id", *(F.when(bit(k) == v, zero).alias(f"d{k}_{v}") for k in bits for v in (0, 1)))
    dist = labelled_distances(graph, start, radius)
    met = F.lit(False)
    for k in bits:
        met = met | F.when(bit(k) == 1, F.col(f"d{k}_0").isNotNull()).otherwise(F.col(f"d{k}_1").isNotNull())
    out = stored(numbered.join(dist, "id").where(~met).select("id"), "apart")
    forget(numbered, dist)
    return out


def _cover_within(graph: Graph, radius: float, k: int, seed: int, sampled: bool, runs: list | None = None, held: HeldDistances | None = None) -> list[int] | None:
    """Centres, no two within the radius, that leave nothing farther; None once more than k are needed.

    sampled: up to k candidates at once, in a hashed order that is another one for each trial; those apart from all others are centres.
    A trial takes twice as many candidates as the last one where half of those were apart, and half as many where less than a quarter
    was; a single one always is. The number of trials grows with the logarithm of the number of centres. runs gets each trial's size.
    held: candidates' distances of all radii, for few candidates; without it each radius relaxes anew up to itself."""
    left, centres, most, trial = graph.vertices.select("id"), [], k if sampled else 1, 0
    if held is None:
        left = stored(left, "kcentre")
    while True:
        full = len(centres) >= k
        pool = [r.id for r in left.orderBy(hash_priority("id", seed=seed + trial if sampled else seed), "id").limit(1 if full else most).collect()]  # at most k
        if full or not pool:
            forget(left)
            return None if pool else centres
        trial += 1
        if runs is not None:
            runs.append(most)
        if most == 1:
            chosen = pool
        elif held is not None:
            chosen = held.apart(pool, radius)
        else:
            chosen = [r.id for r in apart(graph, seeds(graph, pool), radius).collect()]
        tried = most
        if sampled:
            most = min(k, most * 2) if 2 * len(chosen) >= tried else max(1, most // 2) if 4 * len(chosen) < tried else most
        if len(centres) + len(chosen) > k:
            forget(left)
            return None
        if not chosen:
            continue
        centres += chosen
        if held is not None:
            left = held.beyond(centres, radius)
            continue
        near = relax(graph, seeds(graph, chosen, 0), cap=radius)[0]
        last, left = left, stored(left.join(near, "id", "left_anti"), "kcentre")
        forget(last, near)


def k_centres_by_radius(graph: Graph, k: int, seed: int = 0, sampled: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(position, id, radius): centres for the least radius, doubled and then halved in, at which a greedy (or, sampled, batchwise) distance-independent set of at most k vertices covers the graph; no rows if none does.

    Up to HELD centres, each candidate's distances are found once for all radii."""
    spark, low, high = graph.vertices.sparkSession, 0, 1
    total, least = graph.edges.agg(F.sum("w"), F.min("w")).first()
    if (least or 0) < 0:
        raise ValueError("k centres need weights of 0 or more")
    held = HeldDistances(graph) if k <= HELD else None
    best = _cover_within(graph, 0, k, seed, sampled, held=held)
    if best is None:
        top = (total or 0) + 1
        while (best := _cover_within(graph, high, k, seed, sampled, held=held)) is None and high < top:
            low, high = high, high * 2
        whole = dict(graph.edges.dtypes)["w"] in ("int", "bigint")
        while best is not None and ((high - low > 1) if whole and not tolerance else (high - low > max(tolerance, 1e-3) * high)):
            mid = (low + high) // 2 if whole and not tolerance else (low + high) / 2
            found = _cover_within(graph, mid, k, seed, sampled, held=held)
            low, high, best = (low, mid, found) if found is not None else (mid, high, best)
    else:
        high = 0
    if held is not None:
        held.close()
    return spark.createDataFrame([(i, int(c), float(high)) for i, c in enumerate(best or [])], "position int, id long, radius double")


def centre_assignment(graph: Graph, centres: list[int]) -> DataFrame:
    """(id, cluster): each vertex's nearest centre, the least of equally near ones; null where none is reached."""
    dist = stored(sssp(graph, centres), "centres")
    state = stored(dist.select("id", F.when(F.col("id").isin(centres), F.col("id")).alias("cluster")), "centres")
    a, b = (dist.select(F.col("id").alias(x), F.col("dist").alias(f"d_{x}")) for x in ("src", "dst"))
    down = stored(graph.edges.join(a, "src").join(b, "dst").where("d_src + w = d_dst").select("src", "dst"), "centres")
    while True:
        got = down.join(state.select(F.col("id").alias("src"), "cluster"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("cluster").alias("new"))
        moved = stored(state.join(got, "id", "left").select("id", F.least("cluster", "new").alias("cluster"), F.col("cluster").alias("old")), "centres")
        state = moved.drop("old")
        if moved.where("not (cluster <=> old)").isEmpty():
            return graph.vertices.select("id").join(state, "id", "left")


def distance_independent_set(graph: Graph, hops: int, order: str = "id") -> DataFrame:
    """(id): a maximal set of vertices with pairwise distances above hops: the first maximal independent set of the power graph."""
    near = graph.edges.select("src", "dst")
    power = near
    for _ in range(hops - 1):
        power = power.union(power.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("x")), "dst").select("src", F.col("x").alias("dst"))).where("src <> dst").distinct()
    return independent_set(Graph(graph.vertices, stored(power.withColumn("w", F.lit(1)), "power"), False), order)
