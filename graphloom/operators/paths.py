"""Traversal and shortest paths: rounds of joins from a frontier, one action a round, state in the shared folder.

All results are deterministic: the least parent wins, unreached vertices are absent from distance frames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.graph import Graph
from graphloom.operators.components import star_components
from graphloom.runtime import finished, forget, kept, new_folder, stored
from graphloom.state import PriorityBuckets, StateLog, bucketed, frontier_edges, keyed


class NegativeCycleError(ValueError):
    """A shorter path was found after as many rounds as there are vertices."""


def seeds(graph: Graph, sources: int | Iterable[int] | DataFrame, value: float = 0) -> DataFrame:
    """(id, dist) of the sources that are vertices."""
    if isinstance(sources, DataFrame):
        rows = sources if "dist" in sources.columns else sources.withColumn("dist", F.lit(value))
    else:
        ids = [sources] if isinstance(sources, int) else list(sources)
        rows = graph.vertices.sparkSession.createDataFrame([(int(i), value) for i in ids], f"id long, dist {'long' if isinstance(value, int) else 'double'}")
    return rows.select("id", "dist").join(graph.vertices.select("id"), "id", "left_semi")


def bfs_distance(graph: Graph, sources, cap: int | None = None) -> DataFrame:
    """(id, dist): hops from the nearest source, up to cap. A round moves the vertices next to the frontier, no edge, and writes the new ones."""
    edges, own = keyed(graph.edges, "src", "edges")
    log, level = StateLog(seeds(graph, sources, 0).select("id").distinct().withColumn("dist", F.lit(0)), "bfs"), 0
    while log.changed and (cap is None or level < cap):
        level += 1
        ahead = frontier_edges(edges, log.last()).select(F.col("dst").alias("id")).distinct()
        log.append(ahead.join(log.current().select("id"), "id", "left_anti").withColumn("dist", F.lit(level)))
    if own:
        forget(edges)
    return log.close()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def bfs(graph: Graph, source) -> DataFrame:
    """(id, parent): a breadth-first tree in which the least neighbour of the level before is the parent, and a source is its own."""
    dist = stored(bfs_distance(graph, source), "bfs")
    return bfs_parents(graph, dist)


def bfs_parents(graph: Graph, dist: DataFrame) -> DataFrame:
    """(id, parent) from hop distances; the edges that run from one level to the next are joined once."""
    up = dist.select(F.col("id").alias("src"), (F.col("dist") + 1).alias("next"))
    down = dist.select(F.col("id").alias("dst"), F.col("dist").alias("next"))
    parent = graph.edges.join(up, "src").join(down, ["dst", "next"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return dist.select("id").join(parent, "id", "left").select("id", F.coalesce("parent", "id").alias("parent"))


def relax(graph: Graph, start: DataFrame, state: DataFrame | None = None, cap: float | None = None, delta: float | None = None, widest: bool = False, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds of relaxation from start (id, dist) over state (id, dist): the final state, and the rows that changed.

    Only changed rows join the edges, and only improved ones are written. With delta the rows of the least bucket alone are taken, as in
    delta-stepping, from priority buckets: an id that has left its bucket is dropped when the bucket comes.
    widest: the bottleneck is maximised instead of the sum minimised."""
    better = F.max if widest else F.min
    gains = F.col("new") > F.col("dist") if widest else F.col("new") < F.col("dist")
    offer = (lambda d, w: F.least(d, w)) if widest else (lambda d, w: d + w)
    edges, own = keyed(graph.edges, "src", "edges")
    first = start.groupBy("id").agg(better("dist").alias("dist"))
    old = None
    if state is None:
        log = StateLog(first, "relax")
    else:
        old, new = keyed(state.select("id", "dist"), "id", "relax")
        log = StateLog(old, "relax")
        log.append(_improved(first, old, gains))
    if rounds is None:
        rounds = graph.vertices.count() + 1
    buckets, spent = None, 0
    if delta is not None:
        buckets = PriorityBuckets(edges.sparkSession, "relax")
        of = F.floor(F.col("dist") / delta).cast("long").alias("bucket")
        buckets.add(log.last().select("id", of))
    while True:
        if buckets is None:
            if not log.changed:
                break
            if spent >= rounds:
                raise NegativeCycleError("negative cycle")
            active, spent = log.last(), spent + 1
        else:
            taken = buckets.pop()
            if taken is None:
                break
            active = log.current().where(of == taken[0]).join(taken[1], "id", "left_semi")
        offers = frontier_edges(edges, active, "dist").groupBy(F.col("dst").alias("id")).agg(better(offer(F.col("dist"), F.col("w"))).alias("dist"))
        if cap is not None:
            offers = offers.where(F.col("dist") <= cap)
        log.append(_improved(offers, log.current(), gains))
        if buckets is not None and log.changed:
            buckets.add(log.last().select("id", of))
    if own:
        forget(edges)
    if buckets is not None:
        buckets.close()
    final = log.close()
    if state is None:
        return final, final
    changed = stored(_improved(final, old, gains), "relax")
    if new:
        forget(old)
    return final, changed


def labelled_distances(graph: Graph, start: DataFrame, cap: float) -> DataFrame:
    """(id, ...): for each column of start (id, ...), the distances up to cap from the rows that have a value there (weights of 0 or more).

    All columns are relaxed together: a round joins the rows that changed with the edges once, whatever the number of columns."""
    names = [c for c in start.columns if c != "id"]
    edges, own = keyed(graph.edges, "src", "edges")
    log = StateLog(start.groupBy("id").agg(*(F.min(c).alias(c) for c in names)), "labelled")
    far = lambda c: F.when(F.col(c) + F.col("w") <= cap, F.col(c) + F.col("w"))
    while log.changed:
        offers = frontier_edges(edges, log.last(), *names).groupBy(F.col("dst").alias("id")).agg(*(F.min(far(c)).alias(f"new_{c}") for c in names))
        gains = F.lit(False)
        for c in names:
            gains = gains | (F.col(f"new_{c}").isNotNull() & (F.col(c).isNull() | (F.col(f"new_{c}") < F.col(c))))
        log.append(offers.join(log.current(), "id", "left").where(gains).select("id", *(F.least(c, f"new_{c}").alias(c) for c in names)))
    if own:
        forget(edges)
    return log.close()


def without_paths(graph: Graph) -> tuple[Graph, list[DataFrame]]:
    """The graph without vertices of at most two neighbours, stored, and the levels in which they went: (v, other, leaves, enters).

    A level takes out the vertices whose hash is less than that of their neighbours with at most two of their own, and puts edges between the
    two neighbours of each, as long as the way through it. So distances between those that stay are as before, and a path of n vertices goes in
    some log n levels. leaves and enters are the weights to and from a neighbour when v went."""
    edges, levels = stored(graph.edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "level"), []
    while True:
        ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
        low = ends.groupBy("id").agg(F.count("*").alias("n"), F.array_distinct(F.array(F.min("other"), F.max("other"))).alias("others")).where("n <= 2")
        low = stored(low.select("id", "others", F.struct(hash_priority("id", seed=len(levels)).alias("h"), "id").alias("place")), "level")
        pairs = low.select("id", "place", F.explode("others").alias("other")).join(low.select(F.col("id").alias("other"), F.col("place").alias("before")), "other")
        gone = low.select(F.col("id").alias("v")).join(pairs.where("before < place").select(F.col("id").alias("v")), "v", "left_anti")
        none = F.lit(None).cast(edges.schema["w"].dataType)
        leaves = edges.withColumnRenamed("src", "v").join(gone, "v").select("v", F.col("dst").alias("other"), F.col("w").alias("leaves"), none.alias("enters"))
        enters = edges.withColumnRenamed("dst", "v").join(gone, "v").select("v", F.col("src").alias("other"), none.alias("leaves"), F.col("w").alias("enters"))
        level = stored(leaves.union(enters).groupBy("v", "other").agg(F.min("leaves").alias("leaves"), F.min("enters").alias("enters")), "level")
        forget(low)
        if level.isEmpty():
            forget(level)
            break
        levels.append(level)
        gone = level.select("v").distinct()
        through = level.select("v", F.col("other").alias("src"), "enters").join(level.select("v", F.col("other").alias("dst"), "leaves"), "v")
        through = through.where("src <> dst and enters is not null and leaves is not null").select("src", "dst", (F.col("enters") + F.col("leaves")).alias("w"))
        kept = edges.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti")
        last, edges = edges, stored(kept.select("src", "dst", "w").union(through).groupBy("src", "dst").agg(F.min("w").alias("w")), "level")
        forget(last)
    ids = graph.vertices
    if levels:
        ids = ids.join(_union([x.select(F.col("v").alias("id")) for x in levels]).distinct(), "id", "left_anti")
    core = Graph(ids, edges, graph.directed).store()
    forget(edges)
    return core, levels


class HeldDistances:
    """Distances from single vertices to all they reach (weights of 0 or more), each found once and held as a column of a table bucketed by id.

    They are relaxed on the graph without its paths, so the rounds follow what is left of its depth, and put back level by level."""

    def __init__(self, graph: Graph):
        self.graph, self.core, self.levels = graph, None, []
        self.tables: list[tuple[DataFrame, list[int], dict[int, dict]]] = []
        self.runs = 0

    def find(self, ids: list[int]) -> None:
        """Hold the distances from these vertices, those that aren't yet in one relaxation."""
        held = {c for _, own, _ in self.tables for c in own}
        new = [c for c in dict.fromkeys(ids) if c not in held]
        if not new:
            return
        if self.core is None:
            self.core, self.levels = without_paths(self.graph)
        self.runs += 1
        kind = self.graph.edges.schema["w"].dataType
        zero = 0 if kind.typeName() in ("integer", "long") else 0.0
        names = [f"d{c}" for c in new]
        columns = "id long, " + ", ".join(f"`{n}` {kind.simpleString()}" for n in names)
        start, at = self._upwards({c: {c: zero} for c in new})
        spark = self.graph.vertices.sparkSession
        rows = lambda some: spark.createDataFrame([(v, *(start[v].get(c) for c in new)) for v in some], columns)
        parts = [labelled_distances(self.core, rows([v for v in start if v not in at]), float("inf"))]
        for k in reversed(range(len(self.levels))):
            offers = self.levels[k].where("enters is not null").join(_union(parts).withColumnRenamed("id", "other"), "other").select(F.col("v").alias("id"), *((F.col(n) + F.col("enters")).alias(n) for n in names))
            own = [v for v in start if at.get(v) == k]
            if own:
                offers = offers.union(rows(own))
            parts.append(stored(offers.groupBy("id").agg(*(F.min(n).alias(n) for n in names)), "held"))
        self.tables.append((bucketed(_union(parts), "id", "held"), new, {}))
        forget(*parts)

    def _upwards(self, start: dict[int, dict]) -> tuple[dict[int, dict], dict[int, int]]:
        """Distances from the sources along vertices that went ever later, and the level of each that went: a source meets at most two of a level."""
        at: dict[int, int] = {}
        if not self.levels:
            return start, at
        steps = _union([x.select("v", "other", "leaves", F.lit(k).alias("level")) for k, x in enumerate(self.levels)])
        ahead, seen, ways = set(start), set(start), {}
        while ahead:
            found = steps.where(F.col("v").isin(sorted(ahead))).collect()
            for r in found:
                at[r.v] = r.level
                ways.setdefault(r.v, []).append((r.other, r.leaves))
            ahead = {r.other for r in found} - seen
            seen |= ahead
        for v in sorted(ways, key=at.get):
            for other, w in ways[v]:
                for c, d in start.get(v, {}).items() if w is not None else ():
                    own = start.setdefault(other, {})
                    own[c] = min(own.get(c, d + w), d + w)
        return start, at

    def apart(self, ids: list[int], radius: float) -> list[int]:
        """Those of some vertices that no other one of them reaches within the radius."""
        self.find(ids)
        met = set()
        for table, own, rows in self.tables:
            some = [c for c in own if c in ids]
            lack = [v for v in ids if v not in rows]
            if some and lack:
                found = {r.id: r for r in table.where(F.col("id").isin(lack)).collect()}
                rows.update({v: found.get(v) for v in lack})
            for c in some:
                met.update(v for v in ids if v != c and rows[v] is not None and rows[v][f"d{c}"] is not None and rows[v][f"d{c}"] <= radius)
        return [v for v in ids if v not in met]

    def beyond(self, sources: list[int], radius: float) -> DataFrame:
        """(id): the vertices that none of the sources reaches within the radius."""
        self.find(sources)
        out = self.graph.vertices.select("id")
        for table, own, _ in self.tables:
            some = [c for c in own if c in sources]
            if some:
                near = F.coalesce(F.least(*(F.col(f"d{c}") for c in some), F.lit(None)) <= radius, F.lit(False))
                out = out.join(table.where(near).select("id"), "id", "left_anti")
        return out

    def close(self) -> None:
        forget(*self.levels, *(table for table, *_ in self.tables))
        if self.core is not None:
            forget(self.core.vertices, self.core.edges)


def _improved(offers: DataFrame, known: DataFrame, gains: Column) -> DataFrame:
    """The offers (id, dist) that no known row (id, dist) is as good as."""
    both = offers.select("id", F.col("dist").alias("new")).join(known.select("id", "dist"), "id", "left")
    return both.where(F.col("dist").isNull() | gains).select("id", F.col("new").alias("dist"))


def sssp(graph: Graph, sources, cap: float | None = None, delta: float | None = None) -> DataFrame:
    """(id, dist): least sums of weights from the nearest source; raises NegativeCycleError."""
    zero = 0 if dict(graph.edges.dtypes)["w"] in ("int", "bigint") else 0.0
    return relax(graph, seeds(graph, sources, zero), cap=cap, delta=delta)[0]


def repair(graph: Graph, state: DataFrame, improved: DataFrame, hops: bool = False) -> tuple[DataFrame, DataFrame]:
    """After distances fell at improved (id, dist): the repaired distances, and the affected rows. hops: every edge counts 1."""
    g = Graph(graph.vertices, graph.edges.withColumn("w", F.lit(1)), graph.directed) if hops else graph
    return relax(g, improved.select("id", "dist"), state.select("id", "dist"))


def widest_path(graph: Graph, sources, top: int = (1 << 31) - 1) -> DataFrame:
    """(id, width): the greatest bottleneck of a path from a source; sources have top, unreached vertices are absent."""
    return relax(graph, seeds(graph, sources, top), widest=True)[0].withColumnRenamed("dist", "width")


def betweenness(graph: Graph, source: int) -> DataFrame:
    """(id, score): single-source dependencies of the reached vertices (the source's own included), by path counts down and dependencies up the levels."""
    level = stored(bfs_distance(graph, source), "bc")
    a, b = level.select(F.col("id").alias("src"), F.col("dist").alias("d")), level.select(F.col("id").alias("dst"), (F.col("dist") - 1).alias("d"))
    down = stored(graph.edges.select("src", "dst").join(a, "src").join(b, ["dst", "d"]).select("src", "dst", "d"), "bc")
    depth = level.agg(F.max("dist")).first()[0]
    if depth is None:
        return level.select("id", F.lit(0.0).alias("score"))
    paths = stored(level.where("dist = 0").select("id", F.lit(1.0).alias("paths")), "bc")
    every, last = paths, paths
    for d in range(depth):
        last = stored(down.where(F.col("d") == d).join(last.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")), "bc")
        every = every.union(last)
    every = stored(every, "bc")
    scores = stored(level.where(F.col("dist") == depth).select("id", F.lit(0.0).alias("score")), "bc")
    out, last = scores, scores
    for d in range(depth - 1, -1, -1):
        hit = down.where(F.col("d") == d).join(last.select(F.col("id").alias("dst"), "score"), "dst").join(every.select(F.col("id").alias("dst"), F.col("paths").alias("below")), "dst").join(every.select(F.col("id").alias("src"), "paths"), "src")
        sums = hit.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("paths") / F.col("below") * (1 + F.col("score"))).alias("score"))
        last = stored(level.where(F.col("dist") == d).select("id").join(sums, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), "bc")
        out = out.union(last)
    return out


class DynamicPaths:
    """Shortest paths that follow edge insertions and new sources, with the edges on some shortest path.

    A batch writes the edges it inserts, the distances that fell, and what changed among the support edges; the state is read as the last
    row of each id. Every COMPACT batches edges, distances and support are written together, and what they replace is deleted.
    With a folder each batch has a number and leaves its part there: a new object goes on from the last one, and a batch
    that is given again starts from the state before it. Batches up to the last compaction are settled; they can't come again.
    """

    COMPACT = 16
    KINDS = ("edges", "dist", "support")

    def __init__(self, graph: Graph, sources, folder: str | None = None, support: bool = True):
        """support=False keeps distances alone."""
        self.kinds = self.KINDS if support else self.KINDS[:2]
        self.base, self.spark, self.number = graph, graph.edges.sparkSession, 0
        self.durable, self.folder = folder is not None, folder.rstrip("/") if folder else new_folder(graph.edges.sparkSession, "dynamic")
        if not finished(self.spark, f"{self.folder}/whole-dist"):
            dist = sssp(graph, sources)
            kept(graph.edges.limit(0).select("src", "dst", "w"), f"{self.folder}/whole-edges/-1")
            if support:
                kept(self._tight(graph.edges, dist), f"{self.folder}/whole-support/-1")
            kept(dist, f"{self.folder}/whole-dist/-1")  # the last one marks the others as complete
        done = [*finished(self.spark, f"{self.folder}/dist"), *finished(self.spark, f"{self.folder}/whole-dist")]
        self._load(max(done) + 1)

    @staticmethod
    def _tight(edges: DataFrame, dist: DataFrame) -> DataFrame:
        a, b = (dist.select(F.col("id").alias(x), F.col("dist").alias(f"d_{x}")) for x in ("src", "dst"))
        return edges.join(a, "src").join(b, "dst").where("d_src + w = d_dst").select("src", "dst", "w")

    def _load(self, number: int) -> None:
        """The state before a batch: the last compaction before it, and the batches since."""
        whole = [n for n in finished(self.spark, f"{self.folder}/whole-dist") if n < number]
        if not whole:
            raise ValueError(f"batch {number} is settled already")
        self.whole, self.number = whole[-1], number
        self.batches = [n for n in finished(self.spark, f"{self.folder}/dist") if self.whole < n < number]
        self.parts = {k: [self._read(f"whole-{k}/{self.whole}"), *(self._read(f"{k}/{n}") for n in self.batches)] for k in self.kinds}

    def _read(self, place: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{place}")

    @property
    def added(self) -> DataFrame:
        """(src, dst, w): all edges inserted so far."""
        return _union(self.parts["edges"])

    @property
    def graph(self) -> Graph:
        """The graph with all edges inserted so far."""
        return Graph(self.base.vertices, self.base.edges.select("src", "dst", "w").union(self.added), self.base.directed)

    @property
    def state(self) -> DataFrame:
        """(id, dist): distances only fall, so the least row of an id is its last."""
        return _union(self.parts["dist"]).groupBy("id").agg(F.min("dist").alias("dist"))

    def support(self) -> DataFrame:
        """(src, dst, w): the edges on some shortest path, kept batch by batch: each batch has the support edges of the vertices it reached anew (new), and in a row without src every such vertex."""
        whole, later = self.parts["support"][0], [p.withColumn("batch", F.lit(n)) for p, n in zip(self.parts["support"][1:], self.batches, strict=True)]
        if not later:
            return whole
        marks = _union(later)
        last = marks.groupBy("dst").agg(F.max("batch").alias("last"))
        kept_ = whole.join(last, "dst", "left_anti").select("src", "dst", "w")
        return kept_.union(marks.join(last, "dst").where("batch = last and src is not null").select("src", "dst", "w"))

    def insert(self, edges: DataFrame, directed: bool = False, number: int | None = None) -> DataFrame:
        """Add edges (src, dst, w) and repair over base and inserted edges: the affected rows."""
        number = self._begin(number)
        new = edges.select(*(F.col(c).cast(self.base.edges.schema[c].dataType).alias(c) for c in ("src", "dst", "w")))
        new = kept(new if directed else new.union(new.select("dst", "src", "w")), f"{self.folder}/edges/{number}")
        offers = new.join(self.state.select(F.col("id").alias("src"), "dist"), "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        return self._repair(offers, new, number)

    def insert_source(self, source: int, number: int | None = None) -> DataFrame:
        """Add a source, as a batch of its own: the affected rows."""
        number = self._begin(number)
        new = kept(self.added.limit(0), f"{self.folder}/edges/{number}")
        zero = F.lit(0).cast(self.parts["dist"][0].schema["dist"].dataType)
        return self._repair(seeds(self.graph, source, 0).withColumn("dist", zero), new, number)

    def _begin(self, number: int | None) -> int:
        if self.durable and number is None:
            raise ValueError("a state in a folder needs the numbers of its batches")
        number = self.number if number is None else number
        if number != self.number:
            self._load(number)
        return number

    def _repair(self, offers: DataFrame, new: DataFrame, number: int) -> DataFrame:
        self.parts["edges"].append(new)
        graph, old = self.graph, bucketed(self.state, "id", "dynamic")
        _, affected = repair(graph, old, offers)
        forget(old)
        if "support" in self.kinds:
            self._follow(graph, affected, new, number)
        affected = kept(affected, f"{self.folder}/dist/{number}")  # the batch is complete
        self._load(number + 1)
        if len(self.batches) >= self.COMPACT:
            self._compact(number)
        return affected

    def _follow(self, graph: Graph, affected: DataFrame, new: DataFrame, number: int) -> None:
        """Write the support edges of the vertices at which they may have changed."""
        # support changes where a vertex's distance fell, where a neighbour's did, and at inserted edges
        out = graph.edges.join(affected.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        touched = stored(affected.select("id").union(out).union(new.select(F.col("dst").alias("id"))).distinct(), "dynamic")
        dist = stored(_union([*self.parts["dist"], affected]).groupBy("id").agg(F.min("dist").alias("dist")), "dynamic")
        into = graph.edges.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
        kept(self._tight(into, dist).unionByName(touched.select(F.col("id").alias("dst")), allowMissingColumns=True), f"{self.folder}/support/{number}")
        forget(touched, dist)

    def _compact(self, number: int) -> None:
        """All parts up to a batch in one; the batch itself stays until the next time, so that it can come again."""
        before = [self.whole, *self.batches[:-1]]
        self._load(number)
        parts = {"edges": self.added, "dist": self.state} | ({"support": self.support()} if "support" in self.kinds else {})
        for kind in sorted(self.kinds, key=lambda k: k == "dist"):  # dist last: it marks the others as complete
            kept(parts[kind], f"{self.folder}/whole-{kind}/{number - 1}")
        self._load(number + 1)
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = place(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for n in before:
            for kind in self.kinds:
                if n < number - 1:
                    system.delete(place(f"{self.folder}/whole-{kind}/{n}"), True)
                system.delete(place(f"{self.folder}/{kind}/{n}"), True)


def low_diameter_decomposition(graph: Graph, beta: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, cluster, parent): clusters grown in rounds; round i admits the hash-ordered vertices up to the sum of floor(e^(i beta)) as centres if still free. A vertex of several clusters goes to the least."""
    import math

    from graphloom.operators.primitives import dense_ranks

    order = stored(dense_ranks(graph.vertices.select("id"), [hash_priority("id", seed=seed), F.col("id")]), "ldd")
    n = order.count()
    edges, own = keyed(graph.edges, "src", "edges")
    log, admitted, i = None, 0, 0
    while True:
        upto = min(n, admitted + math.floor(math.exp(i * beta)))
        fresh = order.where((F.col("new") >= admitted) & (F.col("new") < upto))
        if log is None:
            log = StateLog(fresh.select("id", F.col("id").alias("cluster"), F.col("id").alias("parent")), "ldd")
        else:  # a cluster that arrives goes before a centre that begins
            offers = frontier_edges(edges, log.last(), "cluster").select(F.col("dst").alias("id"), F.struct(F.lit(0).alias("late"), "cluster", F.col("src").alias("parent")).alias("x"))
            offers = offers.union(fresh.select("id", F.struct(F.lit(1).alias("late"), F.col("id").alias("cluster"), F.col("id").alias("parent")).alias("x")))
            best = offers.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.cluster", "x.parent")
            log.append(best.join(log.current().select("id"), "id", "left_anti"))
        admitted, i = upto, i + 1
        if admitted >= n and not log.changed:
            break
    if own:
        forget(edges)
    forget(order)
    return log.close()


def spanner(graph: Graph, k: int = 4, seed: int = 0) -> DataFrame:
    """(src, dst): tree edges of a decomposition with beta = ln n / 2k, and the least edge between each pair of clusters that touch."""
    import math

    n = max(2, graph.vertices.count())
    part = low_diameter_decomposition(graph, math.log(n) / (2 * k), seed)
    tree = part.where("id <> parent").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    a, b = (part.select(F.col("id").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    between = graph.und().join(a, "src").join(b, "dst").where("c_src <> c_dst").groupBy(F.least("c_src", "c_dst").alias("p"), F.greatest("c_src", "c_dst").alias("q")).agg(F.min(F.struct("src", "dst")).alias("e")).select("e.src", "e.dst")
    return tree.union(between).distinct()


__all__ = ["DynamicPaths", "NegativeCycleError", "betweenness", "bfs", "bfs_distance", "bfs_parents", "labelled_distances", "low_diameter_decomposition", "relax", "repair", "seeds", "spanner", "sssp", "star_components", "widest_path"]
