"""Components, forests, strongly connected and biconnected components, and batch-dynamic connectivity. Labels are least ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.graph import Graph
from graphloom.operators.components import star_components
from graphloom.operators.paths import bfs_distance, bfs_parents, low_diameter_decomposition
from graphloom.operators.primitives import dense_ranks, first_neighbours, most_frequent
from graphloom.runtime import finished, forget, kept, stored
from graphloom.state import StateLog, counted, frontier_edges, keyed


def components(graph: Graph, algorithm: str = "star", keep: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(id, label): weakly connected components, isolated vertices alone. algorithm: star (logarithmic rounds), hashmin (label propagation), or a sample and then the edges that leave its most frequent label: sampled (each vertex's two first edges), bfs (a search from a vertex of a large component) or ldd (a low-diameter decomposition). keep: only edges for which it holds."""
    g = graph.filter_edges(keep) if keep else graph
    if algorithm == "star":
        found = star_components(g.edges.select("src", "dst")).withColumnRenamed("component", "label")
        return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    if algorithm in SAMPLES:
        return _finished(g, SAMPLES[algorithm](g))
    if algorithm != "hashmin":
        raise ValueError(f"algorithm is star, hashmin, {', '.join(SAMPLES)}")
    both = g.edges.select("src", "dst") if not g.directed else g.edges.select("src", "dst").union(g.edges.select("dst", "src"))
    return least_reaching(both, graph.vertices.select("id"))


def _first_edges(g: Graph) -> DataFrame:
    """(id, label): components of each vertex's two first edges."""
    return star_components(first_neighbours(g, 2).select("src", "dst")).withColumnRenamed("component", "label")


def _searched(g: Graph, share: float = 0.1, trials: int = 3) -> DataFrame:
    """(id, label): what a search from a vertex reaches, named by its least id; another vertex is taken, in hashed order, where it reaches no more than a share of all."""
    both = g if not g.directed else Graph(g.vertices, g.edges.union(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), False)
    n, reached = g.vertices.count(), None
    for start in g.vertices.select("id").orderBy(hash_priority("id"), "id").limit(trials).collect():
        forget(reached)
        reached = bfs_distance(both, start.id)
        found = reached.agg(F.count("*").alias("n"), F.min("id").alias("least")).first()
        if found.n > share * n:
            break
    if reached is None:
        return g.vertices.select("id", F.col("id").alias("label"))
    return reached.select("id", F.lit(found.least).alias("label"))


def _decomposed(g: Graph) -> DataFrame:
    """(id, label): clusters of a low-diameter decomposition, named by their least ids."""
    both = g if not g.directed else Graph(g.vertices, g.edges.union(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), False)
    part = low_diameter_decomposition(both, 0.2)
    least = part.groupBy("cluster").agg(F.min("id").alias("label"))
    return part.join(least, "cluster").select("id", "label")


SAMPLES = {"sampled": _first_edges, "bfs": _searched, "ldd": _decomposed}


def _finished(g: Graph, first: DataFrame) -> DataFrame:
    """(id, label) from labels (id, label) of a sample of the edges, least ids: most vertices of a large component meet over few edges, so that few of the others need a look."""
    label = stored(g.vertices.select("id").join(first, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "sampled")
    top = most_frequent(label, "label").first()
    if top is None:
        return label
    to = lambda x: label.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"))
    both = g.edges.select("src", "dst") if not g.directed else g.edges.select("src", "dst").union(g.edges.select("dst", "src"))
    rest = both.join(to("src").where(F.col("l_src") != top.label), "src").join(to("dst"), "dst").where("l_src <> l_dst").select(F.col("l_src").alias("src"), F.col("l_dst").alias("dst")).distinct()
    merged = star_components(rest).select(F.col("id").alias("label"), F.col("component").alias("new"))
    return label.join(merged, "label", "left").select("id", F.coalesce("new", "label").alias("label"))


def least_reaching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label): the least id that reaches each vertex along the edges. A round moves the labels that fell along edges bucketed by source, and writes those that fall."""
    edges, own = keyed(edges.select("src", "dst"), "src", "edges")
    log = StateLog(ids.select("id", F.col("id").alias("label")), "labels")
    while log.changed:
        offers = frontier_edges(edges, log.last(), "label").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        log.append(offers.join(log.current(), "id").where("new < label").select("id", F.col("new").alias("label")))
    if own:
        forget(edges)
    return log.close()


def component_stats(labels: DataFrame) -> DataFrame:
    """(components, largest) of a labelling."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def spanning_forest(graph: Graph) -> DataFrame:
    """(src, dst): breadth-first trees from the least vertex of each component, parents least."""
    roots = components(graph).select(F.col("label").alias("id")).distinct()
    parent = bfs_parents(graph, stored(bfs_distance(graph, roots), "forest"))
    return parent.where("id <> parent").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def is_spanning_forest(graph: Graph, forest: DataFrame) -> bool:
    """Whether the edges are of the graph, connect what it connects, and hold no cycle."""
    if not forest.join(graph.und(), ["src", "dst"], "left_anti").isEmpty():
        return False
    mine, theirs = components(Graph.from_edges(forest, vertices=graph.vertices)), components(graph)
    same = mine.withColumnRenamed("label", "own").join(theirs, "id").where("own <> label").isEmpty()
    return same and forest.count() == graph.vertices.count() - theirs.select("label").distinct().count()


def minimum_spanning_forest(graph: Graph) -> DataFrame:
    """(src, dst, w): Boruvka rounds; each component takes its least edge by (w, src, dst), so ties are settled alike everywhere."""
    return _boruvka(graph.und().select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))


def _boruvka(edges: DataFrame) -> DataFrame:
    """(src, dst, w): the forest of edges between the components a and b that they join. Of the edges between two components the least
    stays, so edges fall with the square of the components left; a round's frames go once the next one's are stored."""
    least = F.min(F.struct("w", "src", "dst")).alias("e")

    def lightest(rows: DataFrame) -> tuple[DataFrame, Observation]:
        pairs = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(least)
        out, seen = counted(pairs.select("e.src", "e.dst", "e.w", "a", "b"))
        return stored(out, "msf"), seen

    (edges, seen), taken = lightest(edges.where("a <> b")), []
    none = edges.sparkSession.createDataFrame([], edges.select("src", "dst", "w").schema)
    while seen.get["n"]:
        ends = edges.select("src", "dst", "w", "a", "b", F.explode(F.array("a", "b")).alias("c"))
        best = ends.groupBy("c").agg(F.min(F.struct("w", "src", "dst", "a", "b")).alias("e")).select("e.*").distinct()
        best = stored(best, "msf")
        taken.append(best.select("src", "dst", "w"))
        label = stored(star_components(best.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "msf")
        to = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"n_{x}"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b")  # every component has an edge, so each has a label
        last = edges
        edges, seen = lightest(moved.select("src", "dst", "w", F.col("n_a").alias("a"), F.col("n_b").alias("b")).where("a <> b"))
        forget(last, label)
    out = none if not taken else taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out


def labelled_reachability(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, centre): every vertex that each of the centres (id) reaches along edges (src, dst), itself included. A round joins the new pairs alone."""
    log = stored(centres.select("id", F.col("id").alias("centre")), "reach")
    every, fresh = [log], log
    while True:
        ahead = edges.join(fresh.select(F.col("id").alias("src"), "centre"), "src").select(F.col("dst").alias("id"), "centre").distinct()
        new = ahead
        for f in every:
            new = new.join(f, ["id", "centre"], "left_anti")
        counted_, seen = counted(new)
        fresh = stored(counted_, "reach")
        if not seen.get["n"]:
            out = every[0]
            for f in every[1:]:
                out = out.union(f)
            return out
        every.append(fresh)
        if len(every) > 8:
            out = every[0]
            for f in every[1:]:
                out = out.union(f)
            whole = stored(out, "reach")
            forget(*every[:-1])  # the next round still reads the last one
            every = [whole]


def _trimmed(left: DataFrame, edges: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, part) with an edge in and one out inside their part, and the edges among them, after some rounds of dropping the others."""
    for _ in range(most):
        inner = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id")
        kept_, seen = counted(left.join(inner, "id", "left_semi"))
        before = left
        left = stored(kept_, "scc")
        live = edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
        edges = stored(live.select("src", "dst"), "scc")
        if seen.get["n"] == before.count():
            break
    return left, edges


def strongly_connected(graph: Graph, seed: int = 0, phases: list | None = None) -> DataFrame:
    """(id, label): each vertex with the least id of its strongly connected component.

    Vertices come as centres in a hashed order, in batches that double. A phase finds which vertices each centre of the batch reaches, and which
    reach it, all centres at once, as tables of (vertex, centre). A vertex in both tables with a centre is of its component and leaves. The others
    are parted by the sets of centres that reach them and that they reach, as a component never lies across, and edges between
    parts go. So the number of phases is logarithmic, and a vertex meets a logarithmic number of centres in expectation. phases, if
    given, gets the number of centres of each.
    """
    order = stored(dense_ranks(graph.vertices.select("id"), [hash_priority("id", seed=seed), F.col("id")]), "scc")
    left = stored(graph.vertices.select("id"), "scc")
    edges = stored(graph.edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    n, upto, size, done = order.count(), 0, 1, []
    while upto < n:
        left, edges = _trimmed(left, edges)  # what goes here is alone
        last, upto, size = upto, min(n, upto + size), size * 2
        chosen, seen = counted(order.where((F.col("new") >= last) & (F.col("new") < upto)).join(left, "id", "left_semi").select("id"))
        centres = stored(chosen, "scc")
        if not seen.get["n"]:
            continue
        if phases is not None:
            phases.append(seen.get["n"])
        ahead = stored(labelled_reachability(edges, centres), "scc")
        back = stored(labelled_reachability(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), centres), "scc")
        both = ahead.join(back, ["id", "centre"])
        found = stored(both.groupBy("id").agg(F.min("centre").alias("centre")), "scc")  # the least of the centres of one component
        done.append(found)
        # a vertex's sets, as sums of hashes that don't depend on an order
        marks = ahead.select("id", F.xxhash64("centre", F.lit(1)).alias("h"), F.xxhash64("centre", F.lit(2)).alias("k")).union(back.select("id", F.xxhash64("centre", F.lit(3)), F.xxhash64("centre", F.lit(4))))
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        parts = left.join(found, "id", "left_anti").join(marks.groupBy("id").agg(wide("h"), wide("k")), "id", "left").select("id", F.coalesce("h", F.lit(0).cast("decimal(38,0)")).alias("h"), F.coalesce("k", F.lit(0).cast("decimal(38,0)")).alias("k"))
        parts = stored(parts, "scc")
        side = lambda x: parts.select(F.col("id").alias(x), F.struct("h", "k").alias(f"p_{x}"))  # noqa: B023, E731
        old = (left, edges, ahead, back)
        left = parts.select("id")
        edges = stored(edges.join(side("src"), "src").join(side("dst"), "dst").where("p_src = p_dst").select("src", "dst"), "scc")
        forget(*old)
    if not done:
        return graph.vertices.select("id", F.col("id").alias("label"))
    found = done[0]
    for f in done[1:]:
        found = found.union(f)
    least = found.groupBy("centre").agg(F.min("id").alias("label"))
    named = found.join(least, "centre").select("id", "label")
    return graph.vertices.select("id").join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def list_ranks(nexts: DataFrame, rounds: list | None = None) -> DataFrame:
    """(a, rank): of every item of linked lists (a, next; null after the last), how many items follow, by pointer jumping: each round doubles the way, so the rounds are logarithmic. rounds, if given, gets each one's number of open items."""
    state = stored(nexts.select("a", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank")), "ranks")
    while True:
        far = state.select(F.col("a").alias("next"), F.col("next").alias("then"), F.col("rank").alias("more"))
        moved, seen = state.join(far, "next", "left").select("a", F.col("then").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), Observation()
        moved = moved.observe(seen, F.count("next").alias("n"))
        last, state = state, stored(moved, "ranks")
        forget(last)
        if rounds is not None:
            rounds.append(seen.get["n"])
        if not seen.get["n"]:
            return state.select("a", "rank")


def euler_tour(forest: DataFrame, label: DataFrame, rounds: list | None = None) -> DataFrame:
    """(id, parent, root, first, last) of every vertex of a forest (src, dst), each tree rooted at its least vertex, the label (id, label) of all its vertices.

    Every edge is two arcs; after an arc into v comes the arc out of v to the neighbour that follows the arc's origin in the circle of v's
    neighbours. The arcs of a tree are one list so, cut before the root's first arc; their ranks are places 1, 2, ... in the tour. A vertex
    is entered at place first and left at place last; what lies between is its subtree. A root has first 0, and itself as its parent.
    """
    arcs = forest.select("src", "dst").union(forest.select("dst", "src"))
    # arcs in order of (src, dst), numbered without gathering a hub's arcs in one task
    numbered = stored(dense_ranks(arcs.select(F.struct("src", "dst").alias("id"))).select("id.src", "id.dst", F.col("new").alias("a")), "tour")
    first = stored(numbered.groupBy("src").agg(F.min("a").alias("first")), "tour")
    after = numbered.select("src", "dst", (F.col("a") + 1).alias("a")).join(numbered.select("a", F.col("src").alias("same")), "a", "left").join(first, "src")
    after = after.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.when(F.col("same") == F.col("src"), F.col("a")).otherwise(F.col("first")).alias("next"))
    cut = first.join(label.where("id = label").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("first").alias("next"), F.lit(True).alias("start"))
    linked = numbered.join(after, ["src", "dst"]).join(cut, "next", "left").select("a", F.when(F.col("start").isNull(), F.col("next")).alias("next"))
    ranks = list_ranks(linked, rounds)
    placed = numbered.join(ranks, "a").join(label.select(F.col("id").alias("src"), F.col("label").alias("root")), "src")
    placed = stored(placed.select("root", "src", "dst", "rank"), "tour")
    total = placed.groupBy("root").agg(F.count("*").alias("total"))
    edges = placed.groupBy("root", F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.max(F.struct("rank", "src", "dst")).alias("down"), F.min("rank").alias("up"))
    inner = edges.join(total, "root").select(F.col("down.dst").alias("id"), F.col("down.src").alias("parent"), "root", (F.col("total") - F.col("down.rank")).alias("first"), (F.col("total") - F.col("up")).alias("last"))
    roots = label.where("id = label").select(F.col("id").alias("root")).join(total, "root", "left")
    own = roots.select(F.col("root").alias("id"), F.col("root").alias("parent"), "root", F.lit(0).cast("long").alias("first"), F.coalesce(F.col("total") + 1, F.lit(0)).cast("long").alias("last"))
    return inner.union(own)


def subtree_extremes(tour: DataFrame, own: DataFrame) -> DataFrame:
    """(id, low, high): the least low and greatest high of own (id, low, high) in each vertex's subtree.

    Values stand at the places where vertices are entered. Tables of extremes over 1, 2, 4, ... places are made one from another; a subtree's
    stretch of places is two overlapping ones of them, whatever the depth of the tree."""
    rows = stored(tour.join(own, "id").select("id", "root", "first", "last", "low", "high"), "extremes")
    asked = rows.select("id", "root", "first", "last", F.floor(F.log2((F.col("last") - F.col("first") + 1).cast("double"))).cast("int").alias("level"))
    asked = stored(asked, "extremes")
    most = asked.agg(F.max("level")).first()[0]
    table, found, level = stored(rows.select("root", F.col("first").alias("place"), "low", "high"), "extremes"), [], 0
    while most is not None and level <= most:
        width = 1 << level
        here = asked.where(F.col("level") == level)
        ends = here.select("id", "root", F.col("first").alias("place")).union(here.select("id", "root", (F.col("last") - width + 1).alias("place")))
        found.append(stored(ends.join(table, ["root", "place"]).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")), "extremes"))
        level += 1
        if level <= most:
            both = table.union(table.select("root", (F.col("place") - width).alias("place"), "low", "high").where("place >= 0"))
            last, table = table, stored(both.groupBy("root", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")), "extremes")
            forget(last)
    out = found[0] if found else rows.select("id", "low", "high")
    for f in found[1:]:
        out = out.union(f)
    return out


def biconnected(graph: Graph, rounds: list | None = None) -> DataFrame:
    """(src, dst, first_src, first_dst): each undirected edge and the least edge of its biconnected component.

    Any spanning forest does: Boruvka's, in a logarithmic number of rounds. Its Euler tour, ranked by pointer jumping, gives each
    vertex the stretch of places of its subtree; the least and greatest place that a subtree's other edges reach tell which
    tree edges share a cycle, and those are connected components of child vertices. No loop runs along a path of the graph."""
    label = stored(components(graph), "bicon")
    und = graph.und().select("src", "dst")
    forest = stored(_boruvka(und.select("src", "dst", F.lit(1).alias("w"), F.col("src").alias("a"), F.col("dst").alias("b"))).select("src", "dst"), "bicon")
    tour = stored(euler_tour(forest, label, rounds), "bicon")
    spot = stored(tour.select("id", "parent", F.col("first").alias("pre"), (F.col("last") - F.col("first") + 1).alias("size")), "bicon")
    a, b = (spot.select(F.col("id").alias(x), F.col("parent").alias(f"p_{x}"), F.col("pre").alias(f"pre_{x}"), F.col("size").alias(f"size_{x}")) for x in ("src", "dst"))
    full = stored(und.join(a, "src").join(b, "dst"), "bicon")
    tree_edge = (F.col("p_src") == F.col("dst")) | (F.col("p_dst") == F.col("src"))
    other = full.where(~tree_edge)
    seen = other.select(F.col("src").alias("id"), F.col("pre_dst").alias("p")).union(other.select(F.col("dst").alias("id"), F.col("pre_src").alias("p"))).groupBy("id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    own = spot.join(seen, "id", "left").select("id", F.least("pre", F.coalesce("lo", "pre")).alias("low"), F.greatest("pre", F.coalesce("hi", "pre")).alias("high"))
    reach = subtree_extremes(tour, own)
    parents = spot.select(F.col("id").alias("parent"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"), F.col("parent").alias("grand"))
    through = spot.where("id <> parent").join(reach, "id").join(parents, "parent").where("grand <> parent and (low < p_pre or high >= p_pre + p_size)").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    first, second = F.when(F.col("pre_src") < F.col("pre_dst"), F.col("src")).otherwise(F.col("dst")), F.when(F.col("pre_src") < F.col("pre_dst"), F.col("dst")).otherwise(F.col("src"))
    apart = (F.greatest("pre_src", "pre_dst") >= F.least("pre_src", "pre_dst") + F.when(F.col("pre_src") < F.col("pre_dst"), F.col("size_src")).otherwise(F.col("size_dst")))
    across = other.where(apart).select(first.alias("src"), second.alias("dst"))
    joined = star_components(through.union(across))
    child = F.when(F.col("p_src") == F.col("dst"), F.col("src")).when(F.col("p_dst") == F.col("src"), F.col("dst")).otherwise(second)
    named = full.withColumn("id", child).join(joined, "id", "left").select("src", "dst", F.coalesce("component", "id").alias("c"))
    firsts = named.groupBy("c").agg(F.min(F.struct("src", "dst")).alias("f"))
    return named.join(firsts, "c").select("src", "dst", F.col("f.src").alias("first_src"), F.col("f.dst").alias("first_dst"))


def vertex_parts(graph: Graph, parts: DataFrame) -> DataFrame:
    """(id, parent, first_src, first_dst): each vertex, its parent in the breadth-first tree of its component and the biconnected component of the edge to it; null at roots."""
    roots = components(graph).select(F.col("label").alias("id")).distinct()
    parent = bfs_parents(graph, stored(bfs_distance(graph, roots), "bicon")).where("id <> parent")
    of = parent.withColumns({"src": F.least("id", "parent"), "dst": F.greatest("id", "parent")}).join(parts, ["src", "dst"]).select("id", "parent", "first_src", "first_dst")
    return graph.vertices.select("id").join(of, "id", "left")


def articulation_points(parts: DataFrame) -> DataFrame:
    """(id): vertices whose edges lie in several biconnected components."""
    ends = parts.select(F.col("src").alias("id"), "first_src", "first_dst").union(parts.select("dst", "first_src", "first_dst")).distinct()
    return ends.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


class IncrementalComponents:
    """Labels under batches of insertions and queries. A batch's insertions go first.

    A vertex keeps the label of its arrival; what became of labels is a table of those that merged, so a batch writes new
    vertices and that table, and every COMPACT batches all labels. With a folder each numbered batch leaves its state
    there: a new object goes on from the last one, and a batch that is given again starts from the state before it."""

    COMPACT = 16

    def __init__(self, vertices: DataFrame, folder: str | None = None):
        self.spark, self.folder, self.batches = vertices.sparkSession, folder, 0
        self.start = vertices.select("id", F.col("id").alias("label"))
        self.none = self.spark.createDataFrame([], "label long, new long")
        done = finished(self.spark, f"{folder}/roots") if folder else []
        if folder and not finished(self.spark, f"{folder}/base"):
            kept(self.start, f"{folder}/base/{(done or [0])[0]}")
        self._load(done[-1] + 1 if done else 0)

    def _load(self, number: int) -> None:
        """The state before a batch."""
        if not self.folder:
            self.base, self.roots = stored(self.start, "incremental"), self.none
            return
        read = lambda kind, n, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/{n}")
        whole = [n for n in finished(self.spark, f"{self.folder}/base") if n <= number][-1]
        self.base = read("base", whole, "id long, label long")
        for n in finished(self.spark, f"{self.folder}/new"):
            if whole <= n < number:
                self.base = self.base.union(read("new", n, "id long, label long"))
        last = [n for n in finished(self.spark, f"{self.folder}/roots") if whole <= n < number]
        self.roots = read("roots", last[-1], "label long, new long") if last else self.none

    @property
    def labels(self) -> DataFrame:
        """(id, label): the least id of each vertex's component."""
        return self.base.join(self.roots, "label", "left").select("id", F.coalesce("new", "label").alias("label"))

    def process(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """batch (u, v, op in insert, query): the queries (u, v, connected) after all insertions."""
        if self.folder and number is None:
            raise ValueError("a state in a folder needs the numbers of its batches")
        if self.folder and number in finished(self.spark, f"{self.folder}/roots"):
            self._load(number)
        keep = (lambda df, kind: kept(df, f"{self.folder}/{kind}/{number}")) if self.folder else (lambda df, kind: stored(df, "incremental"))
        batch = stored(batch.select("u", "v", "op"), "incremental")
        ends = batch.select(F.col("u").alias("id")).union(batch.select("v")).distinct()
        fresh = keep(ends.join(self.base, "id", "left_anti").select("id", F.col("id").alias("label")), "new")
        self.base = self.base.union(fresh)
        to = lambda x: self.labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"))
        links = batch.where("op = 'insert'").join(to("u"), "u").join(to("v"), "v").select(F.col("l_u").alias("src"), F.col("l_v").alias("dst"))
        merged = stored(star_components(links).select(F.col("id").alias("was"), F.col("component").alias("now")).where("was <> now"), "incremental")
        moved = self.roots.join(merged, self.roots["new"] == merged["was"], "left").select("label", F.coalesce("now", "new").alias("new"))
        added = merged.join(self.roots.select(F.col("label").alias("was")), "was", "left_anti").select(F.col("was").alias("label"), F.col("now").alias("new"))
        self.roots = keep(moved.union(added), "roots")
        self.batches += 1
        if self.batches % self.COMPACT == 0:
            whole = self.labels
            self.base = kept(whole, f"{self.folder}/base/{number + 1}") if self.folder else stored(whole, "incremental")
            self.roots = self.none
        return batch.where("op = 'query'").join(to("u"), "u").join(to("v"), "v").select("u", "v", (F.col("l_u") == F.col("l_v")).alias("connected"))
