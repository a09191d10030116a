"""The graph: a DataFrame of vertices and one of edges.

vertices: id BIGINT, weight DOUBLE (nullable). edges: src BIGINT, dst BIGINT, w. A symmetric graph holds each edge in both
directions; its canonical half is und(). Unreached, unclustered and the like are NULL, never a magic number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_priority
from graphloom.state import bucketed


def _edge_columns(edges: DataFrame) -> DataFrame:
    w = F.col("w") if "w" in edges.columns else F.lit(1).cast("long")
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w")).where("src is not null and dst is not null")


@dataclass(frozen=True)
class Graph:
    """vertices (id, weight), edges (src, dst, w), and whether edges is one direction of a directed graph."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None, dense: bool = False, drop_loops: bool = True, parallel: str | None = "min") -> Graph:
        """A graph of an edge list. parallel: min, max or sum merges parallel edges, None keeps them. dense: ids 0 to the greatest endpoint are all vertices."""
        e = _edge_columns(edges)
        if drop_loops:
            e = e.where("src <> dst")
        if not directed:
            e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        if parallel:
            e = e.groupBy("src", "dst").agg(getattr(F, parallel)("w").alias("w"))
            if not directed and parallel == "sum" and not drop_loops:
                e = e.withColumn("w", F.when(F.col("src") == F.col("dst"), F.col("w") / 2).otherwise(F.col("w")))
        if vertices is not None:
            v = vertices.select(F.col("id").cast("long").alias("id"), (F.col("weight").cast("double") if "weight" in vertices.columns else F.lit(None).cast("double")).alias("weight"))
        elif dense:
            most = _edge_columns(edges).agg(F.max(F.greatest("src", "dst"))).first()[0]
            v = edges.sparkSession.range(0 if most is None else most + 1).select("id", F.lit(None).cast("double").alias("weight"))
        else:
            both = _edge_columns(edges)
            v = both.select(F.col("src").alias("id")).union(both.select("dst")).distinct().withColumn("weight", F.lit(None).cast("double"))
        return Graph(v, e, directed)

    def store(self) -> Graph:
        """The same graph, written to the shared folder, vertices bucketed by id and edges by src: loops join them again and again without moving them."""
        return Graph(bucketed(self.vertices, "id", "vertices"), bucketed(self.edges, "src", "edges"), self.directed)

    def und(self) -> DataFrame:
        """Each undirected edge once, src < dst (loops left out)."""
        if not self.directed:
            return self.edges.where("src < dst")
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w"))

    def transpose(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), self.directed)

    def symmetrised(self, parallel: str = "min") -> Graph:
        return Graph.from_edges(self.edges, False, self.vertices, parallel=parallel)

    def degrees(self) -> DataFrame:
        """(id, degree): out-degree; 0 for isolated vertices."""
        return self.vertices.select("id").join(self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def hub(self) -> int | None:
        """The vertex of greatest degree, the least id of equals."""
        top = self.degrees().agg(F.min_by("id", F.struct((-F.col("degree")).alias("d"), "id")).alias("id")).first()
        return top.id

    def filter_edges(self, keep: Callable[[Column, Column, Column], Column]) -> Graph:
        """The edges for which keep(src, dst, w) holds; the predicate may be asymmetric."""
        return Graph(self.vertices, self.edges.where(keep(F.col("src"), F.col("dst"), F.col("w"))), self.directed)

    def split_edges(self, kind: Callable[[Column, Column, Column], Column]) -> tuple[Graph, DataFrame]:
        """kind gives 0 keep, 1 drop, 2 extract: the graph that stays and the extracted edges."""
        marked = self.edges.withColumn("kind", kind(F.col("src"), F.col("dst"), F.col("w")))
        return Graph(self.vertices, marked.where("kind = 0").drop("kind"), self.directed), marked.where("kind = 2").drop("kind")

    def sample_edges(self, share: float, seed: int = 0) -> DataFrame:
        """A repeatable share of the edges, the same for both directions of one."""
        return self.edges.where(hash_priority(F.least("src", "dst"), F.greatest("src", "dst"), seed=seed) % 1_000_000 < int(share * 1_000_000))

    def pack(self, keep: Callable[[Column, Column, Column], Column]) -> tuple[Graph, DataFrame]:
        """filter_edges, and the new degree of every vertex."""
        out = self.filter_edges(keep)
        return out, out.degrees()

    def isolate(self, gone: DataFrame) -> Graph:
        """The graph without any edge of the given vertices (id): their degree is 0."""
        ids = gone.select(F.col("id").alias("src")).distinct()
        left = self.edges.join(ids, "src", "left_anti").join(ids.withColumnRenamed("src", "dst"), "dst", "left_anti")
        return Graph(self.vertices, left.select("src", "dst", "w"), self.directed)

    def relabelled(self, order: DataFrame) -> Graph:
        """Vertices renamed by order (id, new)."""
        names = order.select("id", "new")
        v = self.vertices.join(names, "id").select(F.col("new").alias("id"), "weight")
        e = self.edges.join(names.select(F.col("id").alias("src"), F.col("new").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("new").alias("b")), "dst")
        return Graph(v, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), self.directed)
