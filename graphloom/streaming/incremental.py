"""Batch-dynamic operators on Structured Streaming: each micro-batch is one batch of updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.graph import Graph
from graphloom.operators.connectivity import IncrementalComponents
from graphloom.operators.paths import DynamicPaths


def stream_components(updates: DataFrame, vertices: DataFrame, answer: Callable[[int, DataFrame], None], checkpoint: str) -> tuple[StreamingQuery, IncrementalComponents]:
    """updates (u, v, op): inserts merge labels, queries of the same batch are answered after them, in order of batches.

    The state lies beside the stream's checkpoint: a restarted stream goes on from it, and a batch given again changes nothing."""
    state = IncrementalComponents(vertices, f"{checkpoint.rstrip('/')}/labels")

    def each(batch: DataFrame, number: int) -> None:
        answer(number, state.process(batch, number))

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start(), state


def stream_paths(updates: DataFrame, graph: Graph, sources, changed: Callable[[int, DataFrame], None], checkpoint: str) -> tuple[StreamingQuery, DynamicPaths]:
    """updates (src, dst, w): every batch of inserted undirected edges repairs the distances; changed gets the affected rows. A restarted stream goes on from the state beside its checkpoint."""
    state = DynamicPaths(graph, sources, f"{checkpoint.rstrip('/')}/paths")

    def each(batch: DataFrame, number: int) -> None:
        changed(number, state.insert(batch, number=number))

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start(), state


def windowed_flow(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, src, events): for graph construction, events of each user in a window of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("src")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "src", "events")
