"""Random graphs from hashes: repeatable, and made by as many tasks as there are edges to make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import clock_seconds, hash_digits, hash_priority, haversine, uniform_weight
from graphloom.graph import Graph
from graphloom.runtime import stored


def rmat(spark: SparkSession, scale: int, edges: int, a: float = 0.5, b: float = 0.1, c: float = 0.1, seed: int = 0) -> Graph:
    """2 ** scale vertices; every edge picks one of four quadrants at each level. A level costs one hash, and every edge is made once."""
    # its low 30 bits are in its last 8 digits
    low = F.transform(F.sequence(F.lit(1), F.lit(scale)), lambda level: hash_digits("id", level, seed=seed, first=8) % (1 << 30) / (1 << 30))

    def deeper(ends, u) -> F.Column:
        right, down = u >= a + b, ((u >= a) & (u < a + b)) | (u >= a + b + c)
        return F.struct(*((2 * ends[k] + F.when(x, 1).otherwise(0)).cast("long").alias(k) for k, x in (("src", right), ("dst", down))))

    start = F.struct(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    e = spark.range(edges).select(F.aggregate(low, start, deeper).alias("e")).select("e.src", "e.dst")
    # written as they are: a filter on the ends, or a second direction, would make them anew
    return Graph.from_edges(stored(e, "rmat"), vertices=spark.range(1 << scale))


def erdos_renyi(spark: SparkSession, n: int, edges: int, most_weight: int = 1, seed: int = 0) -> Graph:
    """At most that many different edges between hashed ends, weights from 1 to most_weight."""
    end = lambda k: hash_priority("id", F.lit(k), seed=seed) % max(1, n)
    e = spark.range(edges).select(end(1).alias("src"), end(2).alias("dst"))
    return Graph.from_edges(e.withColumn("w", uniform_weight("src", "dst", most_weight, seed)), vertices=spark.range(n))


def barabasi_albert(spark: SparkSession, n: int, per_vertex: int, seed: int = 0) -> Graph:
    """Preferential attachment by slots: edge slot s copies an end of a hashed earlier slot; chains of copies are followed by pointer jumping, in logarithmically many rounds."""
    slots = spark.range(per_vertex, n * per_vertex).select(F.col("id").alias("slot"), F.floor(F.col("id") / per_vertex).alias("src"))
    r = hash_priority("slot", seed=seed) % (2 * F.col("src") * per_vertex)
    picked = slots.withColumn("r", r)
    # even picks name a vertex, odd ones another slot's target
    state = stored(picked.select("slot", "src", F.when(F.col("r") % 2 == 0, F.floor(F.col("r") / 2 / per_vertex)).when(F.col("r") / 2 < per_vertex, F.lit(0).cast("long")).alias("dst"), F.when((F.col("r") % 2 == 1) & (F.col("r") / 2 >= per_vertex), F.floor(F.col("r") / 2)).alias("next")), "ba")
    while not state.where("dst is null").isEmpty():
        other = state.select(F.col("slot").alias("next"), F.col("dst").alias("d"), F.col("next").alias("n"))
        state = stored(state.join(other, "next", "left").select("slot", "src", F.coalesce("dst", "d").alias("dst"), F.when(F.col("dst").isNull() & F.col("d").isNull(), F.col("n")).alias("next")), "ba")
    return Graph.from_edges(state.select("src", "dst"), vertices=spark.range(n))


def with_uniform_weights(graph: Graph, most: int, seed: int = 0) -> Graph:
    return Graph(graph.vertices, graph.edges.withColumn("w", uniform_weight("src", "dst", most, seed)), graph.directed)


def transit_edges(stop_times: DataFrame) -> DataFrame:
    """(src, dst, w): consecutive stops of trips (trip_id, stop_sequence, stop_id, arrival_time, departure_time), with the least seconds in the vehicle."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    ride = stop_times.select(F.col("stop_id").alias("src"), F.lead("stop_id").over(w).alias("dst"), (F.lead(clock_seconds(F.col("arrival_time"))).over(w) - clock_seconds(F.col("departure_time"))).alias("w"))
    return ride.where("dst is not null and w >= 0 and src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def road_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(src, dst, w): rounded metres along ways (way_id, nodes array, oneway) between nodes (id, lat, lon)."""
    each = ways.select("way_id", F.coalesce(F.lower(F.col("oneway")), F.lit("no")).alias("oneway"), F.posexplode("nodes").alias("k", "src"))
    step = each.withColumn("dst", F.lead("src").over(Window.partitionBy("way_id").orderBy("k"))).where("dst is not null")
    spot = lambda x: nodes.select(F.col("id").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    far = step.join(spot("src"), "src").join(spot("dst"), "dst").select("src", "dst", "oneway", F.round(haversine(F.col("lat_src"), F.col("lon_src"), F.col("lat_dst"), F.col("lon_dst"))).cast("long").alias("w"))
    ahead = far.where("oneway <> '-1'").select("src", "dst", "w")
    back = far.where("oneway not in ('yes', 'true', '1')").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return ahead.union(back).where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
