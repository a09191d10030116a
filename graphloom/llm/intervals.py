"""Interval overlap join: which intervals of two sides share a slot under a common key, and how they lie to each other.

1. Time is cut into shards of WIDTH slots. An interval stands in the shard of its start, and is replicated to each later shard
   that it reaches and in which an interval of its key starts; an open end reaches all of them.
2. Both sides are dealt to groups by the hash of (key, shard) and cogrouped. In a group each side's list is sorted by start and
   swept forward: an interval meets those of the other side that start inside it, at its own start included for one side alone.
3. The reference point of a pair is its later start. The sweep looks at partners that start inside the shard only, so a pair of
   replicated intervals is found in one shard, once.

`overlapping_pairs` lists the pairs of two sides with ids. `relation_sums` counts them by relation: there, intervals of one key with equal
slots are one class with sums first, so what meets under a key is bounded by its slots and not by its rows, and no pair is listed.

Slots are whole numbers; ends are inclusive; a null end is open (infinite, equal to every other open end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import stored

WIDTH, GROUP_ROWS, PAIRS, OPEN = 32, 1 << 14, 1 << 20, 1 << 40
DAY, GAP = 86_400_000_000, 300_000_000
#: by 3 * sign(start of the left one - start of the right one) + sign of the ends' difference, from -4 on
RELATIONS = ["overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by"]


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is read as UTC, whatever the session's zone is."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")).cast("long") * DAY + clock.cast("long") * 1_000_000 + (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("long")


def floored(us: Column, width: int) -> Column:
    """us divided by width, rounded down, also before 1970."""
    return ((us - F.pmod(us, F.lit(width))) / width).cast("long")


def sessions(clicks: DataFrame, gap: int = GAP, shard: int = DAY) -> DataFrame:
    """client_id, first_us, last_us and open (a click at the last ts is of kind click) of every session.

    Clicks in one piece of time as long as the gap are of one session, so each such piece is one row before anything meets under a client; pieces
    are chained within a shard (a day), and only sessions at a day's border are chained over days.
    """
    us = micros(clicks, "ts")
    rows = clicks.where("client_id is not null and ts is not null").select(F.col("client_id").cast("long").alias("client_id"), us.alias("us"), F.coalesce(F.col("kind") == "click", F.lit(False)).cast("long").alias("is_click"))
    # last holds the flag in its lowest bit: the greatest one has it set if any click at that ts is of kind click
    pieces = rows.groupBy("client_id", floored(F.col("us"), shard).alias("shard"), floored(F.col("us"), gap).alias("piece")).agg(F.min("us").alias("first"), F.max(F.col("us") * 2 + F.col("is_click")).alias("last"))

    def chained(df: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("first")
        before = F.shiftright(F.lag("last").over(order), 1)
        begins = df.withColumn("begins", F.when(F.col("first") - before <= gap, 0).otherwise(1))
        numbered = begins.withColumn("number", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "number").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    local = stored(chained(pieces, ["client_id", "shard"]).select("client_id", "first", "last"), "sessions")
    last = F.shiftright("last", 1)
    border = (F.pmod("first", F.lit(shard)) <= gap) | (F.pmod(last, F.lit(shard)) >= shard - gap)
    joined = chained(local.where(border), ["client_id"]).select("client_id", "first", "last")
    every = local.where(~border).union(joined)
    return every.select("client_id", F.col("first").alias("first_us"), last.alias("last_us"), (F.col("last") % 2 != 0).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client_id, first_us, last_us and open (status held) of every sale with a client and a time; a line without a time or sale plays no part."""
    shipped = lines.where("sale_id is not null and shipped_at is not null").select(F.col("sale_id").cast("long").alias("sale_id"), micros(lines, "shipped_at").alias("us")).groupBy("sale_id").agg(F.max("us").alias("shipped_us"))
    own = sales.where("client_id is not null and sold_at is not null").select(F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client_id"), micros(sales, "sold_at").alias("first_us"), F.coalesce(F.col("status") == "held", F.lit(False)).alias("open"))
    return own.join(shipped, "sale_id", "left").select("sale_id", "client_id", "first_us", F.greatest("first_us", "shipped_us").alias("last_us"), "open")


def _sharded(left: DataFrame, right: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (key, s, e, ...) with their shards: an interval's first one, and the later ones it reaches in which its key has a start."""
    shard = lambda c: floored(F.col(c), width)
    starts = left.select("key", shard("s").alias("shard")).union(right.select("key", shard("s").alias("shard"))).distinct()
    known = starts.groupBy("key").agg(F.collect_list("shard").alias("shards"))

    def dealt(side: DataFrame) -> DataFrame:
        marked = side.withColumn("shard", shard("s")).withColumn("last", shard("e"))
        long_ = marked.where("last > shard").join(known, "key")
        more = long_.withColumn("shard", F.explode(F.filter("shards", lambda x: (x > F.col("shard")) & (x <= F.col("last"))))).drop("shards")
        return marked.unionByName(more).drop("last")

    return dealt(left), dealt(right)


def _meetings(a: list[np.ndarray], b: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides (key, shard, s, e; each sorted by key, shard, s) that share a slot and whose later start lies in the shard: indexes, in bounded pieces."""
    both = np.stack([np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])])
    group = np.unique(both, axis=1, return_inverse=True)[1].ravel()
    base = min(a[2].min(), b[2].min(), a[1].min() * width, b[1].min() * width)
    span = max(a[2].max(), b[2].max(), (a[1].max() + 1) * width, (b[1].max() + 1) * width) - base + 2
    ga, gb = group[: len(a[0])] * span - base, group[len(a[0]) :] * span - base

    def forward(x: list[np.ndarray], gx: np.ndarray, y: list[np.ndarray], gy: np.ndarray, after: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, first = gy + y[2], x[1] * width
        low = np.searchsorted(keys, gx + np.maximum(x[2] + after, first))
        high = np.searchsorted(keys, gx + np.minimum(x[3], first + width - 1), "right")
        upto = np.cumsum(np.maximum(high - low, 0))
        for at in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(at, min(at + PAIRS, int(upto[-1])))
            i = np.searchsorted(upto, pair, "right")
            yield i, high[i] - (upto[i] - pair)

    yield from forward(a, ga, b, gb, 0)
    for j, i in forward(b, gb, a, ga, 1):
        yield i, j


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    found = [table.column(c).to_numpy() for c in names]
    order = np.lexsort((found[2], found[1], found[0]))
    return [c[order] for c in found]


def _grouped(left: DataFrame, right: DataFrame, width: int) -> tuple:
    """Both sides cogrouped by the hash of (key, shard), in groups of about GROUP_ROWS rows."""
    left, right = (stored(x, "intervals") for x in _sharded(left, right, width))
    groups = max(64, (left.count() + right.count()) // GROUP_ROWS)
    of = F.pmod(F.xxhash64("key", "shard"), F.lit(groups)).alias("group")
    return left.select("*", of).groupBy("group"), right.select("*", of).groupBy("group")


def overlapping_pairs(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """left_id, right_id of every pair of intervals (id, key, s, e) that share a key and a slot, each once. Rows without key or start meet nothing."""
    sides = [x.where("key is not null and s is not null").select("key", F.col("s").cast("long").alias("s"), F.coalesce(F.col("e").cast("long"), F.lit(OPEN)).alias("e"), "id") for x in (left, right)]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names, out = ["key", "shard", "s", "e", "id"], []
        if a.num_rows and b.num_rows:
            x, y = _columns(a, names), _columns(b, names)
            out = [(x[4][i], y[4][j]) for i, j in _meetings(x[:4], y[:4], width)]
        join = lambda k: np.concatenate([p[k] for p in out]) if out else np.zeros(0, np.int64)
        return pa.table({"left_id": join(0), "right_id": join(1)})

    first, second = _grouped(*sides, width)
    return first.cogroup(second).applyInArrow(run, "left_id long, right_id long")


def relation_sums(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of every left class (key, s, e) and relation to right classes (key, s, e, n, check): n_pairs, overlap_slots (null if both are open) and the sum of check."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["key", "shard", "s", "e"]
        x = _columns(a, names) if a.num_rows and b.num_rows else [np.zeros(0, np.int64)] * 4
        sums = np.zeros((3, len(x[0]) * 9), np.int64)
        if len(x[0]):
            y = _columns(b, [*names, "n", "check"])
            for i, j in _meetings(x, y[:4], width):
                relation = 4 + 3 * np.sign(x[2][i] - y[2][j]) + np.sign(x[3][i] - y[3][j])
                low, at = np.maximum(x[2][i], y[2][j]), 9 * i + relation
                shared = np.where((x[3][i] == OPEN) & (y[3][j] == OPEN), 0, np.minimum(x[3][i], y[3][j]) - low + 1)
                np.add.at(sums[0], at, y[4][j])
                np.add.at(sums[1], at, y[4][j] * shared)
                np.add.at(sums[2], at, y[5][j])
        at = np.flatnonzero(sums[0])
        own, relation = at // 9, at % 9
        never = (x[3][own] == OPEN) & (relation % 3 == 1)
        return pa.table({"key": x[0][own], "s": x[2][own], "e": x[3][own], "relation": relation, "n_pairs": sums[0][at], "overlap_slots": pa.array(sums[1][at], pa.int64(), mask=never), "check": sums[2][at]})

    first, second = _grouped(left, right, width)
    found = first.cogroup(second).applyInArrow(run, "key long, s long, e long, relation long, n_pairs long, overlap_slots long, check long")
    # a class that reaches several shards has a row from each
    return found.groupBy("key", "s", "e", "relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("overlap_slots").alias("overlap_slots"), F.sum("check").alias("check"))


def sale_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, slot: int = DAY, gap: int = GAP) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots and sessions_crc of every sale that shares a slot with a click session of its client.

    Defined cases: rows without client or time play no part; every row of sales is a sale of its own, with the lines of its sale_id (rows with
    one id each give rows; a null id has no lines); repeated clicks and lines change nothing; a ship time before the sale's is
    ignored; a null status or kind is another one than held or click; other columns play no part; empty tables give no rows.
    """
    begin = floored(F.col("first_us"), slot).alias("s")
    end = F.when(F.col("open"), F.lit(OPEN)).otherwise(floored(F.col("last_us"), slot)).alias("e")
    found = sessions(clicks, gap)
    own = found.select(F.col("client_id").alias("key"), begin, end, F.crc32(F.col("first_us").cast("string")).alias("crc"))
    right = own.groupBy("key", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("check"))
    sold = sale_intervals(sales, lines)
    sold = stored(sold.select("sale_id", F.col("client_id").alias("key"), begin, end), "sale-slots")
    sums = relation_sums(sold.select("key", "s", "e").distinct(), right)
    names = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("relation") + 1).cast("int"))
    return sold.join(sums, ["key", "s", "e"]).select("sale_id", names.alias("relation"), "n_pairs", "overlap_slots", F.col("check").alias("sessions_crc"))
