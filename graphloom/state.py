"""Loop state: tables bucketed by a key, logs of the rows a round changes, and priority buckets over them.

A round of a traversal joins a frontier with all edges. Edges stored by `bucketed` lie in as many buckets as a shuffle has
partitions, dealt by the hash that a shuffle uses, so the scan counts as dealt by its key: the join, and a grouping by
that key, move no edge. State in a `StateLog` is bucketed by id alike and only ever appended to: a round writes what it
changes, and reads each id's last row without a shuffle. `PriorityBuckets` gives the rows of the least bucket to a round without
reading the others; an entry that no longer holds is left where it is and dropped when its bucket comes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import forget, new_folder


def bucket_count(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, so that what is shuffled to join a bucketed table meets it bucket by bucket."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write the rows to the shared folder as a table bucketed by key, and read them back."""
    spark = df.sparkSession
    path, called = new_folder(spark, name), f"graphloom_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(bucket_count(spark), key).saveAsTable(called)
    out = spark.table(called)
    out._stored_at, out._stored_as, out._stored_by = path, called, key
    return out


def keyed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, bool]:
    """The rows bucketed by key, and whether they had to be written for it (the caller forgets them then)."""
    return (df, False) if getattr(df, "_stored_by", None) == key else (bucketed(df, key, name), True)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows with an observation that has their number n after an action, without a job of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


class StateLog:
    """Rows (id, ...) of which a later one replaces an earlier one of the same id: a table bucketed by id and partitioned by version.

    An append writes only the rows it is given, as a new version; after COMPACT versions the current rows begin a new table."""

    COMPACT = 12

    def __init__(self, rows: DataFrame, name: str = "state"):
        self.spark, self.name, self.columns = rows.sparkSession, name, [c for c in rows.columns if c != "id"]
        self.table, self.number, self.kept, self.old = None, 0, 0, None
        self.changed = self.append(rows)

    def append(self, rows: DataFrame) -> int:
        """The number of rows written. They may be made from current() and last() as they were before."""
        if self.kept >= self.COMPACT:
            self._compact()
        self.number += 1
        self.changed = self._write(rows)
        self.kept += 1
        return self.changed

    def _write(self, rows: DataFrame) -> int:
        if self.table is None:
            self.table, self.path = f"graphloom_{uuid.uuid4().hex}", new_folder(self.spark, self.name)
        out, seen = counted(rows.select("id", *self.columns).withColumn("version", F.lit(self.number)))
        out = out.write.format("parquet").mode("append").option("compression", "zstd").option("path", self.path)
        out.partitionBy("version").bucketBy(bucket_count(self.spark), "id").saveAsTable(self.table)
        return seen.get["n"]

    def last(self) -> DataFrame:
        """The rows of the last append."""
        return self.spark.table(self.table).where(F.col("version") == self.number).select("id", *self.columns)

    def current(self) -> DataFrame:
        """Each id's last row."""
        if self.kept == 1:
            return self.spark.table(self.table).select("id", *self.columns)
        return self.spark.table(self.table).groupBy("id").agg(*(F.max_by(c, "version").alias(c) for c in self.columns))

    def _handle(self) -> DataFrame:
        out = self.spark.table(self.table).select("id", *self.columns)
        out._stored_at, out._stored_as, out._stored_by = self.path, self.table, "id"
        return out

    def _compact(self) -> None:
        """A table of the current rows; the one before stays until the next time, as rows that are being appended may be read from it."""
        rows, old = self.current(), self._handle()
        self.table = None
        self._write(rows)
        forget(self.old)
        self.old, self.kept = old, 1

    def close(self) -> DataFrame:
        """The current rows in one table; all else is deleted."""
        if self.kept > 1:
            self._compact()
        forget(self.old)
        self.old = None
        return self._handle()


class PriorityBuckets:
    """Entries (id, bucket) in a log partitioned by bucket. A round takes the least bucket; moves are appended, never deleted.

    WINDOW buckets from the least one on have a partition each, later ones share the last: when it is the least, its entries are dealt
    anew. The number of folders is bounded so, whatever the priorities are.
    """

    WINDOW = 128

    def __init__(self, spark: SparkSession, name: str = "buckets"):
        self.spark, self.folder, self.first, self.number, self.places = spark, new_folder(spark, name), None, 0, {}

    def add(self, rows: DataFrame) -> None:
        """rows (id, bucket long); rows without a bucket are in none."""
        rows = rows.where("bucket is not null").select("id", "bucket")
        if self.first is None:
            self.first = rows.agg(F.min("bucket")).first()[0]
            if self.first is None:
                return
        self.number += 1
        path = f"{self.folder}/{self.number}"
        slot = F.least(F.col("bucket"), F.lit(self.first + self.WINDOW)).alias("slot")
        rows.select("*", slot).hint("rebalance", "slot").write.partitionBy("slot").parquet(path)
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        for x in place.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(place):
            found = x.getPath().getName()
            if found.startswith("slot="):
                self.places.setdefault(int(found[5:]), []).append(f"{path}/{found}")

    def pop(self) -> tuple[int, DataFrame] | None:
        """The least bucket that has entries and its distinct ids, valid or not any more; None after the last one."""
        while self.places:
            least = min(self.places)
            found = self.spark.read.schema("id long, bucket long").parquet(*self.places.pop(least))
            if least < self.first + self.WINDOW:
                return least, found.select("id").distinct()
            self.first = None
            self.add(found.distinct())
        return None

    def close(self) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def frontier_edges(edges: DataFrame, frontier: DataFrame, *values: str | Column) -> DataFrame:
    """The edges (src, ...) that leave a frontier (id, ...). With both bucketed nothing moves; else the frontier alone does."""
    return edges.join(frontier.select(F.col("id").alias("src"), *values), "src")
