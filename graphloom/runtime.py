"""Session helpers shared by every operator: shared storage, loop state, sizes."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="graphloom-")).as_uri()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what stored() or bucketed() wrote for these frames; nothing may read them afterwards."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            if hasattr(df, "_stored_as"):
                df.sparkSession.sql(f"drop table if exists {df._stored_as}")
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """Write the rows to a path of the caller's, over what an unfinished write has left there, and read them back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name complete Parquet folders inside a folder, ascending."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path
    system = place(folder).getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(place(folder)):
        return []
    names = [x.getPath().getName() for x in system.listStatus(place(folder))]
    return sorted(int(n) for n in names if n.lstrip("-").isdigit() and system.exists(place(f"{folder}/{n}/_SUCCESS")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder, by any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
