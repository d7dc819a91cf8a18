"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of this machine only where that is unset and all runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            found = own.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="plyforge-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plyforge_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    path = getattr(df, "_plyforge_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def by_key(df: DataFrame, source: DataFrame, key: str, mb: int = 4) -> DataFrame:
    """df hashed by key into a task for every mb MB of the files of source (one a core at least): a task's share of rows
    doesn't grow with the input. Later groupings and windows by key need no other shuffle."""
    size = source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // (mb << 20))), key)


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An index that is built once a session and source folder, and read from its table from then on."""
    stamp = max((os.stat(os.path.join(source, f)).st_mtime_ns for f in os.listdir(source)), default=0) if os.path.isdir(source) else 0
    key = (spark.sparkContext.applicationId, name, source, stamp)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with a column of numbers from 0 without gaps in the order of keys.

    A range shuffle sorts, and its ranges are written once with each row's place: the ranges of two runs of one plan
    needn't agree. Their counts, one row a range, then give the numbers, so no task sees the whole table. Equal keys go in
    any order.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    base = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return rows.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
