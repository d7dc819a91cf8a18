"""Changes of a game table: each returns the new table; writing it elsewhere and renaming makes the change whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.sources.tables import numbered


def add(games: DataFrame, new: DataFrame) -> DataFrame:
    """Append games; their ids go on from the largest."""
    top = games.agg(F.coalesce(F.max("game_id") + 1, F.lit(0)).alias("top"))
    rows = renumber(new).crossJoin(F.broadcast(top)).withColumn("game_id", F.col("game_id") + F.col("top")).drop("top")
    return games.unionByName(rows.select(games.columns))


def update(games: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace games by id; the deleted flag of the old row stays."""
    flags = games.select("game_id", F.col("deleted").alias("was"))
    rows = changed.join(flags, "game_id").withColumn("deleted", F.col("was")).select(games.columns)
    return games.join(changed, "game_id", "left_anti").select(games.columns).unionByName(rows)


def set_deleted(games: DataFrame, which: Column, deleted: bool = True) -> DataFrame:
    return games.withColumn("deleted", F.when(which, F.lit(deleted)).otherwise(F.col("deleted")))


def renumber(games: DataFrame, *order: Column) -> DataFrame:
    """Ids from 0 without gaps in the given order (by id if none)."""
    return numbered(games.withColumnRenamed("game_id", "_old"), [x for x in order] or [F.col("_old")], "game_id").select(games.columns)


def compact(games: DataFrame) -> DataFrame:
    """Drop deleted games and close the gaps in the ids."""
    return renumber(games.where(~F.col("deleted")))


def sort_database(games: DataFrame, *order: Column, purge: bool = False) -> DataFrame:
    """Games in a new order with new ids; purge drops deleted ones. order names other columns than game_id, which settles ties."""
    return renumber(games.where(~F.col("deleted")) if purge else games, *order, F.col("_old"))


def save(games: DataFrame, path: str) -> None:
    """Write beside, then rename into place: at every moment the old or the new table is whole, at path or beside it.

    If the second rename fails, the old table goes back to its place.
    """
    spark = games.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, here = (jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old", ""))
    fs = here.getFileSystem(conf)
    if fs.exists(old) and not fs.exists(here):  # what an interrupted save left
        fs.rename(old, here)
    games.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, here):
        fs.rename(old, here)
        raise OSError(f"{path}.new can't be moved")
    fs.delete(old, True)
