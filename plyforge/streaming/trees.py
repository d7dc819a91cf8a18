"""Trees over game files that keep arriving: an extension, as batch reports have no streaming meaning of their own.

Each micro-batch is counted alone and written under its number; a batch that runs again overwrites its own part, so the
sum over all parts counts every game once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.operators import trees
from plyforge.sources import pgn


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Start counting the tree index of the PGN files that come into folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.pgn").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        games = df.select("path", F.decode("content", "utf-8").alias("text"))
        split = games.mapInPandas(_split, "game_id long, text string")
        steps = trees.chess_steps(pgn.plies_of(split), pgn.games_of(split))
        trees.tree_index(steps).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _split(frames):
    import zlib

    import pandas as pd

    from plyforge.rules.pgn import split_games

    for f in frames:
        rows = [((zlib.crc32(p.encode()) << 24) + i, g) for p, t in zip(f["path"], f["text"], strict=True) for i, g in enumerate(split_games(t))]
        yield pd.DataFrame(rows, columns=["game_id", "text"])


def total(spark: SparkSession, out: str) -> DataFrame:
    """The tree over all batches so far."""
    parts = spark.read.parquet(out)
    return parts.groupBy("pos_key", "san").agg(*[F.sum(c).alias(c) for c in ("games", "white_wins", "draws", "black_wins")])
