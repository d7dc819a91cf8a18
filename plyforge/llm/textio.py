"""Shared plumbing: raw UTF-8 views of Arrow string columns and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.sources.tables import discard, materialize, shared_dir

__all__ = ["CHUNK_BYTES", "chunks", "discard", "documents", "materialize", "pick", "shared_dir", "small_batches", "string_buffers"]

CHUNK_BYTES = 1 << 20


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes: a batch of very long texts must not fill a Python worker. A lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. No copy of the bytes unless there are nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: (first row, end row, bytes, offsets from 0). A longer text stands alone."""
    data, offs = string_buffers(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash."""
    return docs.select(*[F.col(c) for c in cols])
