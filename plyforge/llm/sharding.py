"""Shards of near-equal size from indivisible groups: best-fit-decreasing bin packing.

Groups of equal texts must not be split. Groups in descending size enter the bin with the tightest remaining capacity,
found in a balanced tree; the capacity is the smallest for which all groups fit, found by bisection. Groups of one size
are interchangeable, and once one has entered a bin, the bin stays the tightest for the next as long as it has room: so
the packer gets one row a distinct size, with the number of groups, and gives runs of them to bins, with the same result
as group by group. Distinct sizes number sqrt(2 * bytes of all texts) at most.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.textio import discard, materialize, pick

LARGE = 2048  # a group above total / LARGE takes its shard from a map, not a join: at most so many, however often the text occurs


class _Tree:
    """A treap of (remaining capacity, bin): balanced in expectation, with the successor of a capacity in O(log n)."""

    def __init__(self, seed: int = 1):
        self.root: list | None = None
        self.rng = np.random.default_rng(seed)

    def _split(self, t: list | None, key: tuple) -> tuple[list | None, list | None]:
        if t is None:
            return None, None
        if t[0] < key:
            t[2], r = self._split(t[2], key)
            return t, r
        left, t[1] = self._split(t[1], key)
        return left, t

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a if b is None else b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, key: tuple) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, None, None, self.rng.random()]), b)

    def take_tightest(self, need: int) -> tuple | None:
        """Remove and return the least key with a capacity of at least need."""
        a, b = self._split(self.root, (need, -1))
        if b is None:
            self.root = a
            return None
        least = b
        while least[1] is not None:
            least = least[1]
        key = least[0]
        _, rest = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, rest)
        return key


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """Bin of each item; with bins given, None if the items don't fit in so many. Equal sizes go in order of position.

    Without a number of bins, a new one is opened whenever no open bin has room; an item above the capacity stands alone.
    """
    sizes = list(sizes)
    tree, made = _Tree(), 0
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            if bins is not None and (made == bins or sizes[i] > capacity):
                return None
            found, made = (max(capacity, sizes[i]), made), made + 1
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


def pack_runs(runs: list[tuple[int, int]], capacity: int, bins: int) -> list[tuple[int, int, int]] | None:
    """(size, number, bin) by best-fit-decreasing of runs (size, number) in descending size; None if they don't fit."""
    tree, made, out = _Tree(), 0, []
    for size, n in runs:
        while n:
            found = tree.take_tightest(size)
            if found is None:
                if made == bins or size > capacity:
                    return None
                found, made = (capacity, made), made + 1
            k = min(n, found[0] // size)
            out.append((size, k, found[1]))
            tree.add((found[0] - k * size, found[1]))
            n -= k
    return out


def balance(runs: Iterable[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """pack_runs with the least capacity that it finds feasible by bisection."""
    runs = sorted(runs, reverse=True)
    low = max(-(-sum(s * n for s, n in runs) // bins), runs[0][0] if runs else 0)
    best, step = pack_runs(runs, low, bins), 1
    high = low
    while best is None:
        low, high = high + 1, low + step
        best = pack_runs(runs, high, bins)
        step *= 4
    while low < high:
        mid = (low + high) // 2
        tried = pack_runs(runs, mid, bins)
        if tried is None:
            low = mid + 1
        else:
            best, high = tried, mid
    return best


def _numbered(rows: DataFrame, by: str, order: list[str], parts: int, part: str) -> DataFrame:
    """rows with nth, from 0 without gaps within `by`: numbered part by part, so that no task sees more than one part."""
    sums = rows.groupBy(by, part).agg(F.count(F.lit(1)).alias("n"))
    base = sums.select(by, part, (F.sum("n").over(Window.partitionBy(by).orderBy(part)) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy(by, part).orderBy(*order)) - 1
    return rows.withColumn("rank", rank).join(base, [by, part]).withColumn("nth", (F.col("rank") + F.col("base")).cast("long")).drop("rank", "base", part)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each document, under the law `bytes`.

    size is the text's UTF-8 bytes plus 1 (null text: 1, crc32 of nothing). Equal texts share a shard, null and empty
    ones too; shard sizes are as equal as the groups allow. Ties: groups of one size go to its bins in the order of hashes
    of their texts. slot numbers a shard's rows from 0 without gaps. grown_shard is null: this law makes no promise on
    growth. Repeated rows are rows of their own; null ids are kept. Other columns aren't read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pick(docs, id_col, text_col).select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("part", F.pmod(F.xxhash64("group", F.lit(11)), F.lit(parts)).cast("int"))
    groups = materialize(groups, "shard-groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    runs = list(zip(sizes["bytes"].tolist(), sizes["n"].tolist(), strict=True))
    plan = pd.DataFrame(balance(runs, shards), columns=["bytes", "k", "shard"], dtype="int64")
    plan["till"] = plan.groupby("bytes")["k"].cumsum()
    plan["from"] = plan["till"] - plan["k"]
    plan = spark.createDataFrame(plan, "bytes long, k long, shard long, till long, from long").select("bytes", "from", "till", F.col("shard").cast("int").alias("shard"))
    of_group = _numbered(groups, "bytes", ["group"], parts, "part").join(plan, "bytes").where("nth >= from and nth < till").select("group", "bytes", "shard")
    of_group = materialize(of_group, "shard-of-group")
    total = sum(s * n for s, n in runs)
    large = {r[0]: r[1] for r in of_group.where(F.col("bytes") * LARGE > total).select("group", "shard").collect()}
    known = F.col("group").isin(*large)
    placed = rows.where(~known).join(of_group.select("group", "shard"), "group")
    if large:
        own = F.create_map(*[x for g, s in sorted(large.items()) for x in (F.lit(g), F.lit(s))])
        placed = placed.unionByName(rows.where(known).withColumn("shard", F.element_at(own, F.col("group"))))
    placed = placed.select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(parts)).cast("int").alias("part"))
    placed = materialize(placed, "shard-placed")
    for x in (rows, groups, of_group):
        discard(x)
    return _numbered(placed, "shard", ["id", "text_crc32", "size"], parts, "part").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("nth").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
