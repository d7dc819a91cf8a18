"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words; a term's weight is 1 + ln(occurrences), and its hash votes for or against each of
the 128 bits. Fingerprints within radius r agree on at least two of r + 2 blocks of bits, so a table for each pair of
blocks, permuted to the front as its key, finds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.minhash import _U, word_hashes
from plyforge.llm.pieces import mix
from plyforge.llm.textio import materialize, pick, small_batches

BITS = 128


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts x 16) bytes; a text without words has all bits clear. A text of one word has that word as its term."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offs[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    if not len(data):
        return out
    word, woff = word_hashes(data, offs)
    pair = word.copy()
    pair[:-1] = mix(word[:-1] * _U(0x9E3779B97F4A7C15) + word[1:] * _U(0xC2B2AE3D27D4EB4F))
    for d in range(len(texts)):
        a, b = woff[d], woff[d + 1]
        if a == b:
            continue
        terms, n = np.unique(pair[a : b - 1] if b - a > 1 else word[a:b], return_counts=True)
        both = np.empty((len(terms), 2), ">u8")
        both[:, 0], both[:, 1] = terms, mix(terms ^ _U(0x5851F42D4C957F2D))
        weight = (1 + np.log(n)).astype(np.float32)
        # whole texts, but the bits of only so many terms at a time
        votes = np.zeros(BITS)
        for s in range(0, len(terms), 8192):
            votes += weight[s : s + 8192] @ np.unpackbits(both[s : s + 8192].view(np.uint8), axis=1).astype(np.float32)
        out[d] = np.packbits(votes * 2 > weight.sum(dtype=np.float64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the angle that the share of differing bits estimates, 0 at least; rows of bytes."""
    differ = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.maximum(0.0, np.cos(np.pi * differ / BITS))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each whole text as 32 lowercase hex digits; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in range(0, len(texts), 256):
                prints = [p.tobytes().hex() for p in fingerprints(texts[s : s + 256])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, len(prints)).cast(pa.int64()), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    return pick(docs, id_col, text_col).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def within_radius(prints: DataFrame, queries: DataFrame, radius: int, col: str = "fingerprint") -> DataFrame:
    """(query, fingerprint, distance): for every distinct fingerprint of queries, all distinct ones of prints in the radius.

    Equal fingerprints are one row on either side: join them back to their documents. Nulls are left out. The tables'
    keys are hashed blocks; a hot key splits like any skewed join, and every candidate is compared on all bits. A pair
    comes from the first table alone whose key it shares, so pairs need no shuffle of their own.
    """
    blocks = radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(col).alias(name)).where(F.col(col).isNotNull()).distinct()
        bits = F.concat(*[F.lpad(F.conv(F.substring(name, s, 8), 16, 2), 32, "0") for s in (1, 9, 17, 25)])
        part = [F.substring(bits, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]
        keys = [F.xxhash64(F.lit(t), part[i], part[j]) for t, (i, j) in enumerate(combinations(range(blocks), 2))]
        halves = [F.conv(F.substring(name, s, 16), 16, -10).cast("long").alias(f"{name}_{s}") for s in (1, 17)]
        return rows.select(*halves, F.explode(F.array(*keys)).alias("key"))

    met = tables(queries, "query").join(tables(prints, "fingerprint"), "key")
    xor = [F.col(f"query_{s}").bitwiseXOR(F.col(f"fingerprint_{s}")) for s in (1, 17)]
    distance = F.bit_count(xor[0]) + F.bit_count(xor[1])

    def hexed(name: str) -> Column:
        return F.lower(F.concat(*[F.lpad(F.hex(f"{name}_{s}"), 16, "0") for s in (1, 17)])).alias(name)

    near = met.withColumn("distance", distance).where(F.col("distance") <= radius)
    return near.select(hexed("query"), hexed("fingerprint"), "distance").distinct()


def near_prints(pairs: DataFrame, radius: int, queries: Column, col: str = "fingerprint") -> DataFrame:
    """pairs with near_prints: for the rows of queries, how many other distinct fingerprints lie in the radius; else null."""
    asked = pairs.where(queries)
    counts = within_radius(pairs, asked, radius, col).where("distance > 0").groupBy("query").agg(F.count(F.lit(1)).alias("near_prints"))
    found = asked.join(counts.withColumnRenamed("query", col), col, "left").withColumn("near_prints", F.coalesce("near_prints", F.lit(0).cast("long")))
    return pairs.where(~F.coalesce(queries, F.lit(False))).withColumn("near_prints", F.lit(None).cast("long")).unionByName(found)


#: Bytes of texts for each range of ids.
RANGE_BYTES = 64 << 20
_RESULT = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> dict:
    edits = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    theirs = fingerprints(edits)
    return {
        "id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
        "fingerprint": [p.tobytes().hex() for p in prints],
        "edited_fingerprint": [p.tobytes().hex() for p in theirs],
        "near_edited": likeness(prints, theirs),
        "near_next": likeness(prints, next_prints),
    }


def _text_runs(texts: list[str], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    s = 0
    while s < len(texts):
        e, size = s, 0
        while e < len(texts) and (e == s or size + len(texts[e]) <= limit):
            size += len(texts[e])
            e += 1
        yield s, e
        s = e


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter of its code points (rounded down) replaced by the
    first as many of the next document, ascending id; after the last comes the first.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text counts as
    empty. Null ids come first in the order; rows with one id are ordered by the text's hash. A single row follows
    itself. Other columns aren't read; an empty table gives an empty result.

    The rows are sorted by ranges of ids, each text shuffled once. Every row but the last of a range meets its follower in
    the range's task; a range's first and last texts are handed on, and last ones are joined with the next range's first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, id_col, text_col).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text_col).alias("tie"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *_RESULT.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def end(kind: int, i: int | None, text: str) -> pa.RecordBatch:
            row = {"kind": kind, "part": part, "text": text, "id": i}
            return pa.RecordBatch.from_pylist([row], schema)

        held: tuple[list, list[str], np.ndarray] | None = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for s, e in _text_runs(texts):
                prints = fingerprints(texts[s:e])
                if held is None:
                    yield end(1, ids[s], texts[s])
                    some = ids[s:e], texts[s:e], prints
                else:
                    some = held[0] + ids[s:e], held[1] + texts[s:e], np.concatenate((held[2], prints))
                cols = _results(some[0][:-1], some[1][:-1], some[1][1:], some[2][:-1], some[2][1:])
                n = len(some[0]) - 1
                yield pa.RecordBatch.from_pydict({"kind": [0] * n, "part": [part] * n, "text": [None] * n} | cols, schema)
                held = some[0][-1:], some[1][-1:], some[2][-1:]
        if held is not None:
            yield end(2, held[0][0], held[1][0])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (batch.column(c).to_pylist() for c in range(3))
            for s, e in _text_runs(texts):
                t, f = texts[s:e], following[s:e]
                yield pa.RecordBatch.from_pydict(_results(ids[s:e], t, f, fingerprints(t), fingerprints(f)), pa.schema(_RESULT.items()))

    dealt = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("id", "text")
    made = materialize(dealt.mapInArrow(run, "kind int, part int, text string, " + _SCHEMA), "simhash-ranges")
    firsts = made.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    order = Window.orderBy("part")  # one number a range
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = made.where("kind = 1").select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(every)).alias("next"))
    ends = made.where("kind = 2").select("part", "id", "text").join(after, "part").join(firsts, "next").select("id", "text", "following")
    inner = made.where("kind = 0").select(*_RESULT)
    return inner.unionByName(ends.mapInArrow(last, _SCHEMA)).withColumnRenamed("id", id_col)
