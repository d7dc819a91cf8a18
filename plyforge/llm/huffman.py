"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent lanes.

File (all little-endian): b"PFH2", u8 longest code, u32 vocabulary size, u32 size of the zlib-packed u8 code lengths, the
code lengths, then the blocks, and a block of no documents as the end. Block: u32 documents, u64 ids, u32 checkpoint step, u32 size of
the zlib-packed document table (i64 document id, u32 number of ids each), u64 size of the bits; the table, the u64 bit
offsets of the checkpoints (one every `step` ids), and the bits, most significant first. A block holds whole documents,
and every checkpoint starts an independent lane, so a block is decoded with one table look-up per id over all its lanes
at once.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.pieces import PieceTable, byte_letters
from plyforge.llm.textio import chunks, discard, materialize, pick, shared_dir, small_batches

MAGIC = b"PFH2"
STEP = 128
BLOCK_IDS = 1 << 18
MAX_BITS = 16
#: Ids of a file before coding, in bytes, past which there are more files than shuffle partitions.
FILE_BYTES = 1 << 30


def id_type(path: str, end_id: int | None) -> str:
    """The smallest little-endian type that holds every id of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    largest = max([end_id or 0, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if largest < 1 << 16 else "<u4"


_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER  # second bytes, and the first byte of the Latin-1 letters
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32


class ByteEncoder:
    """Ids of many texts at once over their UTF-8 bytes: pieces are found, hashed and looked up as arrays.

    The file's model must be one that lower-cases, drops white space, splits off 's 't 're 've 'm 'll 'd, runs of letters,
    single digits and runs of other marks, and marks the ends of words, so that pieces are independent. New pieces are encoded by the library, many in one text, and told apart by the end marks;
    texts with other characters than ASCII and the Latin-1 letters, or with special tokens, go to it whole.
    """

    def __init__(self, path: str, kind: str, most: int = 1 << 19, most_bytes: int = 16 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: the library's model alone, for pieces that are split and lower-cased already
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in byte_letters().items() if b != 32}
        self.kind = np.dtype(kind)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = PieceTable(kind, most, most_bytes)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each has) of pieces of raw."""
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        groups = [[raw[a:b].decode("latin-1") for a, b in spans[s : s + 500]] for s in range(0, len(spans), 500)]
        out, sizes = [], []
        for group, e in zip(groups, self.model.encode_batch_fast([t if t.isascii() else t.translate(self.letters) for t in map(" ".join, groups)], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                out.append(ids)
                sizes.append(np.diff(cut, prepend=0))
            else:
                each = [self.whole(p.encode("latin-1").decode()) for p in group]
                out += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(out) if out else np.zeros(0, self.kind), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends) of the pieces, texts with odd characters included as they come."""
        low = _DOWN[data]
        two = np.flatnonzero(low[:-1] == 0xC3) + 1 if len(low) else np.zeros(0, np.int64)
        two = two[(low[two] >= 0x80) & (low[two] <= 0x9E)]
        low[two] += 32
        kind = _CLASS[low]
        before = np.empty_like(kind)
        before[:1], before[1:] = _SPACE, kind[:-1]
        edge = offs[:-1][np.diff(offs) > 0]
        before[edge] = _SPACE
        start = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
        tick = np.flatnonzero((low == 39) & (before != _OTHER))
        if len(tick):  # 's 't 're 've 'm 'll 'd split from what follows, unless other marks run into the apostrophe
            last = offs[np.searchsorted(offs, tick, side="right")]
            padded = np.concatenate((low, np.zeros(3, np.uint8)))
            a, b = np.where(tick + 1 < last, padded[tick + 1], 0), np.where(tick + 2 < last, padded[tick + 2], 0)
            size = np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 2, np.where(((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)), 3, 0))
            tick, size, last = tick[size > 0], size[size > 0], last[size > 0]
            start[tick + 1] = False
            after = tick + size
            after = after[after < last]
            start[after[kind[after] != _SPACE]] = True
        stop = start | (kind == _SPACE)
        stop[edge] = True
        stops = np.append(np.flatnonzero(stop), len(low))
        is_start = start[stops[:-1]]
        return low, stops[:-1][is_start], stops[1:][is_start]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of data[offs[d]:offs[d + 1]]."""
        docs = len(offs) - 1
        if not len(data):
            return [np.zeros(0, self.kind)] * docs
        self.table.begin()
        odd = np.zeros(len(data) + 1, np.int64)
        wrong = _CLASS[data] == _ODD
        nxt, prv = np.append(data[1:], 0), np.append(0, data[:-1])
        two = (data & 0xC0) == 0x80
        wrong |= two != (prv == 0xC3)  # half a letter
        wrong |= (data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))
        wrong |= (data == 60) & (nxt == 124)
        wrong[-1] |= data[-1] == 0xC3
        np.cumsum(wrong, out=odd[1:])
        slow = odd[offs[1:]] > odd[offs[:-1]]
        low, starts, ends = self.pieces(data, offs)
        if slow.any():
            keep = ~slow[np.searchsorted(offs, starts, side="right") - 1]
            starts, ends = starts[keep], ends[keep]
        raw = low.tobytes()
        flat, n = self.table.ids_of(self.table.numbers(low, starts, ends, lambda s, e: self.learn(raw, s, e)))
        bound = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=bound[1:])
        bound = bound[np.searchsorted(starts, offs)].tolist()
        out = [flat[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
        for d in np.flatnonzero(slow):
            out[d] = self.whole(data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
        return out


_KEPT: list = []


def encoder(path: str, kind: str) -> ByteEncoder:
    """The worker's encoder, kept between tasks: one at a time, its table of pieces within some 40 MB."""
    if not _KEPT or _KEPT[0] != (path, kind):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _KEPT[:] = [(path, kind), ByteEncoder(path, kind)]
    return _KEPT[1]


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths up to limit by package-merge; 0 for ids without count."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    levels, packed = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((weight, packed))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packed = merged[:even:2] + merged[1:even:2]
    take, lengths = 2 * (n - 1), np.zeros(n, np.uint8)
    for is_leaf in reversed(levels):
        leaves = int(np.count_nonzero(is_leaf[:take]))
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of given lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths = np.asarray(lengths, np.uint8)
        self.bits = bits = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.int64(1) << (bits - lengths[order].astype(np.int64))
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (bits - lengths[order].astype(np.int64))).astype(np.uint64)
        self.table_id = np.zeros(1 << bits, np.uint32)
        self.table_len = np.ones(1 << bits, np.uint8)
        total = int(span.sum())
        self.table_id[:total] = np.repeat(order, span)
        self.table_len[:total] = np.repeat(lengths[order], span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STEP-th id)."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        total = int(end[-1]) if len(end) else 0
        words = np.zeros(total // 32 + 3, np.uint64)
        if len(ids):
            at = start >> 5
            # a code of at most 32 bits lies in two neighbouring words of 32
            wide = self.codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            words[at[edge]] += np.bitwise_or.reduceat(wide >> np.uint64(32), edge)
            words[at[edge] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), edge)
        return words.astype(">u4").tobytes(), start[::STEP].astype(np.uint64)

    def unpack(self, raw: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block: all lanes advance together, one table look-up each."""
        out = np.zeros((STEP, len(offsets)), np.uint32)
        if not n:
            return out[:0].ravel()
        data = np.frombuffer(raw, ">u4").astype(np.uint64)
        pair = (data[:-1] << np.uint64(32)) | data[1:]
        pos = offsets.astype(np.int64)
        last = len(pair) - 1
        shift = np.uint64(64 - self.bits)
        for s in range(STEP):
            window = (pair[np.minimum(pos >> 5, last)] << (pos & 31).astype(np.uint64)) >> shift
            out[s] = self.table_id[window]
            pos += self.table_len[window]
        return out.T.ravel()[:n]


def write_block(book: Codebook, ids: list[int], docs: list[np.ndarray]) -> bytes:
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    raw, marks = book.pack(flat)
    table = np.zeros(len(docs), [("id", "<i8"), ("n", "<u4")])
    table["id"], table["n"] = ids, [len(d) for d in docs]
    packed = zlib.compress(table.tobytes(), 1)
    return struct.pack("<IQIIQ", len(docs), len(flat), STEP, len(packed), len(raw)) + packed + marks.astype("<u8").tobytes() + raw


def file_head(book: Codebook) -> bytes:
    packed = zlib.compress(book.lengths.tobytes(), 6)
    return MAGIC + struct.pack("<BII", book.bits, len(book.lengths), len(packed)) + packed


FILE_END = struct.pack("<I", 0)


def read_file(f) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, numbers of ids, ids) of each block of an open file."""
    if f.read(4) != MAGIC:
        raise ValueError("not a token-id file")
    _, vocab, packed = struct.unpack("<BII", f.read(9))
    book = Codebook(np.frombuffer(zlib.decompress(f.read(packed)), np.uint8)[:vocab])
    while (ndocs := struct.unpack("<I", f.read(4))[0]) > 0:
        n, step, packed, size = struct.unpack("<QIIQ", f.read(24))
        if step != STEP:
            raise ValueError(f"checkpoint step {step}")
        table = np.frombuffer(zlib.decompress(f.read(packed)), [("id", "<i8"), ("n", "<u4")])[:ndocs]
        marks = np.frombuffer(f.read(8 * ((n + STEP - 1) // STEP)), "<u8")
        yield table["id"], table["n"].astype(np.int64), book.unpack(f.read(size), marks, n)


def encode_ids(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids binary): ids of each whole text in their id_type, the end id appended."""
    kind = id_type(path, end_id)
    tail = np.array([] if end_id is None else [end_id], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1)):
                ids = [np.concatenate((x, tail)).tobytes() for x in enc.encode(data, offs)]
                n = [len(b) // tail.itemsize for b in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["id", "n", "ids"])

    return pick(docs, id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, "id long, n long, ids binary")


def global_counts(encoded: DataFrame, kind: str) -> np.ndarray:
    """Occurrences of each id over all documents; at most one number per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                c = np.bincount(np.frombuffer(raw.as_buffer(), kind))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    rows = encoded.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_files(encoded: DataFrame, kind: str, lengths: np.ndarray, folder: str, parts: int) -> DataFrame:
    """Write (id, n, ids) in ascending id order, one file for each of `parts` ranges of ids: (part, path, n_docs, n_ids).

    Blocks are written as they fill, so a range may be of any size. A task that runs again writes under another name; only
    the returned rows name valid files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        book, part = Codebook(lengths), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.pfh"
        ids, docs, held, n_docs, n_ids = [], [], 0, 0, 0
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(file_head(book))
            for batch in chain([first], batches):
                for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    d = np.frombuffer(raw.as_buffer(), kind)
                    ids.append(i)
                    docs.append(d)
                    held += len(d)
                    n_docs, n_ids = n_docs + 1, n_ids + len(d)
                    if held >= BLOCK_IDS:
                        f.write(write_block(book, ids, docs))
                        ids, docs, held = [], [], 0
            if docs:
                f.write(write_block(book, ids, docs))
            f.write(FILE_END)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    return encoded.select("id", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, "part long, path string, n_docs long, n_ids long")


def read_documents(files: DataFrame, parts: int) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files, about one a task; start counts all ids
    before it."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as f:
                    for ids, n, flat in read_file(f):
                        off = np.concatenate(([0], np.cumsum(n)))
                        raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + off[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
                        base += int(off[-1])

    return listed.select("path", "base").repartition(parts, "path").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents to token-id files and read them back: (id, start, n_tokens, ids_crc32).

    Null text counts as empty: the end id alone. Repeated ids keep their rows, next to each other; rows without id are
    left out, as they have no place in the order. Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoded = materialize(encode_ids(docs, path, end_id, id_col, text_col), "huf-ids")
    kind = id_type(path, end_id)
    counts = global_counts(encoded, kind)
    limit = max(MAX_BITS, int(np.count_nonzero(counts)).bit_length() + 1)
    lengths = code_lengths(counts, limit)
    size = int(counts.sum()) * np.dtype(kind).itemsize
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    files = materialize(write_files(encoded, kind, lengths, f"{shared_dir(spark)}/huf-{uuid.uuid4().hex}", parts), "huf-files")
    discard(encoded)
    return read_documents(files, parts).withColumnRenamed("id", id_col)
