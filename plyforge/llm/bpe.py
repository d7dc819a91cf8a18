"""Byte-level BPE encoding and decoding with a pair occurrence index.

The index maps every adjacent pair of the unseen pieces of a run of texts to all its positions. Ranks are taken in
ascending order, a band at a time: a band is a run of ranks in which no pair holds a symbol that the band itself makes,
so all positions of a band are known when it begins, and a position is merged as soon as no neighbour in the band goes
first. Each merge adds the pairs that it makes to the lists of later bands. A merged pair's neighbours are found over
linked positions, so no symbol array is ever rebuilt. The ids of pieces are kept for the task in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from plyforge.llm.pieces import PieceTable, byte_letters, gather
from plyforge.llm.textio import chunks, pick, small_batches

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space on which libraries differ, and characters past those whose classes are the same in every Unicode version.
_ODD = re.compile("[\x1c-\x1f\x85̀-\U0010ffff]")
_SHIFT = 20
_NONE = np.int32(1 << 30)
RUN_BYTES = 2 << 20
_SPACE, _LETTER, _DIGIT, _OTHER, _MORE, _WRONG = range(6)
_CLASS = np.full(256, _WRONG, np.uint8)
_CLASS[:0x80] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x1C:0x20] = _WRONG
_CLASS[0x80:0xC0] = _MORE
#: Classes of the characters of two bytes, below U+0300.
_TWO = np.full(0x300, _OTHER, np.uint8)
for _c in range(0x80, 0x300):
    if regex.match(r"\p{L}", chr(_c)):
        _TWO[_c] = _LETTER
    elif regex.match(r"\p{N}", chr(_c)):
        _TWO[_c] = _DIGIT
    elif chr(_c) == "\xa0":
        _TWO[_c] = _SPACE
_TWO[0x85] = _WRONG


def _pool(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places, sizes) of strings."""
    n = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(n) - n, n


class Vocabulary:
    """A vocabulary file as arrays; path: a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.path = path
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        rules: dict[int, int] = {}
        self.left, self.right, self.made = (np.zeros(len(merges), np.int32) for _ in range(3))
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, self.made[rank] = vocab[a], vocab[b], vocab[a + b]
            self.left[rank], self.right[rank] = x, y
            rules.setdefault(x << _SHIFT | y, rank)
        keys = np.fromiter(rules, np.int64, len(rules))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(rules.values(), np.int32, len(rules))[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max(*vocab.values(), *self.special.values()) if self.special else 1 + max(vocab.values())
        raw: list[bytes] = [b""] * size
        self.known = np.zeros(size, bool)
        for t, i in [*((bytes(back[c] for c in t), i) for t, i in vocab.items()), *((t.encode(), i) for t, i in self.special.items())]:
            raw[i], self.known[i] = t, True
        self.bytes_of = _pool(raw)
        self.decimal = _pool([b"%d," % i for i in range(size)])
        #: first rank of each band; None if the file makes or uses a symbol out of order, where only rank by rank is right
        self.bands = self._bands()
        self.band_of = np.searchsorted(self.bands, np.arange(len(merges)), side="right").astype(np.uint16) - 1 if self.bands is not None else None
        pairs = (self.byte_id[:, None].astype(np.int64) << _SHIFT | self.byte_id[None]).ravel()
        self.byte_pairs = self.rank(pairs)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _bands(self) -> np.ndarray | None:
        born, starts, here = {int(i): -1 for i in self.byte_id}, [0], set()
        for r, (a, b, c) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True)):
            if a not in born or b not in born or c in born:
                return None
            if a in here or b in here:
                starts.append(r)
                here = set()
            born[c] = r
            here.add(c)
        return np.array(starts) if len(starts) < 1 << 16 else None

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, _NONE if no rule joins it."""
        if not len(self.keys):
            return np.full(len(pairs), _NONE)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], _NONE)


class PairIndexBpe:
    """An encoder and decoder for one vocabulary; most, most_bytes: bounds of the table of pieces."""

    def __init__(self, vocabulary: Vocabulary | str, most: int = 1 << 18, most_bytes: int = 8 << 20):
        self.v = v = Vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
        self.table = PieceTable("<i4", most, most_bytes)
        self._library = None
        self._dear = sorted(v.special)

    # merging

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each piece) of pieces that lie one after the other in data."""
        v, n = self.v, len(data)
        if v.bands is None:
            ids = [x for w in np.split(data, np.cumsum(sizes)[:-1]) for x in [self._merge_by_rank(w.tobytes())]] if len(sizes) else []
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)
        end = np.cumsum(sizes)
        full = sizes > 0
        sym = np.empty(n + 1, np.int32)
        sym[:n], sym[n] = v.byte_id[data], (1 << _SHIFT) - 1
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[end[full] - 1], prv[(end - sizes)[full]] = n, n
        nxt[n] = prv[n] = n
        rank = np.full(n + 1, _NONE)
        if n > 1:
            rank[: n - 1] = v.byte_pairs[data[:-1].astype(np.int32) << 8 | data[1:]]
            rank[end[full] - 1] = _NONE
        later: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            """Add positions to the lists of their pairs' bands."""
            if not len(at):
                return
            band = v.band_of[rank[at]]
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            edge = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            for b, s, e in zip(band[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True):
                later.setdefault(b, []).append(at[s:e])

        enter(np.flatnonzero(rank < _NONE).astype(np.int32))
        for b in range(len(v.bands)):
            if b not in later:
                continue
            low, high = v.bands[b], v.bands[b + 1] if b + 1 < len(v.bands) else len(v.made)
            lists = later.pop(b)
            at = np.concatenate(lists)
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
            fresh: list[np.ndarray] = []
            while True:
                r = rank[at]
                live = (r >= low) & (r < high)
                at, r = at[live], r[live]
                if not len(at):
                    break
                touch = nxt[at[:-1]] == at[1:]
                if touch.any():
                    # a run of one pair that overlaps itself is merged at every other place, once nothing beside it goes first
                    beside = np.zeros(len(at), bool)
                    beside[1:] = touch & (r[:-1] < r[1:])
                    beside[:-1] |= touch & (r[1:] < r[:-1])
                    head = np.ones(len(at), bool)
                    head[1:] = ~(touch & (r[1:] == r[:-1]))
                    first = np.flatnonzero(head)
                    size = np.diff(np.append(first, len(at)))
                    free = ~np.logical_or.reduceat(beside, first)
                    go = np.repeat(free, size) & ((np.arange(len(at)) - np.repeat(first, size)) % 2 == 0)
                    go = at[go]
                else:
                    go = at
                second = nxt[go]
                sym[go] = v.made[rank[go]]
                sym[second] = -1
                rank[second] = _NONE
                after = nxt[second]
                nxt[go] = after
                prv[after] = go
                prv[n] = n
                before = prv[go]
                changed = np.concatenate((go, before[before < n]))
                rank[changed] = v.rank(sym[changed].astype(np.int64) << _SHIFT | sym[nxt[changed]])
                fresh.append(changed)
                if go is at:
                    break
            changed = np.concatenate(fresh) if fresh else np.zeros(0, np.int32)
            enter(changed[rank[changed] < _NONE])
        live = sym[:n] >= 0
        count = np.zeros(n + 1, np.int64)
        np.cumsum(live, out=count[1:])
        return sym[:n][live], count[end] - count[end - sizes]

    def _merge_by_rank(self, word: bytes) -> list[int]:
        """The same for one piece with a heap of active ranks, for vocabularies without bands."""
        v = self.v
        sym, nxt, prv = [int(v.byte_id[b]) for b in word], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        where: dict[int, list[int]] = {}
        active: list[int] = []

        def enter(i: int) -> None:
            if 0 <= i and nxt[i] < len(word):
                r = int(v.rank(np.array([sym[i] << _SHIFT | sym[nxt[i]]]))[0])
                if r < _NONE:
                    if r not in where:
                        heapq.heappush(active, r)
                    where.setdefault(r, []).append(i)

        for i in range(len(word) - 1):
            enter(i)
        while active:
            r = heapq.heappop(active)
            for i in sorted(where.pop(r)):
                j = nxt[i]
                if sym[i] == v.left[r] and j < len(word) and sym[j] == v.right[r]:
                    sym[i], sym[j], nxt[i] = int(v.made[r]), -1, nxt[j]
                    if nxt[j] < len(word):
                        prv[nxt[j]] = i
                    enter(i)
                    enter(prv[i])
        return [s for s in sym if s >= 0]

    # pieces

    def pretokens(self, text: str) -> list[str]:
        """Pieces of a text, special tokens whole."""
        if self.v.split and any(t in text for t in self._dear):
            return [w for part in self.v.split.split(text) if part for w in ([part] if part in self.v.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return PATTERN.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.v.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _starts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where pieces start, whether a text must be split by the library instead)."""
        kind = _CLASS[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xCB))
        more = kind == _MORE
        if len(lead) and lead[-1] + 1 == len(data):
            lead = lead[:-1]
        good = more[lead + 1]
        lead = lead[good]
        c = _TWO[((data[lead] & 31).astype(np.int32) << 6) | (data[lead + 1] & 63)]
        kind[lead] = c
        wrong = kind == _WRONG
        kind[lead + 1] = c
        more[lead + 1] = False
        wrong |= more  # a second byte without its first
        wrong[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <| may begin a special token
        for t in self._dear:
            if not t.startswith("<|"):
                wrong |= data == t.encode()[0]
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(wrong, out=total[1:])
        slow = total[offs[1:]] > total[offs[:-1]]
        second = np.zeros(len(data), bool)
        second[lead + 1] = True
        edge = offs[:-1][np.diff(offs) > 0]
        before = np.empty_like(kind)
        before[:1], before[1:] = _OTHER, kind[:-1]
        start = kind != before
        start[edge] = True
        # the last of a run of white space before something else stands alone, or is a space and goes with what follows
        at = np.flatnonzero(start & (kind != _SPACE) & (before == _SPACE))
        at = at[~np.isin(at, edge)] if len(at) else at
        last = at - 1
        last = np.where(second[last], last - 1, last)
        start[last] = True
        glued = at[data[at - 1] == 32]
        start[glued] = False
        tick = np.flatnonzero(data == 39)
        if len(tick):
            prev = data[np.maximum(tick - 1, 0)]
            first = np.zeros(len(data), bool)
            first[edge] = True
            tick = tick[first[tick] | ((before[tick] != _OTHER) & (prev != 32))]
            stop = offs[np.searchsorted(offs, tick, side="right")]
            padded = np.concatenate((data, np.zeros(3, np.uint8)))
            a, b = np.where(tick + 1 < stop, padded[tick + 1], 0), np.where(tick + 2 < stop, padded[tick + 2], 0)
            size = np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 2, np.where(((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)), 3, 0))
            tick, size, stop = tick[size > 0], size[size > 0], stop[size > 0]
            start[tick + 1] = False
            after = tick + size
            after = after[after < stop]
            start[after[kind[after] != _SPACE]] = True
        start[second] = False
        return np.flatnonzero(start), slow

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends - starts
        ids, sizes = self.merge(gather(data, starts, n), n)
        for t in self._dear:
            raw = t.encode()
            for k in np.flatnonzero(n == len(raw)).tolist():
                if data[starts[k] : ends[k]].tobytes() == raw:
                    at = int(sizes[:k].sum())
                    ids = np.concatenate((ids[:at], [self.v.special[t]], ids[at + sizes[k] :])).astype(np.int32)
                    sizes[k] = 1
        return ids, sizes

    # texts

    def encode_run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their offsets by text) of the texts data[offs[d]:offs[d + 1]]; offs[0] is 0."""
        docs = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        if docs == 1 and len(data) > 2 * RUN_BYTES:
            return self._encode_long(data)
        self.table.begin()
        starts, slow = self._starts(data, offs)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offs, starts, side="right") - 1
        if slow.any():
            keep = ~slow[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
            parts, sizes, owner, size = [data], [], [], len(data)
            for d in np.flatnonzero(slow).tolist():
                words = [w.encode() for w in self.pretokens(data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))]
                parts += [np.frombuffer(b"".join(words), np.uint8)]
                sizes += [len(w) for w in words]
                owner += [d] * len(words)
            n = np.array(sizes, np.int64)
            begin = size + np.cumsum(n) - n
            data = np.concatenate(parts)
            starts, ends, doc = np.concatenate((starts, begin)), np.concatenate((ends, begin + n)), np.concatenate((doc, np.array(owner, np.int64)))
            order = np.argsort(doc, kind="stable")
            starts, ends, doc = starts[order], ends[order], doc[order]
        ids, n = self.table.ids_of(self.table.numbers(data, starts, ends, lambda s, e: self._learn(data, s, e)))
        count = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=count[1:])
        return ids, count[np.searchsorted(doc, np.arange(docs + 1))]

    def _encode_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A long text in runs that end between a letter and a space before a letter, where a piece always ends."""
        cls = _CLASS[data] == _LETTER
        cut = np.flatnonzero(cls[:-2] & (data[1:-1] == 32) & cls[2:]) + 1
        low = data.tobytes()
        cut = cut if not any(t.encode() in low for t in self._dear) else cut[:0]
        out, at = [], 0
        while at < len(data):
            k = np.searchsorted(cut, at + RUN_BYTES)
            end = int(cut[k]) if k < len(cut) else len(data)
            part = data[at:end]
            if end - at > 2 * RUN_BYTES:  # nowhere to cut: whole
                starts, slow = self._starts(part, np.array([0, len(part)]))
                if slow[0]:
                    part = low[at:end].decode("utf-8", "replace")
                    words = [w.encode() for w in self.pretokens(part)]
                    part, n = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
                else:
                    n = np.diff(np.append(starts, len(part)))
                self.table.begin()
                starts = np.cumsum(n) - n
                out.append(self.table.ids_of(self.table.numbers(part, starts, starts + n, lambda s, e, part=part: self._learn(part, s, e)))[0])
            else:
                out.append(self.encode_run(part, np.array([0, len(part)]))[0])
            at = end
        ids = np.concatenate(out)
        return ids, np.array([0, len(ids)])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens become these tokens."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_run(data, np.array([0, len(data)]))[0].tolist()

    def decode_run(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, their offsets by text) of runs of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.v.known) or not self.v.known[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        pool, at, n = self.v.bytes_of
        size = n[ids]
        end = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=end[1:])
        return gather(pool, at[ids], size), end[offs]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), np.int64)
        return self.decode_run(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray, offs: np.ndarray) -> tuple[memoryview, list[int]]:
        """The ids in decimals, a comma behind each, and their offsets by text."""
        pool, at, n = self.v.decimal
        size = n[ids]
        end = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=end[1:])
        return memoryview(gather(pool, at[ids], size)), end[offs].tolist()

    def digests(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the decimal ids with commas, sha256 of the decoded text) of each text."""
        ids, ioffs = self.encode_run(data, offs)
        csv, coffs = self.decimals(ids, ioffs)
        raw, roffs = self.decode_run(ids, ioffs)
        same = len(raw) == len(data) and (roffs == offs).all() and (raw == data).all()  # so it's UTF-8 as it stands
        view, roffs = memoryview(raw), roffs.tolist()
        for d, n in enumerate(np.diff(ioffs).tolist()):
            text = view[roffs[d] : roffs[d + 1]]
            if not same:
                text = bytes(text).decode("utf-8", "replace").encode()
            yield n, hashlib.sha256(csv[coffs[d] : max(coffs[d], coffs[d + 1] - 1)]).hexdigest(), hashlib.sha256(text).hexdigest()


_LOADED: dict[str, Vocabulary] = {}


def encoder(path: str) -> PairIndexBpe:
    """A new encoder for a task; the worker keeps the vocabulary's arrays (a few MB) and nothing that grows."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return PairIndexBpe(_LOADED[path])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each whole text. Null and empty texts have no ids; rows keep their multiplicity."""
    return tokenized(docs, path, (id_col,), text_col).select(id_col, "ids")


def tokenized(docs: DataFrame, path: str, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns in keep, then n_tokens, ids array<int> and whether they decode to the text, in the rows' order.

    Null text counts as empty: no ids, round_trip true.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in keep])
    schema = StructType([*kept.schema.fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(len(keep)), RUN_BYTES):
                ids, ioffs = bpe.encode_run(data, offs)
                raw, roffs = bpe.decode_run(ids, ioffs)
                if len(raw) == len(data) and (roffs == offs).all() and (raw == data).all():
                    same = np.ones(j - i, bool)
                else:
                    same = np.array([raw[roffs[d] : roffs[d + 1]].tobytes() == data[offs[d] : offs[d + 1]].tobytes() for d in range(j - i)])
                cols = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                lists = pa.ListArray.from_arrays(pa.array(ioffs.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(ioffs), pa.int64()), lists, pa.array(same)], names=[*keep, "n_tokens", "ids", "round_trip"])

    return docs.select(*[f"`{c}`" for c in keep], f"`{text_col}`").mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); bytes that aren't UTF-8 come back as the replacement character. Null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])

    return pick(encoded, id_col, "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids decoded again.

    Null text counts as empty: 0 ids and the digests of nothing. A null id comes back null. Repeated rows come back as
    often as they came; other columns aren't read; an empty table gives an empty result. Very long texts are encoded in
    runs, and a piece may be as long as its text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1), RUN_BYTES):
                n, a, b = zip(*bpe.digests(data, offs), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return pick(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
