"""Pieces of many texts at once over their UTF-8 bytes: hashes of spans, and a table from a piece to its token ids.

Everything is an array: a table of half a million pieces is a few dozen MB, and it ends with the task that made it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

_U = np.uint64
#: The low n bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans beyond so many bytes are hashed one by one.
_LONG = 256


def byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input moves every bit of the output."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first 8 bytes, last 8 bytes beyond them) of each span of data.

    Blocks of 8 bytes go through mix() one after the other, so no relation between equal-length spans survives, as it
    does with polynomials modulo 2^64. With the length, the last two columns tell spans of up to 16 bytes apart for sure.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    n = ends - starts
    first = words[starts] & _BYTES[np.minimum(n, 8)]
    last = np.zeros(len(n), np.uint64)
    over = np.flatnonzero(n > 8)
    left = np.minimum(n[over] - 8, 8)
    last[over] = words[ends[over] - left] & _BYTES[left]
    h = mix((first + n.astype(np.uint64)) * _U(0x9E3779B97F4A7C15) + _U(0xA24BAED4963EE407))
    h[over] = mix((h[over] ^ last[over]) * _U(0xC2B2AE3D27D4EB4F))
    over = over[n[over] > 16]
    for i in over[n[over] > _LONG].tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    over, at = over[n[over] <= _LONG], 8
    while len(over):
        h[over] = mix((h[over] ^ words[starts[over] + at]) * _U(0xC2B2AE3D27D4EB4F) + _U(at))
        at += 8
        over = over[n[over] - 8 > at]
    return h, first, last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of data."""
    return span_keys(data, starts, ends)[0]


def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[at[0]:at[0] + n[0]], pool[at[1]:at[1] + n[1]] ... one after the other."""
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    where = np.repeat((at - (end - n)).astype(kind), n)
    where += np.arange(total, dtype=kind)
    return pool[where]


class PieceTable:
    """The ids of pieces seen before, found by open addressing over arrays.

    A hit agrees in all bytes: pieces of up to 16 bytes by their two ends, longer ones by a comparison with the bytes
    kept. Past `most` pieces or `most_bytes` of ids and long pieces, the next run of texts begins with those pieces alone
    that came up again after the run that brought them, or with none if these are too many.
    """

    def __init__(self, kind: str, most: int = 1 << 18, most_bytes: int = 8 << 20):
        self.kind, self.most, self.most_bytes = np.dtype(kind), most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.bits = 12
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.held = self.slots_used = 0
        self.again = np.zeros(1024, bool)
        #: hash, first and last bytes, length, place of the bytes of a long piece, place and number of the ids
        self.cols = [np.zeros(1024, t) for t in (np.uint64, np.uint64, np.uint64, np.int32, np.int32, np.int32, np.int32)]
        self.ids, self.ids_used = np.zeros(1 << 12, self.kind), 0
        self.raw, self.raw_used = np.zeros(1 << 12, np.uint8), 0

    def begin(self) -> None:
        """Before a run of texts: forget what came up once if the bounds were passed."""
        if not self._full(1):
            return
        keep = np.flatnonzero(self.again[: self.held])
        h, first, last, n, raw_at, at, size = (c[keep] for c in self.cols)
        ids, long = gather(self.ids, at, size.astype(np.int64)), n > 16
        raw = gather(self.raw, raw_at[long], n[long].astype(np.int64))
        self.clear()
        begin = np.zeros(len(keep), np.int64)
        n = n.astype(np.int64)
        begin[long] = np.cumsum(n[long]) - n[long]
        self._place(self._add((h, first, last, n), raw, begin, ids, size.astype(np.int64)))
        if self._full(2):
            self.clear()

    def _full(self, parts: int) -> bool:
        return self.held * parts > self.most or (self.ids_used * self.kind.itemsize + self.raw_used) * parts > self.most_bytes

    def _find(self, keys: tuple[np.ndarray, ...], data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h, first, last, n = keys
        mask, shift = (1 << self.bits) - 1, _U(64 - self.bits)
        at = (h >> shift).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            no = self.slot[at]
            live = no >= 0
            todo, at, no = todo[live], at[live], no[live].astype(np.int64)
            same = (self.cols[0][no] == h[todo]) & (self.cols[1][no] == first[todo]) & (self.cols[2][no] == last[todo]) & (self.cols[3][no] == n[todo])
            out[todo[same]] = no[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        far = np.flatnonzero((out >= 0) & (n > 16))
        if len(far):
            size, no = n[far].astype(np.int64), out[far]
            differ = gather(data, starts[far], size) != gather(self.raw, self.cols[4][no], size)
            end = np.cumsum(size)
            wrong = np.add.reduceat(differ.astype(np.int64), end - size) > 0
            out[far[wrong]] = -1
        return out

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _place(self, no: np.ndarray) -> None:
        """Give the pieces, whose hashes differ, slots."""
        if 2 * (self.slots_used + len(no)) > len(self.slot):
            while 2 * (self.slots_used + len(no)) > 1 << self.bits:
                self.bits += 1
            old = self.slot[self.slot >= 0].astype(np.int64)
            self.slot = np.full(1 << self.bits, -1, np.int32)
            self._fill(old)
        self._fill(no)
        self.slots_used += len(no)

    def _fill(self, no: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (self.cols[0][no] >> _U(64 - self.bits)).astype(np.int64)
        while len(no):
            free = self.slot[at] < 0
            self.slot[at[free]] = no[free]
            lost = self.slot[at] != no
            no, at = no[lost], (at[lost] + 1) & mask

    def _add(self, keys: tuple[np.ndarray, ...], data: np.ndarray, starts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces."""
        h, first, last, n = keys
        no = np.arange(self.held, self.held + len(h))
        if self.held + len(h) > len(self.cols[0]):
            room = max(self.held + len(h), 2 * len(self.cols[0]))
            *self.cols, self.again = [np.concatenate((c, np.zeros(room - len(c), c.dtype))) for c in (*self.cols, self.again)]
        long = n > 16
        kept = np.where(long, n, 0)
        raw_at = self.raw_used + np.cumsum(kept) - kept
        bytes_ = gather(data, starts[long], n[long])
        self._room("raw", self.raw_used + len(bytes_))
        self.raw[self.raw_used : self.raw_used + len(bytes_)] = bytes_
        self.raw_used += len(bytes_)
        self._room("ids", self.ids_used + len(ids))
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        for c, x in zip(self.cols, (h, first, last, n, raw_at, self.ids_used + np.cumsum(sizes) - sizes, sizes), strict=True):
            c[no] = x
        self.ids_used += len(ids)
        self.held += len(h)
        return no

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each piece; learn(starts, ends) gives the ids of pieces that the table lacks, and how many each has."""
        n = ends - starts
        keys = (*span_keys(data, starts, ends), n)
        out = self._find(keys, data, starts)
        self.again[out[out >= 0]] = True
        new = np.flatnonzero(out < 0)
        if len(new):
            order = np.argsort(keys[0][new], kind="stable")
            found = keys[0][new[order]]
            one = new[order[np.append(True, found[1:] != found[:-1])]]
            self._place(self._add(tuple(k[one] for k in keys), data, starts[one], *learn(starts[one], ends[one])))
            out[new] = self._find(tuple(k[new] for k in keys), data, starts[new])
            clash = np.flatnonzero(out < 0)  # two pieces of one hash: the other one gets no slot
            if len(clash):
                out[clash] = self._add(tuple(k[clash] for k in keys), data, starts[clash], *learn(starts[clash], ends[clash]))
        return out

    def ids_of(self, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, how many each has)."""
        size = self.cols[6][no].astype(np.int64)
        return gather(self.ids, self.cols[5][no], size), size
