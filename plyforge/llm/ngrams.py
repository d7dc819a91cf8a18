"""Hashed character n-grams of many texts at once, over folded UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACE = 32
_FOLD = np.full(256, SPACE, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD_DIGITS = _FOLD.copy()
_FOLD_DIGITS[48:58] = np.arange(48, 58)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def folded(data: np.ndarray, offs: np.ndarray, digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, starts): each text between two spaces; letters in lower case, other ASCII (but digits, if so asked) as spaces.

    Text d is buffer[starts[d]:starts[d + 1]], with its leading space; the next text's leading space ends it.
    """
    docs = len(offs) - 1
    buf = np.full(int(offs[-1]) + docs + 1, SPACE, np.uint8)
    starts = offs + np.arange(docs + 1)
    low = (_FOLD_DIGITS if digits else _FOLD)[data]
    if len(low):
        # capital Latin-1 letters are C3 80 to C3 9E in UTF-8, the small ones 32 higher
        wide = np.flatnonzero(low[:-1] == 0xC3) + 1
        wide = wide[(low[wide] >= 0x80) & (low[wide] <= 0x9E)]
        low[wide] += 32
    for d in range(docs):
        buf[starts[d] + 1 : starts[d] + 1 + offs[d + 1] - offs[d]] = low[offs[d] : offs[d + 1]]
    return buf, starts


def grams(buf: np.ndarray, sizes: tuple[int, ...], bits: int, inside_words: bool) -> list[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram at every position, -1 where there is none.

    With inside_words, an n-gram may begin or end with the space beside a word but not hold one within.
    """
    n, out = len(buf), []
    wide = buf.astype(np.uint64)
    h = wide.copy()
    if inside_words:
        space = buf == SPACE
        far = np.where(space, np.arange(n), n)
        nxt = np.minimum.accumulate(far[::-1])[::-1]
        nxt = np.append(nxt[1:], n)  # the next space after position i
    for size in range(2, max(sizes) + 1):
        m = n - size + 1
        if m <= 0:
            out += [np.zeros(0, np.int64)] * (size in sizes)
            h = h[:0]
            continue
        h = h[:m] * np.uint64(0x100000001B3) + wide[size - 1 :] + np.uint64(1)
        if size in sizes:
            b = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
            if inside_words:
                b[(nxt[:m] < np.arange(size - 1, n)) | (space[:m] & space[1 : m + 1])] = -1
            out.append(b)
    return out


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values (rows by position) between starts[d] and starts[d + 1]; values may end early."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    at = np.minimum(starts, len(values))
    return total[at[1:]] - total[at[:-1]]


def letters(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True for each text with an ASCII letter."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf], out=total[1:])
    return total[starts[1:]] > total[starts[:-1]]
