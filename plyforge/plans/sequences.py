"""Matching of step patterns on the rows of one entity's timeline.

A timeline reaches the matcher as an array of bit sets, one a row: bit i tells whether predicate i holds there (move
predicates: of the move that departs from the row). A pattern is a tuple (kind, steps, color, back, least, most, opts) of
plain values, steps being (kind, predicate or steps, lo, hi).
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bit of every row: the side to move is White.
WHITE_BIT = 62


#: Bounds of what is written out as shifted columns; beyond them the matcher below runs.
MOST_WAYS, MOST_ROWS = 64, 64


class _Open(Exception):
    """The pattern has no short list of ways."""


def ways(pattern: tuple) -> list[tuple[list[tuple[int, int]], list[int]]] | None:
    """Every way through a bounded pattern, the preferred one first: (predicates and the offsets of their rows, offsets hit).

    None if the pattern has groups, options, open repetitions or too many ways.
    """
    kind, steps, color, back, _, _, opts = pattern
    stride = 2 if color and (kind == "path" or color == "single") else 1

    def go(i: int, at: int) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
        if i == len(steps):
            yield [], []
            return
        step, pred, lo, hi = steps[i]
        if hi is None or step == "group" or (step == "gap" and not any(s[0] != "gap" and s[2] for s in steps[i + 1 :])):
            raise _Open
        if kind == "line" or step == "filter":
            if step != "filter" or (lo, hi) != (1, 1) or kind == "path":
                raise _Open
            after = at + (-stride if back else stride) if kind == "line" else at
            counts = [(1, after, [(pred, at)], [at] if kind == "line" else [])]
        elif back:
            raise _Open
        elif step == "gap":
            counts = [(n, at + n * (stride if kind == "path" else 1), [], []) for n in (range(lo, hi + 1) if kind == "path" else range(hi, lo - 1, -1))]
        else:
            counts = [(n, at + n * stride, [(pred, at + j * stride) for j in range(n)], [at + j * stride + 1 for j in range(n)]) for n in range(hi, lo - 1, -1)]
        for _, after, need, hit in counts:
            if abs(after) > MOST_ROWS:
                raise _Open
            for more, rest in go(i + 1, after):
                yield need + more, hit + rest

    if opts or not steps:
        return None
    out = []
    try:
        for need, hit in go(0, 0):
            if len(out) == MOST_WAYS or not need:
                return None
            out.append((need, sorted(set(hit)) or ([] if kind == "path" else [0])))
    except _Open:
        return None
    return out


class Matcher:
    def __init__(self, pattern: tuple, rows: list[int]):
        self.kind, self.steps, self.color, self.back, self.least, self.most, self.opts = pattern
        self.rows, self.last = rows, len(rows) - 1

    def _move(self, pred: int, p: int) -> bool:
        return 0 <= p < self.last and bool(self.rows[p] >> pred & 1)

    def _at(self, pred: int, p: int) -> bool:
        return 0 <= p <= self.last and bool(self.rows[p] >> pred & 1)

    # path: consecutive moves; gaps take as few moves as they can, repetitions as many

    def _path(self, i: int, p: int, stride: int) -> list[int] | None:
        if i == len(self.steps):
            return []
        kind, pred, lo, hi = self.steps[i]
        room = (self.last - p) // stride + 1
        if kind == "gap":
            for n in range(lo, (room if hi is None else min(hi, room)) + 1):
                rest = self._path(i + 1, p + n * stride, stride)
                if rest is not None:
                    return rest
            return None
        n, most = 0, room if hi is None else hi
        while n < most and self._move(pred, p + n * stride):
            n += 1
        for k in range(n, lo - 1, -1):
            rest = self._path(i + 1, p + k * stride, stride)
            if rest is not None:
                return [p + j * stride + 1 for j in range(k)] + rest
        return None

    # cqlpath and line: (end, rows hit) of every way, longest repetition first

    def _ways(self, steps: tuple, i: int, p: int, depth: int) -> Iterator[tuple[int, list[int]]]:
        if i == len(steps):
            yield p, []
            return
        for end, hit in self._repeat(steps[i], p, depth):
            for last, more in self._ways(steps, i + 1, end, depth):
                yield last, hit + more

    def _repeat(self, step: tuple, p: int, depth: int, done: int = 0) -> Iterator[tuple[int, list[int]]]:
        kind, item, lo, hi = step
        most = (100 if self.kind == "line" else 20) if hi is None else hi
        if done < most and depth < 400:
            for end, hit in self._once(kind, item, p, depth):
                if end == p and done >= lo:
                    continue  # a repetition that doesn't advance ends
                for last, more in self._repeat(step, end, depth + 1, done + 1):
                    yield last, hit + more
        if done >= lo:
            yield p, []

    def _once(self, kind: str, item, p: int, depth: int) -> Iterator[tuple[int, list[int]]]:
        step = -1 if self.back else 1
        if self.color == "single":
            step *= 2
        if kind == "group":
            yield from self._ways(item, 0, p, depth)
        elif kind == "gap":
            if p < self.last:
                yield p + 1, []
        elif kind == "move":
            q = p - 1 if self.back else p  # backwards, the move that led here
            if self._move(item, q):
                yield p + step, [q + 1]
        elif self._at(item, p):
            yield (p + step, [p]) if self.kind == "line" else (p, [])

    def starts(self) -> Iterator[tuple[int, list[int]]]:
        """(row, rows hit) for every row at which the pattern matches."""
        for p in range(self.last + 1):
            if self.color in ("white", "black") and (self.rows[p] >> WHITE_BIT & 1) != (self.color == "white"):
                continue
            if self.kind == "path":
                hit = self._path(0, p, 2 if self.color else 1)
                if hit is not None:
                    yield p, hit
                continue
            best = None
            for end, hit in self._ways(self.steps, 0, p, 0):
                size = abs(end - p)
                if "range" in self.opts and not (self.least <= size <= (1 << 30 if self.most is None else self.most)):
                    continue
                if self.kind == "line" and size == 0 and "range" not in self.opts:
                    continue
                if best is None or size > best[0]:
                    best = (size, hit, end)
                if self.kind == "cqlpath" or "firstmatch" in self.opts:
                    break
            if best is not None:
                hit = sorted(set(best[1])) or [p]
                yield p, hit[-1:] if "lastposition" in self.opts else hit


def match(pattern: tuple, rows: list[int]) -> tuple[list[int], list[int]]:
    """(rows at which the pattern starts, rows it hits from its first start)."""
    m = Matcher(pattern, rows)
    starts, hits, until = [], [], -1
    for p, hit in m.starts():
        if "nestban" in m.opts and p <= until:
            continue
        starts.append(p)
        if not hits or m.kind == "line":
            hits += hit
        until = max([until, *hit])
    return starts, sorted(set(hits))
