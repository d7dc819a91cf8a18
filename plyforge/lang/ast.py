"""Syntax tree of the pattern language. Nodes are frozen, so branches of a rewrite can be compared and dropped.

Pieces are strings of letters (upper case White, '_' for empty squares); square sets are 64-bit masks, a1 lowest.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

ALL = (1 << 64) - 1
LIGHT = 0x55AA55AA55AA55AA
DARK = ALL ^ LIGHT
WHITES, BLACKS = "PNBRQK", "pnbrqk"


class Node:
    """Any query node."""


class SetNode:
    """Any square set."""


# -- square sets


@dataclass(frozen=True)
class Pieces(SetNode):
    letters: str


@dataclass(frozen=True)
class Squares(SetNode):
    mask: int


@dataclass(frozen=True)
class SetNot(SetNode):
    a: SetNode


@dataclass(frozen=True)
class SetOp(SetNode):
    """op: & | -"""

    op: str
    a: SetNode
    b: SetNode


@dataclass(frozen=True)
class Attacks(SetNode):
    """Squares of b that pieces on a attack; reverse: squares of a that attack any of b."""

    a: SetNode
    b: SetNode
    reverse: bool = False


@dataclass(frozen=True)
class Ray(SetNode):
    dirs: tuple[tuple[int, int], ...]
    a: SetNode


@dataclass(frozen=True)
class Between(SetNode):
    a: SetNode
    b: SetNode


@dataclass(frozen=True)
class Moved(SetNode):
    """a translated by each offset (files, ranks); what leaves the board is lost."""

    offsets: tuple[tuple[int, int], ...]
    a: SetNode


@dataclass(frozen=True)
class Var(SetNode):
    name: str


# -- moves


@dataclass(frozen=True)
class MovePattern:
    """Conditions on one move; None: any. who, taken, target, origin: piece letters. to accepts the king's and the rook's square."""

    src: int | None = None
    to: int | None = None
    who: str | None = None
    target: str | None = None
    capture: bool | None = None
    promo: str | None = None  # letters QRBN
    check: bool = False
    mate: bool = False
    castle: bool = False
    ep: bool = False
    dirs: tuple[tuple[int, int], ...] | None = None
    reach: tuple[int, int] = (1, 7)
    san: str | None = None
    color: str | None = None


@dataclass(frozen=True)
class Step:
    """One step of a sequence. kind: move, filter, gap, group. item: MovePattern, Node, or a tuple of steps."""

    kind: str
    item: Any = None
    lo: int = 1
    hi: int | None = 1


# -- queries


@dataclass(frozen=True)
class Header(Node):
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Truth(Node):
    a: SetNode


@dataclass(frozen=True)
class Compare(Node):
    """Cardinality of a against a number or the cardinality of a set."""

    a: SetNode
    op: str
    b: Any


@dataclass(frozen=True)
class Flag(Node):
    """check, mate, stalemate, wtm, btm, opposite_bishops, same_bishops."""

    name: str


@dataclass(frozen=True)
class Castling(Node):
    color: str
    king: bool | None
    queen: bool | None


@dataclass(frozen=True)
class Fen(Node):
    text: str


@dataclass(frozen=True)
class Attacked(Node):
    a: SetNode
    color: str


@dataclass(frozen=True)
class Ply(Node):
    op: str
    n: int
    hi: int | None = None


@dataclass(frozen=True)
class MoveNumber(Node):
    op: str
    n: int


@dataclass(frozen=True)
class Power(Node):
    """side: white, black, total, diff, raw, versus (then n is unused)."""

    side: str
    op: str
    n: int = 0


@dataclass(frozen=True)
class Pawns(Node):
    kind: str
    color: str
    op: str
    n: int


@dataclass(frozen=True)
class Ray3(Node):
    """pin or skewer: slider, first and second piece on its line."""

    kind: str
    slider: SetNode
    front: SetNode
    rear: SetNode | None


@dataclass(frozen=True)
class Fork(Node):
    attacker: SetNode
    slots: tuple[SetNode, ...]
    pool: SetNode | None = None
    op: str = ">="
    n: int = 2


@dataclass(frozen=True)
class Trapped(Node):
    a: SetNode


@dataclass(frozen=True)
class Outpost(Node):
    a: SetNode


@dataclass(frozen=True)
class Files(Node):
    """open or semi-open files; files: mask of file numbers, 255 any."""

    semi: bool
    color: str | None
    files: int


@dataclass(frozen=True)
class Rook7(Node):
    color: str


@dataclass(frozen=True)
class Distance(Node):
    a: SetNode
    b: SetNode
    op: str
    n: int


@dataclass(frozen=True)
class Discovered(Node):
    color: str | None
    check: bool


@dataclass(frozen=True)
class Played(Node):
    """A move that was played; previous: the one that led here. legal: count of legal moves instead."""

    move: MovePattern
    previous: bool = False
    legal: bool = False
    op: str = ">="
    n: int = 1


@dataclass(frozen=True)
class Path(Node):
    """kind: path, cqlpath, line. color: white, black, single or None. opts: of line."""

    kind: str
    steps: tuple[Step, ...]
    color: str | None = None
    back: bool = False
    least: int = 0
    most: int | None = None
    opts: tuple[str, ...] = ()


@dataclass(frozen=True)
class And(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    a: Node


@dataclass(frozen=True)
class Scope(Node):
    """kind: parent, child, initial, terminal."""

    kind: str
    a: Node


@dataclass(frozen=True)
class PlyIn(Node):
    lo: int
    hi: int
    a: Node


@dataclass(frozen=True)
class Occurs(Node):
    op: str
    n: int
    hi: int | None
    a: Node


@dataclass(frozen=True)
class Bind(Node):
    name: str
    domain: SetNode
    a: Node


@dataclass(frozen=True)
class Play(Node):
    move: MovePattern
    a: Node
    op: str = ">="
    n: int = 1


@dataclass(frozen=True)
class WhatIf(Node):
    """changes: (verb, arguments...) in order."""

    changes: tuple[tuple, ...]
    a: Node


@dataclass(frozen=True)
class Symmetric(Node):
    kind: str
    a: Node


@dataclass(frozen=True)
class Shifted(Node):
    kind: str
    a: Node


@dataclass(frozen=True)
class Comment(Node):
    op: str
    value: str


@dataclass(frozen=True)
class Nag(Node):
    codes: tuple[int, ...]


@dataclass(frozen=True)
class Raw(Node):
    """A SQL predicate on the step's own columns: the same combinators over any timeline."""

    sql: str


def walk(x: Any):
    """x and everything below it."""
    yield x
    if is_dataclass(x):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from walk(y)


def rebuild(x: Any, f) -> Any:
    """x with f applied to every node from the leaves up; f returns its argument or another node."""
    if is_dataclass(x):
        x = replace(x, **{k.name: rebuild(getattr(x, k.name), f) for k in fields(x)})
    elif isinstance(x, tuple):
        x = tuple(rebuild(y, f) for y in x)
    return f(x)


#: Nodes that hold for a game as a whole and only gate a conjunction.
GAME_LEVEL = (Header, Occurs)


def is_game_level(x: Node) -> bool:
    if isinstance(x, GAME_LEVEL) or (isinstance(x, Scope) and x.kind in ("initial", "terminal")):
        return True
    if isinstance(x, And | Or):
        return bool(x.items) and all(map(is_game_level, x.items))
    return isinstance(x, Not) and is_game_level(x.a)


def is_header_only(x: Node) -> bool:
    if isinstance(x, Header):
        return True
    if isinstance(x, And | Or):
        return all(map(is_header_only, x.items))
    return isinstance(x, Not | Symmetric | Shifted) and is_header_only(x.a)

