"""SQL expressions over 64-bit boards: shifts that don't wrap, rays, fills, counts. All stay inside generated code."""

from __future__ import annotations

from itertools import count

from plyforge.rules.board import PAWN_HITS, STEPS, _walk, signed

_FRESH = count()


def lit(mask: int) -> str:
    v = signed(mask)
    return "(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L" if v >= 0 else f"({v}L)"


def let(value: str, body) -> str:
    """body(name) with value computed once; body gets the name it is bound to."""
    name = f"v{next(_FRESH)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def landing(df: int, dr: int) -> int:
    """Squares from which a step of (df, dr) stays on the board."""
    return sum(1 << s for s in range(64) if 0 <= (s & 7) + df < 8 and 0 <= (s >> 3) + dr < 8)


def moved(a: str, df: int, dr: int) -> str:
    k = df + 8 * dr
    keep = f"({a} & {lit(landing(df, dr))})"
    return keep if k == 0 else f"shiftleft({keep}, {k})" if k > 0 else f"shiftrightunsigned({keep}, {-k})"


def union(parts: list[str]) -> str:
    return "(" + " | ".join(parts) + ")" if parts else "0L"


def ray(a: str, dirs) -> str:
    """Up to seven steps in each direction, not blocked."""
    return let(a, lambda v: union([moved(v, x * n, y * n) for x, y in dirs for n in range(1, 8)]))


_WAYS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))


def between(a: str, b: str) -> str:
    """Squares strictly between collinear squares of a and b: ahead of one and behind the other in the same direction."""
    return let(a, lambda x: let(b, lambda y: union([f"({ray(x, [d])} & {ray(y, [(-d[0], -d[1])])})" for d in _WAYS])))


def fill(a: str, up: bool) -> str:
    """a and all squares of its files above (or below)."""
    s = "shiftleft" if up else "shiftrightunsigned"
    one = let(a, lambda v: f"({v} | {s}({v}, 8))")
    two = let(one, lambda v: f"({v} | {s}({v}, 16))")
    return let(two, lambda v: f"({v} | {s}({v}, 32))")


def file_fill(a: str) -> str:
    return f"({fill(a, True)} | {fill(a, False)})"


def beside(a: str) -> str:
    return let(a, lambda v: f"({moved(v, 1, 0)} | {moved(v, -1, 0)})")


def files_of(a: str) -> str:
    """The occupied files as eight bits."""
    return f"({fill(a, False)} & 255L)"


def has(a: str, i: str) -> str:
    return f"((shiftrightunsigned({a}, cast({i} as int)) & 1L) = 1L)"


def bit(i: str) -> str:
    return f"shiftleft(1L, cast({i} as int))"


def pawn_hits(pawns: str, white: bool) -> str:
    d = 1 if white else -1
    return let(pawns, lambda v: f"({moved(v, 1, d)} | {moved(v, -1, d)})")


def passed(own: str, foe: str, white: bool) -> str:
    """Own pawns with no enemy pawn ahead on their own or a neighbouring file."""
    front = fill(moved(foe, 0, -1 if white else 1), not white)
    return let(front, lambda f: f"({own} & ~({f} | {beside(f)}))")


def isolated(own: str) -> str:
    return f"({own} & ~{beside(file_fill(own))})"


def backward(own: str, foe: str, white: bool) -> str:
    """Own pawns without a friend level or behind on a neighbouring file, whose next square an enemy pawn attacks."""
    supported = fill(beside(own), white)
    stopped = moved(pawn_hits(foe, not white), 0, -1 if white else 1)
    return f"({own} & ~{supported} & {stopped})"


def islands(own: str) -> str:
    return let(files_of(own), lambda f: f"cast(bit_count({f} & ~shiftleft({f}, 1)) as int)")


def pawn_count(kind: str, own: str, foe: str, white: bool) -> str:
    if kind == "islands":
        return islands(own)
    if kind == "doubled":
        return f"(bit_count({own}) - bit_count({files_of(own)}))"
    board = {"passed": lambda: passed(own, foe, white), "isolated": lambda: isolated(own), "backward": lambda: backward(own, foe, white)}[kind]()
    return f"bit_count({board})"


def outposts(own: str, foe: str, white: bool) -> str:
    """Squares on ranks 4-6 (5-3 for Black) that a friendly pawn guards and no enemy pawn can ever attack."""
    ranks = sum(0xFF << (8 * r) for r in ((3, 4, 5) if white else (2, 3, 4)))
    span = pawn_hits(fill(foe, not white), not white)
    return f"({lit(ranks)} & {pawn_hits(own, white)} & ~{span})"


# -- attacks of whole boards: tables of rays cut at the first piece


def table(squares) -> str:
    """An array of 64 sets, one for each square."""
    return "array(" + ", ".join(lit(sum(1 << t for t in x)) for x in squares) + ")"


_RAYS = {d: table(_walk(s, *d) for s in range(64)) for d in _WAYS}
_OCCUPIED = "(p | n | b | r | q | k)"


def nearest(a: str, d: tuple[int, int]) -> str:
    """The square of a that a ray in direction d meets first: its lowest or highest bit. Of no square: any."""
    if d[0] + 8 * d[1] < 0:
        return f"(length(bin({a})) - 1)"
    # no ray upwards holds square 0, so a may be halved, and the highest bit is no sign
    return let(f"shiftrightunsigned({a}, 1)", lambda v: f"bit_count({v} ^ ({v} - 1L))")


def sight(i: str, d: tuple[int, int], occupied: str) -> str:
    """Squares seen from square i in direction d, up to the first piece."""
    ray = f"{_RAYS[d]}[{i}]"
    if d[0] + 8 * d[1] < 0:
        return f"({ray} & shiftleft(-1L, {nearest(f'({ray} & {occupied})', d)}))"
    return let(f"shiftrightunsigned({ray} & {occupied}, 1)", lambda v: f"({ray} & (shiftleft({v} ^ ({v} - 1L), 1) | 1L))")


def attack_maps() -> str:
    """array<bigint>: the squares that the piece on each square attacks, whether or not the position is legal."""

    def piece(o: str) -> str:
        straight, slant = (union([sight("i", d, o) for d in _WAYS if (0 in d) == along]) for along in (True, False))
        slides = f"(if({has('(r | q)', 'i')}, {straight}, 0L) | if({has('(b | q)', 'i')}, {slant}, 0L))"
        pawn = f"if({has('w', 'i')}, {table(PAWN_HITS[True])}[i], {table(PAWN_HITS[False])}[i])"
        return f"case when not {has(o, 'i')} then 0L when {has('p', 'i')} then {pawn} when {has('n', 'i')} then {table(STEPS['N'])}[i] when {has('k', 'i')} then {table(STEPS['K'])}[i] else {slides} end"

    return let(_OCCUPIED, lambda o: f"transform(sequence(0, 63), i -> {piece(o)})")


def piece_lines() -> str:
    """array<struct<slider, front, rear>>: the first two pieces that every ray of every slider meets."""

    def met(d: tuple[int, int], o: str) -> str:
        sliders = "(r | q)" if 0 in d else "(b | q)"
        return let(f"if({has(sliders, 's')}, {_RAYS[d]}[s] & {o}, 0L)", lambda a: let(nearest(a, d), lambda f: let(f"({a} & ~{bit(f)})", lambda c: f"if({c} = 0L, null, named_struct('slider', s, 'front', {f}, 'rear', {nearest(c, d)}))")))

    return let(_OCCUPIED, lambda o: f"flatten(transform(filter(sequence(0, 63), i -> {has('(b | r | q)', 'i')}), s -> filter(array({', '.join(met(d, o) for d in _WAYS)}), x -> x is not null)))")
