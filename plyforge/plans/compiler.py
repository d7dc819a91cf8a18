"""Query trees to DataFrame plans.

Every node becomes a boolean over the rows of a timeline (one row a ply). Leaves are SQL expressions; parent and child are
lag and lead; initial, terminal, occurrences and game-level terms are window aggregates over the game, so all of them
share one partitioning. Header terms are pushed to the games table and reach the timeline by a left semi join. Sequences
gather a game's predicate bits (a game is short) and match them in an Arrow function; hypothetical moves and boards
explode through the rules kernel and come back as one boolean a row.
"""

from __future__ import annotations

from dataclasses import asdict
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions import bitboards as B
from plyforge.functions import chess
from plyforge.lang import ast as A
from plyforge.lang.rewrite import expand_all
from plyforge.operators import headers
from plyforge.plans import sequences


_FRESH = count()


class CompileError(ValueError):
    pass


_SQL_OP = {"=": "=", "!=": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
_SIDE = {"white": "w", "black": "bl"}
_ROLE_COLUMN = {"P": "p", "N": "n", "B": "b", "R": "r", "Q": "q", "K": "k"}


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pieces_sql(letters: str) -> str:
    have = set(letters)
    parts = []
    if "_" in have:
        parts.append("(~(w | bl))")
    for side, all_, col in ((A.WHITES, set(A.WHITES), "w"), (A.BLACKS, set(A.BLACKS), "bl")):
        mine = have & all_
        if mine == all_:
            parts.append(col)
        else:
            parts += [f"({_ROLE_COLUMN[c.upper()]} & {col})" for c in side if c in mine and c.swapcase() not in have]
    both = [c for c in A.WHITES if c in have and c.lower() in have]
    full_w, full_b = have >= set(A.WHITES), have >= set(A.BLACKS)
    for c in both:
        if full_w and full_b:
            continue
        parts.append(_ROLE_COLUMN[c] if not (full_w or full_b) else f"({_ROLE_COLUMN[c]} & {'bl' if full_w else 'w'})")
    return B.union(parts)


def set_sql(s: A.SetNode, env: dict[str, str]) -> str:
    """The set as a BIGINT expression over the board columns."""
    if isinstance(s, A.Squares):
        return B.lit(s.mask)
    if isinstance(s, A.Pieces):
        return pieces_sql(s.letters)
    if isinstance(s, A.SetNot):
        return f"(~{set_sql(s.a, env)})"
    if isinstance(s, A.SetOp):
        a, b = set_sql(s.a, env), set_sql(s.b, env)
        return f"({a} & {b})" if s.op == "&" else f"({a} | {b})" if s.op == "|" else f"({a} & ~{b})"
    if isinstance(s, A.Moved):
        return B.let(set_sql(s.a, env), lambda v: B.union([B.moved(v, x, y) for x, y in s.offsets]))
    if isinstance(s, A.Ray):
        return B.ray(set_sql(s.a, env), s.dirs)
    if isinstance(s, A.Between):
        return B.between(set_sql(s.a, env), set_sql(s.b, env))
    if isinstance(s, A.Var):
        if s.name not in env:
            raise CompileError(f"${s.name} is not bound")
        return env[s.name]
    if isinstance(s, A.Attacks):
        a, b = set_sql(s.a, env), set_sql(s.b, env)
        if s.reverse:
            return B.let(a, lambda x: B.let(b, lambda y: f"aggregate(sequence(0, 63), 0L, (t, i) -> if({B.has(x, 'i')} and (atk[i] & {y}) <> 0L, t | {B.bit('i')}, t))"))
        before, after = B.bit("|").split("|")
        if isinstance(s.a, A.Var) and a.startswith(before):  # bound to one square: no loop over all
            return f"(atk[{a.removeprefix(before).removesuffix(after)}] & {b})"
        return B.let(a, lambda x: f"(aggregate(sequence(0, 63), 0L, (t, i) -> if({B.has(x, 'i')}, t | atk[i], t)) & {b})")
    raise CompileError(f"unknown set {s}")


def power_sql(side: str) -> str:
    def one(c):
        return f"(bit_count(p & {c}) + 3 * bit_count(n & {c}) + 3 * bit_count(b & {c}) + 5 * bit_count(r & {c}) + 9 * bit_count(q & {c}))"

    w, b = one("w"), one("bl")
    return {"white": w, "black": b, "total": f"({w} + {b})", "diff": f"abs({w} - {b})", "raw": f"({w} - {b})"}[side]


def value_sql(i: str) -> str:
    return "(case " + " ".join(f"when {B.has(c, i)} then {v}" for c, v in (("k", 100), ("q", 9), ("r", 5), ("b", 3), ("n", 3), ("p", 1))) + " else 0 end)"


def move_sql(m: A.MovePattern, v: str) -> str:
    """Conditions on the move struct v; false where there is none."""
    c = [f"{v} is not null"]
    letter = f"if({v}.white, {v}.role, lower({v}.role))"
    if m.src is not None:
        c.append(f"({B.bit(v + '.from_sq')} & {B.lit(m.src)}) <> 0L")
    if m.to is not None:
        c.append(f"(({B.bit(v + '.to_sq')} | {B.bit(v + '.to_norm')}) & {B.lit(m.to)}) <> 0L")
    if m.who:
        c.append(f"instr({text_literal(m.who)}, {letter}) > 0")
    if m.capture:
        c.append(f"{v}.capture")
    if m.target:
        c.append(f"instr({text_literal(m.target)}, if({v}.captured = '', '_', {v}.captured)) > 0")
    if m.promo:
        c.append(f"({v}.promo <> '' and instr('{m.promo}', {v}.promo) > 0)")
    c += [f"{v}.{f}" for f in ("check", "mate", "castle", "ep") if getattr(m, f)]
    if m.color:
        c.append(f"{v}.white" if m.color == "white" else f"not {v}.white")
    if m.san is not None:
        c.append(f"regexp_replace({v}.san, '[+#!?]', '') = {text_literal(m.san)}")
    if m.dirs is not None:
        df, dr = f"({v}.to_norm % 8 - {v}.from_sq % 8)", f"({v}.to_norm div 8 - {v}.from_sq div 8)"
        c.append("(" + " or ".join(f"({df} = {x * n} and {dr} = {y * n})" for x, y in m.dirs for n in range(m.reach[0], m.reach[1] + 1)) + ")")
    return "coalesce(" + " and ".join(c) + ", false)"


def fen_sql(text: str) -> str:
    """A whole FEN: board, turn and rights. Else a pattern by ranks: * any run, ? or . any square, A and a any piece."""
    part = text.split()
    rows = part[0].split("/")
    if len(rows) > 8:
        raise CompileError(f"more than eight ranks: {text!r}")
    full = len(rows) == 8 and len(part) >= 3 and all(sum(int(c) if c.isdigit() else 1 for c in r) == 8 for r in rows) and all(c in "12345678PNBRQKpnbrqk" for r in rows for c in r)
    if full:
        return f"substring_index(epd, ' ', 3) = {text_literal(' '.join(part[:3]))}"
    c = []
    for i, row in enumerate(rows):
        rx = ""
        for x in row:
            rx += {"*": ".{0,8}", "?": ".", ".": ".", "A": "[PNBRQK]", "a": "[pnbrqk]", "_": "[.]"}.get(x) or (f"[.]{{{x}}}" if x.isdigit() else x)
        if rx != ".{0,8}":
            c.append(f"substring(board, {8 * i + 1}, 8) rlike '^{rx}$'")
    if len(part) > 1 and part[1] in ("w", "b"):
        c.append("wtm" if part[1] == "w" else "not wtm")
    return "(" + " and ".join(c or ["true"]) + ")"


class Compiler:
    """Plans for one timeline: rows(game, ply, ...) and games(game, headers...)."""

    def __init__(self, rows: DataFrame, games: DataFrame | None = None, game: str = "game_id", ply: str = "ply"):
        self.df, self.games, self.game, self.ply = rows, games, game, ply
        self.g, self.p = f"_g{next(_FRESH)}", f"_p{next(_FRESH)}"  # nested compilers meet in one plan: names are never shared

    def add(self, expr: str | Column) -> str:
        name = f"_c{next(_FRESH)}"
        self.df = self.df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)
        return name

    def over(self, ordered: bool = False) -> str:
        return f"over (partition by {self.game}" + (f" order by {self.ply})" if ordered else ")")

    def next_move(self) -> str:
        if "_next_mv" not in self.df.columns:
            self.df = self.df.withColumn("_next_mv", F.expr(f"lead(mv) {self.over(True)}"))
        return "_next_mv"

    def any_in_game(self, hit: str) -> str:
        return self.add(f"max({hit}) {self.over()}")

    # -- leaves

    def leaf(self, q: A.Node, env: dict[str, str]) -> str | None:
        """SQL of a predicate on one position, or null if q needs more than that."""
        if isinstance(q, A.Raw):
            return f"coalesce({q.sql}, false)"
        if isinstance(q, A.Truth):
            return f"({set_sql(q.a, env)} <> 0L)"
        if isinstance(q, A.Compare):
            b = str(q.b) if isinstance(q.b, int) else f"bit_count({set_sql(q.b, env)})"
            return f"(bit_count({set_sql(q.a, env)}) {_SQL_OP[q.op]} {b})"
        if isinstance(q, A.Flag):
            one_each = "bit_count(b & w) = 1 and bit_count(b & bl) = 1"
            light = B.lit(A.LIGHT)
            return {
                "check": "is_check", "mate": "(is_check and legal_count = 0)", "stalemate": "(not is_check and legal_count = 0)", "wtm": "wtm", "btm": "(not wtm)",
                "opposite_bishops": f"({one_each} and (((b & w & {light}) = 0L) <> ((b & bl & {light}) = 0L)))", "same_bishops": f"({one_each} and (((b & w & {light}) = 0L) = ((b & bl & {light}) = 0L)))",
            }[q.name]
        if isinstance(q, A.Castling):
            king, queen = (1, 2) if q.color == "white" else (4, 8)
            c = [f"((castling & {m}) {'<>' if want else '='} 0)" for m, want in ((king, q.king), (queen, q.queen)) if want is not None]
            return "(" + " and ".join(c) + ")"
        if isinstance(q, A.Fen):
            return fen_sql(q.text)
        if isinstance(q, A.Attacked):
            return f"({set_sql(A.Attacks(A.Pieces(A.WHITES if q.color == 'white' else A.BLACKS), q.a), env)} <> 0L)"
        if isinstance(q, A.Ply):
            return f"({self.ply} between {q.n} and {q.hi})" if q.op == "between" else f"({self.ply} {_SQL_OP[q.op]} {q.n})"
        if isinstance(q, A.MoveNumber):
            return f"(greatest(1, ({self.ply} + 1) div 2) {_SQL_OP[q.op]} {q.n})"
        if isinstance(q, A.Power):
            return f"({power_sql('white')} {_SQL_OP[q.op]} {power_sql('black')})" if q.side == "versus" else f"({power_sql(q.side)} {_SQL_OP[q.op]} {q.n})"
        if isinstance(q, A.Pawns):
            white = q.color != "black"
            own, foe = ("(p & w)", "(p & bl)") if white else ("(p & bl)", "(p & w)")
            return f"({B.pawn_count(q.kind, own, foe, white)} {_SQL_OP[q.op]} {q.n})"
        if isinstance(q, A.Ray3):
            return self.ray3(q, env)
        if isinstance(q, A.Fork):
            return self.fork(q, env)
        if isinstance(q, A.Trapped):
            free = f"(atk[i] & ~if({B.has('w', 'i')}, w | {B.pawn_hits('(p & bl)', False)}, bl | {B.pawn_hits('(p & w)', True)}))"
            return B.let(f"({set_sql(q.a, env)} & ~(k | p))", lambda a: f"exists(sequence(0, 63), i -> {B.has(a, 'i')} and {free} = 0L)")
        if isinstance(q, A.Outpost):
            return B.let(set_sql(q.a, env), lambda a: f"((({a} & w & {B.outposts('(p & w)', '(p & bl)', True)}) | ({a} & bl & {B.outposts('(p & bl)', '(p & w)', False)})) <> 0L)")
        if isinstance(q, A.Files):
            return self.files(q)
        if isinstance(q, A.Rook7):
            rank, side = (6, "w") if q.color == "white" else (1, "bl")
            return f"((r & {side} & {B.lit(0xFF << 8 * rank)}) <> 0L)"
        if isinstance(q, A.Distance):
            far = "greatest(abs(i % 8 - j % 8), abs(i div 8 - j div 8))"
            return B.let(set_sql(q.a, env), lambda a: B.let(set_sql(q.b, env), lambda b: f"exists(sequence(0, 63), i -> {B.has(a, 'i')} and exists(sequence(0, 63), j -> {B.has(b, 'j')} and {far} {_SQL_OP[q.op]} {q.n}))"))
        if isinstance(q, A.Discovered):
            sides = [q.color] if q.color else ["white", "black"]
            c = []
            for s in sides:
                mine, foe = ("QRB", A.BLACKS) if s == "white" else ("qrb", A.WHITES)
                target = ("k" if s == "white" else "K") if q.check else foe
                c.append(f"{set_sql(A.Attacks(A.Pieces(mine), A.Pieces(target)), env)} <> 0L")
            return "(" + " or ".join(c) + ")"
        if isinstance(q, A.Comment):
            return f"({headers.text_sql('mv.comment', q.op, q.value)} and mv.comment is not null)"
        if isinstance(q, A.Nag):
            return f"coalesce(arrays_overlap(mv.nags, array({', '.join(map(str, q.codes))})), false)"
        return None

    def ray3(self, q: A.Ray3, env: dict[str, str]) -> str:
        c = [B.has(set_sql(q.slider, env), "x.slider"), B.has(set_sql(q.front, env), "x.front"), f"{B.has('w', 'x.slider')} <> {B.has('w', 'x.front')}", f"{B.has('w', 'x.front')} = {B.has('w', 'x.rear')}"]
        if q.rear is not None:
            c.append(B.has(set_sql(q.rear, env), "x.rear"))
        front, rear = value_sql("x.front"), value_sql("x.rear")
        if q.kind == "skewer":
            c.append(f"({front} >= {rear})")
        elif q.rear is None:
            c.append(f"({rear} > {front})")
        return f"exists(lines, x -> {' and '.join(c)})"

    def fork(self, q: A.Fork, env: dict[str, str]) -> str:
        c = []
        if q.pool is not None:
            c.append(f"bit_count(t & {set_sql(q.pool, env)}) {_SQL_OP[q.op]} {q.n}")
        slots = [set_sql(s, env) for s in q.slots]
        for pick in range(1, 1 << len(slots)):  # each choice of slots needs as many targets: then all can be assigned apart
            of = [s for i, s in enumerate(slots) if pick >> i & 1]
            c.append(f"bit_count(t & {B.union(of)}) >= {len(of)}")
        c.append("bit_count(t) >= 2")
        inner = f"element_at(transform(array(atk[i] & if({B.has('w', 'i')}, bl, w)), t -> {' and '.join(c)}), 1)"
        return B.let(set_sql(q.attacker, env), lambda a: f"exists(sequence(0, 63), i -> {B.has(a, 'i')} and {inner})")

    def files(self, q: A.Files) -> str:
        w, b = B.files_of("(p & w)"), B.files_of("(p & bl)")
        if not q.semi:
            return f"((~({w} | {b}) & {q.files}L) <> 0L)"
        sides = {"white": f"(~{w} & {b} & {q.files}L) <> 0L", "black": f"(~{b} & {w} & {q.files}L) <> 0L"}
        return f"({sides[q.color]})" if q.color else f"({sides['white']} or {sides['black']})"

    # -- nodes

    def hit(self, q: A.Node, env: dict[str, str] | None = None) -> str:
        """SQL of a boolean: the row belongs to q's rows."""
        env = env or {}
        found = self.leaf(q, env)
        if found is not None:
            return f"coalesce({found}, false)"
        if isinstance(q, A.Header):
            return f"({self.ply} = 0 and {self.header(q)})"
        if isinstance(q, A.And):
            return self.conjunction(q.items, env)
        if isinstance(q, A.Or):
            return "(" + " or ".join(self.hit(x, env) for x in q.items) + ")"
        if isinstance(q, A.Not):
            if A.is_header_only(q.a):
                return f"({self.ply} = 0 and not {self.gate(q.a, env)})"
            return f"(not {self.hit(q.a, env)})"
        if isinstance(q, A.Played):
            return self.played(q, anchored=False)
        if isinstance(q, A.Scope):
            return self.scope(q, env)
        if isinstance(q, A.PlyIn):
            return f"({self.ply} >= {q.lo} and {self.ply} < {q.hi} and {self.hit(q.a, env)})"
        if isinstance(q, A.Occurs):
            h = self.add(self.hit(q.a, env))
            n = self.add(f"sum(cast({h} as int)) {self.over()}")
            ok = f"{n} between {q.n} and {q.hi}" if q.op == "between" else f"{n} {_SQL_OP[q.op]} {q.n}"
            return f"({ok} and {h})" if q.n > 0 or q.op != ">=" else h
        if isinstance(q, A.Path):
            return self.path(q, env, anchored=False)
        if isinstance(q, A.Bind):
            return self.bind(q, env)
        if isinstance(q, A.Play):
            return self.play(q)
        if isinstance(q, A.WhatIf):
            return self.what_if(q)
        raise CompileError(f"no plan for {type(q).__name__}")

    def gate(self, q: A.Node, env: dict[str, str]) -> str:
        """SQL of a boolean that is the same on all rows of a game: q matches."""
        if isinstance(q, A.Header):
            return self.header(q)
        if isinstance(q, A.And) and q.items and A.is_header_only(q):
            return "(" + " and ".join(self.gate(x, env) for x in q.items) + ")"
        if isinstance(q, A.Or) and A.is_header_only(q):
            return "(" + " or ".join(self.gate(x, env) for x in q.items) + ")"
        if isinstance(q, A.Not) and A.is_header_only(q.a):
            return f"(not {self.gate(q.a, env)})"
        return self.any_in_game(self.add(self.hit(q, env)))

    def header(self, q: A.Header) -> str:
        if "_hd" not in self.df.columns:
            if self.games is None:
                raise CompileError("header terms need the games table")
            g = self.games.select(F.col(self.game).alias(self.g), F.struct(*[c for c in self.games.columns if c not in (self.game, "movetext")]).alias("_hd"))
            self.df = self.df.join(g, F.col(self.game) == F.col(self.g), "left").drop(self.g)
        return f"coalesce({headers.predicate_sql(q.name, q.op, q.value, '_hd.')}, false)"

    def conjunction(self, items: tuple[A.Node, ...], env: dict[str, str]) -> str:
        """Left to right: game-level terms gate, the rest share rows; a move after a position departs from it."""
        gates = [self.gate(x, env) for x in items if A.is_game_level(x)]
        rows: list[str] = []
        for x in items:
            if A.is_game_level(x):
                continue
            if rows and isinstance(x, A.Played) and not x.legal:
                rows.append(self.played(x, anchored=not x.previous))
            elif rows and isinstance(x, A.Path):
                rows.append(self.path(x, env, anchored=True))
            elif rows and isinstance(x, A.Not) and isinstance(x.a, A.Played) and not x.a.legal:
                rows.append(f"(not {self.played(x.a, anchored=not x.a.previous)})")
            elif rows and isinstance(x, A.Not) and isinstance(x.a, A.Path):
                rows.append(f"(not {self.path(x.a, env, anchored=True)})")
            else:
                rows.append(self.hit(x, env))
        if not rows:  # only gates, or nothing: the rows of the first gate, or the first row
            level = [x for x in items if not isinstance(x, A.Header)]
            rows = [self.hit(level[-1], env)] if level and not A.is_header_only(level[-1]) else [f"({self.ply} = 0)"]
        return "(" + " and ".join(gates + rows) + ")"

    def played(self, q: A.Played, anchored: bool) -> str:
        if q.legal:
            if "_legal" not in self.df.columns:
                self.df = self.df.withColumn("_legal", chess.legal_moves(F.col("epd")))
            n = "size(_legal)" if q.move == A.MovePattern() else f"size(filter(_legal, m -> {move_sql(q.move, 'm')}))"
            return f"({n} {_SQL_OP[q.op]} {q.n})"
        return move_sql(q.move, self.next_move() if anchored else "mv")

    def scope(self, q: A.Scope, env: dict[str, str]) -> str:
        h = self.add(self.hit(q.a, env))
        if q.kind == "parent":
            return self.add(f"coalesce(lag({h}) {self.over(True)}, false)")
        if q.kind == "child":
            return self.add(f"coalesce(lead({h}) {self.over(True)}, false)")
        if q.kind == "initial":
            return f"({h} and {self.ply} = 0)"
        last = self.add(f"max({self.ply}) {self.over()}")
        return f"({h} and {self.ply} = {last})"

    def bind(self, q: A.Bind, env: dict[str, str]) -> str:
        name = f"sq_{q.name}_{next(_FRESH)}"

        def inside(x: A.Node, e: dict[str, str]) -> str:
            found = self.leaf(x, e)
            if found is not None:
                return found
            if isinstance(x, A.And | A.Or):
                return "(" + (" and " if isinstance(x, A.And) else " or ").join(inside(y, e) for y in x.items) + ")" if x.items else "true"
            if isinstance(x, A.Not):
                return f"(not {inside(x.a, e)})"
            if isinstance(x, A.Played) and not x.legal:
                return move_sql(x.move, "mv")
            if isinstance(x, A.Bind):
                deeper = f"sq_{x.name}_{next(_FRESH)}"
                return f"exists(sequence(0, 63), {deeper} -> {B.has(set_sql(x.domain, e), deeper)} and {inside(x.a, e | {x.name: B.bit(deeper)})})"
            raise CompileError(f"{type(x).__name__} can't stand under a variable")

        return f"exists(sequence(0, 63), {name} -> {B.has(set_sql(q.domain, env), name)} and {inside(q.a, env | {q.name: B.bit(name)})})"

    # -- sequences

    def path(self, q: A.Path, env: dict[str, str], anchored: bool) -> str:
        preds: list[str] = []

        def number(sql: str) -> int:
            if sql not in preds:
                preds.append(sql)
            return preds.index(sql)

        def plain(steps):
            out = []
            for s in steps:
                if s.kind == "group":
                    item = plain(s.item)
                elif s.kind == "move" and isinstance(s.item, A.Node):  # a step of any timeline: the row that follows
                    h = self.add(self.hit(s.item, env))
                    item = number(self.add(f"coalesce(lead({h}) {self.over(True)}, false)"))
                elif s.kind == "move":
                    item = number(move_sql(s.item, self.next_move()))
                elif s.kind == "filter":
                    node = s.item
                    item = number(self.played(node, anchored=False) if isinstance(node, A.Played) and not node.legal else self.add(self.hit(node, env)))
                else:
                    item = None
                out.append((s.kind, item, s.lo, s.hi))
            return tuple(out)

        pattern = (q.kind, plain(q.steps), q.color, q.back, q.least, q.most, q.opts)
        ways = sequences.ways(pattern)
        if ways is not None:
            return self.shifted(pattern, ways, preds, anchored)
        if len(preds) > sequences.WHITE_BIT:
            raise CompileError(f"a sequence of more than {sequences.WHITE_BIT} different steps")
        if pattern[2] in ("white", "black"):
            side = f" | if(wtm, shiftleft(1L, {sequences.WHITE_BIT}), 0L)"
        else:
            side = ""
        bits = self.add(" | ".join([f"if({p}, {1 << i}L, 0L)" for i, p in enumerate(preds)] or ["0L"]) + side)

        @F.pandas_udf("struct<starts:array<int>,hits:array<int>>")
        def run(rows: pd.Series) -> pd.DataFrame:
            found = [sequences.match(pattern, [int(x) for x in r]) for r in rows]
            return pd.DataFrame({"starts": [a for a, _ in found], "hits": [b for _, b in found]})

        # one entity's rows make one array: timelines are short, entities many
        per_game = self.df.groupBy(F.col(self.game).alias(self.g)).agg(F.sort_array(F.collect_list(F.struct(self.ply, bits))).alias("_rows"))
        per_game = per_game.select(self.g, F.expr("_rows[0]").getField(self.ply).alias("_base"), run(F.col("_rows").getField(bits)).alias("_seq"))
        name = f"_s{next(_FRESH)}"
        per_game = per_game.select(self.g, F.expr(f"transform(_seq.{'starts' if anchored else 'hits'}, x -> x + _base)").alias(name))
        self.df = self.df.join(per_game, F.col(self.game) == F.col(self.g), "left").drop(self.g)
        return f"coalesce(array_contains({name}, cast({self.ply} as bigint)), false)"

    def shifted(self, pattern: tuple, ways: list, preds: list[str], anchored: bool) -> str:
        """A bounded pattern over leads and lags of its predicates: one sorted window a timeline, none of it gathered."""
        cols = [self.add(f"coalesce({p}, false)") for p in preds]
        moved: dict[tuple[str, int], str] = {}

        def at(col: str, offset: int) -> str:
            if offset == 0:
                return col
            if (col, offset) not in moved:
                moved[col, offset] = self.add(f"coalesce({'lead' if offset > 0 else 'lag'}({col}, {abs(offset)}) {self.over(True)}, false)")
            return moved[col, offset]

        side = {"white": "wtm and ", "black": "not wtm and "}.get(pattern[2], "")
        cases = " ".join(f"when {side}{' and '.join(at(cols[p], o) for p, o in dict.fromkeys(need))} then cast(array({', '.join(map(str, hit))}) as array<int>)" for need, hit in ways)
        found = self.add(f"case {cases} end")
        if anchored:
            return f"({found} is not null)"
        if pattern[0] == "line":  # every start counts, and a fixed line has one way
            start = self.add(f"({found} is not null)")
            return "(" + " or ".join(at(start, -o) for o in ways[0][1]) + ")"
        first = self.add(f"min(if({found} is null, null, named_struct('p', {self.ply}, 'o', {found}))) {self.over()}")
        return f"coalesce(array_contains({first}.o, cast({self.ply} - {first}.p as int)), false)"

    # -- hypothetical moves and boards

    def play(self, q: A.Play) -> str:
        """Legal moves that fit and lead to a position where q holds, counted."""
        base = self.df.select(self.game, self.ply, F.explode(chess.boards_after(F.col("epd"))).alias("x"))
        inner = Compiler(base.select(F.concat_ws(":", self.game, self.ply, "x.mv.uci").alias("_case"), F.col(self.game).alias(self.g), F.col(self.ply).alias(self.p), F.lit(0).alias("ply"), "x.*"), None, "_case", "ply")
        inner.df = inner.df.where(move_sql(q.move, "mv"))
        h = inner.hit(expand_all(q.a))
        good = inner.df.where(h).groupBy(self.g, self.p).agg(F.count(F.lit(1)).alias(name := f"_n{next(_FRESH)}"))
        self.df = self.df.join(good, (F.col(self.game) == F.col(self.g)) & (F.col(self.ply) == F.col(self.p)), "left").drop(self.g, self.p)
        return f"(coalesce({name}, 0L) {_SQL_OP[q.op]} {q.n})"

    def what_if(self, q: A.WhatIf) -> str:
        changes = tuple(("moves", tuple({k: v for k, v in asdict(s.item).items() if v not in (None, False)} for s in c[1] if s.kind == "move")) if c[0] == "moves" else c for c in q.changes)
        base = self.df.select(self.game, self.ply, chess.changed_boards(changes)(F.col("epd")).alias("x")).where("x.epd is not null")
        inner = Compiler(base.select(F.concat_ws(":", self.game, self.ply).alias("_case"), F.col(self.game).alias(self.g), F.col(self.ply).alias(self.p), F.lit(0).alias("ply"), "x.*", F.lit(None).cast(chess.MOVE).alias("mv")), None, "_case", "ply")
        h = inner.hit(expand_all(q.a))
        good = inner.df.where(h).select(self.g, self.p, F.lit(True).alias(name := f"_w{next(_FRESH)}")).distinct()
        self.df = self.df.join(good, (F.col(self.game) == F.col(self.g)) & (F.col(self.ply) == F.col(self.p)), "left").drop(self.g, self.p)
        return f"coalesce({name}, false)"


def search(query: A.Node, rows: DataFrame, games: DataFrame | None = None, game: str = "game_id", ply: str = "ply") -> DataFrame:
    """(game, matching_plies, match_count) of every matching game.

    Header terms of a top-level conjunction filter the games first; a query of headers alone never reads the timeline.
    """
    q = expand_all(query)
    if games is not None:
        if A.is_header_only(q) or q == A.And(()):
            ok = headers.filter_games(games, q) if q != A.And(()) else games
            return ok.select(game, F.array(F.lit(0)).alias("matching_plies"), F.lit(1).alias("match_count"))
        if isinstance(q, A.And):
            first = [x for x in q.items if A.is_header_only(x)]
            rest = tuple(x for x in q.items if not A.is_header_only(x))
            if first and rest:
                games = headers.filter_games(games, A.And(tuple(first)))
                rows = rows.join(games.select(game), game, "left_semi")
                q = A.And(rest)
    most = ply_limit(q)
    if most is not None:
        rows = rows.where(F.col(ply) <= most)
    c = Compiler(rows, games, game, ply)
    h = c.hit(q)
    found = c.df.where(h).groupBy(game).agg(F.sort_array(F.collect_list(F.col(ply).cast("int"))).alias("matching_plies"))
    return found.withColumn("match_count", F.size("matching_plies"))


def hit_rows(query: A.Node, rows: DataFrame, games: DataFrame | None = None, game: str = "game_id", ply: str = "ply") -> DataFrame:
    """(game, ply) of every row that query holds at."""
    c = Compiler(rows, games, game, ply)
    h = c.hit(expand_all(query))
    return c.df.where(h).select(game, ply)


def ply_limit(q: A.Node) -> int | None:
    """The last ply a conjunction of plain position terms can hold at, to prune the scan by."""
    if not isinstance(q, A.And) or any(isinstance(x, A.Scope | A.Occurs | A.Path | A.Played | A.Play | A.WhatIf) for x in A.walk(q)):
        return None
    found = [x.n - (x.op == "<") for x in q.items if isinstance(x, A.Ply) and x.op in ("=", "<", "<=")]
    found += [x.hi for x in q.items if isinstance(x, A.Ply) and x.op == "between"]
    return min(found) if found else None
