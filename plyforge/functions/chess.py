"""Arrow functions for what needs the rules of chess: legal moves, boards after them, changed boards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plyforge.rules.board import BadFen, IllegalMove, Move, Position

MOVE = "struct<uci:string,san:string,from_sq:int,to_sq:int,to_norm:int,role:string,white:boolean,capture:boolean,captured:string,promo:string,check:boolean,mate:boolean,castle:boolean,ep:boolean>"
BOARD = "p:bigint,n:bigint,b:bigint,r:bigint,q:bigint,k:bigint,w:bigint,bl:bigint,wtm:boolean,castling:int,ep:int,pos_key:bigint,epd:string,board:string,is_check:boolean,legal_count:int,atk:array<bigint>,lines:array<struct<slider:int,front:int,rear:int>>"

NAMES = ["p", "n", "b", "r", "q", "k", "w", "bl", "wtm", "castling", "ep", "pos_key", "epd", "board", "is_check", "legal_count", "atk", "lines"]


def board_columns(p: Position) -> dict:
    out: dict = p.bitboards()
    legal = p.legal()
    return out | {
        "wtm": p.white, "castling": sum(v for c, v in zip("KQkq", (1, 2, 4, 8), strict=True) if c in p.rights), "ep": p.ep if any(m.ep for m in legal) else -1, "pos_key": p.key(), "epd": p.epd(),
        "board": "".join(p.board[f + 8 * r] or "." for r in range(7, -1, -1) for f in range(8)), "is_check": p.in_check(), "legal_count": len(legal), "atk": p.attack_maps(),
        "lines": [{"slider": s, "front": a, "rear": b} for s, a, b in p.lines()],
    }


@lru_cache(4096)
def _legal(epd: str) -> list[dict]:
    p = Position.from_fen(epd)
    return [p.describe(m) for m in p.legal()]


@lru_cache(1024)
def _after(epd: str) -> list[dict]:
    p = Position.from_fen(epd)
    return [{"mv": p.describe(m)} | board_columns(p.make(m)) for m in p.legal()]


def legal_moves(epd: Column) -> Column:
    """array<MOVE> of the legal moves of a position."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_legal)

    return F.pandas_udf(run, f"array<{MOVE}>")(epd)


def boards_after(epd: Column) -> Column:
    """array<struct<mv, BOARD>> of the positions after each legal move."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_after)

    return F.pandas_udf(run, f"array<struct<mv:{MOVE},{BOARD}>>")(epd)


def apply_changes(epd: str, changes: tuple) -> Position | None:
    """The changed position, or null if a king is missing or the side that moved is left in check."""
    p = Position.from_fen(epd)
    board, white, rights, ep = p.board.copy(), p.white, p.rights, p.ep
    for c in changes:
        if c[0] == "pass":
            white, ep = not white, -1
        elif c[0] == "turn":
            white, ep = c[1], -1
        elif c[0] == "remove":
            for s in range(64):
                if c[2] >> s & 1 and board[s] and (c[1] is None or board[s] in c[1]):
                    board[s] = ""
        elif c[0] == "transfer":
            if board[c[1]]:
                board[c[2]], board[c[1]] = board[c[1]], ""
        elif c[0] == "add":
            for s in range(64):
                if c[2] >> s & 1:
                    board[s] = c[1]
        elif c[0] == "swap":
            board[c[1]], board[c[2]] = board[c[2]], board[c[1]]
        elif c[0] == "swap_color":
            for s in range(64):
                if c[1] >> s & 1:
                    board[s] = board[s].swapcase()
        elif c[0] == "moves":
            at = Position(board.copy(), white, rights, ep)
            for pattern in c[1]:
                fits = [m for m in at.legal() if move_fits(at, m, pattern)]
                if not fits:
                    return None
                at = at.make(fits[0])
            board, white, rights, ep = at.board, at.white, at.rights, at.ep
    n = Position(board, white, rights, ep)
    n.rights = "".join(c for c in rights if n._right_holds(c))
    if board.count("K") != 1 or board.count("k") != 1 or any(board[s] in ("P", "p") for s in (*range(8), *range(56, 64))):
        return None
    return None if n.attacked(n.king(not white), white) else n


def move_fits(p: Position, m: Move, k: dict) -> bool:
    """Whether a legal move meets the conditions of a move pattern given as a dict."""
    d = p.describe(m)
    letter = d["role"] if d["white"] else d["role"].lower()
    if k.get("san") is not None and d["san"].strip("+#") != k["san"]:
        return False
    if k.get("src") is not None and not k["src"] >> d["from_sq"] & 1:
        return False
    if k.get("to") is not None and not (k["to"] >> d["to_norm"] & 1 or k["to"] >> d["to_sq"] & 1):
        return False
    if k.get("who") and letter not in k["who"]:
        return False
    if k.get("capture") and not d["capture"]:
        return False
    if k.get("target") and (d["captured"] or "_") not in k["target"]:
        return False
    if k.get("promo") and (not d["promo"] or d["promo"] not in k["promo"]):
        return False
    return all(d[f] for f in ("check", "mate", "castle", "ep") if k.get(f))


def changed_boards(changes: tuple):
    """An Arrow function from EPD to the columns of the changed board (null where it isn't one)."""

    def one(epd: str) -> dict | None:
        try:
            n = apply_changes(epd, changes)
        except (BadFen, IllegalMove):
            return None
        return None if n is None else board_columns(n)

    def run(epd: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = lru_cache(4096)(one)
        for s in epd:
            found = [seen(e) for e in s]
            yield pd.DataFrame({c: [None if f is None else f[c] for f in found] for c in NAMES}, columns=NAMES)

    return F.pandas_udf(run, f"struct<{BOARD}>")
