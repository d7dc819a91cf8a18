"""Named queries: mating patterns and other motifs by their common names."""

from __future__ import annotations

from plyforge.lang import ast as A
from plyforge.lang.parser import parse
from plyforge.lang.validate import validate

THEMES = {
    "smothered_mate": "flipcolor { mate and attacks(N, k) and not attacks(k, [a_]) and not attacks(k, [A_]) }",
    "back_rank_mate": "flipcolor { mate and k on a8-h8 and [RQ] on a8-h8 and attacks([RQ], k) }",
    "knight_and_rook_corner_mate": "flipcolor { mate and attacks(R, k) and attacks(N, R) and k on [a8, h8, a1, h1] }",
    "two_bishops_mate": "flipcolor { mate and attacks(B, k) and B == 2 and Q == 0 }",
    "queen_guarded_mate": "flipcolor { mate and attacks(Q, k) and attacks([PNBR], Q) and attacks(k, Q) }",
    "legal_trap": "flipcolor { mate and attacks(N, k) and Q == 0 and N >= 2 }",
    "rook_guarded_by_bishop_mate": "flipcolor { mate and attacks(R, k) and attacks(B, R) }",
    "double_check": "flipcolor { attackers(A, k) >= 2 }",
    "greek_gift": "path [Bxh7 kxh7 ... Ng5]",
    "underpromotion": "path [--=\"RBN\"]",
    "opposite_bishop_ending": "opposite_bishops and [QqRrNn] == 0",
    "pawn_ending": "[Aa] == [KkPp]",
    "passed_pawn_on_7th": "flipcolor { passed_pawns white >= 1 and P on a7-h7 }",
    "knight_outpost": "flipcolor { outpost N }",
    "exchange_of_queens": "move capture [q, Q] and move previous capture [q, Q]",
    "perpetual_checks": "line --> check{1} --> not check --> check --> not check --> check",
}


def theme(name: str) -> A.Node:
    return validate(parse(THEMES[name]))
