"""Endgame features: a catalog of material classes, one bit each, OR-ed over a game, and their popularity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import bitboards as B
from plyforge.lang import ast as A

#: category, then (id, name, side A as QRBN, side B as QRBN, condition). Pawns: any unless the condition says so.
CATALOG: list[tuple[str, list[tuple[str, str, str, str, str]]]] = [
    ("pawn", [("KP_K", "Pawn against king", "", "", "a_pawns=1 and b_pawns=0"), ("KPP_K", "Pawns against king", "", "", "a_pawns>=2 and b_pawns=0"), ("KP_KP", "Pawn against pawn", "", "", "a_pawns=1 and b_pawns=1"), ("PAWNS", "Pawn ending", "", "", "a_pawns>=1 and b_pawns>=1"), ("PAWN_UP", "Pawn ending, a pawn or two up", "", "", "b_pawns>=1 and a_pawns-b_pawns between 1 and 2")]),
    ("rook", [("R_R", "Rook ending", "R", "R", ""), ("RP_R", "Rook and pawn against rook", "R", "R", "a_pawns=1 and b_pawns=0"), ("RPP_R", "Rook and pawns against rook", "R", "R", "a_pawns>=2 and b_pawns=0"), ("R_PAWNS", "Rook against pawns", "R", "", "b_pawns>=1"), ("R_UP", "Rook ending, a pawn or two up", "R", "R", "b_pawns>=1 and a_pawns-b_pawns between 1 and 2"), ("RR_RR", "Double rooks", "RR", "RR", ""), ("RR_R", "Two rooks against rook", "RR", "R", ""), ("R_K", "Rook against king", "R", "", "a_pawns=0 and b_pawns=0")]),
    ("bishop", [("B_B", "Bishop ending", "B", "B", ""), ("SCB", "Bishops of one color", "B", "B", "same"), ("OCB", "Bishops of opposite colors", "B", "B", "opposite"), ("B_PAWNS", "Bishop against pawns", "B", "", "b_pawns>=1"), ("BB_B", "Two bishops against bishop", "BB", "B", ""), ("BB_K", "Two bishops against king", "BB", "", "a_pawns=0 and b_pawns=0"), ("BB_BB", "Bishop pairs", "BB", "BB", "")]),
    ("knight", [("N_N", "Knight ending", "N", "N", ""), ("N_PAWNS", "Knight against pawns", "N", "", "b_pawns>=1"), ("NP_N", "Knight and pawn against knight", "N", "N", "a_pawns=1 and b_pawns=0"), ("NN_P", "Two knights against pawns", "NN", "", "b_pawns>=1"), ("NN_N", "Two knights against knight", "NN", "N", "")]),
    ("minor", [("B_N", "Bishop against knight", "B", "N", ""), ("BB_N", "Two bishops against knight", "BB", "N", ""), ("BB_NN", "Bishops against knights", "BB", "NN", ""), ("BN_K", "Bishop and knight against king", "BN", "", "a_pawns=0 and b_pawns=0"), ("BN_B", "Bishop and knight against bishop", "BN", "B", ""), ("BN_N", "Bishop and knight against knight", "BN", "N", ""), ("BB_BN", "Two bishops against bishop and knight", "BB", "BN", "")]),
    ("rook_minor", [("R_B", "Rook against bishop", "R", "B", ""), ("R_N", "Rook against knight", "R", "N", ""), ("RB_R", "Rook and bishop against rook", "RB", "R", ""), ("RN_R", "Rook and knight against rook", "RN", "R", ""), ("RB_RB", "Rook and bishop each", "RB", "RB", ""), ("RN_RN", "Rook and knight each", "RN", "RN", ""), ("RB_RN", "Rook and bishop against rook and knight", "RB", "RN", ""), ("R_BN", "Rook against two minor pieces", "R", "BN", "")]),
    ("queen", [("Q_Q", "Queen ending", "Q", "Q", ""), ("Q_PAWNS", "Queen against pawns", "Q", "", "b_pawns>=1"), ("QP_Q", "Queen and pawn against queen", "Q", "Q", "a_pawns=1 and b_pawns=0"), ("Q_K", "Queen against king", "Q", "", "a_pawns=0 and b_pawns=0")]),
    ("queen_other", [("Q_R", "Queen against rook", "Q", "R", ""), ("Q_RR", "Queen against two rooks", "Q", "RR", ""), ("Q_MINOR", "Queen against minor pieces", "Q", "*", "b_minors between 1 and 3")]),
]
FEATURES = [(bit, cat, *f) for bit, (cat, f) in enumerate((c, f) for c, fs in CATALOG for f in fs)]


def sides(plies: DataFrame, *keep: str) -> DataFrame:
    """Per position the pieces of each side as one number (queens, rooks, bishops, knights as digits), its pawns and light bishops."""
    light = B.lit(A.LIGHT)
    cols = []
    for name, c in (("w", "w"), ("b", "bl")):
        cols.append(F.expr(f"1000 * bit_count(q & {c}) + 100 * bit_count(r & {c}) + 10 * bit_count(b & {c}) + bit_count(n & {c})").alias(f"{name}_code"))
        cols.append(F.expr(f"bit_count(p & {c})").alias(f"{name}_pawns"))
        cols.append(F.expr(f"(b & {c} & {light}) <> 0L").alias(f"{name}_light"))
    return plies.select(*keep, *cols)


def _code(letters: str) -> int:
    return sum(letters.count(x) * n for x, n in (("Q", 1000), ("R", 100), ("B", 10), ("N", 1)))


def _range(condition: str, name: str) -> tuple[int, int]:
    m = re.search(rf"(?<![a-z_-]){name}(>=|=| between )(\d+)(?: and (\d+))?", condition)
    if not m:
        return -99, 99
    lo = int(m[2])
    return lo, int(m[3]) if m[3] and "between" in m[1] else lo if m[1] == "=" else 99


def rules(spark: SparkSession) -> DataFrame:
    """The catalog as a table of material on both sides, for either side being A, and the ranges its conditions set."""
    minors = [10 * i + j for i in range(4) for j in range(4) if 1 <= i + j <= 3]
    rows = []
    for bit, _, _, _, a, b, c in FEATURES:
        for other in minors if b == "*" else [_code(b)]:
            limits = (*_range(c, "a_pawns"), *_range(c, "b_pawns"), *_range(c, "a_pawns-b_pawns"))
            bishops = {"same": 1, "opposite": 2}.get(c, 0)
            rows.append((_code(a), other, bit, False, *limits, bishops))
            rows.append((other, _code(a), bit, True, *limits, bishops))
    values = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in rows)
    return spark.sql(f"select * from values {values} as t(w_code, b_code, bit, flipped, a_lo, a_hi, b_lo, b_hi, d_lo, d_hi, bishops)")


def endgame_index(plies: DataFrame, game: str = "game_id") -> DataFrame:
    """(game, features): the bits of all positions of each game.

    Positions of at most four pieces a side meet the catalog, some hundred rows that are broadcast, on both sides' material.
    """
    few = "bit_count((n | b | r | q) & w) <= 4 and bit_count((n | b | r | q) & bl) <= 4"
    a, b = "if(flipped, b_pawns, w_pawns)", "if(flipped, w_pawns, b_pawns)"
    ok = f"{a} between a_lo and a_hi and {b} between b_lo and b_hi and {a} - {b} between d_lo and d_hi and (bishops = 0 or (bishops = 1) = (w_light = b_light))"
    met = sides(plies.where(few), game).join(F.broadcast(rules(plies.sparkSession)), ["w_code", "b_code"]).where(ok)
    return met.groupBy(game).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("features"))


def catalog(spark: SparkSession) -> DataFrame:
    """(bit, category, id, name) of every feature."""
    rows = ", ".join(f"({bit}, '{cat}', '{i}', '{name}')" for bit, cat, i, name, *_ in FEATURES)
    return spark.sql(f"select * from values {rows} as t(bit, category, id, name)")


def popularity(index: DataFrame, games: DataFrame, game: str = "game_id") -> DataFrame:
    """Per feature: games, share of all candidate games, outcomes. index: (game, features)."""
    total = games.agg(F.count(F.lit(1)).alias("total"))
    bits = F.expr(f"filter(sequence(0, {len(FEATURES) - 1}), i -> bit_get(features, i) = 1)")
    hits = index.select(game, F.explode(bits).alias("bit")).join(games.select(game, "result"), game)
    r = F.col("result")
    out = hits.groupBy("bit").agg(F.count(F.lit(1)).alias("games"), F.count_if(r == 1).alias("white_wins"), F.count_if(r == 3).alias("draws"), F.count_if(r == 2).alias("black_wins"))
    return F.broadcast(catalog(index.sparkSession)).join(out, "bit", "left").na.fill(0, ["games", "white_wins", "draws", "black_wins"]).crossJoin(F.broadcast(total)).withColumn("percentage", F.when(F.col("total") > 0, F.col("games") * 100.0 / F.col("total")).otherwise(0.0))


def category_popularity(features: DataFrame) -> DataFrame:
    """Per category, the sum over its features, in the catalog's order."""
    order = F.element_at(F.create_map(*[x for i, (c, _) in enumerate(CATALOG) for x in (F.lit(c), F.lit(i))]), F.col("category"))
    return features.groupBy("category").agg(F.sum("games").alias("games")).withColumn("position", order)


def with_feature(index: DataFrame, feature: str | int, k: int | None = None, game: str = "game_id") -> DataFrame:
    """Games that have a feature, by id or bit; the first k ids if k is given."""
    bit = feature if isinstance(feature, int) else next(b for b, _, i, *_ in FEATURES if i == feature)
    out = index.where(F.expr(f"bit_get(features, {bit}) = 1")).select(game)
    return out if k is None else out.orderBy(game).limit(k)
