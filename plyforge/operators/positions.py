"""Position and material search, postings and their diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions import bitboards as B
from plyforge.lang import ast as A
from plyforge.plans.compiler import fen_sql, pieces_sql
from plyforge.rules.board import BadFen, Position


def position_predicate(fen: str, turn: str | None = None, mode: str = "exact") -> str:
    """SQL of a position search: exact is the whole position (four FEN fields) or the board; partial the listed pieces."""
    part = fen.split()
    c = []
    try:
        p = Position.from_fen(fen)
    except BadFen:
        p, mode = None, "partial"
    if mode == "partial" or p is None:
        if p is None:
            c.append(fen_sql(part[0]))
        else:
            for s, x in enumerate(p.board):
                if x:
                    c.append(f"({pieces_sql(x)} & {B.lit(1 << s)}) <> 0L")
    elif len(part) >= 4:
        return f"pos_key = {p.key()}L and epd = '{p.epd()}'"
    else:
        c += [f"{k} = {B.lit(v)}" for k, v in p.bitboards().items()]
        if len(part) > 1:
            c.append("wtm" if part[1] == "w" else "not wtm")
    if turn in ("white", "w", "black", "b"):
        c.append("wtm" if turn[0] == "w" else "not wtm")
    return " and ".join(c or ["true"])


def search_position(plies: DataFrame, fen: str, turn: str | None = None, mode: str = "exact", max_ply: int | None = None) -> DataFrame:
    """(game_id, ply): the first hit of each game."""
    rows = plies if max_ply is None else plies.where(F.col("ply") <= max_ply)
    return rows.where(F.expr(position_predicate(fen, turn, mode))).groupBy("game_id").agg(F.min("ply").alias("ply"))


def scan_position(plies: DataFrame, fen: str, sample: int | None = None) -> DataFrame:
    """(game_id, plies): every hit of the whole position; sample: of that many games with the smallest ids."""
    return all_hits(plies, F.expr(position_predicate(fen)), sample)


def all_hits(plies: DataFrame, at: Column, sample: int | None = None) -> DataFrame:
    """(game_id, plies): every row of a game where `at` holds."""
    out = plies.where(at).groupBy("game_id").agg(F.sort_array(F.collect_list("ply")).alias("plies"))
    return out if sample is None else out.orderBy("game_id").limit(sample)


@dataclass(frozen=True)
class MaterialFilter:
    """Exact counts by letter; opposite, same: sides have a bishop on light squares, differing or alike. any_ply: else the last."""

    counts: dict[str, int] = field(default_factory=dict)
    opposite: bool = False
    same: bool = False
    any_ply: bool = False
    max_ply: int = 250

    def __hash__(self) -> int:
        return hash((tuple(sorted(self.counts.items())), self.opposite, self.same, self.any_ply, self.max_ply))


def material_predicate(f: MaterialFilter) -> str:
    c = [f"bit_count({pieces_sql(x)}) = {n}" for x, n in sorted(f.counts.items())]
    light = [f"(({pieces_sql(x)} & {B.lit(A.LIGHT)}) <> 0L)" for x in "Bb"]
    if f.opposite or f.same:
        c += [f"{pieces_sql(x)} <> 0L" for x in "Bb"]
        c.append(f"{light[0]} {'<>' if f.opposite else '='} {light[1]}")
    return " and ".join(c or ["true"])


def search_material(plies: DataFrame, f: MaterialFilter) -> DataFrame:
    """(game_id, ply): first ply that fits, or the last position if that fits."""
    rows = plies.where(F.col("ply") <= f.max_ply)
    if f.any_ply:
        return rows.where(F.expr(material_predicate(f))).groupBy("game_id").agg(F.min("ply").alias("ply"))
    boards = F.struct("p", "n", "b", "r", "q", "k", "w", "bl", "ply")
    last = rows.groupBy("game_id").agg(F.max_by(boards, "ply").alias("x")).select("game_id", "x.*")
    return last.where(F.expr(material_predicate(f))).select("game_id", "ply")


def position_index(plies: DataFrame, max_ply: int = 24, min_games: int = 1, key: str = "pos_key", game: str = "game_id", ply: str = "ply", first: int = 5) -> DataFrame:
    """(key, n, games): number of games of every position up to max_ply, and the smallest `first` of their ids.

    All ids are the rows of posting_pairs: no position's games meet in one row or task. Pairs are made distinct first, and
    the smallest ids are found before the shuffle (a window group limit).
    """
    pairs = plies.where(F.col(ply) <= max_ply).select(key, game).distinct()
    n = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_games)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(game))
    few = pairs.withColumn("nth", nth).where(F.col("nth") <= first).groupBy(key).agg(F.sort_array(F.collect_list(game)).alias("games"))
    return n.join(few, key)


def posting_pairs(plies: DataFrame, max_ply: int = 24, key: str = "pos_key", game: str = "game_id", ply: str = "ply") -> DataFrame:
    """(key, game) pairs sorted by key within files: a look-up reads few row groups, and no key's games meet in one task."""
    return plies.where(F.col(ply) <= max_ply).select(key, game).distinct().repartitionByRange(key, game).sortWithinPartitions(key, game)


SIZES = ((1, 10), (11, 100), (101, 1000), (1001, 10_000), (10_001, 100_000), (100_001, None))


def bucket(n: Column) -> Column:
    out = F.when(n <= SIZES[0][1], "1-10")
    for lo, hi in SIZES[1:-1]:
        out = out.when(n <= hi, f"{lo}-{hi}")
    return out.otherwise("100001+")


def index_diagnostics(pairs: DataFrame, key: str, game: str) -> DataFrame:
    """(bucket, positions, postings) by how many games share a position; pairs: distinct (key, game)."""
    n = pairs.groupBy(key).agg(F.count(game).alias("n"))
    return n.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("positions"), F.sum("n").alias("postings"))


def lookup(index: DataFrame, fen: str) -> DataFrame:
    """Postings of one position: a filter on the sorted key."""
    return index.where(F.col("pos_key") == Position.from_fen(fen).key())
