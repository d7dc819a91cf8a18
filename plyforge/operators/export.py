"""Games to PGN text, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 78


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'[{name} "'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"]\n'))


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """Line breaks instead of spaces, so that no line is longer than width unless a word is."""
    return F.trim(F.regexp_replace(text, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n"))


def pgn_text(movetext: Column) -> Column:
    """The seven-tag roster, ECO and ratings if known, then the moves, as one text."""
    result = F.element_at(F.array(*[F.lit(x) for x in ("*", "1-0", "0-1", "1/2-1/2")]), F.coalesce(F.col("result"), F.lit(0)) + 1)
    head = [_tag("Event", F.coalesce("event", F.lit("?"))), _tag("Site", F.coalesce("site", F.lit("?"))), _tag("Date", F.coalesce("date", F.lit("????.??.??"))), _tag("Round", F.coalesce("round", F.lit("?"))), _tag("White", F.coalesce("white", F.lit("?"))), _tag("Black", F.coalesce("black", F.lit("?"))), _tag("Result", result)]
    extra = [F.coalesce(_tag(n, F.col(c).cast("string")), F.lit("")) for n, c in (("ECO", "eco"), ("WhiteElo", "white_elo"), ("BlackElo", "black_elo"), ("FEN", "start_fen"))]
    body = F.concat(movetext, F.lit(" "), result)
    return F.concat(*head, *extra, F.lit("\n"), wrapped(body), F.lit("\n\n"))


def movetexts(plies: DataFrame) -> DataFrame:
    """(game_id, moves): numbered SAN of each game."""
    one = F.struct("ply", F.when(F.col("mv.white"), F.concat(((F.col("ply") + 1) / 2).cast("int").cast("string"), F.lit(". "), F.col("mv.san"))).otherwise(F.col("mv.san")).alias("t"))
    return plies.where("mv is not null").groupBy("game_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), " ").alias("moves"))


def export_pgn(games: DataFrame, plies: DataFrame) -> DataFrame:
    """(game_id, value): the PGN of each game, rebuilt from its moves."""
    return games.join(movetexts(plies), "game_id", "left").select("game_id", pgn_text(F.coalesce("moves", F.lit(""))).alias("value"))


def write_pgn(games: DataFrame, plies: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """Text files, each a run of the games in order."""
    out = games.select(*games.columns).join(movetexts(plies), "game_id", "left")
    rows = out.orderBy(*(order or [F.col("game_id")])).select(F.regexp_replace(pgn_text(F.coalesce("moves", F.lit(""))), "\n$", "").alias("value"))
    rows.write.mode("overwrite").text(path)
