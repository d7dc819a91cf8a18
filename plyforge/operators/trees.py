"""Opening trees, continuation lines and the transition graph, over any timeline of states and moves.

rows: one row a step with (game, ply, state, move that departs or null). outcome and ratings come from games.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Names:
    """Column names of a timeline."""

    game: str = "game_id"
    ply: str = "ply"
    state: str = "pos_key"
    move: str = "san"


def chess_steps(plies: DataFrame, games: DataFrame) -> DataFrame:
    """(game_id, ply, pos_key, san, uci, next_key, result, white_elo, black_elo, ym) of undeleted games."""
    w = Window.partitionBy("game_id").orderBy("ply")
    steps = plies.select("game_id", "ply", "pos_key", F.lead("mv.san").over(w).alias("san"), F.lead("mv.uci").over(w).alias("uci"), F.lead("pos_key").over(w).alias("next_key"))
    g = games.where(~F.col("deleted")).select("game_id", "result", "white_elo", "black_elo", (F.col("year") * 16 + F.coalesce(F.col("month"), F.lit(0))).alias("ym"))
    return steps.join(g, "game_id")


def first_hits(rows: DataFrame, at: Column, names: Names) -> DataFrame:
    """The first row of each game where `at` holds: a partial minimum by game, no sort."""
    return rows.where(at).groupBy(names.game).agg(F.min_by(F.struct(*rows.columns), names.ply).alias("x")).select("x.*")


def outcome_columns(result: str = "result") -> list[Column]:
    r = F.col(result)
    return [F.count(F.lit(1)).alias("games"), F.count_if(r == 1).alias("white_wins"), F.count_if(r == 3).alias("draws"), F.count_if(r == 2).alias("black_wins")]


def percentages(df: DataFrame, digits: int | None = 2) -> DataFrame:
    for c, name in (("white_wins", "white_pct"), ("draws", "draw_pct"), ("black_wins", "black_pct")):
        x = F.col(c) * 100.0 / F.col("games")
        df = df.withColumn(name, F.round(x, digits) if digits is not None else x)
    return df


def opening_tree(steps: DataFrame, at: Column, names: Names = Names(), samples: int = 3, digits: int | None = 2) -> DataFrame:
    """Moves from a state, at its first hit in each game: games, outcomes, mean ratings (games with both), dates, sample ids."""
    rated = F.when((F.col("white_elo") > 0) & (F.col("black_elo") > 0), 1)
    hits = first_hits(steps, at, names).where(F.col(names.move).isNotNull())
    out = hits.groupBy(names.move).agg(
        *outcome_columns(),
        F.try_divide(F.sum(F.col("white_elo") * rated), F.sum(rated)).cast("bigint").alias("avg_white_elo"),
        F.try_divide(F.sum(F.col("black_elo") * rated), F.sum(rated)).cast("bigint").alias("avg_black_elo"),
        F.min("ym").alias("first_ym"),
        F.max("ym").alias("last_ym"),
    )
    if samples:
        # the k smallest ids of each move: ranks within moves, never a list of all ids
        w = Window.partitionBy(names.move).orderBy(names.game)
        few = hits.select(names.move, names.game).withColumn("i", F.row_number().over(w)).where(F.col("i") <= samples)
        out = out.join(few.groupBy(names.move).agg(F.sort_array(F.collect_list(names.game)).alias("sample_ids")), names.move)
    return percentages(out, digits)


def tree_index(steps: DataFrame, names: Names = Names(), max_ply: int | None = 24) -> DataFrame:
    """Opening tree of every state: each visit counts, a last position has the move null."""
    rows = steps if max_ply is None else steps.where(F.col(names.ply) <= max_ply)
    return rows.groupBy(names.state, names.move).agg(*outcome_columns())


def nested_tree(index: DataFrame, names: Names = Names()) -> DataFrame:
    """One row a state with its moves as an array, most played first. A state has few different moves."""
    move = F.struct(F.col("games"), F.col(names.move).alias("move"), "white_wins", "draws", "black_wins")
    return index.groupBy(names.state).agg(F.sum("games").alias("total"), F.sort_array(F.collect_list(move), False).alias("moves"))


def next_moves(steps: DataFrame, at: Column, names: Names = Names()) -> DataFrame:
    """Moves at every hit of a state."""
    return steps.where(at & F.col(names.move).isNotNull()).groupBy(names.move).agg(F.count(F.lit(1)).alias("n"))


def continuations(steps: DataFrame, at: Column, depth: int, names: Names = Names(), min_games: int = 1, min_percentage: float = 0.0, max_lines: int | None = 20) -> DataFrame:
    """Lines of up to depth moves behind the first hit: games, outcomes, share of the games that reach it, last date.

    Order: games down, length down, moves. The lines come from leads over the game, so a game's moves are never gathered.
    """
    if not 1 <= depth <= 20:
        raise ValueError("depth must be from 1 to 20")
    w = Window.partitionBy(names.game).orderBy(names.ply)
    line = F.array_compact(F.array(F.col(names.move), *[F.lead(names.move, i).over(w) for i in range(1, depth)]))
    rows = steps.withColumn("moves", line).withColumn("hit", F.coalesce(at, F.lit(False)))
    hits = first_hits(rows, F.col("hit"), names)
    total = hits.agg(F.count(F.lit(1)).alias("reaching"))
    out = hits.where(F.size("moves") > 0).groupBy("moves").agg(*outcome_columns(), F.max("ym").alias("last_ym")).crossJoin(F.broadcast(total))
    out = out.withColumn("percentage", F.col("games") * 100.0 / F.col("reaching")).where((F.col("games") >= min_games) & (F.col("percentage") >= min_percentage))
    out = out.orderBy(F.desc("games"), F.desc(F.size("moves")), F.array_join("moves", " "))
    return out if max_lines is None else out.limit(max_lines)


def formatted(moves: Column, number: int = 1, white: bool = True) -> Column:
    """3... a6 4. Ba4 Nf6: the moves of a line numbered from a full move."""
    start = 0 if white else 1

    def one(m: Column, i: Column) -> Column:
        half = i + F.lit(start)
        n = (F.lit(number) + F.floor(half / 2)).cast("string")
        return F.when(half % 2 == 0, F.concat(n, F.lit(". "), m)).when(i == 0, F.concat(n, F.lit("... "), m)).otherwise(m)

    return F.array_join(F.transform(moves, one), " ")


def graph(steps: DataFrame, next_state: str = "next_key", names: Names = Names(), min_games: int = 1) -> DataFrame:
    """Edges (state, move, next) with games, outcomes and dates."""
    edges = steps.where(F.col(names.move).isNotNull()).groupBy(F.col(names.state).alias("state"), F.col(names.move).alias("move"), F.col(next_state).alias("next"))
    return edges.agg(*outcome_columns(), F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym")).where(F.col("games") >= min_games)


def _lines(e: DataFrame, start: Column, depth: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(moves, games) of the lines from a state that end there or at depth; keep thins out the lines that go on."""
    live = keep(e.where(start).select(F.array("m").alias("moves"), F.col("t").alias("at"), F.col("g").alias("games")))
    done = None
    for _ in range(min(depth, 20) - 1):
        grown = live.join(e, F.col("at") == F.col("s"), "left")
        ended = grown.where("s is null").select("moves", "games")
        done = ended if done is None else done.unionByName(ended)
        live = keep(grown.where("s is not null").select(F.concat("moves", F.array("m")).alias("moves"), F.col("t").alias("at"), F.least("games", "g").alias("games")))
    last = live.select("moves", "games")
    return last if done is None else last.unionByName(done)


def top_lines(edges: DataFrame, start: Column, depth: int, max_lines: int = 10, width: int = 64) -> DataFrame:
    """Best lines through the graph from a state: a line's games are the least of its edges'.

    A beam of `width` lines a round first finds max_lines lines; the games of the last of them are a bound that the best
    lines reach. The lines are then grown anew without a beam, over all prefixes that reach the bound. Of prefixes that
    lead to one state with equal games, whatever follows leaves the first max_lines in front, so these alone go on: the
    result is exact, and a round holds max_lines rows at most for each state and number of games.
    """
    e = edges.select(F.col("state").alias("s"), F.col("move").alias("m"), F.col("next").alias("t"), F.col("games").alias("g"))
    name = F.array_join("moves", " ")
    best = [F.desc("games"), F.desc(F.size("moves")), name]
    beam = _lines(e, start, depth, lambda x: x.orderBy(F.desc("games"), name).limit(max(width, max_lines)))
    found = beam.orderBy(*best).limit(max_lines).agg(F.count(F.lit(1)), F.min("games")).first()
    least = found[1] if found[0] == max_lines else 0
    nth = F.row_number().over(Window.partitionBy("at", "games").orderBy(name))
    out = _lines(e, start, depth, lambda x: x.where(F.col("games") >= least).withColumn("nth", nth).where(F.col("nth") <= max_lines).drop("nth"))
    return out.orderBy(*best).limit(max_lines)
