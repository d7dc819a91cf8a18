"""Games as lists: structured filters, sorting, paging, ranks, statistics, cached searches."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.lang.parser import parse
from plyforge.lang.validate import validate
from plyforge.operators import positions
from plyforge.plans.compiler import search
from plyforge.sources.tables import numbered

SORTS = {"id": "game_id", "white": "white", "black": "black", "white_elo": "white_elo", "black_elo": "black_elo", "eco": "eco", "event": "event", "site": "site", "round": "round", "result": "result"}


@dataclass(frozen=True)
class GameFilter:
    """All given fields must hold. Texts: part of the value, any case; eco: prefix; date: part of YYYY.MM.DD."""

    player: str | None = None
    white: str | None = None
    black: str | None = None
    event: str | None = None
    site: str | None = None
    eco: str | None = None
    date: str | None = None
    result: str | None = None
    min_elo: int | None = None
    max_elo: int | None = None
    include_deleted: bool = True
    only_deleted: bool = False
    fen: str | None = None
    turn: str | None = None
    match_mode: str = "exact"
    max_ply: int | None = None
    material: positions.MaterialFilter | None = None
    query: str | None = None
    start_game: int | None = None
    end_game: int | None = None
    sort: str | None = None
    descending: bool = False


def sort_games(games: DataFrame, column: str | None, descending: bool = False, game: str = "game_id", columns: dict[str, str] | None = None) -> DataFrame:
    """Ties by id; descending turns the whole order round, ids too. Missing values count as least; an unknown column: by id."""
    names = columns or SORTS
    if column == "date":
        keys = [F.coalesce(F.col(c), F.lit(0)) for c in ("year", "month", "day")]
    elif column in names and names[column] != game:
        keys = [F.col(names[column])]
    else:
        keys = []
    keys.append(F.col(game))
    return games.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys])


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` from 0. On sorted rows this is a top-k plan, not a full sort."""
    return rows.offset(number * size).limit(size)


def _part(col: str, value: str):
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(value.lower()))


def filter_games(games: DataFrame, f: GameFilter, plies: DataFrame | None = None) -> DataFrame:
    """Header fields are filters on games; positions, material and queries become left semi joins on their ids."""
    out = games
    if f.player is not None:
        out = out.where(_part("white", f.player) | _part("black", f.player))
    for c in ("white", "black", "event", "site"):
        if getattr(f, c) is not None:
            out = out.where(_part(c, getattr(f, c)))
    if f.eco is not None:
        out = out.where(F.startswith(F.upper("eco"), F.lit(f.eco.upper())))
    if f.date is not None:
        out = out.where(F.contains(F.coalesce(F.col("date"), F.lit("????.??.??")), F.lit(f.date)))
    if f.result is not None and f.result.lower() != "all":
        out = out.where(F.coalesce(F.col("result"), F.lit(0)) == {"1-0": 1, "0-1": 2, "1/2-1/2": 3}.get(f.result, 0))
    if f.min_elo is not None:
        out = out.where((F.col("white_elo") >= f.min_elo) | (F.col("black_elo") >= f.min_elo))
    if f.max_elo is not None:
        out = out.where((F.col("white_elo") <= f.max_elo) & (F.col("black_elo") <= f.max_elo))
    if f.only_deleted:
        out = out.where("deleted")
    elif not f.include_deleted:
        out = out.where(~F.col("deleted"))
    if f.start_game is not None:
        out = out.where(F.col("game_id") >= f.start_game)
    if f.end_game is not None:
        out = out.where(F.col("game_id") < f.end_game)
    if plies is not None:
        if f.fen is not None:
            out = out.join(positions.search_position(plies, f.fen, f.turn, f.match_mode, f.max_ply), "game_id", "left_semi")
        if f.material is not None:
            out = out.join(positions.search_material(plies, f.material), "game_id", "left_semi")
        if f.query is not None:
            out = out.join(search(validate(parse(f.query)), plies, games), "game_id", "left_semi")
    return out


def query_games(games: DataFrame, f: GameFilter, plies: DataFrame | None = None, number: int = 0, size: int = 50) -> tuple[DataFrame, int]:
    """(page, total)."""
    found = filter_games(games, f, plies)
    return page(sort_games(found, f.sort, f.descending), number, size), found.count()


def name_ranks(names: DataFrame, col: str) -> DataFrame:
    """(name, rank) of each distinct name, in byte order from 0; no task orders all names.
    """
    distinct = names.select(F.col(col).alias("name")).where(F.col(col).isNotNull()).distinct()
    return numbered(distinct, [F.col("name")], "rank")


def stats(games: DataFrame) -> DataFrame:
    """One row: total, active, deleted, players, events, sites."""
    names = games.select(F.explode(F.array("white", "black")).alias("x")).agg(F.countDistinct("x").alias("players"))
    return games.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("deleted")).alias("active"), F.count_if(F.col("deleted")).alias("deleted"), F.countDistinct("event").alias("events"), F.countDistinct("site").alias("sites")
    ).crossJoin(names)


class Sessions:
    """Named search results: one main slot, two reference slots that drop the least recently used."""

    def __init__(self, references: int = 2):
        self.n, self.references = {"main": 0, "ref": 0}, references
        self.main: tuple[str, tuple, DataFrame] | None = None
        self.refs: OrderedDict[str, tuple[tuple, DataFrame]] = OrderedDict()

    def find(self, db: str, query: str) -> str | None:
        key = (db, query)
        if self.main and self.main[1] == key:
            return self.main[0]
        return next((i for i, (k, _) in self.refs.items() if k == key), None)

    def create(self, db: str, query: str, found: DataFrame, owner: str = "main") -> str:
        kind = "main" if owner == "main" else "ref"
        self.n[kind] += 1
        name = f"{kind}_{self.n[kind]}"
        found = found.persist()
        if kind == "main":
            if self.main:
                self.main[2].unpersist()
            self.main = (name, (db, query), found)
        else:
            self.refs[name] = ((db, query), found)
            while len(self.refs) > self.references:
                self.refs.popitem(last=False)[1][1].unpersist()
        return name

    def get(self, name: str) -> DataFrame | None:
        if self.main and self.main[0] == name:
            return self.main[2]
        if name in self.refs:
            self.refs.move_to_end(name)
            return self.refs[name][1]
        return None

    def clear(self, name: str) -> bool:
        if self.main and self.main[0] == name:
            self.main[2].unpersist()
            self.main = None
            return True
        found = self.refs.pop(name, None)
        if found:
            found[1].unpersist()
        return found is not None


class QueryCache:
    """Filtered games kept by filter: a change of the sort alone filters nothing anew."""

    def __init__(self, games: DataFrame, plies: DataFrame | None = None):
        self.games, self.plies, self.key, self.found, self.hits = games, plies, None, None, 0

    def rows(self, f: GameFilter) -> DataFrame:
        key = replace(f, sort=None, descending=False)
        if key != self.key:
            if self.found is not None:
                self.found.unpersist()
            self.key, self.found = key, filter_games(self.games, f, self.plies).persist()
        else:
            self.hits += 1
        return sort_games(self.found, f.sort, f.descending)
