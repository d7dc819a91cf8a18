"""One game database: a folder with the games and plies tables, or PGN text read once and kept."""

from __future__ import annotations

import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.lang.explain import explain
from plyforge.lang.parser import ParseError, parse
from plyforge.lang.validate import SemanticError, validate
from plyforge.operators import endgames, export, listing, mutations, positions, trees
from plyforge.plans.compiler import search
from plyforge.rules.board import START, Position
from plyforge.sources import pgn


class Database:
    """path: a folder made by build(), or PGN. mode: mmap (read as needed), preload (cached) or ram (kept in memory)."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "mmap"):
        self.spark, self.path = spark, path
        if os.path.isdir(os.path.join(path, "games")):
            self.games, self.plies = spark.read.parquet(f"{path}/games"), spark.read.parquet(f"{path}/plies")
        else:
            texts = pgn.read_pgn(spark, path)
            self.games, self.plies = pgn.games_of(texts).persist(), pgn.plies_of(texts).persist()
        if mode in ("preload", "ram"):
            self.games, self.plies = self.games.persist(), self.plies.persist()
        self.sessions = listing.Sessions()

    def search(self, query: str) -> DataFrame:
        return search(validate(parse(query)), self.plies, self.games)

    def session(self, query: str, owner: str = "main") -> str:
        found = self.sessions.find(self.path, query)
        return found or self.sessions.create(self.path, query, self.search(query), owner)

    def list_games(self, f: listing.GameFilter, number: int = 0, size: int = 50) -> tuple[DataFrame, int]:
        return listing.query_games(self.games, f, self.plies, number, size)

    def get(self, game_id: int) -> DataFrame:
        return export.export_pgn(self.games.where(F.col("game_id") == game_id), self.plies.where(F.col("game_id") == game_id))

    def steps(self) -> DataFrame:
        return trees.chess_steps(self.plies, self.games)

    def at(self, fen: str | None):
        return F.col("pos_key") == Position.from_fen(fen or START).key()

    def tree(self, fen: str | None = None, candidates: DataFrame | None = None) -> DataFrame:
        s = self.steps() if candidates is None else self.steps().join(candidates.select("game_id"), "game_id", "left_semi")
        return trees.opening_tree(s, self.at(fen)).orderBy(F.desc("games"), "san")

    def continuations(self, fen: str | None = None, depth: int = 8, min_games: int = 1, max_lines: int = 20, candidates: DataFrame | None = None) -> DataFrame:
        s = self.steps() if candidates is None else self.steps().join(candidates.select("game_id"), "game_id", "left_semi")
        p = Position.from_fen(fen or START)
        return trees.continuations(s, self.at(fen), depth, trees.Names(), min_games, 0.0, max_lines).withColumn("formatted", trees.formatted(F.col("moves"), p.full, p.white))

    def endgames(self, candidates: DataFrame | None = None) -> DataFrame:
        g = self.games if candidates is None else self.games.join(candidates.select("game_id"), "game_id", "left_semi")
        return endgames.popularity(endgames.endgame_index(self.plies), g)

    def reference(self, f: listing.GameFilter, fen: str | None = None, tree: bool = True, continuations: bool = False, popular: bool = False, games: bool = True, size: int = 50) -> dict[str, DataFrame]:
        """Several reports over one set of candidates, which is kept for them."""
        candidates = listing.filter_games(self.games, f, self.plies).select("game_id").persist()
        out: dict[str, DataFrame] = {}
        if tree:
            out["tree"] = self.tree(fen, candidates)
        if continuations:
            out["continuations"] = self.continuations(fen, candidates=candidates)
        if popular:
            out["endgames"] = self.endgames(candidates)
        if games:
            out["games"] = listing.page(listing.sort_games(self.games.join(candidates, "game_id", "left_semi"), f.sort, f.descending), 0, size)
        return out

    def build(self, out: str, what: tuple[str, ...] = ("booster", "pos-idx", "tree", "continuations", "endgames")) -> None:
        """Materialised views, each one aggregation written as Parquet."""
        made = {
            "booster": lambda: self.plies.select("game_id", "ply", "pos_key", "epd", "p", "n", "b", "r", "q", "k", "w", "bl", "wtm").repartitionByRange("pos_key").sortWithinPartitions("pos_key", "game_id"),
            "pos-idx": lambda: positions.posting_pairs(self.plies),
            "tree": lambda: trees.tree_index(self.steps()),
            "continuations": lambda: trees.graph(self.steps()),
            "endgames": lambda: endgames.endgame_index(self.plies),
        }
        for name in what:
            made[name]().write.mode("overwrite").parquet(f"{out}/{name}")

    def sort_to(self, out: str, column: str, descending: bool = False, purge: bool = False) -> None:
        key = F.col(listing.SORTS.get(column, "game_id"))
        mutations.sort_database(self.games, key.desc() if descending else key.asc(), purge=purge).write.mode("overwrite").parquet(out)


def explained(query: str) -> dict:
    try:
        return asdict(explain(query))
    except (ParseError, SemanticError) as e:
        return {"error": str(e)}
