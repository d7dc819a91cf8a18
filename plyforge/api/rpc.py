"""JSON-RPC by lines: {"id", "command", "params"} in, {"id", "status", "result" | "error"} out."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.api.cli import session
from plyforge.api.database import Database, explained
from plyforge.lang.parser import ParseError, parse
from plyforge.lang.validate import SemanticError, validate
from plyforge.operators import endgames, listing, mutations, positions
from plyforge.sources import pgn

ALIASES = {"open_db": "open", "close_db": "close", "cql_search": "search", "search_cql": "search", "explain_dsl": "explain", "opening_tree": "tree", "query": "query_games", "get": "get_game", "db_stats": "stats", "info": "stats", "popularity": "endgames", "ping": "version", "delete_game": "delete", "undelete_game": "undelete"}


class Rows(list):
    """Rows of an answer; cut: whether there were more than the limit."""

    cut = False


def rows(df: DataFrame, limit: int = 1000) -> Rows:
    """The first rows, up to limit: an answer is one line, so it's bounded, and says so when it is cut."""
    found = df.limit(limit + 1).toJSON().collect()
    out = Rows(json.loads(r) for r in found[:limit])
    out.cut = len(found) > limit
    return out


def is_cut(answer: object) -> bool:
    if isinstance(answer, dict):
        return any(is_cut(x) for x in answer.values())
    return isinstance(answer, Rows) and answer.cut


class Server:
    """Open databases by key; every command is a method cmd_<name>(params)."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark
        self.open: dict[str, Database] = {}

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = session()
        return self._spark

    def handle(self, line: str) -> dict:
        try:
            m = json.loads(line)
        except ValueError as e:
            return {"id": None, "status": "error", "error": f"not JSON: {e}"}
        name = m.get("command", "")
        f: Callable | None = getattr(self, "cmd_" + ALIASES.get(name, name), None)
        if f is None:
            return {"id": m.get("id"), "status": "error", "error": f"unknown command {name!r}"}
        try:
            answer = f(m.get("params") or {})
            return {"id": m.get("id"), "status": "ok", "result": answer} | ({"truncated": True} if is_cut(answer) else {})
        except (ParseError, SemanticError, KeyError, ValueError, FileNotFoundError) as e:
            return {"id": m.get("id"), "status": "error", "error": f"{type(e).__name__}: {e}"}

    def db(self, p: dict) -> Database:
        key = p.get("db") or next(iter(self.open), None)
        if key not in self.open:
            raise KeyError(f"database {key!r} isn't open")
        return self.open[key]

    def game_filter(self, p: dict) -> listing.GameFilter:
        names = {f.name for f in fields(listing.GameFilter)} - {"material"}
        k = {x: v for x, v in p.items() if x in names}
        if p.get("material"):
            k["material"] = positions.MaterialFilter(p["material"], any_ply=bool(p.get("any_ply")))
        return listing.GameFilter(**k)

    def cmd_version(self, p):
        return {"name": "plyforge", "version": 1}

    def cmd_open(self, p):
        self.open[p.get("key", p["path"])] = Database(self.spark, p["path"], p.get("mode", "mmap"))
        return {"key": p.get("key", p["path"])}

    def cmd_close(self, p):
        return {"closed": self.open.pop(p.get("db"), None) is not None}

    def cmd_list_open(self, p):
        return list(self.open)

    def cmd_stats(self, p):
        return rows(listing.stats(self.db(p).games))[0]

    def cmd_query_games(self, p):
        db = self.db(p)
        number, size = int(p.get("page", 0)), int(p.get("page_size", 50))
        if p.get("search_id"):
            found = db.sessions.get(p["search_id"])
            if found is None:
                raise KeyError(f"no search {p['search_id']!r}")
            g = db.games.join(found, "game_id")
            return {"total": found.count(), "games": rows(listing.page(listing.sort_games(g, p.get("sort"), bool(p.get("descending"))), number, size).drop("movetext", "tags"))}
        page, total = db.list_games(self.game_filter(p), number, size)
        return {"total": total, "games": rows(page.drop("movetext", "tags"))}

    def cmd_get_game(self, p):
        found = rows(self.db(p).get(int(p["id"])))
        if not found:
            raise KeyError(f"no game {p['id']}")
        return found[0]

    def cmd_search(self, p):
        db = self.db(p)
        name = db.session(p["query"], p.get("owner", "main"))
        return {"search_id": name, "count": db.sessions.get(name).count()}

    def cmd_search_results(self, p):
        found = self.db(p).sessions.get(p["search_id"])
        if found is None:
            raise KeyError(f"no search {p['search_id']!r}")
        return rows(listing.page(found.orderBy("game_id"), int(p.get("page", 0)), int(p.get("page_size", 50))))

    def cmd_clear_search(self, p):
        return {"cleared": self.db(p).sessions.clear(p["search_id"])}

    def cmd_validate_dsl(self, p):
        try:
            validate(parse(p["query"]))
            return {"valid": True}
        except ParseError as e:
            return {"valid": False, "error": e.message, "line": e.line, "column": e.column}
        except SemanticError as e:
            return {"valid": False, "error": str(e)}

    def cmd_explain(self, p):
        return explained(p["query"])

    def cmd_search_position(self, p):
        return rows(positions.search_position(self.db(p).plies, p["fen"], p.get("turn"), p.get("mode", "exact"), p.get("max_ply")).orderBy("game_id"), int(p.get("limit", 1000)))

    def cmd_search_material(self, p):
        return rows(positions.search_material(self.db(p).plies, positions.MaterialFilter(p["counts"], bool(p.get("opposite")), bool(p.get("same")), bool(p.get("any_ply")))).orderBy("game_id"))

    def cmd_tree(self, p):
        return rows(self.db(p).tree(p.get("fen")))

    def cmd_continuations(self, p):
        return rows(self.db(p).continuations(p.get("fen"), int(p.get("depth", 8)), int(p.get("min_games", 1)), int(p.get("max_lines", 20))))

    def cmd_endgames(self, p):
        return rows(self.db(p).endgames())

    def cmd_endgame_games(self, p):
        return rows(endgames.with_feature(endgames.endgame_index(self.db(p).plies), p["feature"], int(p.get("limit", 100))))

    def cmd_reference(self, p):
        made = self.db(p).reference(self.game_filter(p.get("filter", {})), p.get("fen"), p.get("tree", True), p.get("continuations", False), p.get("endgames", False), p.get("games", True))
        return {k: rows(v.drop("movetext", "tags")) for k, v in made.items()}

    def cmd_name_ranks(self, p):
        return rows(listing.name_ranks(self.db(p).games, p.get("column", "white")).orderBy("rank"))

    def cmd_import_pgn(self, p):
        return pgn.build(self.spark, p["path"], p["out"])

    def cmd_index_status(self, p):
        return {"status": pgn.status(p["path"], p["view"])}

    def cmd_build(self, p):
        self.db(p).build(p["out"], tuple(p.get("what") or ("pos-idx", "tree", "continuations", "endgames")))
        return {"out": p["out"]}

    def _flag(self, p, value: bool):
        db = self.db(p)
        db.games = mutations.set_deleted(db.games, F.col("game_id").isin(p["ids"]), value)
        return {"ids": p["ids"]}

    def cmd_delete(self, p):
        return self._flag(p, True)

    def cmd_undelete(self, p):
        return self._flag(p, False)

    def cmd_compact(self, p):
        db = self.db(p)
        gone = db.games.where("deleted").count()
        db.games = mutations.compact(db.games)
        return {"removed": gone}

    def cmd_save(self, p):
        mutations.save(self.db(p).games, p["out"])
        return {"out": p["out"]}

    def cmd_sort_db(self, p):
        self.db(p).sort_to(p["out"], p.get("sort", "id"), bool(p.get("descending")), bool(p.get("purge")))
        return {"out": p["out"]}

    def cmd_set_threads(self, p):
        self.spark.conf.set("spark.sql.shuffle.partitions", str(int(p["threads"])))
        return {"threads": int(p["threads"])}

    def cmd_cancel(self, p):
        self.spark.interruptAll()
        return {"cancelled": True}


def serve(lines=None, out=None, spark: SparkSession | None = None) -> None:
    server = Server(spark)
    for line in lines if lines is not None else sys.stdin:
        if line.strip():
            print(json.dumps(server.handle(line)), file=out or sys.stdout, flush=True)


if __name__ == "__main__":
    serve()
