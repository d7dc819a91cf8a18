"""Command line: python -m plyforge.api.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.api.database import Database, explained
from plyforge.lang.parser import ParseError
from plyforge.lang.validate import SemanticError
from plyforge.operators import export, listing, mutations, positions
from plyforge.sources import pgn

HELP = ".help .schema .info .limit N .open PATH .get ID .explain QUERY .clear .exit; anything else is a query"


def session() -> SparkSession:
    return SparkSession.builder.appName("plyforge").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show(df: DataFrame, limit: int = 20) -> None:
    for r in df.limit(limit).toJSON().collect():
        print(r)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plyforge")
    sub = p.add_subparsers(dest="command", required=True)

    def cmd(name: str, *args: tuple, aliases: tuple[str, ...] = ()) -> None:
        s = sub.add_parser(name, aliases=list(aliases))
        for names, kw in args:
            s.add_argument(*names, **kw)

    db, q, limit = (("db",), {}), (("query",), {}), (("--limit",), {"type": int, "default": 20})
    fen, out = (("--fen",), {}), (("out",), {})
    cmd("check", db, (("--view",), {}))
    cmd("info", db)
    cmd("list", db, (("--page",), {"type": int, "default": 0}), (("--size",), {"type": int, "default": 20}), (("--sort",), {}), (("--desc",), {"action": "store_true"}), (("--player",), {}), (("--eco",), {}), (("--result",), {}), (("--date",), {}))
    cmd("search", db, q, limit, aliases=("cql",))
    cmd("shell", db, aliases=("repl", "interactive"))
    cmd("explain", q)
    cmd("search-pos", db, (("fen",), {}), (("--turn",), {}), (("--mode",), {"default": "exact"}), (("--max-ply",), {"type": int}), limit)
    cmd("search-mat", db, (("counts",), {"help": "such as Q=0,q=0,R=1,r=1"}), (("--any-ply",), {"action": "store_true"}), limit)
    cmd("get", db, (("id",), {"type": int}))
    cmd("import", db, out)
    cmd("create", out)
    cmd("export", db, out, (("--sort",), {}))
    cmd("bench", db)
    cmd("build", db, out, (("what",), {"nargs": "*"}))
    cmd("tree", db, fen, limit)
    cmd("continuations", db, fen, (("--depth",), {"type": int, "default": 8}), limit)
    cmd("endgames", db, limit)
    cmd("sort-pgn", db, out, (("--sort",), {"default": "date"}))
    cmd("sort-db", db, out, (("--sort",), {"default": "date"}), (("--desc",), {"action": "store_true"}), (("--purge",), {"action": "store_true"}))
    cmd("compact", db, out)
    return p


def run(a: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if a.command == "explain":
        print(json.dumps(explained(a.query), indent=1))
        return 0
    spark = spark or session()
    if a.command == "create":
        spark.createDataFrame([], pgn.GAMES).write.parquet(f"{a.out}/games")
        spark.createDataFrame([], pgn.PLIES).write.parquet(f"{a.out}/plies")
        return 0
    if a.command == "import":
        print(json.dumps(pgn.build(spark, a.db, a.out)))
        return 0
    if a.command == "check":
        print(pgn.status(a.db, a.view or a.db + ".view"))
        return 0
    db = Database(spark, a.db)
    if a.command == "info":
        show(listing.stats(db.games))
    elif a.command == "list":
        f = listing.GameFilter(player=a.player, eco=a.eco, result=a.result, date=a.date, sort=a.sort, descending=a.desc)
        rows, total = db.list_games(f, a.page, a.size)
        print(json.dumps({"total": total}))
        show(rows.drop("movetext", "tags"), a.size)
    elif a.command in ("search", "cql"):
        show(db.search(a.query).orderBy("game_id"), a.limit)
    elif a.command in ("shell", "repl", "interactive"):
        repl(db)
    elif a.command == "search-pos":
        show(positions.search_position(db.plies, a.fen, a.turn, a.mode, a.max_ply).orderBy("game_id"), a.limit)
    elif a.command == "search-mat":
        counts = {k: int(v) for k, v in (x.split("=") for x in a.counts.split(","))}
        show(positions.search_material(db.plies, positions.MaterialFilter(counts, any_ply=a.any_ply)).orderBy("game_id"), a.limit)
    elif a.command == "get":
        for r in db.get(a.id).collect():
            print(r["value"])
    elif a.command in ("export", "sort-pgn"):
        key = F.col(listing.SORTS.get(a.sort or "id", "game_id")) if a.sort != "date" else F.struct("year", "month", "day")
        export.write_pgn(db.games, db.plies, a.out, [key, F.col("game_id")])
    elif a.command == "build":
        db.build(a.out, tuple(x for x in a.what if x != "all") or ("booster", "pos-idx", "tree", "continuations", "endgames"))
    elif a.command == "tree":
        show(db.tree(a.fen), a.limit)
    elif a.command == "continuations":
        show(db.continuations(a.fen, a.depth), a.limit)
    elif a.command == "endgames":
        show(db.endgames().where("games > 0").orderBy(F.desc("games")), a.limit)
    elif a.command == "sort-db":
        db.sort_to(a.out, a.sort, a.desc, a.purge)
    elif a.command == "compact":
        mutations.save(mutations.compact(db.games), a.out)
    elif a.command == "bench":
        for name, f in (("stats", lambda: listing.stats(db.games).collect()), ("sort by white", lambda: listing.page(listing.sort_games(db.games, "white"), 0, 50).collect()), ("tree", lambda: db.tree().collect()), ("search", lambda: db.search("mate").count())):
            t = time.time()
            f()
            print(json.dumps({"name": name, "ms": round(1000 * (time.time() - t))}))
    return 0


def repl(db: Database, lines=None) -> None:
    limit = 20
    for line in lines if lines is not None else sys.stdin:
        line = line.strip()
        word, _, rest = line.partition(" ")
        if not line:
            continue
        if word == ".exit":
            return
        if word == ".help":
            print(HELP)
        elif word == ".schema":
            print(db.games.schema.simpleString(), db.plies.schema.simpleString())
        elif word == ".info":
            show(listing.stats(db.games))
        elif word == ".limit":
            limit = int(rest)
        elif word == ".open":
            db = Database(db.spark, rest)
        elif word == ".get":
            show(db.get(int(rest)))
        elif word == ".explain":
            print(json.dumps(explained(rest)))
        elif word == ".clear":
            print("\033[2J", end="")
        else:
            try:
                show(db.search(line).orderBy("game_id"), limit)
            except (ParseError, SemanticError) as e:
                print(e)


def main() -> int:
    return run(parser().parse_args())


if __name__ == "__main__":
    sys.exit(main())
