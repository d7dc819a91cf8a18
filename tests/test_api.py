import io
import json

from plyforge.api import cli, rpc
from plyforge.api.database import Database
from plyforge.operators import listing
from plyforge.plans.on_games import texts
from plyforge.streaming import trees as streaming


def _file(spark, tmp_path):
    path = tmp_path / "games.pgn"
    path.write_text("\n".join(r["text"] for r in texts(spark).orderBy("game_id").collect()))
    return str(path)


def test_cli(spark, tmp_path, capsys):
    path = _file(spark, tmp_path)
    out = str(tmp_path / "db")
    for args in (["import", path, out], ["info", out], ["search", out, "mate", "--limit", "3"], ["tree", out], ["continuations", out, "--depth", "2"], ["endgames", out], ["get", out, "2"], ["list", out, "--sort", "white", "--size", "2"], ["search-pos", out, "8/8/8/8/4P3/8/8/8", "--mode", "partial"], ["search-mat", out, "Q=0"], ["check", path, "--view", out], ["explain", "flipcolor { Qc3 }"], ["sort-pgn", out, str(tmp_path / "s")], ["sort-db", out, str(tmp_path / "d"), "--sort", "white"], ["compact", out, str(tmp_path / "c")], ["build", out, str(tmp_path / "v"), "tree", "pos-idx", "endgames"], ["create", str(tmp_path / "new")]):
        assert cli.run(cli.parser().parse_args(args), spark) == 0
    text = capsys.readouterr().out
    assert '"total":5' in text and "Qh4#" in text and "valid" in text and "Colors swapped" in text


def test_repl(spark, tmp_path, capsys):
    db = Database(spark, _file(spark, tmp_path))
    cli.repl(db, [".help", ".limit 1", "mate", "piece B on zz", ".explain check", ".info", ".exit", "never"])
    out = capsys.readouterr().out
    assert out.count('"game_id"') == 1 and "Syntax error" in out


def test_rpc(spark, tmp_path):
    path = _file(spark, tmp_path)
    calls = [
        ("open_db", {"path": path, "key": "a"}), ("stats", {}), ("cql_search", {"query": "mate"}), ("cql_search", {"query": "mate"}), ("query_games", {"search_id": "main_1", "page_size": 2, "sort": "white"}), ("query_games", {"player": "morphy"}), ("validate_dsl", {"query": "wtm and btm"}),
        ("validate_dsl", {"query": "check ("}), ("explain_dsl", {"query": "mate"}), ("opening_tree", {}), ("continuations", {"depth": 2}), ("get_game", {"id": 2}), ("get_game", {"id": 99}), ("delete", {"ids": [0]}), ("compact", {}), ("nonsense", {}), ("reference", {"filter": {"eco": "C"}}),
        ("search_position", {"fen": "8/8/8/8/4P3/8/8/8", "mode": "partial"}), ("name_ranks", {"column": "white"}), ("clear_search", {"search_id": "main_1"}), ("close_db", {"db": "a"}), ("stats", {}),
    ]
    out = io.StringIO()
    rpc.serve([json.dumps({"id": i, "command": c, "params": p}) for i, (c, p) in enumerate(calls)] + ["{"], out, spark)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    ok = [g["status"] for g in got]
    assert ok == ["ok"] * 12 + ["error"] + ["ok"] * 2 + ["error"] + ["ok"] * 5 + ["error", "error"]
    assert got[1]["result"]["total"] == 5 and got[2]["result"] == got[3]["result"] == {"search_id": "main_1", "count": 5}
    assert got[4]["result"]["total"] == 5 and len(got[4]["result"]["games"]) == 2 and got[5]["result"]["total"] == 1
    assert got[6]["result"]["valid"] is False and got[7]["result"]["line"] == 1 and got[14]["result"]["removed"] == 1


def test_structured_filter_with_query(spark, tmp_path):
    db = Database(spark, _file(spark, tmp_path))
    rows, total = db.list_games(listing.GameFilter(query="mate and R on d8", result="1-0"))
    assert total == 1 and rows.first()["white"] == "Morphy, Paul"


def test_streaming_counts_each_game_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "a.pgn").write_text("1. e4 e5 1-0\n")
    streaming.watch(spark, str(inbox), out, mark).awaitTermination()
    (inbox / "b.pgn").write_text("1. e4 c5 0-1\n")
    streaming.watch(spark, str(inbox), out, mark).awaitTermination()
    got = {r["san"]: r["games"] for r in streaming.total(spark, out).collect()}
    assert got["e4"] == 2 and got["e5"] == 1 and got["c5"] == 1
