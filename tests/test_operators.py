import pytest
from pyspark.sql import functions as F

from plyforge.operators import endgames, export, listing, mutations, positions, trees
from plyforge.plans.on_games import tables, texts
from plyforge.rules.board import START, Position
from plyforge.sources import pgn


@pytest.fixture(scope="module")
def data(spark):
    g, p = tables(spark)
    return g.persist(), p.persist()


def test_pgn_source_splits_anywhere(spark, tmp_path):
    raw = "\n".join(r["text"] for r in texts(spark).orderBy("game_id").collect())
    (tmp_path / "a.pgn").write_text(raw)
    (tmp_path / "b.pgn").write_text('1. e4 e5 *\n\n[White "Ä"]\r\n\r\n1. d4 *\n')
    whole = {r["text"] for r in pgn.read_pgn(spark, str(tmp_path)).collect()}
    assert len(whole) == 7
    for size in (90, 333, 1000):
        got = pgn.read_pgn(spark, str(tmp_path), size)
        rows = got.collect()
        assert sorted(r["game_id"] for r in rows) == list(range(7))
        assert {r["text"].strip() for r in rows} == {t.strip() for t in whole}


def test_build_and_status(spark, tmp_path):
    src = tmp_path / "a.pgn"
    src.write_text("\n".join(r["text"] for r in texts(spark).collect()))
    out = str(tmp_path / "view")
    assert pgn.status(str(src), out) == "missing"
    assert pgn.build(spark, str(src), out)["games"] == 5
    assert pgn.status(str(src), out) == "valid"
    src.write_text(src.read_text() + "\n1. e4 *\n")
    assert pgn.status(str(src), out) == "outdated"


def test_export_round_trip(spark, data):
    g, p = data
    out = export.export_pgn(g, p).orderBy("game_id")
    assert all(len(line) <= 90 for r in out.collect() for line in r["value"].splitlines() if not line.startswith("["))
    again = pgn.plies_of(out.select("game_id", F.col("value").alias("text")))
    assert again.select("game_id", "ply", "epd").exceptAll(p.select("game_id", "ply", "epd")).count() == 0
    assert again.count() == p.count()


def test_position_search(data):
    g, p = data
    after = Position.start().make(Position.start().parse_san("e4"))
    assert {(r["game_id"], r["ply"]) for r in positions.search_position(p, after.fen()).collect()} == {(i, 1) for i in (0, 1, 3, 4)}
    assert positions.search_position(p, "8/8/8/8/4P3/8/8/8", mode="partial").count() == 4
    assert positions.search_position(p, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR", turn="white").count() == 0
    assert positions.scan_position(p, START).count() == 5
    assert positions.search_material(p, positions.MaterialFilter({"Q": 0, "q": 1})).count() >= 1
    index = positions.position_index(p, 24)
    assert positions.lookup(index, after.fen()).first()["n"] == 4


def test_tree_and_lines(data):
    g, p = data
    s = trees.chess_steps(p, g)
    at = F.col("pos_key") == Position.start().key()
    t = {r["san"]: r for r in trees.opening_tree(s, at).collect()}
    assert t["e4"]["games"] == 4 and t["f3"]["games"] == 1 and t["f3"]["black_wins"] == 1
    assert t["e4"]["avg_white_elo"] == (2700 + 2600 + 1500) // 3 and t["e4"]["white_pct"] == 100.0
    lines = trees.continuations(s, at, 3).collect()
    assert list(lines[0]["moves"]) == ["e4", "e5", "Nf3"] and lines[0]["games"] == 2 and lines[0]["reaching"] == 5
    assert [r["games"] for r in lines] == [2, 1, 1, 1]
    edges = trees.graph(s)
    best = trees.top_lines(edges, F.col("s") == Position.start().key(), 4, 3).collect()
    assert list(best[0]["moves"])[:3] == ["e4", "e5", "Nf3"] and best[0]["games"] == 2
    assert trees.tree_index(s, max_ply=None).where("san is null").count() == 5


def test_deep_top_line_may_be_undone(data):
    with pytest.raises(ValueError):
        trees.continuations(trees.chess_steps(data[1], data[0]), F.lit(True), 0)


@pytest.mark.parametrize(
    "fen, features",
    [
        ("8/8/4k3/8/4P3/4K3/8/8 w - -", {"KP_K"}), ("8/8/4k3/4p3/8/4K3/8/8 w - -", {"KP_K"}), ("8/8/4k3/r7/8/4K3/R7/8 w - -", {"R_R"}), ("8/8/4k3/r7/4P3/4K3/R7/8 w - -", {"R_R", "RP_R"}),
        ("8/8/4k3/b7/4P3/4K3/B7/8 w - -", {"B_B", "OCB"}), ("8/8/4k3/1b6/4P3/4K3/B7/8 w - -", {"B_B", "SCB"}), ("8/8/4k3/bn6/4P3/4K3/R7/8 w - -", {"R_BN"}), ("8/8/4k3/bn6/4P3/4K3/Q7/8 w - -", {"Q_MINOR"}), (START, set()),
    ],
)
def test_endgame_features(spark, fen, features):
    p = Position.from_fen(fen)
    row = {"game_id": 1, "ply": 0, **p.bitboards()}
    df = spark.createDataFrame([tuple(row.values())], "game_id long, ply int, p long, n long, b long, r long, q long, k long, w long, bl long")
    got = endgames.endgame_index(df).collect()
    bits = got[0]["features"] if got else 0
    assert {i for bit, _, i, *_ in endgames.FEATURES if bits >> bit & 1} == features


def test_catalog_size():
    assert len(endgames.FEATURES) == 47 and len(endgames.CATALOG) == 8


def test_mutations(spark, data):
    g = data[0].select("game_id", "white", "deleted")
    gone = mutations.set_deleted(g, F.col("game_id") == 1)
    small = mutations.compact(gone).orderBy("game_id").collect()
    assert [r["game_id"] for r in small] == [0, 1, 2, 3] and small[1]["white"] == "Player, First"
    assert mutations.set_deleted(gone, F.lit(True), False).where("deleted").count() == 0
    assert mutations.add(g, g.where("game_id < 2")).agg(F.max("game_id")).first()[0] == 6
    new = g.where("game_id = 1").withColumn("white", F.lit("X"))
    assert mutations.update(gone, new).where("game_id = 1").first().asDict() == {"game_id": 1, "white": "X", "deleted": True}


def test_save(spark, data, tmp_path):
    path = str(tmp_path / "g")
    mutations.save(data[0].select("game_id", "white"), path)
    mutations.save(spark.read.parquet(path).where("game_id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_sessions_and_cache(data):
    s = listing.Sessions()
    a = s.create("db", "mate", data[0])
    assert a == "main_1" and s.find("db", "mate") == a
    assert s.create("db", "check", data[0]) == "main_2" and s.get("main_1") is None
    r1, r2 = s.create("db", "1", data[0], "gui"), s.create("db", "2", data[0], "gui")
    s.get(r1)
    s.create("db", "3", data[0], "gui")
    assert s.get(r1) is not None and s.get(r2) is None and s.clear(r1) and not s.clear(r1)
    c = listing.QueryCache(data[0])
    assert [r["game_id"] for r in c.rows(listing.GameFilter(sort="white")).collect()] == [1, 3, 0, 2, 4]
    c.rows(listing.GameFilter(sort="black"))
    assert c.hits == 1


def test_sort_ties_and_unknown_parts(spark):
    df = spark.createDataFrame([(0, 2000, None, None), (1, None, None, None), (2, 2000, 5, None), (3, 2000, 5, None)], "game_id long, year int, month int, day int")
    assert [r["game_id"] for r in listing.sort_games(df, "date").collect()] == [1, 0, 2, 3]
    assert [r["game_id"] for r in listing.sort_games(df, "date", True).collect()] == [3, 2, 0, 1]
    assert [r["game_id"] for r in listing.sort_games(df, "nonsense").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_numbers_of_a_large_written_table(spark, tmp_path, reuse):
    """Ids stay gapless where ranges are sampled, coalesced and read again: checked on what was written."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 1_500_000
        games = spark.range(n).select(F.col("id").alias("game_id"), F.expr("id % 3 = 0").alias("deleted"), F.md5(F.col("id").cast("string")).alias("white"), F.expr("repeat('x', cast(id % 7 as int))").alias("extra"))
        kept = n - (n + 2) // 3
        for name, out, want in (("compact", mutations.compact(games), kept), ("sort", mutations.sort_database(games, F.col("white"), purge=True), kept), ("ranks", listing.name_ranks(games, "white"), n)):
            key = "rank" if name == "ranks" else "game_id"
            out.write.parquet(str(tmp_path / name))
            back = spark.read.parquet(str(tmp_path / name))
            got = back.agg(F.count(F.lit(1)), F.countDistinct(key), F.min(key), F.max(key)).first()
            assert tuple(got) == (want, want, 0, want - 1), name
            order = back.orderBy(key).select(F.col("name" if name == "ranks" else "white").alias("v")).limit(20_000).collect()
            assert name == "compact" or [r["v"] for r in order] == sorted(r["v"] for r in order)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_top_lines_hidden_behind_heavy_moves(spark):
    """Seventy heavy moves that lead to next to nothing don't push the best line out of a narrow search."""
    edges = [("S", f"h{i:02}", f"H{i}", 100) for i in range(70)] + [(f"H{i}", "x", f"X{i}", 1) for i in range(70)] + [("S", "good", "G", 50), ("G", "end", "E", 50)]
    df = spark.createDataFrame(edges, "state string, move string, next string, games long")
    got = [(r["games"], r["moves"]) for r in trees.top_lines(df, F.col("s") == "S", 2, 3, width=64).collect()]
    assert got == [(50, ["good", "end"]), (1, ["h00", "x"]), (1, ["h01", "x"])]


def test_top_lines_equal_all_lines(spark):
    import random

    rng = random.Random(2)
    edges = {}
    for layer in range(4):
        for a in range(5):
            for b in range(5):
                if rng.random() < 0.6:
                    edges[f"{layer}{a}", f"m{b}"] = (f"{layer + 1}{b}", rng.randint(1, 6))
    df = spark.createDataFrame([(s, m, t, g) for (s, m), (t, g) in edges.items()], "state string, move string, next string, games long")

    def lines(at, moves, games, depth):
        out = [(m, t, g) for (s, m), (t, g) in edges.items() if s == at]
        if moves and (not out or len(moves) == depth):
            return [(-games, -len(moves), " ".join(moves))]
        return [x for m, t, g in out for x in lines(t, [*moves, m], min(games, g), depth)]

    for depth in (2, 4):
        want = sorted(lines("00", [], 99, depth))[:8]
        got = [(-r["games"], -len(r["moves"]), " ".join(r["moves"])) for r in trees.top_lines(df, F.col("s") == "00", depth, 8, width=3).collect()]
        assert got == want


def test_save_survives_an_interruption(spark, tmp_path):
    path = str(tmp_path / "t")
    mutations.save(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the second rename had failed
    mutations.save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]


def test_rpc_says_what_it_cuts(spark):
    from plyforge.api import rpc

    assert rpc.is_cut({"a": rpc.rows(spark.range(5), 3)}) and not rpc.is_cut(rpc.rows(spark.range(3), 3))
