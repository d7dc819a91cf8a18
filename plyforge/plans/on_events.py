"""Timeline operators on users' events: one user is a game, one event a ply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.lang import ast as A
from plyforge.operators import listing, positions, trees
from plyforge.plans.compiler import hit_rows
from plyforge.sources.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS game_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply, event_type, value, ts, props FROM events)"
NAMES = trees.Names(state="state", move="move")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").alias("game_id"), (F.row_number().over(w) - 1).cast("long").alias("ply"), "event_type", "value", "ts", "props")


def is_(kind: str) -> A.Raw:
    return A.Raw(f"event_type = '{kind}'")


def over(n: float) -> A.Raw:
    return A.Raw(f"value > {n}D")


def _hits(name: str, q: A.Node, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: hit_rows(q, timeline(spark, sf))
    ORACLE[name] = f"WITH {EV} {sql}"


_W = "WINDOW w AS (PARTITION BY game_id ORDER BY ply)"
_hits("b1_leaf", is_("purchase"), "SELECT game_id, ply FROM ev WHERE event_type = 'purchase'")
_hits("b4_and", A.And((is_("click"), over(50))), "SELECT game_id, ply FROM ev WHERE event_type = 'click' AND value > 50")
_hits("b4_gated_and", A.And((A.Occurs(">=", 12, None, is_("purchase")), is_("view"))), "SELECT game_id, ply FROM ev WHERE event_type = 'view' AND game_id IN (SELECT game_id FROM ev WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 12)")
_hits("b5_anchored_and", A.And((is_("view"), A.Path("path", (A.Step("move", is_("purchase")),)))), f"SELECT game_id, ply FROM (SELECT *, lead(event_type) OVER w AS nxt FROM ev {_W}) WHERE event_type = 'view' AND nxt = 'purchase'")
_hits("b6_and_not", A.And((is_("view"), A.Not(over(50)))), "SELECT game_id, ply FROM ev WHERE event_type = 'view' AND NOT coalesce(value > 50, false)")
_hits("b7_or", A.Or((is_("signup"), A.And((is_("error"), over(90))))), "SELECT game_id, ply FROM ev WHERE event_type = 'signup' OR (event_type = 'error' AND value > 90)")
_hits("b8_not", A.Not(A.Or((is_("click"), is_("view")))), "SELECT game_id, ply FROM ev WHERE event_type NOT IN ('click', 'view')")
_hits("b9_parent", A.And((is_("purchase"), A.Scope("parent", is_("click")))), f"SELECT game_id, ply FROM (SELECT *, lag(event_type) OVER w AS prv FROM ev {_W}) WHERE event_type = 'purchase' AND prv = 'click'")
_hits("b10_child", A.Scope("child", A.Scope("child", is_("purchase"))), f"SELECT game_id, ply FROM (SELECT *, lead(event_type, 2) OVER w AS nxt FROM ev {_W}) WHERE nxt = 'purchase'")
_hits("b11_initial", A.Scope("initial", is_("view")), "SELECT game_id, ply FROM ev WHERE ply = 0 AND event_type = 'view'")
_hits("b12_terminal", A.Scope("terminal", is_("error")), "SELECT game_id, ply FROM (SELECT *, max(ply) OVER (PARTITION BY game_id) AS last FROM ev) WHERE ply = last AND event_type = 'error'")
_hits("b13_ply_in", A.PlyIn(5, 20, is_("purchase")), "SELECT game_id, ply FROM ev WHERE ply >= 5 AND ply < 20 AND event_type = 'purchase'")
_hits("b14_occurrences", A.Occurs("between", 8, 12, is_("purchase")), "SELECT game_id, ply FROM (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY game_id) AS n FROM ev) WHERE event_type = 'purchase' AND n BETWEEN 8 AND 12")
_hits("b20_comment", A.Raw("contains(props, '7')"), "SELECT game_id, ply FROM ev WHERE contains(props, '7')")
_hits("b22_precedence", A.Or((is_("signup"), A.And((is_("click"), A.Not(over(10)))))), "SELECT game_id, ply FROM ev WHERE event_type = 'signup' OR event_type = 'click' AND NOT coalesce(value > 10, false)")
_hits("p11_ply_range", A.And((A.Ply("between", 3, 9), is_("view"))), "SELECT game_id, ply FROM ev WHERE ply BETWEEN 3 AND 9 AND event_type = 'view'")
_hits("p12_move_number", A.And((A.MoveNumber("<=", 4), is_("view"))), "SELECT game_id, ply FROM ev WHERE greatest(1, (ply + 1) // 2) <= 4 AND event_type = 'view'")

_LEADS = "le AS (SELECT *, " + ", ".join(f"lead(event_type, {i}) OVER w AS e{i}, lead(value, {i}) OVER w AS v{i}" for i in range(1, 7)) + f" FROM ev {_W})"


def _first(where: str, plies: list[str], cases: str = "") -> str:
    """Rows hit from the first start per game; cases: a column the rows' offsets depend on."""
    rows = " UNION ALL ".join(f"SELECT game_id, {p} AS ply FROM f" + (f" WHERE {p} IS NOT NULL" if "CASE" in p else "") for p in plies)
    return f", {_LEADS}, s AS (SELECT *{cases}, row_number() OVER (PARTITION BY game_id ORDER BY ply) AS rn FROM le WHERE {where}), f AS (SELECT * FROM s WHERE rn = 1) {rows}"


def _path(name: str, q: A.Path, tail: str) -> None:
    QUERIES[name] = lambda spark, sf: hit_rows(q, timeline(spark, sf))
    ORACLE[name] = f"WITH {EV}{tail}"


def m(kind: str, lo: int = 1, hi: int | None = 1) -> A.Step:
    return A.Step("move", is_(kind), lo, hi)


_path("e1_path", A.Path("path", (m("view"), m("click"), m("purchase"))), _first("e1 = 'view' AND e2 = 'click' AND e3 = 'purchase'", ["ply + 1", "ply + 2", "ply + 3"]))
_gap = "CASE WHEN e2 = 'purchase' THEN 0 WHEN e3 = 'purchase' THEN 1 WHEN e4 = 'purchase' THEN 2 END"
_path("e2_gap", A.Path("path", (m("signup"), A.Step("gap", None, 0, 2), m("purchase"))), _first(f"e1 = 'signup' AND ({_gap}) IS NOT NULL", ["ply + 1", f"ply + 2 + ({_gap})"]))
_rep = "CASE WHEN e1 = 'click' AND e2 = 'click' AND e3 = 'click' AND e4 = 'view' THEN 3 WHEN e1 = 'click' AND e2 = 'click' AND e3 = 'view' THEN 2 END"
_path("e3_repetition", A.Path("path", (m("click", 2, 3), m("view"))), _first(f"({_rep}) IS NOT NULL", ["ply + 1", "ply + 2", "ply + 3", f"CASE WHEN ({_rep}) = 3 THEN ply + 4 END"]))
_path("e4_one_side", A.Path("path", (m("view"), m("purchase")), "single"), _first("e1 = 'view' AND e3 = 'purchase'", ["ply + 1", "ply + 3"]))
_path("e5_filtered_path", A.Path("cqlpath", (m("click"), A.Step("filter", over(50)), m("view"))), _first("e1 = 'click' AND v1 > 50 AND e2 = 'view'", ["ply + 1", "ply + 1", "ply + 2"]).replace("UNION ALL", "UNION"))
QUERIES["e6_line"] = lambda spark, sf: hit_rows(A.Path("line", (A.Step("filter", is_("view")), A.Step("filter", is_("purchase")))), timeline(spark, sf))
ORACLE["e6_line"] = f"WITH {EV}, {_LEADS} SELECT game_id, ply FROM le WHERE event_type = 'view' AND e1 = 'purchase' UNION SELECT game_id, ply + 1 FROM le WHERE event_type = 'view' AND e1 = 'purchase'"
QUERIES["e6_line_back"] = lambda spark, sf: hit_rows(A.Path("line", (A.Step("filter", is_("purchase")), A.Step("filter", is_("view"))), back=True), timeline(spark, sf))
ORACLE["e6_line_back"] = ORACLE["e6_line"]

# -- trees, lines and graphs: the state is the event at hand, the move the one that follows

ST = f"""{EV}, st AS (SELECT game_id, ply, event_type AS state, lead(event_type) OVER w AS move, lead(event_type) OVER w AS next_state, game_id % 3 + 1 AS result,
 CASE WHEN game_id % 5 = 0 THEN 0 ELSE 1000 + game_id % 500 END AS white_elo, 900 + game_id % 300 AS black_elo, year(ts) * 16 + month(ts) AS ym FROM ev {_W})"""
_OUT = "count(*) AS games, count(*) FILTER (WHERE result = 1) AS white_wins, count(*) FILTER (WHERE result = 3) AS draws, count(*) FILTER (WHERE result = 2) AS black_wins"
_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY ply) AS rn FROM st WHERE state = 'click') WHERE rn = 1)"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("game_id").orderBy("ply")
    t = timeline(spark, sf)
    g = F.col("game_id")
    return t.select(
        "game_id", "ply", F.col("event_type").alias("state"), F.lead("event_type").over(w).alias("move"), F.lead("event_type").over(w).alias("next_state"), (g % 3 + 1).alias("result"),
        F.when(g % 5 == 0, F.lit(0)).otherwise(1000 + g % 500).alias("white_elo"), (900 + g % 300).alias("black_elo"), (F.year("ts") * 16 + F.month("ts")).cast("long").alias("ym"),
    )


def a1(spark: SparkSession, sf: str) -> DataFrame:
    out = trees.opening_tree(steps(spark, sf), F.col("state") == "click", NAMES, samples=3)
    return out.withColumn("sample_ids", F.array_join(F.col("sample_ids").cast("array<string>"), ","))


QUERIES["a1_next_move_tree"] = a1
ORACLE["a1_next_move_tree"] = f"""WITH {ST}, {_FIRST}, h AS (SELECT *, row_number() OVER (PARTITION BY move ORDER BY game_id) AS i FROM f WHERE move IS NOT NULL)
SELECT move, {_OUT}, CAST(sum(white_elo) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS BIGINT) // count(*) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS avg_white_elo,
 CAST(sum(black_elo) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS BIGINT) // count(*) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS avg_black_elo, min(ym) AS first_ym, max(ym) AS last_ym,
 string_agg(CASE WHEN i <= 3 THEN CAST(game_id AS VARCHAR) END, ',' ORDER BY game_id) AS sample_ids,
 round(count(*) FILTER (WHERE result = 1) * 100.0 / count(*), 2) AS white_pct, round(count(*) FILTER (WHERE result = 3) * 100.0 / count(*), 2) AS draw_pct, round(count(*) FILTER (WHERE result = 2) * 100.0 / count(*), 2) AS black_pct
FROM h GROUP BY move"""
QUERIES["a2_tree_of_candidates"] = lambda spark, sf: trees.opening_tree(steps(spark, sf).join(hit_rows(A.Occurs(">=", 12, None, is_("purchase")), timeline(spark, sf)).select("game_id").distinct(), "game_id", "left_semi"), F.col("state") == "click", NAMES, samples=0)
_MEANS = """CAST(sum(white_elo) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS BIGINT) // count(*) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS avg_white_elo,
 CAST(sum(black_elo) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS BIGINT) // count(*) FILTER (WHERE white_elo > 0 AND black_elo > 0) AS avg_black_elo, min(ym) AS first_ym, max(ym) AS last_ym"""
_PCT = ", ".join(f"round(count(*) FILTER (WHERE result = {r}) * 100.0 / count(*), 2) AS {c}_pct" for r, c in ((1, "white"), (3, "draw"), (2, "black")))
ORACLE["a2_tree_of_candidates"] = f"WITH {ST}, {_FIRST} SELECT move, {_OUT}, {_MEANS}, {_PCT} FROM f WHERE move IS NOT NULL AND game_id IN (SELECT game_id FROM ev WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 12) GROUP BY move"
QUERIES["a3_tree_index"] = lambda spark, sf: trees.tree_index(steps(spark, sf), NAMES, 24)
ORACLE["a3_tree_index"] = f"WITH {ST} SELECT state, move, {_OUT} FROM st WHERE ply <= 24 GROUP BY state, move"
QUERIES["a3_nested_tree"] = lambda spark, sf: trees.nested_tree(trees.tree_index(steps(spark, sf).where("move is not null"), NAMES, 24), NAMES).select("state", "total", F.expr("moves[0].games").alias("best"))
ORACLE["a3_nested_tree"] = f"WITH {ST}, x AS (SELECT state, move, count(*) AS n FROM st WHERE ply <= 24 AND move IS NOT NULL GROUP BY 1, 2) SELECT state, CAST(sum(n) AS BIGINT) AS total, max(n) AS best FROM x GROUP BY 1"


def a4(spark: SparkSession, sf: str) -> DataFrame:
    out = trees.continuations(steps(spark, sf), F.col("state") == "click", 3, NAMES, min_games=2, min_percentage=0.5, max_lines=25)
    return out.select(F.array_join("moves", " ").alias("line"), "games", "white_wins", "draws", "black_wins", "last_ym", "reaching", F.round("percentage", 6).alias("percentage"))


QUERIES["a4_continuations"] = a4
_LINES = f"""{ST}, l3 AS (SELECT *, lead(move) OVER w AS m2, lead(move, 2) OVER w AS m3 FROM st {_W}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY ply) AS rn FROM l3 WHERE state = 'click') WHERE rn = 1),
x AS (SELECT concat_ws(' ', move, m2, m3) AS line, CASE WHEN m3 IS NOT NULL THEN 3 WHEN m2 IS NOT NULL THEN 2 ELSE 1 END AS len, {_OUT}, max(ym) AS last_ym, (SELECT count(*) FROM f) AS reaching FROM f WHERE move IS NOT NULL GROUP BY 1, 2)"""
ORACLE["a4_continuations"] = f"WITH {_LINES} SELECT line, games, white_wins, draws, black_wins, last_ym, reaching, round(games * 100.0 / reaching, 6) AS percentage FROM x WHERE games >= 2 AND games * 100.0 / reaching >= 0.5 ORDER BY games DESC, len DESC, line LIMIT 25"


def a9(spark: SparkSession, sf: str) -> DataFrame:
    out = trees.continuations(steps(spark, sf), F.col("state") == "click", 3, NAMES, max_lines=None).where(F.size("moves") == 3)
    return out.select(trees.formatted(F.col("moves"), 3, False).alias("line"), "games")


QUERIES["a9_formatted_lines"] = a9
ORACLE["a9_formatted_lines"] = f"WITH {_LINES} SELECT '3... ' || split_part(line, ' ', 1) || ' 4. ' || split_part(line, ' ', 2) || ' ' || split_part(line, ' ', 3) AS line, games FROM x WHERE len = 3"
QUERIES["a6_graph"] = lambda spark, sf: trees.graph(steps(spark, sf), "next_state", NAMES, min_games=5)
ORACLE["a6_graph"] = f"WITH {ST} SELECT state, move, next_state AS \"next\", {_OUT}, min(ym) AS first_ym, max(ym) AS last_ym FROM st WHERE move IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5"
QUERIES["a7_top_lines"] = lambda spark, sf: trees.top_lines(trees.graph(steps(spark, sf), "next_state", NAMES), F.col("s") == "click", 3, 10, 200).select(F.array_join("moves", " ").alias("line"), "games")
ORACLE["a7_top_lines"] = f"WITH {ST}, e AS (SELECT state s, move m, count(*) g FROM st WHERE move IS NOT NULL GROUP BY 1, 2) SELECT a.m || ' ' || b.m || ' ' || c.m AS line, least(a.g, b.g, c.g) AS games FROM e a JOIN e b ON b.s = a.m JOIN e c ON c.s = b.m WHERE a.s = 'click' ORDER BY games DESC, line LIMIT 10"
QUERIES["a8_next_moves"] = lambda spark, sf: trees.next_moves(steps(spark, sf), F.col("state") == "view", NAMES)
ORACLE["a8_next_moves"] = f"WITH {ST} SELECT move, count(*) AS n FROM st WHERE state = 'view' AND move IS NOT NULL GROUP BY 1"

# -- postings: a position is the last two events

_POS = f"{EV}, ps AS (SELECT game_id, ply, coalesce(lag(event_type) OVER w, '-') || '>' || event_type AS pos FROM ev {_W})"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("game_id").orderBy("ply")
    return timeline(spark, sf).select("game_id", "ply", F.concat(F.coalesce(F.lag("event_type").over(w), F.lit("-")), F.lit(">"), "event_type").alias("pos"))


QUERIES["n3_postings"] = lambda spark, sf: positions.position_index(pairs(spark, sf), 24, 2, "pos").select("pos", "n", F.array_join(F.col("games").cast("array<string>"), ",").alias("first_ids"))
ORACLE["n3_postings"] = f"WITH {_POS}, d AS (SELECT DISTINCT pos, game_id FROM ps WHERE ply <= 24), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY game_id) AS i FROM d) SELECT pos, count(*) AS n, string_agg(CASE WHEN i <= 5 THEN CAST(game_id AS VARCHAR) END, ',' ORDER BY game_id) AS first_ids FROM r GROUP BY pos HAVING count(*) >= 2"
QUERIES["n4_posting_lookup"] = lambda spark, sf: stored(spark, "postings", sf, lambda: positions.posting_pairs(pairs(spark, sf), 24, "pos")).where("pos = 'view>purchase'")
ORACLE["n4_posting_lookup"] = f"WITH {_POS} SELECT DISTINCT pos, game_id FROM ps WHERE ply <= 24 AND pos = 'view>purchase'"
QUERIES["n5_index_diagnostics"] = lambda spark, sf: positions.index_diagnostics(positions.posting_pairs(pairs(spark, sf), 24, "pos"), "pos", "game_id")
ORACLE["n5_index_diagnostics"] = f"WITH {_POS}, d AS (SELECT pos, count(DISTINCT game_id) AS n FROM ps WHERE ply <= 24 GROUP BY 1) SELECT CASE WHEN n <= 10 THEN '1-10' WHEN n <= 100 THEN '11-100' WHEN n <= 1000 THEN '101-1000' WHEN n <= 10000 THEN '1001-10000' WHEN n <= 100000 THEN '10001-100000' ELSE '100001+' END AS bucket, count(*) AS positions, CAST(sum(n) AS BIGINT) AS postings FROM d GROUP BY 1"
QUERIES["n1_first_hit"] = lambda spark, sf: trees.first_hits(timeline(spark, sf).select("game_id", "ply", "event_type"), F.col("event_type") == "purchase", NAMES).select("game_id", "ply")
ORACLE["n1_first_hit"] = f"WITH {EV} SELECT game_id, min(ply) AS ply FROM ev WHERE event_type = 'purchase' GROUP BY 1"
QUERIES["n7_all_hits"] = lambda spark, sf: positions.all_hits(timeline(spark, sf), F.col("event_type") == "signup").select("game_id", F.array_join(F.col("plies").cast("array<string>"), ",").alias("plies"))
ORACLE["n7_all_hits"] = f"WITH {EV} SELECT game_id, string_agg(CAST(ply AS VARCHAR), ',' ORDER BY ply) AS plies FROM ev WHERE event_type = 'signup' GROUP BY 1"
QUERIES["a13_name_ranks"] = lambda spark, sf: listing.name_ranks(spark.read.parquet(f"{sf}/part.parquet"), "p_name")
ORACLE["a13_name_ranks"] = "SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS rank FROM (SELECT DISTINCT p_name FROM part)"
