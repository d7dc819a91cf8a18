"""Header operators on orders, board operators on boards made of order lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import bitboards as B
from plyforge.lang import ast as A
from plyforge.lang.parser import parse
from plyforge.operators import endgames, headers, listing, mutations, positions
from plyforge.plans.compiler import hit_rows, power_sql, set_sql
from plyforge.sources.tables import by_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_COLS = """o_orderkey AS game_id, c_name AS white, c_mktsegment AS black, CAST(floor(o_totalprice / 100) AS INT) AS white_elo, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal / 4) AS INT) END AS black_elo,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS result, o_orderpriority AS eco, year(o_orderdate) AS year, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE month(o_orderdate) END AS month,
 CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE day(o_orderdate) END AS day, n_name AS event, c_mktsegment AS site, o_orderpriority AS round, o_orderkey % 9 = 0 AS deleted"""
_FROM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
G = f"g AS (SELECT {_COLS} {_FROM})"


def games(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "customer", "nation")}
    joined = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
    exprs = [x.strip() for x in _COLS.replace("\n", " ").split(", ")]
    # commas inside the expressions don't stand before a blank and a name that ends in AS, so parts are joined again
    parts, word = [], ""
    for x in exprs:
        word = f"{word}, {x}" if word else x
        if " AS " in x and not word.count("(") - word.count(")"):
            parts.append(word)
            word = ""
    out = joined.selectExpr(*parts)
    return out.withColumn("date", F.concat_ws(".", "year", F.coalesce(F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("??")), F.coalesce(F.lpad(F.col("day").cast("string"), 2, "0"), F.lit("??")))).withColumn("tags", F.create_map(F.lit("clerk"), F.concat("eco", F.lit("/"), "black")))


def _headers(name: str, dsl: str, where: str) -> None:
    q = parse(dsl)
    QUERIES[name] = lambda spark, sf: headers.filter_games(games(spark, sf), q).select("game_id")
    ORACLE[name] = f"WITH {G} SELECT game_id FROM g WHERE {where}"


_headers("h1_player", 'player contains "build"', "contains(lower(white), 'build') OR contains(lower(black), 'build')")
_headers("h2_white_black", 'white endswith "7" and black != "machinery"', "ends_with(lower(white), '7') AND lower(black) <> 'machinery'")
_headers("h3_white_elo", "white_elo >= 2500 and black_elo != 1200", "white_elo >= 2500 AND coalesce(black_elo <> 1200, false)")
_headers("h4_any_elo", "elo >= 3500", "coalesce(white_elo >= 3500, false) OR coalesce(black_elo >= 3500, false)")
_headers("h5_avg_elo", "avg_elo < 1200", "(white_elo + black_elo) // 2 < 1200")
_headers("h6_elo_diff", "elo_diff <= 50 and raw_elo_diff >= 10", "abs(white_elo - black_elo) <= 50 AND white_elo - black_elo >= 10")
_headers("h7_result", 'result != "1/2-1/2" and result "All"', "result <> 3")
_headers("h8_eco", 'eco startswith "1-u"', "starts_with(lower(eco), '1-u')")
_LATE, _EARLY = "year * 10000 + coalesce(month, 12) * 100 + coalesce(day, 31)", "year * 10000 + coalesce(month, 1) * 100 + coalesce(day, 1)"
_headers("h9_date_equal", 'date == "1996.03"', "year = 1996 AND month = 3")
_headers("h9_date_after", 'date > "1995.06" and date <= "1996.02.15"', f"{_EARLY} > 19950631 AND {_LATE} <= 19960215")
_headers("h9_date_from", 'date >= "1997" and date < "1997.04"', f"{_EARLY} >= 19970101 AND {_LATE} < 19970401")
_headers("h10_event_site", 'event contains "an" and site "auto"', "contains(lower(event), 'an') AND contains(lower(site), 'auto')")
_headers("h11_round", 'round == "3-MEDIUM"', "lower(trim(round)) = '3-medium'")
_headers("h12_tag", 'tag "Clerk" contains "high/f"', "contains(lower(eco || '/' || black), 'high/f')")
_headers("h13_text_ops", 'white ~ "0[1-3]5$" and event >= "f"', "regexp_matches(white, '(?i)0[1-3]5$') AND lower(event) >= 'f'")
_headers("h14_numeric", "white_elo != 1500 and white_elo > 1490 and white_elo < 1510", "white_elo <> 1500 AND white_elo > 1490 AND white_elo < 1510")
_headers("b8_header_not", 'not (white endswith "1" or result "1-0")', "NOT (ends_with(lower(white), '1') OR result = 1)")
_headers("b21_empty_query", "", "true")
QUERIES["h15_structured_filter"] = lambda spark, sf: listing.filter_games(games(spark, sf), listing.GameFilter(player="0", site="HOUSE", eco="2", date="199", result="1-0", min_elo=1000, include_deleted=False, start_game=10, end_game=9000)).select("game_id")
ORACLE["h15_structured_filter"] = f"WITH {G} SELECT game_id FROM g WHERE contains(white, '0') AND contains(lower(site), 'house') AND starts_with(eco, '2') AND contains(CAST(year AS VARCHAR), '199') AND result = 1 AND (white_elo >= 1000 OR black_elo >= 1000) AND NOT deleted AND game_id >= 10 AND game_id < 9000"


def h16(spark: SparkSession, sf: str) -> DataFrame:
    """Headers first: the timeline is read for the games that are left, by a left semi join."""
    keep = headers.filter_games(games(spark, sf), parse('result "1-0" and eco startswith "1"'))
    return hit_rows(A.Compare(A.Pieces("P"), ">=", 1), boards(spark, sf).join(keep.select("game_id"), "game_id", "left_semi")).select("game_id")


QUERIES["h16_headers_then_boards"] = h16
QUERIES["r1_sorted_page"] = lambda spark, sf: listing.page(listing.sort_games(games(spark, sf), "white_elo", True), 2, 25).select("game_id", "white_elo")
ORACLE["r1_sorted_page"] = f"WITH {G} SELECT game_id, white_elo FROM g ORDER BY white_elo DESC NULLS LAST, game_id DESC LIMIT 25 OFFSET 50"
QUERIES["r1_sort_by_date"] = lambda spark, sf: listing.page(listing.sort_games(games(spark, sf), "date"), 0, 40).select("game_id", "date")
ORACLE["r1_sort_by_date"] = f"WITH {G} SELECT game_id, year || '.' || coalesce(lpad(CAST(month AS VARCHAR), 2, '0'), '??') || '.' || coalesce(lpad(CAST(day AS VARCHAR), 2, '0'), '??') AS date FROM g ORDER BY year, coalesce(month, 0), coalesce(day, 0), game_id LIMIT 40"
QUERIES["r1_sort_by_name"] = lambda spark, sf: listing.page(listing.sort_games(games(spark, sf), "white"), 1, 30).select("game_id", "white")
ORACLE["r1_sort_by_name"] = f"WITH {G} SELECT game_id, white FROM g ORDER BY white, game_id LIMIT 30 OFFSET 30"
QUERIES["r2_total"] = lambda spark, sf: listing.filter_games(games(spark, sf), listing.GameFilter(player="0001")).agg(F.count(F.lit(1)).alias("total"))
ORACLE["r2_total"] = f"WITH {G} SELECT count(*) AS total FROM g WHERE contains(lower(white), '0001') OR contains(lower(black), '0001')"
QUERIES["r5_game_range"] = lambda spark, sf: listing.filter_games(games(spark, sf), listing.GameFilter(start_game=100, end_game=300)).select("game_id", "white")
ORACLE["r5_game_range"] = f"WITH {G} SELECT game_id, white FROM g WHERE game_id >= 100 AND game_id < 300"
QUERIES["s9_one_game"] = lambda spark, sf: games(spark, sf).where("game_id = 42").select("game_id", "white", "black", "result")
ORACLE["s9_one_game"] = f"WITH {G} SELECT game_id, white, black, result FROM g WHERE game_id = 42"
QUERIES["s10_stats"] = lambda spark, sf: listing.stats(games(spark, sf))
ORACLE["s10_stats"] = f"WITH {G} SELECT count(*) AS total, count(*) FILTER (WHERE NOT deleted) AS active, count(*) FILTER (WHERE deleted) AS deleted, count(DISTINCT event) AS events, count(DISTINCT site) AS sites, (SELECT count(DISTINCT x) FROM (SELECT white AS x FROM g UNION ALL SELECT black FROM g)) AS players FROM g"
QUERIES["k3_delete"] = lambda spark, sf: mutations.set_deleted(games(spark, sf), F.col("game_id") % 100 == 1).where("deleted").select("game_id")
ORACLE["k3_delete"] = f"WITH {G} SELECT game_id FROM g WHERE deleted OR game_id % 100 = 1"


def k3u(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).select("game_id", "white", "deleted")
    new = g.where("game_id % 50 = 0").select("game_id", F.upper("white").alias("white"), F.lit(False).alias("deleted"))
    return mutations.update(g, new)


QUERIES["k3_update"] = k3u
ORACLE["k3_update"] = f"WITH {G} SELECT game_id, CASE WHEN game_id % 50 = 0 THEN upper(white) ELSE white END AS white, deleted FROM g"
QUERIES["k3_add"] = lambda spark, sf: (lambda g: mutations.add(g, g.where("game_id < 20")))(games(spark, sf).select("game_id", "white"))
ORACLE["k3_add"] = f"WITH {G} SELECT game_id, white FROM g UNION ALL SELECT (SELECT max(game_id) FROM g) + row_number() OVER (ORDER BY game_id), white FROM g WHERE game_id < 20"
QUERIES["k4_compact"] = lambda spark, sf: mutations.compact(games(spark, sf).select("game_id", "white", "deleted")).select("game_id", "white")
ORACLE["k4_compact"] = f"WITH {G} SELECT row_number() OVER (ORDER BY game_id) - 1 AS game_id, white FROM g WHERE NOT deleted"
QUERIES["k6_sort_database"] = lambda spark, sf: mutations.sort_database(games(spark, sf).select("game_id", "white", "white_elo", "deleted"), F.col("white_elo").desc(), purge=True).select("game_id", "white", "white_elo")
ORACLE["k6_sort_database"] = f"WITH {G} SELECT row_number() OVER (ORDER BY white_elo DESC, g.game_id) - 1 AS game_id, white, white_elo FROM g WHERE NOT deleted"

# -- boards: a line of an order is a piece; its role, side and square follow from the line, and a square holds one piece

_ROLES = "pnbrqk"


def boards(spark: SparkSession, sf: str) -> DataFrame:
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    code = F.col("l_linenumber") % 6 * 2 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    x = l.select(F.col("l_orderkey").alias("game_id"), code.alias("code"), F.when(F.col("l_linenumber") % 6 == 0, 8 + F.col("l_partkey") % 48).otherwise(F.col("l_partkey") % 63).cast("int").alias("s"))
    x = by_key(x, l, "game_id").groupBy("game_id", "s").agg(F.min("code").alias("code")).select("game_id", "s", F.expr("code div 2").alias("role"), (F.col("code") % 2 == 1).alias("black"))
    bit = F.expr("shiftleft(1L, s)")
    zero = F.lit(0).cast("bigint")
    roles = [F.coalesce(F.bit_or(F.when(F.col("role") == i, bit)), zero).alias(c) for i, c in enumerate(_ROLES)]
    out = x.groupBy("game_id").agg(*roles, F.coalesce(F.bit_or(F.when(~F.col("black"), bit)), zero).alias("w"), F.coalesce(F.bit_or(F.when(F.col("black"), bit)), zero).alias("bl"))
    return out.withColumn("ply", F.lit(0)).withColumn("wtm", F.col("game_id") % 2 == 0)


X = "x0 AS (SELECT l_orderkey AS game_id, l_linenumber % 6 * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS code, CAST(CASE WHEN l_linenumber % 6 = 0 THEN 8 + l_partkey % 48 ELSE l_partkey % 63 END AS INT) AS s FROM lineitem), x AS (SELECT game_id, s, min(code) // 2 AS role, min(code) % 2 = 1 AS black FROM x0 GROUP BY 1, 2)"
_SETS = f"""{X}, ids AS (SELECT DISTINCT game_id FROM x), pc AS (SELECT game_id, role, black, s, s % 8 AS f, s // 8 AS r FROM x)"""


def _count(name: str, expr: str, sql: str) -> None:
    """(game_id, n): an integer expression over each board. sql: rows (game_id, ...) to count by game."""
    QUERIES[name] = lambda spark, sf: boards(spark, sf).select("game_id", F.expr(expr).cast("bigint").alias("n"))
    ORACLE[name] = f"WITH {_SETS}, hit AS ({sql}) SELECT ids.game_id, count(hit.game_id) AS n FROM ids LEFT JOIN hit ON hit.game_id = ids.game_id GROUP BY 1"


def _pieces(letters: str) -> str:
    return " OR ".join(f"(role = {_ROLES.index(c.lower())} AND {'NOT ' if c.isupper() else ''}black)" for c in letters)


def _set(dsl: str) -> str:
    q = parse(dsl)
    return f"bit_count({set_sql(q.a, {})})"


_count("p4_piece_count", _set("[QRn]"), f"SELECT DISTINCT game_id, s FROM pc WHERE {_pieces('QRn')}")
_count("p10_on_squares", _set("[Pp] on a2-d5"), f"SELECT DISTINCT game_id, s FROM pc WHERE ({_pieces('Pp')}) AND f <= 3 AND r BETWEEN 1 AND 4")
_count("p15_light_squares", _set("light [Bb]"), f"SELECT DISTINCT game_id, s FROM pc WHERE ({_pieces('Bb')}) AND (f + r) % 2 = 1")
_count("q1_empty", _set("_"), "SELECT ids.game_id, i FROM ids, range(64) t(i) WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.game_id = ids.game_id AND pc.s = i)")
_count("q3_algebra", _set("(([Pp] | [Nn]) \\ a1-h4) & ~light"), f"SELECT DISTINCT game_id, s FROM pc WHERE ({_pieces('PpNn')}) AND r > 3 AND (f + r) % 2 = 0")
_RAY = "SELECT DISTINCT game_id, nf + 8 * nr AS s FROM (SELECT game_id, f + d.x * n AS nf, r + d.y * n AS nr FROM pc, (VALUES {dirs}) d(x, y), range(1, 8) t(n) WHERE {who}) WHERE nf BETWEEN 0 AND 7 AND nr BETWEEN 0 AND 7"
_count("q6_ray", _set("ray(diagonal, B)"), _RAY.format(dirs="(1,1),(-1,1),(1,-1),(-1,-1)", who=_pieces("B")))
_count("q8_shift", _set("northwest 2 Q"), f"SELECT DISTINCT game_id, s FROM pc WHERE ({_pieces('Q')}) AND f >= 2 AND r <= 5")
_count("q8_offset", _set("offset(r, 1, -2) & light"), f"SELECT DISTINCT game_id, s FROM pc WHERE ({_pieces('r')}) AND f <= 6 AND r >= 2 AND (f + 1 + r - 2) % 2 = 1")
_BETWEEN = f"""SELECT DISTINCT a.game_id, a.f + sign(b.f - a.f) * n + 8 * (a.r + sign(b.r - a.r) * n) AS s FROM pc a JOIN pc b ON a.game_id = b.game_id, range(1, 7) t(n)
WHERE ({_pieces('Rr').replace('role', 'a.role').replace('black', 'a.black')}) AND ({_pieces('Qq').replace('role', 'b.role').replace('black', 'b.black')}) AND (a.f = b.f OR a.r = b.r OR abs(a.f - b.f) = abs(a.r - b.r)) AND n < greatest(abs(a.f - b.f), abs(a.r - b.r))"""
_count("q7_between", _set("between([Rr], [Qq])"), _BETWEEN)
_PAWN = "SELECT DISTINCT a.game_id, a.s FROM pc a WHERE a.role = 0 AND {own} AND NOT EXISTS (SELECT 1 FROM pc b WHERE b.game_id = a.game_id AND b.role = 0 AND {other})"
_count("w1_passed_white", B.pawn_count("passed", "(p & w)", "(p & bl)", True), _PAWN.format(own="NOT a.black", other="b.black AND abs(b.f - a.f) <= 1 AND b.r > a.r"))
_count("w1_passed_black", B.pawn_count("passed", "(p & bl)", "(p & w)", False), _PAWN.format(own="a.black", other="NOT b.black AND abs(b.f - a.f) <= 1 AND b.r < a.r"))
_count("w2_isolated", B.pawn_count("isolated", "(p & w)", "(p & bl)", True), _PAWN.format(own="NOT a.black", other="NOT b.black AND abs(b.f - a.f) = 1"))
_count("w3_doubled", B.pawn_count("doubled", "(p & w)", "(p & bl)", True), "SELECT DISTINCT a.game_id, a.s FROM pc a WHERE a.role = 0 AND NOT a.black AND EXISTS (SELECT 1 FROM pc b WHERE b.game_id = a.game_id AND b.role = 0 AND NOT b.black AND b.f = a.f AND b.r < a.r)")
_count("w4_backward", B.pawn_count("backward", "(p & w)", "(p & bl)", True), _PAWN.format(own="NOT a.black", other="NOT b.black AND abs(b.f - a.f) = 1 AND b.r <= a.r") + " AND EXISTS (SELECT 1 FROM pc c WHERE c.game_id = a.game_id AND c.role = 0 AND c.black AND abs(c.f - a.f) = 1 AND c.r = a.r + 2)")
_count("w5_islands", B.pawn_count("islands", "(p & w)", "(p & bl)", True), "SELECT DISTINCT a.game_id, a.f FROM pc a WHERE a.role = 0 AND NOT a.black AND NOT EXISTS (SELECT 1 FROM pc b WHERE b.game_id = a.game_id AND b.role = 0 AND NOT b.black AND b.f = a.f - 1)")


def _board(name: str, dsl: str, where: str) -> None:
    """game_id of the boards where a query holds."""
    q = parse(dsl)
    QUERIES[name] = lambda spark, sf: hit_rows(q, boards(spark, sf)).select("game_id")
    ORACLE[name] = f"WITH {_SETS} SELECT game_id FROM ids i WHERE {where}"


def _n(letters: str, more: str = "") -> str:
    return f"(SELECT count(DISTINCT s) FROM pc WHERE pc.game_id = i.game_id AND ({_pieces(letters)}){more})"


_board("p3_square_content", "Qc3 or pe5", f"{_n('Q', ' AND s = 18')} > 0 OR {_n('p', ' AND s = 36')} > 0")
_board("p5_turn", "wtm and N", f"game_id % 2 = 0 AND {_n('N')} > 0")
_board("q10_set_comparison", "[Qq] > [Rr]", f"{_n('Qq')} > {_n('Rr')}")
_board("m1_exact_counts", "Q == 1 and r == 0 and P == 1", f"{_n('Q')} = 1 AND {_n('r')} = 0 AND {_n('P')} = 1")
_board("m2_opposite_bishops", "opposite_bishops", f"{_n('B')} = 1 AND {_n('b')} = 1 AND {_n('B', ' AND (f + r) % 2 = 1')} <> {_n('b', ' AND (f + r) % 2 = 1')}")
_board("m2_same_bishops", "same_colored_bishops", f"{_n('B')} = 1 AND {_n('b')} = 1 AND {_n('B', ' AND (f + r) % 2 = 1')} = {_n('b', ' AND (f + r) % 2 = 1')}")
_POW = "({P} + 3 * {N} + 3 * {B} + 5 * {R} + 9 * {Q})"
_WP, _BP = _POW.format(**{c: _n(c) for c in "PNBRQ"}), _POW.format(**{c: _n(c.lower()) for c in "PNBRQ"})
_board("m4_power", "white_power >= 9 and 5 >= black_power", f"{_WP} >= 9 AND {_BP} <= 5")
_board("m5_power_versus", "white_power > black_power", f"{_WP} > {_BP}")
_board("m6_power_diff", "power_diff >= 8", f"abs({_WP} - {_BP}) >= 8")
QUERIES["m3_signed_difference"] = lambda spark, sf: boards(spark, sf).select("game_id", F.expr(power_sql("raw")).cast("bigint").alias("n"))
ORACLE["m3_signed_difference"] = f"WITH {_SETS} SELECT game_id, CAST({_WP} - {_BP} AS BIGINT) AS n FROM ids i"
QUERIES["m7_material_search"] = lambda spark, sf: positions.search_material(boards(spark, sf), positions.MaterialFilter({"Q": 0, "R": 1}, opposite=True)).select("game_id")
ORACLE["m7_material_search"] = f"WITH {_SETS} SELECT game_id FROM ids i WHERE {_n('Q')} = 0 AND {_n('R')} = 1 AND {_n('B')} > 0 AND {_n('b')} > 0 AND ({_n('B', ' AND (f + r) % 2 = 1')} > 0) <> ({_n('b', ' AND (f + r) % 2 = 1')} > 0)"
_board("t6_rook_on_7th", "rook_7th white", f"{_n('R', ' AND r = 6')} > 0")
_board("t7_open_file", "open_file [c, d]", "NOT EXISTS (SELECT 1 FROM pc WHERE pc.game_id = i.game_id AND role = 0 AND f = 2) OR NOT EXISTS (SELECT 1 FROM pc WHERE pc.game_id = i.game_id AND role = 0 AND f = 3)")
_board("t7_semi_open_file", "semi_open_file white", "EXISTS (SELECT 1 FROM pc a WHERE a.game_id = i.game_id AND a.role = 0 AND a.black AND NOT EXISTS (SELECT 1 FROM pc b WHERE b.game_id = i.game_id AND b.role = 0 AND NOT b.black AND b.f = a.f))")
_board("t8_distance", "distance(R, q) <= 2", "EXISTS (SELECT 1 FROM pc a JOIN pc b ON a.game_id = b.game_id WHERE a.game_id = i.game_id AND a.role = 3 AND NOT a.black AND b.role = 4 AND b.black AND greatest(abs(a.f - b.f), abs(a.r - b.r)) <= 2)")
_OUTPOST = "EXISTS (SELECT 1 FROM pc a JOIN pc g ON g.game_id = a.game_id AND g.role = 0 AND NOT g.black AND abs(g.f - a.f) = 1 AND g.r = a.r - 1 WHERE a.game_id = i.game_id AND a.role IN (1, 2) AND NOT a.black AND a.r BETWEEN 3 AND 5 AND NOT EXISTS (SELECT 1 FROM pc e WHERE e.game_id = a.game_id AND e.role = 0 AND e.black AND abs(e.f - a.f) = 1 AND e.r > a.r))"
_board("t5_outpost", "outpost [N, B]", _OUTPOST)
_board("y1_flip_color", "flipcolor { Qc3 }", f"{_n('Q', ' AND s = 18')} > 0 OR {_n('q', ' AND s = 42')} > 0")
_board("y1_all_symmetries", "flip { N on b2 }", f"{_n('N', ' AND s IN (9, 14, 49, 54)')} > 0")
_board("y4_shift_horizontal", "shifthorizontal { P on a3 and R on b4 }", "EXISTS (SELECT 1 FROM pc a JOIN pc b ON a.game_id = b.game_id WHERE a.game_id = i.game_id AND a.role = 0 AND NOT a.black AND a.r = 2 AND b.role = 3 AND NOT b.black AND b.r = 3 AND b.f = a.f + 1)")


def _bind(spark: SparkSession, sf: str) -> DataFrame:
    return hit_rows(parse("piece $x in [NB] { $x on light and distance($x, r) <= 1 }"), boards(spark, sf)).select("game_id")


QUERIES["b15_variable"] = _bind
ORACLE["b15_variable"] = f"WITH {_SETS} SELECT DISTINCT a.game_id FROM pc a JOIN pc b ON a.game_id = b.game_id AND b.role = 3 AND b.black WHERE a.role IN (1, 2) AND NOT a.black AND (a.f + a.r) % 2 = 1 AND greatest(abs(a.f - b.f), abs(a.r - b.r)) <= 1"

# -- endgame features over the boards

QUERIES["a10_endgame_features"] = lambda spark, sf: endgames.endgame_index(boards(spark, sf))


def _popular(spark: SparkSession, sf: str) -> DataFrame:
    g = boards(spark, sf).select("game_id", (F.col("game_id") % 3 + 1).alias("result"))
    return endgames.popularity(endgames.endgame_index(boards(spark, sf)), g)


QUERIES["a11_popularity"] = lambda spark, sf: _popular(spark, sf).select("id", "games", "white_wins", "draws", "black_wins", F.round("percentage", 6).alias("percentage"))
QUERIES["a11_categories"] = lambda spark, sf: endgames.category_popularity(_popular(spark, sf))
QUERIES["a12_with_feature"] = lambda spark, sf: endgames.with_feature(endgames.endgame_index(boards(spark, sf)), "R_R")


def _only(a: str, b: str) -> str:
    """SQL: side A has exactly the pieces a besides pawns and king, side B exactly b."""
    return " AND ".join([f"{_n(c)} = {a.count(c)}" for c in "QRBN"] + [f"{_n(c.lower())} = {b.count(c)}" for c in "QRBN"])


def _either(a: str, b: str) -> str:
    return f"(({_only(a, b)}) OR ({_only(b, a)}))"


_FEAT = f"""ft AS (SELECT game_id, game_id % 3 + 1 AS result, {_either('R', 'R')} AS r_r, {_either('Q', 'Q')} AS q_q,
 {_either('B', 'B')} AND ({_n('B', ' AND (f + r) % 2 = 1')} > 0) <> ({_n('b', ' AND (f + r) % 2 = 1')} > 0) AS ocb FROM ids i)"""
ORACLE["a12_with_feature"] = f"WITH {_SETS}, {_FEAT} SELECT game_id FROM ft WHERE r_r"
_SIDES = ", ".join(f"count(*) FILTER (WHERE role = {_ROLES.index(c)} AND {'' if b else 'NOT '}black) AS {c}{b}" for b in (0, 1) for c in "pnbrq") + ", " + ", ".join(f"coalesce(bool_or((f + r) % 2 = 1) FILTER (WHERE role = 2 AND {'' if b else 'NOT '}black), false) AS light{b}" for b in (0, 1))


def _feature(a: str, b: str, condition: str) -> str:
    """SQL: either side has the pieces a, the other b, and the condition holds."""

    def way(x: int, y: int) -> str:
        c = [f"{k}{x} = {a.count(k.upper())}" for k in "qrbn"]
        c += [f"q{y} = 0", f"r{y} = 0", f"b{y} + n{y} BETWEEN 1 AND 3"] if b == "*" else [f"{k}{y} = {b.count(k.upper())}" for k in "qrbn"]
        c.append({"": "true", "same": "light0 = light1", "opposite": "light0 <> light1", "b_minors between 1 and 3": "true"}.get(condition, condition.replace("a_pawns", f"p{x}").replace("b_pawns", f"p{y}")))
        return " AND ".join(c)

    return f"(({way(0, 1)}) OR ({way(1, 0)}))"


_ALL = f"""sd AS (SELECT game_id, {_SIDES} FROM pc GROUP BY 1), hits AS ({' UNION ALL '.join(f"SELECT game_id, CAST({bit} AS BIGINT) AS bit, '{cat}' AS category, {[c for c, _ in endgames.CATALOG].index(cat)} AS position FROM sd WHERE {_feature(a, b, c)}" for bit, cat, _, _, a, b, c in endgames.FEATURES)})"""
ORACLE["a10_endgame_features"] = f"WITH {_SETS}, {_ALL} SELECT game_id, bit_or(CAST(1 AS BIGINT) << bit) AS features FROM hits GROUP BY 1"
ORACLE["a11_popularity"] = f"""WITH {_SETS}, {_ALL} SELECT c.id, count(hits.bit) AS games, count(hits.bit) FILTER (WHERE hits.game_id % 3 = 0) AS white_wins, count(hits.bit) FILTER (WHERE hits.game_id % 3 = 2) AS draws, count(hits.bit) FILTER (WHERE hits.game_id % 3 = 1) AS black_wins,
 round(count(hits.bit) * 100.0 / (SELECT count(*) FROM ids), 6) AS percentage FROM (VALUES {', '.join(f"('{i}', {bit})" for bit, _, i, *_ in endgames.FEATURES)}) c(id, bit) LEFT JOIN hits ON hits.bit = c.bit GROUP BY 1"""
ORACLE["a11_categories"] = f"WITH {_SETS}, {_ALL} SELECT c.category, count(hits.bit) AS games, CAST(c.position AS INT) AS position FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {i})' for i, (c, _) in enumerate(endgames.CATALOG))}) c(category, position) LEFT JOIN hits ON hits.category = c.category GROUP BY 1, 3"
ORACLE["h16_headers_then_boards"] = f"WITH {G}, {_SETS} SELECT game_id FROM ids i WHERE {_n('P')} >= 1 AND game_id IN (SELECT game_id FROM g WHERE result = 1 AND starts_with(eco, '1'))"
