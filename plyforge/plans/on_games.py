"""Operators that need the rules of chess, on well-known games.

SQL can't play, so the SQL beside each query gets the games as rows of boards, moves in both notations and the moves that
were legal, and finds the answers in these texts: square by square, and from the letters and marks of the notation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.lang.parser import parse
from plyforge.lang.validate import validate
from plyforge.operators import export, positions, trees
from plyforge.plans.compiler import search
from plyforge.plans.on_attacks import _clear, _hits
from plyforge.plans.on_orders import _pieces
from plyforge.rules.board import Position
from plyforge.rules.pgn import replay, split_headers
from plyforge.sources.pgn import games_of, plies_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: (white, black, date, eco, result, ratings, moves): moves are public record.
RECORDS = [
    ("Morphy, Paul", "Duke Karl / Count Isouard", "1858.11.02", "C41", "1-0", (2700, 2300), "1. e4 e5 2. Nf3 d6 3. d4 Bg4 4. dxe5 Bxf3 5. Qxf3 dxe5 6. Bc4 Nf6 7. Qb3 Qe7 8. Nc3 c6 9. Bg5 b5 10. Nxb5 cxb5 11. Bxb5+ Nbd7 12. O-O-O Rd8 13. Rxd7 Rxd7 14. Rd1 Qe6 15. Bxd7+ Nxd7 16. Qb8+ Nxb8 17. Rd8#"),
    ("Anderssen, Adolf", "Kieseritzky, Lionel", "1851.06.21", "C33", "1-0", (2600, 2480), "1. e4 e5 2. f4 exf4 3. Bc4 Qh4+ 4. Kf1 b5 5. Bxb5 Nf6 6. Nf3 Qh6 7. d3 Nh5 8. Nh4 Qg5 9. Nf5 c6 10. g4 Nf6 11. Rg1 cxb5 12. h4 Qg6 13. h5 Qg5 14. Qf3 Ng8 15. Bxf4 Qf6 16. Nc3 Bc5 17. Nd5 Qxb2 18. Bd6 Bxg1 19. e5 Qxa1+ 20. Ke2 Na6 21. Nxg7+ Kd8 22. Qf6+ Nxf6 23. Be7#"),
    ("Player, First", "Player, Second", "1900.??.??", "A00", "0-1", (None, None), "1. f3 e5 2. g4 $4 Qh4# {the shortest mate}"),
    ("Legall", "Saint Brie", "1750.??.??", "C41", "1-0", (None, None), "1. e4 e5 2. Nf3 d6 3. Bc4 Bg4 (3... Nf6 4. Ng5) 4. Nc3 g6? 5. Nxe5! Bxd1 6. Bxf7+ Ke7 7. Nd5#"),
    ("Scholar", "Pupil", "1950.01.??", "C20", "1-0", (1500, 900), "1. e4 e5 2. Qh5 Nc6 3. Bc4 Nf6?? 4. Qxf7#"),
]


#: Besides, a game with a capture in passing and promotions.
MORE = [("White", "Black", "2001.02.03", "B02", "1/2-1/2", (1800, 1750), "1. e4 Nh6 2. e5 f5 3. exf6 Nc6 4. fxg7 Nf7 5. gxh8=N Nxh8")]


def texts(spark: SparkSession, records: list[tuple] = RECORDS) -> DataFrame:
    rows = []
    for i, (w, b, d, eco, res, (we, be), moves) in enumerate(records):
        elo = "".join(f'[{t} "{v}"]\n' for t, v in (("WhiteElo", we), ("BlackElo", be)) if v)
        rows.append((i, f'[Event "Record"]\n[Site "?"]\n[Date "{d}"]\n[Round "1"]\n[White "{w}"]\n[Black "{b}"]\n[Result "{res}"]\n[ECO "{eco}"]\n{elo}\n{moves} {res}\n'))
    return spark.createDataFrame(rows, "game_id long, text string")


def tables(spark: SparkSession, records: list[tuple] = RECORDS) -> tuple[DataFrame, DataFrame]:
    t = texts(spark, records)
    return games_of(t), plies_of(t)


@cache
def _rows() -> str:
    """VALUES of every position: game, ply, 64 squares from a8 to h1, side to move, rights, the move that led to it in both
    notations, and the legal moves, of ply 8 at most also those of the other side."""
    out = []
    for g, (*_, result, _, moves) in enumerate(RECORDS + MORE):
        got = replay(*split_headers(f'[White "x"]\n\n{moves} {result}\n'))
        for ply, p in enumerate(got.positions):
            board = "".join("." * int(c) if c.isdigit() else c for c in p.fen().split()[0] if c != "/")
            side, rights = p.fen().split()[1:3]
            mv = (got.moves[ply - 1].move["san"], got.moves[ply - 1].move["uci"]) if ply else ("", "")
            other = " ".join(_sans(p.null())) if ply <= 8 and not p.in_check() else ""
            out.append(f"({g}, {ply}, '{board}', '{side}', '{rights}', '{mv[0]}', '{mv[1]}', '{' '.join(_sans(p))}', '{other}')")
    return ", ".join(out)


def _sans(p: Position) -> list[str]:
    return [p.san(m) for m in p.legal()]


_FILE, _RANK = "(ascii(substr(uci, {0}, 1)) - 97)", "CAST(substr(uci, {1}, 1) AS INT)"


def _ctes() -> str:
    at = "(8 - {r}) * 8 + {f} + 1".format(r=_RANK.format(0, 4), f=_FILE.format(3))
    return f"""pl(g, ply, brd, side, rights, san, uci, legal, other) AS (VALUES {_rows()}),
mv AS (SELECT g, ply, side = 'b' AS white, san, uci, regexp_replace(san, '[+#]', '') AS bare, {_FILE.format(1)} AS f1, {_RANK.format(0, 2)} AS r1, {_FILE.format(3)} AS f2, {_RANK.format(0, 4)} AS r2, substr(was, {at}, 1) AS taken
 FROM (SELECT *, lag(brd) OVER (PARTITION BY g ORDER BY ply) AS was FROM pl) WHERE ply > 0),
pc AS (SELECT g * 1000 + ply AS game_id, strpos('pnbrqk', lower(c)) - 1 AS role, c = lower(c) AS black, (7 - i // 8) * 8 + i % 8 AS s, i % 8 AS f, 7 - i // 8 AS r FROM (SELECT g, ply, i, substr(brd, CAST(i AS INT) + 1, 1) AS c FROM pl, range(64) t(i)) WHERE c <> '.')"""


def _answers(sql: str) -> str:
    """The games and plies of the rows (g, ply) of sql."""
    return f"WITH {_ctes()} SELECT CAST(g AS BIGINT) AS game_id, string_agg(CAST(ply AS VARCHAR), ',' ORDER BY ply) AS plies, CAST(count(*) AS INT) AS match_count FROM (SELECT DISTINCT g, ply FROM ({sql})) GROUP BY g"


def _moves(where: str) -> str:
    return f"SELECT g, ply FROM mv WHERE {where}"


def _boards(where: str) -> str:
    """Rows of a condition on pc's case a.game_id."""
    return f"SELECT a.game_id // 1000 AS g, a.game_id % 1000 AS ply FROM pc a WHERE {where}"


def _pair(a: str, b: str, more: str = "true") -> str:
    one, two = _pieces(a).replace("role", "a.role").replace("black", "a.black"), _pieces(b).replace("role", "b.role").replace("black", "b.black")
    return f"SELECT a.s, a.game_id // 1000 AS g, a.game_id % 1000 AS ply FROM pc a JOIN pc b ON a.game_id = b.game_id AND a.s <> b.s WHERE ({one}) AND ({two}) AND {_hits('a', 'b.f', 'b.r')} AND {more}"


def _search(name: str, dsl: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        g, p = tables(spark, RECORDS + MORE)
        return search(validate(parse(dsl)), p, g).select("game_id", F.array_join(F.col("matching_plies").cast("array<string>"), ",").alias("plies"), "match_count")

    QUERIES[name] = run


_SAFE = "EXISTS (SELECT 1 FROM range(64) t(i) WHERE {hits} AND NOT EXISTS (SELECT 1 FROM pc o WHERE o.game_id = a.game_id AND o.s = t.i AND o.black = a.black) AND NOT EXISTS (SELECT 1 FROM pc w WHERE w.game_id = a.game_id AND w.role = 0 AND w.black <> a.black AND abs(w.f - t.i % 8) = 1 AND t.i // 8 - w.r = CASE WHEN w.black THEN -1 ELSE 1 END))"
_PIN = f"""SELECT a.game_id // 1000 AS g, a.game_id % 1000 AS ply FROM pc a JOIN pc x ON x.game_id = a.game_id AND x.s <> a.s JOIN pc y ON y.game_id = a.game_id AND y.s <> a.s AND y.s <> x.s
WHERE a.role = 2 AND x.role = 1 AND y.role = 5 AND a.black <> x.black AND x.black = y.black AND {_hits('a', 'x.f', 'x.r')}
 AND (x.f - a.f) * (y.r - a.r) = (x.r - a.r) * (y.f - a.f) AND (x.f - a.f) * (y.f - x.f) + (x.r - a.r) * (y.r - x.r) > 0 AND {_clear('x', 'y.f', 'y.r')}"""
_NEXT = "SELECT *, lead(san) OVER w AS s1, lead(san, 2) OVER w AS s2, lead(san, 3) OVER w AS s3 FROM pl WINDOW w AS (PARTITION BY g ORDER BY ply)"


def _after(n: int) -> str:
    return ", ".join(f"ply + {i}" for i in range(1, n + 1))


#: name: query, and the SQL of its rows (g, ply)
for _name, (_dsl, _sql) in {
    "p1_fen": ('fen "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"', lambda: f"SELECT g, ply FROM pl WHERE brd = 'rnbqkbnrpppppppp{'.' * 20}P{'.' * 11}PPPP.PPPRNBQKBNR' AND side = 'b' AND rights = 'KQkq'"),
    "p2_wildcard_fen": ('fen "*/*/*/*/*P?/*/*/* b" and ply <= 3', lambda: "SELECT g, ply FROM pl WHERE substr(brd, 39, 1) = 'P' AND side = 'b' AND ply <= 3"),
    "p6_castling": ("castling(white, kingside) and ply == 20", lambda: "SELECT g, ply FROM pl WHERE contains(rights, 'K') AND ply = 20"),
    "p7_states": ("mate", lambda: "SELECT g, ply FROM pl WHERE san LIKE '%#'"),
    "p7_check": ("check and not mate", lambda: "SELECT g, ply FROM pl WHERE san LIKE '%+'"),
    "p9_is_attacked": ("is_attacked f7 by white and ply <= 6", lambda: _boards(f"NOT a.black AND {_hits('a', '5', '6')} AND a.game_id % 1000 <= 6")),
    "q4_attacks": ("attacks(Q, k) >= 1", lambda: _pair("Q", "k")),
    "q5_attackers": ("attackers(white, f7) >= 2", lambda: f"SELECT g, ply FROM ({_boards('NOT a.black AND ' + _hits('a', '5', '6'))}) GROUP BY 1, 2 HAVING count(*) >= 2"),
    "t1_pin": ("pin(bishop, knight, king)", lambda: _PIN),
    "t2_fork": ("fork(B, k, q)", lambda: f"SELECT g, ply FROM (SELECT s, g, ply FROM ({_pair('B', 'k')}) INTERSECT SELECT s, g, ply FROM ({_pair('B', 'q')}))"),
    "t4_trapped": ("trapped [b]", lambda: _boards(f"a.role = 2 AND a.black AND NOT {_SAFE.format(hits=_hits('a', 't.i % 8', 't.i // 8'))}")),
    "t9_attacks_words": ("attacks N q", lambda: _pair("N", "q")),
    "t10_discovered": ("discovered_check white", lambda: _pair("QRB", "k")),
    "v1_san": ('move "Rd8#"', lambda: _moves("bare = 'Rd8'")),
    "v2_squares": ("move from e2 to e4", lambda: _moves("uci = 'e2e4'")),
    "v3_pieces": ("move from B to r", lambda: _moves("san LIKE 'B%' AND white AND taken = 'r'")),
    "v4_role_and_color": ("move piece [Nn] black", lambda: _moves("san LIKE 'N%' AND NOT white")),
    "v5_capture": ("move capture [q, r]", lambda: _moves("taken IN ('q', 'r')")),
    "v5_any_capture": ("move capture", lambda: _moves("contains(san, 'x')")),
    "v6_promotion": ("move promote N", lambda: _moves("contains(san, '=N')")),
    "v7_check_mate": ("move check mate", lambda: _moves("san LIKE '%#'")),
    "v8_castle": ("move castle", lambda: _moves("san LIKE 'O-O%'")),
    "v8_en_passant": ("move en_passant", lambda: _moves("regexp_matches(san, '^[a-h]x') AND taken = '.'")),
    "v9_direction": ("move piece Q diagonal", lambda: _moves("san LIKE 'Q%' AND white AND abs(f1 - f2) = abs(r1 - r2)")),
    "v10_previous": ("check and move previous from B", lambda: _moves("regexp_matches(san, '^B.*[+#]$') AND white")),
    "v11_legal": ("legal mate count >= 1", lambda: "SELECT g, ply FROM pl WHERE contains(legal, '#')"),
    "v11_legal_count": ("legal count >= 40", lambda: "SELECT g, ply FROM pl WHERE len(string_split(legal, ' ')) >= 40"),
    "e1_chess_path": ("path [Qb8+ ... Rd8#]", lambda: "SELECT a.g, unnest([a.ply, b.ply]) AS ply FROM pl a JOIN pl b ON a.g = b.g AND b.ply > a.ply AND b.san = 'Rd8#' WHERE a.san = 'Qb8+'"),
    "e5_chess_cqlpath": ("cqlpath { Qb8 check Nxb8 Rd8 mate }", lambda: f"SELECT g, unnest([{_after(3)}]) AS ply FROM ({_NEXT}) WHERE s1 = 'Qb8+' AND s2 = 'Nxb8' AND s3 = 'Rd8#'"),
    "e6_chess_line": ("line --> check --> move previous capture --> mate", lambda: f"SELECT g, unnest([{_after(3)}]) AS ply FROM ({_NEXT}) WHERE regexp_matches(s1, '[+#]$') AND contains(s2, 'x') AND s3 LIKE '%#'"),
    "b2_header_and_position": ('white "Morphy" and mate', lambda: "SELECT g, ply FROM pl WHERE san LIKE '%#' AND g = 0"),
    "b3_move_and_position": ("move capture and check", lambda: _moves("contains(san, 'x') AND regexp_matches(san, '[+#]$')")),
    "b16_play": ("play { mate } and ply <= 8", lambda: "SELECT g, ply FROM pl WHERE contains(legal, '#') AND ply <= 8"),
    "b17_what_if": ("what_if(pass) { play { mate } } and ply <= 8", lambda: "SELECT g, ply FROM pl WHERE contains(other, '#') AND ply <= 8"),
    "b18_symmetric": ("flipcolor { mate and attacks(Q, k) }", lambda: f"SELECT x.g, x.ply FROM ({_pair('Q', 'k')} UNION ALL {_pair('q', 'K')}) x JOIN pl ON pl.g = x.g AND pl.ply = x.ply WHERE san LIKE '%#'"),
    "b20_nag": ("nag $4", lambda: "SELECT g, ply FROM pl WHERE (g = 2 AND san = 'g4') OR (g = 4 AND san = 'Nf6')"),
    "b20_chess_comment": ('comment contains "shortest"', lambda: "SELECT g, ply FROM pl WHERE g = 2 AND san = 'Qh4#'"),
}.items():
    _search(_name, _dsl)
    ORACLE[_name] = _answers(_sql())


def _headers() -> str:
    out = []
    for i, (w, b, d, eco, res, (we, _), moves) in enumerate(RECORDS + MORE):
        y, m, dd = ("NULL" if "?" in x else str(int(x)) for x in d.split("."))
        white, black = (x.replace("'", "''") for x in (w, b))
        n = len([x for x in re.sub(r"\([^)]*\)|\{[^}]*\}", "", moves).split() if x[0].isalpha()])
        out.append(f"({i}, '{white}', '{black}', {y}, {m}, {dd}, {('1-0', '0-1', '1/2-1/2').index(res) + 1}, '{eco}', {we or 'NULL'}, {n})")
    return f"SELECT * FROM (VALUES {', '.join(out)}) t(game_id, white, black, year, month, day, result, eco, white_elo, ply_count)"


QUERIES["s7_headers"] = lambda spark, sf: tables(spark, RECORDS + MORE)[0].select("game_id", "white", "black", "year", "month", "day", "result", "eco", "white_elo", "ply_count")
ORACLE["s7_headers"] = f"SELECT * REPLACE (CAST(game_id AS BIGINT) AS game_id) FROM ({_headers()})"
QUERIES["s8_replay"] = lambda spark, sf: tables(spark, RECORDS + MORE)[1].select("game_id", "ply", "board", F.col("wtm").alias("white"), F.col("legal_count").cast("long").alias("legal_count"), "is_check", F.col("mv.san").alias("san"), F.col("mv.uci").alias("uci"))
ORACLE["s8_replay"] = f"WITH {_ctes()} SELECT CAST(g AS BIGINT) AS game_id, ply, brd AS board, side = 'w' AS white, CASE WHEN legal = '' THEN 0 ELSE len(string_split(legal, ' ')) END AS legal_count, regexp_matches(san, '[+#]$') AS is_check, nullif(san, '') AS san, nullif(uci, '') AS uci FROM pl"
QUERIES["k2_export"] = lambda spark, sf: export.export_pgn(*tables(spark, RECORDS + MORE)).select("game_id", F.regexp_replace(F.element_at(F.split("value", "\n\n"), 2), "\\s+", " ").alias("movetext"))
ORACLE["k2_export"] = f"""WITH {_ctes()} SELECT CAST(g AS BIGINT) AS game_id, string_agg(CASE WHEN ply % 2 = 1 THEN ((ply + 1) // 2) || '. ' ELSE '' END || san, ' ' ORDER BY ply)
 || ' ' || CASE g WHEN 2 THEN '0-1' WHEN {len(RECORDS)} THEN '1/2-1/2' ELSE '1-0' END AS movetext FROM pl WHERE ply > 0 GROUP BY g"""
QUERIES["n1_chess_position"] = lambda spark, sf: positions.search_position(tables(spark, RECORDS + MORE)[1], "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2")
ORACLE["n1_chess_position"] = f"WITH {_ctes()} SELECT CAST(g AS BIGINT) AS game_id, min(ply) AS ply FROM pl WHERE brd = 'rnbqkbnrpppp.ppp{'.' * 12}p{'.' * 7}P{'.' * 11}PPPP.PPPRNBQKBNR' AND side = 'w' AND rights = 'KQkq' GROUP BY g"
QUERIES["n2_placement"] = lambda spark, sf: positions.search_position(tables(spark, RECORDS + MORE)[1], "8/8/8/8/2B1P3/8/8/8", mode="partial")
ORACLE["n2_placement"] = f"WITH {_ctes()} SELECT CAST(g AS BIGINT) AS game_id, min(ply) AS ply FROM pl WHERE substr(brd, 35, 1) = 'B' AND substr(brd, 37, 1) = 'P' GROUP BY g"


def tree(spark: SparkSession, sf: str) -> DataFrame:
    g, p = tables(spark, RECORDS + MORE)
    start = p.where("ply = 0").select("pos_key").limit(1)
    steps = trees.chess_steps(p, g).join(F.broadcast(start.withColumnRenamed("pos_key", "at")), F.lit(True))
    return trees.opening_tree(steps, F.col("pos_key") == F.col("at"), samples=0)


QUERIES["a1_chess_tree"] = tree
ORACLE["a1_chess_tree"] = f"""WITH {_ctes()}, h AS (SELECT game_id, white_elo, result, year, month, year * 16 + coalesce(month, 0) AS ym FROM ({_headers()})), b(game_id, black_elo) AS (VALUES {', '.join(f'({i}, {r[5][1] or "NULL"})' for i, r in enumerate(RECORDS + MORE))})
SELECT san, count(*) AS games, count(*) FILTER (WHERE result = 1) AS white_wins, count(*) FILTER (WHERE result = 3) AS draws, count(*) FILTER (WHERE result = 2) AS black_wins,
 CAST(sum(white_elo) FILTER (WHERE black_elo IS NOT NULL) AS BIGINT) // count(*) FILTER (WHERE white_elo IS NOT NULL AND black_elo IS NOT NULL) AS avg_white_elo, CAST(sum(black_elo) FILTER (WHERE white_elo IS NOT NULL) AS BIGINT) // count(*) FILTER (WHERE white_elo IS NOT NULL AND black_elo IS NOT NULL) AS avg_black_elo,
 min(ym) AS first_ym, max(ym) AS last_ym, round(count(*) FILTER (WHERE result = 1) * 100.0 / count(*), 2) AS white_pct, round(count(*) FILTER (WHERE result = 3) * 100.0 / count(*), 2) AS draw_pct, round(count(*) FILTER (WHERE result = 2) * 100.0 / count(*), 2) AS black_pct
FROM pl JOIN h ON h.game_id = pl.g JOIN b ON b.game_id = pl.g WHERE ply = 1 GROUP BY san"""
