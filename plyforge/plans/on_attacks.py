"""Attack-based terms on boards made of order lines, against SQL that looks for clear lines between pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import bitboards as B
from plyforge.lang import ast as A
from plyforge.lang.parser import parse
from plyforge.plans.compiler import hit_rows, set_sql
from plyforge.plans.on_orders import _SETS, _pieces, boards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def attacked_boards(spark: SparkSession, sf: str, column: str = "atk") -> DataFrame:
    """Boards with atk or lines. The column is generated, not projected: else the optimizer would copy its expression into
    the loops over squares that read it."""
    found = B.attack_maps() if column == "atk" else B.piece_lines()
    return boards(spark, sf).select("*", F.explode_outer(F.array(F.expr(found))).alias(column))


def _clear(a: str, tf: str, tr: str) -> str:
    """No piece stands strictly between piece a and the square (tf, tr) on their line."""
    return f"""NOT EXISTS (SELECT 1 FROM pc z WHERE z.game_id = {a}.game_id AND (z.f - {a}.f) * ({tr} - {a}.r) = (z.r - {a}.r) * ({tf} - {a}.f)
 AND (z.f - {a}.f) * ({tf} - {a}.f) + (z.r - {a}.r) * ({tr} - {a}.r) > 0 AND greatest(abs(z.f - {a}.f), abs(z.r - {a}.r)) < greatest(abs({tf} - {a}.f), abs({tr} - {a}.r)))"""


def _hits(a: str, tf: str, tr: str) -> str:
    """Piece a attacks the square."""
    df, dr = f"abs({tf} - {a}.f)", f"abs({tr} - {a}.r)"
    slides = f"(({a}.role IN (2, 4) AND {df} = {dr}) OR ({a}.role IN (3, 4) AND ({df} = 0 OR {dr} = 0))) AND {df} + {dr} > 0"
    return f"""(({a}.role = 0 AND {df} = 1 AND {tr} - {a}.r = CASE WHEN {a}.black THEN -1 ELSE 1 END) OR ({a}.role = 1 AND {df} * {dr} = 2) OR ({a}.role = 5 AND greatest({df}, {dr}) = 1) OR ({slides} AND {_clear(a, tf, tr)}))"""


_HT = f"{_SETS}, ht AS (SELECT a.game_id, a.s AS src, a.role AS ar, a.black AS ab, b.s AS dst, b.role AS br, b.black AS bb FROM pc a JOIN pc b ON a.game_id = b.game_id AND a.s <> b.s WHERE {_hits('a', 'b.f', 'b.r')})"


def _ab(a: str, b: str) -> str:
    one = _pieces(a).replace("role", "ar").replace("black", "ab")
    two = _pieces(b).replace("role", "br").replace("black", "bb")
    return f"({one}) AND ({two})"


def _board(name: str, dsl: str, sql: str) -> None:
    q = parse(dsl)
    column = "lines" if isinstance(q, A.Ray3) else "atk"
    QUERIES[name] = lambda spark, sf: hit_rows(q, attacked_boards(spark, sf, column)).select("game_id")
    ORACLE[name] = sql


def _count(name: str, dsl: str, sql: str) -> None:
    expr = f"bit_count({set_sql(parse(dsl).a, {})})"
    QUERIES[name] = lambda spark, sf: attacked_boards(spark, sf).select("game_id", F.expr(expr).cast("bigint").alias("n")).where("n > 0")
    ORACLE[name] = sql


_board("q4_board_attacks", "attacks([RBQ], [nbr]) >= 1", f"WITH {_HT} SELECT DISTINCT game_id FROM ht WHERE {_ab('RBQ', 'nbr')}")
_count("q4_attacked_count", "attacks([NBRQ], a)", f"WITH {_HT} SELECT game_id, count(DISTINCT dst) AS n FROM ht WHERE {_ab('NBRQ', 'pnbrqk')} GROUP BY 1")
_count("q5_attackers_count", "attackers(A, [qrbn])", f"WITH {_HT} SELECT game_id, count(DISTINCT src) AS n FROM ht WHERE {_ab('PNBRQK', 'qrbn')} GROUP BY 1")
_board("p9_square_attacked", "is_attacked e4 by black", f"WITH {_SETS} SELECT DISTINCT a.game_id FROM pc a WHERE a.black AND {_hits('a', '4', '3')}")
_board("t9_words", "attacks N q", f"WITH {_HT} SELECT DISTINCT game_id FROM ht WHERE {_ab('N', 'q')}")
_board("t10_board_discovered", "discovered_attack white", f"WITH {_HT} SELECT DISTINCT game_id FROM ht WHERE {_ab('QRB', 'pnbrqk')}")
_board("t2_board_fork", "fork([PNBRQKpnbrqk])", f"WITH {_HT} SELECT DISTINCT game_id FROM (SELECT game_id, src FROM ht WHERE ab <> bb AND br <> 0 GROUP BY 1, 2 HAVING count(DISTINCT dst) >= 2)")
_board("t2_slots", "fork([NBRQ], [qr], [nb])", f"WITH {_HT} SELECT DISTINCT x.game_id FROM ht x JOIN ht y ON x.game_id = y.game_id AND x.src = y.src AND x.dst <> y.dst WHERE {_ab('NBRQ', 'qr').replace('ar', 'x.ar').replace('ab', 'x.ab').replace('br', 'x.br').replace('bb', 'x.bb')} AND (({_pieces('nb').replace('role', 'y.br').replace('black', 'y.bb')}))")
_VAL = "CASE {0}.role WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 100 END"
_LINE = f"""WITH {_SETS} SELECT DISTINCT a.game_id FROM pc a JOIN pc x ON x.game_id = a.game_id AND x.s <> a.s JOIN pc y ON y.game_id = a.game_id AND y.s <> a.s AND y.s <> x.s
WHERE a.role IN (2, 3, 4) AND a.black <> x.black AND x.black = y.black AND {_hits('a', 'x.f', 'x.r')}
 AND (x.f - a.f) * (y.r - a.r) = (x.r - a.r) * (y.f - a.f) AND (x.f - a.f) * (y.f - x.f) + (x.r - a.r) * (y.r - x.r) > 0 AND {_clear('x', 'y.f', 'y.r')}"""
_board("t1_board_pin", "pin([BRQbrq], [PNBRQKpnbrqk])", f"{_LINE} AND {_VAL.format('y')} > {_VAL.format('x')}")
_board("t3_board_skewer", "skewer([BRQbrq], [PNBRQKpnbrqk])", f"{_LINE} AND {_VAL.format('x')} >= {_VAL.format('y')}")
_board("b15_attack_variable", "piece $x in [NBRQ] { attacks($x, q) and attacks($x, [rnb]) }", f"WITH {_HT} SELECT DISTINCT x.game_id FROM ht x JOIN ht y ON x.game_id = y.game_id AND x.src = y.src WHERE NOT x.ab AND x.ar BETWEEN 1 AND 4 AND x.bb AND x.br = 4 AND y.bb AND y.br BETWEEN 1 AND 3")
