"""Header predicates over the games table: names, ratings, partial dates, results, tags."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.lang import ast as A

_OP = {"=": "=", "!=": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
_ELO = {"white_elo": "{0}white_elo", "black_elo": "{0}black_elo", "avg_elo": "(({0}white_elo + {0}black_elo) div 2)", "elo_diff": "abs({0}white_elo - {0}black_elo)", "raw_elo_diff": "({0}white_elo - {0}black_elo)"}


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_sql(col: str, op: str, value: str) -> str:
    """Case-insensitive comparison of a text column; a missing text is empty. A bad regular expression is read as a glob."""
    c, v = f"lower(coalesce({col}, ''))", value.lower()
    if op == "regex":
        try:
            re.compile(value)
            rx = value
        except re.error:
            rx = "^" + "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in value) + "$"
        return f"(coalesce({col}, '') rlike {_quote('(?i)' + rx)})"
    if op in ("contains", "startswith", "endswith"):
        return f"{op}({c}, {_quote(v)})"
    return f"({c} {_OP[op]} {_quote(v)})"


def date_sql(op: str, value: str, prefix: str = "") -> str:
    """Partial dates: = compares the parts given; an order compares with the period's start or end, unknown parts by bound."""
    part = [int(x) for x in re.split(r"[.\-/]", value) if x.isdigit()]
    if not part:
        return text_sql(f"{prefix}date", op, value)
    y, m, d = f"{prefix}year", f"{prefix}month", f"{prefix}day"
    if op in ("=", "!="):
        same = " and ".join(f"{c} = {v}" for c, v in zip((y, m, d), part, strict=False))
        return f"({same})" if op == "=" else f"({y} is not null and not coalesce({same}, false))"
    first = part[0] * 10000 + (part[1] if len(part) > 1 else 1) * 100 + (part[2] if len(part) > 2 else 1)
    last = part[0] * 10000 + (part[1] if len(part) > 1 else 12) * 100 + (part[2] if len(part) > 2 else 31)
    early = f"({y} * 10000 + coalesce({m}, 1) * 100 + coalesce({d}, 1))"
    late = f"({y} * 10000 + coalesce({m}, 12) * 100 + coalesce({d}, 31))"
    return {">": f"({early} > {last})", ">=": f"({early} >= {first})", "<": f"({late} < {first})", "<=": f"({late} <= {last})"}[op]


def predicate_sql(name: str, op: str, value: str, prefix: str = "") -> str:
    """SQL of one header term; columns are reached by prefix."""
    if name == "player":
        return f"({text_sql(prefix + 'white', op, value)} or {text_sql(prefix + 'black', op, value)})"
    if name == "elo":
        return f"(coalesce({prefix}white_elo {_OP[op]} {int(value)}, false) or coalesce({prefix}black_elo {_OP[op]} {int(value)}, false))"
    if name in _ELO:
        return f"coalesce({_ELO[name].format(prefix)} {_OP[op]} {int(value)}, false)"
    if name == "result":
        if value.lower() == "all":
            return "true"
        code = {"1-0": 1, "0-1": 2, "1/2-1/2": 3, "*": 0}.get(value, -1)
        return f"(coalesce({prefix}result, 0) {'<>' if op == '!=' else '='} {code})"
    if name == "date":
        return f"coalesce({date_sql(op, value, prefix)}, false)"
    if name == "round":
        return text_sql(f"trim({prefix}round)", "=" if op == "contains" else op, value.strip())
    if name.startswith("tag:"):
        return text_sql(f"try_element_at({prefix}tags, {_quote(name[4:])})", op, value)
    return text_sql(prefix + name, op, value)


def node_sql(q: A.Node, prefix: str = "") -> str:
    if isinstance(q, A.Header):
        return f"coalesce({predicate_sql(q.name, q.op, q.value, prefix)}, false)"
    if isinstance(q, A.And | A.Or):
        return "(" + (" and " if isinstance(q, A.And) else " or ").join(node_sql(x, prefix) for x in q.items) + ")" if q.items else "true"
    if isinstance(q, A.Not):
        return f"(not {node_sql(q.a, prefix)})"
    raise TypeError(type(q).__name__)


def filter_games(games: DataFrame, q: A.Node) -> DataFrame:
    """Games whose headers meet a header-only query."""
    return games.where(F.expr(node_sql(q)))
