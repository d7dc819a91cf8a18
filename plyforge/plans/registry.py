"""Named queries over the driver's tables and their SQL.

The engine's operators run here on other timelines than games: users' events as timelines, orders as game headers, order
lines as boards. The SQL beside each query says the same by other means: square by square instead of by bit boards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plyforge.plans import on_attacks, on_events, on_games, on_orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in (on_events, on_orders, on_attacks, on_games):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
