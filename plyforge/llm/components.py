"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.textio import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links(a, b): label is the smallest id of its component.

    Per step, the minimum of each id's neighbours is combined before the shuffle and joined back, so a hub with very
    many neighbours is never gathered in one task. Rows with nulls and loops are left out; repeated links count once.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        nxt = materialize(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "cc")
        after = _state(nxt)
        discard(edges)
        edges = nxt
        if after == before:
            break
        before = after
    # converged: every edge leads to the root of a star
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots), "cc-labels")
