"""Sources mixed to target weights by Pfair scheduling.

A source of weight w = p / period owns p slots of every `period` slots. Its block j is released at slot floor(j / w) and
due by slot ceil((j + 1) / w); at every slot the released block with the earliest deadline goes out. As the weights sum to
one, every block meets its window, so after any slot t a source has sent fewer than one block more or less than t * w.
All windows close at the end of a period, so the schedule of one period, which the weights alone decide, is repeated: a
row's slot and position follow from its rank within its source by arithmetic.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MixParams:
    """weights: target share of each source, any scale. block: documents a slot. period: weights are multiples of 1 / period."""

    weights: Mapping[str, float]
    block: int = 8
    period: int = 1000
    seed: int = 3


def numerators(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period by largest remainders; every source of positive weight has one at least."""
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no source has a positive weight")
    if len(live) > period:
        raise ValueError(f"{len(live)} sources need a period of as many slots")
    total = sum(live.values())
    exact = {s: w / total * period for s, w in live.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := period - sum(out.values())) != 0:
        if left > 0:
            out[max(out, key=lambda s: (exact[s] - out[s], s))] += 1
        else:
            out[max((s for s in out if out[s] > 1), key=lambda s: (out[s] - exact[s], s))] -= 1
    return out


def schedule(p: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks, ties by the longer wait, then name."""
    period = sum(p.values())
    names = sorted(p)
    waiting = [(0, names.index(s), 0) for s in names]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // p[names[s]]), release, s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append(names[s])
        if j + 1 < p[names[s]]:
            heapq.heappush(waiting, ((j + 1) * period // p[names[s]], s, j + 1))
    return out


def _order_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _source_key(source: Column) -> Column:
    """A source's name as a key that null has too."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def ranked(docs: DataFrame, params: MixParams, id_col: str, source_col: str, names: list[str], listed: int) -> DataFrame:
    """(row, source, rank, tail): rank of each row in its source, in the order of a keyed hash of the id; tail: where the
    rows of a source that names lacks begin, behind the `listed` rows of the others, null first and then by name.

    The hash's first digits deal every source, however large, to many parts; parts are numbered apart and joined by
    their counts, one row a source and part, on the keys by which the rows are dealt already.
    """
    spark = docs.sparkSession
    parts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), _source_key(source).alias("skey"), F.col(f"`{id_col}`").alias("id"))
    rows = rows.withColumn("key", _order_key(F.col("id"), params.seed))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("skey", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("skey").orderBy("part")
    base = counts.select("skey", "part", (F.sum("n").over(own) - F.col("n")).alias("base"))
    # one row a source
    others = counts.where(~F.col("skey").isin([f"={x}" for x in names])).groupBy("skey").agg(F.sum("n").alias("n"))
    tails = others.select("skey", (F.sum("n").over(Window.orderBy("skey")) - F.col("n") + listed).alias("tail"))
    base = base.join(tails, "skey", "left")
    rank = F.row_number().over(Window.partitionBy("skey", "part").orderBy("key", "id")) - 1
    return rows.withColumn("rank", rank).join(base, ["skey", "part"]).select("row", "source", (F.col("rank") + F.col("base")).alias("rank"), "tail")


def mix(docs: DataFrame, params: MixParams, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row, slot, offset, position, in_mix) for every row of docs, row being a struct of its columns.

    slot is the block's slot, offset the place within the block, position the row's place in the whole mixed order, from
    0 without gaps. A source that runs out leaves its later slots empty, and nothing is dropped or repeated: in_mix tells
    the rows before the first such slot, up to which the shares hold to less than one block. Rows whose source is null or has
    no positive weight come last, by id, with null slot and offset. Ties in the hash go by id, repeated rows side by side.
    An empty table gives an empty result.
    """
    p = numerators(params.weights, params.period)
    names, plan = sorted(p), schedule(p)
    at = {s: [t for t, x in enumerate(plan) if x == s] for s in names}
    sent = []  # blocks of each source sent before each slot of a period
    have = dict.fromkeys(names, 0)
    for x in plan:
        sent.append([have[s] for s in names])
        have[x] += 1
    source = F.col(f"`{source_col}`").cast("string")
    count = {r[0]: r[1] for r in docs.where(source.isin(names)).groupBy(source.alias("s")).count().collect()}  # at most `period` rows
    size = [count.get(s, 0) for s in names]
    period, block = params.period, params.block

    def slot_of(s: str, j: int) -> int:
        return j // p[s] * period + at[s][j % p[s]]

    horizon = min(slot_of(s, n // block) for s, n in zip(names, size, strict=True))
    spark = docs.sparkSession
    # the plan's tables hold one number for each slot of a period and source: the weights alone bound them
    slots = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"s": s, "i": names.index(s), "p": p[s], "at": at[s]} for s in names])), "array<struct<s:string,i:int,p:bigint,at:array<bigint>>>")).alias("x")).select("x.*")
    before = F.from_json(F.lit(json.dumps(sent)), "array<array<bigint>>")
    ahead = spark.range(1).select(F.posexplode(before).alias("t", "sent"))
    rows = ranked(docs, params, id_col, source_col, names, sum(size))
    rows = rows.join(F.broadcast(slots), F.col("source") == F.col("s"), "left")
    rows = rows.withColumn("slot", F.expr(f"(rank div {block}) div p * {period} + element_at(at, cast((rank div {block}) % p as int) + 1)")).withColumn("offset", F.when(F.col("p").isNotNull(), F.col("rank") % block))
    rows = rows.drop("at").withColumn("t", (F.col("slot") % period).cast("int")).join(F.broadcast(ahead.withColumnRenamed("t", "t2")), F.col("t") == F.col("t2"), "left")
    sizes = "array(" + ",".join(f"{n}L" for n in size) + ")"
    shares = "array(" + ",".join(f"{p[s]}L" for s in names) + ")"
    earlier = f"aggregate(sequence(0, {len(names) - 1}), 0L, (acc, k) -> acc + least({sizes}[k], ((slot div {period}) * {shares}[k] + sent[k]) * {block}))"
    position = F.when(F.col("slot").isNotNull(), F.expr(earlier) + F.col("offset")).otherwise(F.col("tail") + F.col("rank"))
    return rows.select("row", "slot", "offset", position.cast("long").alias("position"), F.coalesce(F.col("slot") < horizon, F.lit(False)).alias("in_mix"))


def mixed_order(docs: DataFrame, params: MixParams, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with all its rows and columns, sorted to the mixed order: read file by file, it is the interleaved corpus."""
    out = mix(docs, params, id_col, source_col)
    return out.orderBy("position").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def oracle(params: MixParams) -> str:
    """DuckDB SQL of (doc_id, source, slot, offset, position, in_mix) over the documents table."""
    p = numerators(params.weights, params.period)
    plan = schedule(p)
    seen: dict[str, int] = {}
    values = []
    for t, s in enumerate(plan):
        values.append(f"('{s}',{seen.get(s, 0)},{t},{p[s]})")
        seen[s] = seen.get(s, 0) + 1
    b, q = params.block, params.period
    return f"""
WITH plan(s, j, t, p) AS (VALUES {",".join(values)}),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{params.seed}:' || doc_id), doc_id) - 1 AS r FROM documents),
placed AS (
  SELECT d.doc_id, d.source, r, CAST((r // {b}) // s.p * {q} + plan.t AS BIGINT) AS slot, CASE WHEN plan.t IS NOT NULL THEN r % {b} END AS off
  FROM ranked d LEFT JOIN (SELECT DISTINCT s, p FROM plan) s ON s.s = d.source LEFT JOIN plan ON plan.s = d.source AND plan.j = (r // {b}) % s.p),
horizon AS (
  SELECT min((n // {b}) // p * {q} + t) AS h FROM (
    SELECT x.s, x.p, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT s, p FROM plan) x LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) c ON c.source = x.s) y
  JOIN plan USING (s, p) WHERE plan.j = (n // {b}) % p)
SELECT doc_id, source, slot, CAST(off AS BIGINT) AS "offset",
  CAST(row_number() OVER (ORDER BY slot NULLS LAST, off, source NULLS FIRST, r) - 1 AS BIGINT) AS position, coalesce(slot < h, false) AS in_mix
FROM placed, horizon"""
