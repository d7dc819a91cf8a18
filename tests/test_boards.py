"""Boards and their attacks are made natively, in tasks whose share of rows doesn't grow with the input."""

import os
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plyforge.functions import bitboards as B
from plyforge.plans import on_attacks, on_orders
from plyforge.rules.board import Position

ATTACKS = sorted(on_attacks.QUERIES)
BOARDS = ["m3_signed_difference", "m4_power", "m5_power_versus", "m6_power_diff", "m7_material_search"]


@pytest.fixture(scope="module")
def fourfold(tmp_path_factory):
    """sf0.1's lines four times over, about 43 MB, by links."""
    d = tmp_path_factory.mktemp("fourfold")
    os.mkdir(d / "lineitem.parquet")
    for i in range(4):
        os.symlink("/root/testdata/sf0.1/lineitem.parquet", d / "lineitem.parquet" / f"{i}.parquet")
    return str(d)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ATTACKS)
def test_attacks_run_without_python(spark, sf_dir, name):
    assert "Python" not in plan(on_attacks.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ATTACKS + BOARDS)
def test_tasks_grow_with_the_input(spark, sf_dir, fourfold, name):
    """One shuffle, into a task for every 4 MB."""
    query = (on_attacks.QUERIES | on_orders.QUERIES)[name]
    n, mb = ([int(x) for x in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan(query(spark, sf)))] for sf in (sf_dir, fourfold))
    assert n == [spark.sparkContext.defaultParallelism]
    assert mb == [-(-4 * os.path.getsize("/root/testdata/sf0.1/lineitem.parquet") // (4 << 20))]


@pytest.mark.parametrize("name", ATTACKS + BOARDS)
def test_readers_hold_no_table(spark, sf_dir, name):
    """Lines are hashed as they are read: an aggregate under the shuffle would hold a table that grows with a reader's split."""
    query = (on_attacks.QUERIES | on_orders.QUERIES)[name]
    under = plan(query(spark, sf_dir)).rpartition("Exchange hashpartitioning")[2]
    assert "FileScan parquet" in under and "Aggregate" not in under


def test_attack_columns_equal_the_rules(spark):
    rnd = random.Random(5)
    boards = [[""] * 64, ["Q"] + [""] * 62 + ["q"], [""] * 63 + ["R"], ["k"] * 64, ["Q"] * 64, list("rnbqkbnrpppppppp") + [""] * 32 + list("PPPPPPPPRNBQKBNR")]
    boards += [[rnd.choice("PNBRQKpnbrqk") if rnd.random() < share else "" for _ in range(64)] for share in (0.03, 0.1, 0.3, 0.6, 0.95) for _ in range(60)]
    boards += [[c if s in (a, b) else "" for s in range(64)] for c in "QRBNKPp" for a, b in ((0, 63), (7, 56), (63, 62), (0, 8), (55, 63), (56, 63))]
    at = [Position(b) for b in boards]
    rows = spark.createDataFrame(pd.DataFrame([p.bitboards() | {"id": i} for i, p in enumerate(at)]))
    got = {r.id: r for r in rows.select("id", F.expr(B.attack_maps()).alias("atk"), F.expr(B.piece_lines()).alias("lines")).collect()}
    for i, p in enumerate(at):
        assert got[i].atk == p.attack_maps()
        assert sorted(tuple(x) for x in got[i].lines) == sorted(p.lines())


def test_boards_of_odd_lines(spark, tmp_path):
    """The line of the smallest code holds a square, whatever the numbers; lines without a number or part hold none."""
    rnd = random.Random(6)
    odd = [(rnd.randrange(40), rnd.choice([None, *range(70)]), rnd.choice([None, *range(-7, 20)]), rnd.choice(["R", "N", None])) for _ in range(1500)] + [(None, 3, 2, "R"), (99, None, None, None)]
    spark.createDataFrame(odd, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    want: dict = {}
    for key, part, number, flag in odd:
        game = want.setdefault(key, {})
        rem = None if number is None else abs(number) % 6 * (1 if number > 0 else -1)
        s = None if part is None else 8 + part % 48 if rem == 0 else part % 63
        if s is not None and rem is not None:
            game[s] = min(game.get(s, 99), rem * 2 + (flag == "R"))
    got = {r.game_id: r for r in on_orders.boards(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for key, game in want.items():
        sets = dict.fromkeys(("p", "n", "b", "r", "q", "k", "w", "bl"), 0)
        for s, code in game.items():
            role = int(code / 2)
            if role >= 0:
                sets["pnbrqk"[role]] |= 1 << s
            sets["bl" if code > 0 and code % 2 else "w"] |= 1 << s
        assert {c: got[key][c] for c in sets} == sets


def test_attacks_of_a_variable_read_one_square(spark, sf_dir):
    """One loop, over the squares that the variable takes."""
    found = on_attacks.QUERIES["b15_attack_variable"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in found
