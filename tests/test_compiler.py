import random

import pytest

from plyforge.lang.parser import parse
from plyforge.plans import on_events, sequences
from plyforge.plans.compiler import CompileError, search
from plyforge.plans.on_games import tables

OPERA, IMMORTAL, FOOL, LEGALL, SCHOLAR = range(5)


@pytest.fixture(scope="module")
def data(spark):
    g, p = tables(spark)
    g, p = g.persist(), p.persist()
    yield g, p
    g.unpersist()
    p.unpersist()


GOLDEN = [
    ("R on d8", OPERA, [33]), ("white_queens == 0", OPERA, [32, 33]), ("legal mate count >= 1", OPERA, [32]), ("legal mate piece R count >= 1", OPERA, [32]), ("legal mate piece N count >= 1", OPERA, None),
    ("mate and parent { not check }", FOOL, [4]), ("child { mate }", FOOL, [3]), ("child { child { mate } }", FOOL, [2]),
    ("ply == 33 and check", OPERA, [33]), ("ply <= 2", OPERA, [0, 1, 2]), ("ply 1..3", OPERA, [1, 2, 3]), ("movenumber == 1", OPERA, [0, 1, 2]), ("movenumber == 17 and check", OPERA, [33]), ("move from B to r", OPERA, [29]),
    ("parent { wtm } and child { mate }", FOOL, [3]), ("ply == 1 and parent { wtm }", FOOL, [1]), ("terminal { mate }", SCHOLAR, [7]), ("initial { wtm }", OPERA, [0]), ("terminal { ply == 4 }", FOOL, [4]), ("terminal { ply == 10 }", OPERA, None),
    ("path [Qb8+ ... Rd8#]", OPERA, [31, 33]), ("path [e4 e5]", OPERA, [1, 2]), ("path [e4 d6]", OPERA, None), ("path [e4 --{1} Nf3]", OPERA, [1, 3]), ("path white [Qxf3, ..., Qb3]", OPERA, [9, 13]), ("Bc4 nf6 and path [Qb3]", OPERA, [12]),
    ("cqlpath { Qb8+ Nxb8 Rd8# }", OPERA, [31, 32, 33]), ("line --> check --> move previous capture --> mate", OPERA, [31, 32, 33]), ("mate and line lastposition <-- check*", OPERA, [33]),
    ("check and move mate", OPERA, None), ("move mate and check", OPERA, [33]), ("move castle", OPERA, [23]), ("move castle and R on d1", OPERA, [23]), ('white "Morphy" and mate', OPERA, [33]), ('not white "Morphy"', OPERA, None), ('not white "Morphy"', FOOL, [0]),
    ("occurrences 4..4 { check }", OPERA, [21, 29, 31, 33]), ("occurrences >= 5 { check }", OPERA, None), ("nag $4", FOOL, [3]), ('comment contains "SHORTEST"', FOOL, [4]), ("what_if(pass) { play { mate } } and ply == 5", SCHOLAR, [5]), ("play from q { mate }", FOOL, [3]),
    ("what_if([e4 e5 Qh5]) { attacks(Q, f7) } and ply == 0", OPERA, [0]), ("what_if(remove f6) { play { mate } } and ply == 6", SCHOLAR, [6]), ("legal == 0", OPERA, [33]), ("[Aa] == [KkPp]", OPERA, None), ("opposite_bishops", OPERA, None),
    ('date == "1858.11" and ply == 0', OPERA, [0]), ('date == "1900" and mate', FOOL, [4]), ("flipcolor { mate and R on d8 }", OPERA, [33]), ("move en_passant", OPERA, None),
    ("piece $x in [NB] { $x on b5 and attacks($x, k) }", OPERA, [21]), ("pin(bishop, knight, king)", OPERA, [22, 23, 24]), ('fen "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"', OPERA, [0]),
]


@pytest.mark.parametrize("text, game, plies", GOLDEN)
def test_golden(data, text, game, plies):
    found = {r["game_id"]: list(r["matching_plies"]) for r in search(parse(text), data[1], data[0]).collect()}
    assert found.get(game) == plies


def test_mate_two_plies_after_white_to_move(data):
    found = {r["game_id"] for r in search(parse("mate and parent { parent { wtm } }"), data[1], data[0]).collect()}
    assert found == {FOOL}  # the other games end with White's mate


def test_header_only_query_reads_no_plies(data):
    plan = search(parse('white "Morphy"'), data[1], data[0])._jdf.queryExecution().toString()
    assert "matching" in plan and "epd" not in plan.split("== Physical Plan ==")[1].split("InMemoryRelation")[0]


def test_unbound_variable(data):
    with pytest.raises(CompileError):
        search(parse("$x on d5"), data[1], data[0])


def test_empty_query_matches_all(data):
    assert search(parse(""), data[1], data[0]).count() == 5


def by_ways(pattern, rows):
    """Starts and hits of a bounded pattern from its list of ways."""
    kind, _, color, *_ = pattern
    found = sequences.ways(pattern)
    starts, hits = [], set()
    for p in range(len(rows)):
        if color in ("white", "black") and (rows[p] >> sequences.WHITE_BIT & 1) != (color == "white"):
            continue
        hit = next((h for need, h in found if all(0 <= p + o < len(rows) and rows[p + o] >> b & 1 for b, o in need)), None)
        if hit is not None:
            if kind == "line" or not starts:
                hits |= {p + o for o in hit}
            starts.append(p)
    return starts, sorted(hits)


@pytest.mark.parametrize("kind", ["path", "cqlpath", "line"])
def test_bounded_sequences_equal_the_matcher(kind):
    rng, native = random.Random(kind), 0
    for _ in range(3000):
        steps = []
        for _ in range(rng.randint(1, 4)):
            what = rng.choice(["filter"] if kind == "line" else ["move", "move", "gap"] + ["filter"] * (kind == "cqlpath"))
            lo = rng.randint(0, 2)
            steps.append((what, rng.randrange(3), *((1, 1) if what == "filter" else (lo, lo + rng.randint(0, 2)))))
        color = rng.choice([None, None, "single", "white", "black"])
        pattern = (kind, tuple(steps), color, kind == "line" and rng.random() < 0.4, None, None, ())
        if sequences.ways(pattern) is None:
            continue
        native += 1
        rows = [rng.randrange(8) | (i % 2 == 0) << sequences.WHITE_BIT for i in range(rng.randint(1, 14))]
        rows[-1] &= ~7 if kind != "line" and not any(s[0] == "filter" for s in steps) else -1  # no move departs from the last row
        if any(s[0] == "filter" for s in steps) and any(s[0] == "move" for s in steps):
            continue  # in the compiled query a move's bit is clear in the last row, a filter's may be set
        assert by_ways(pattern, rows) == sequences.match(pattern, rows), pattern
    assert native > 300


@pytest.mark.parametrize("name", ["e1_path", "e2_gap", "e3_repetition", "e4_one_side", "e5_filtered_path", "e6_line", "e6_line_back"])
def test_bounded_sequences_need_no_python(spark, sf_dir, name):
    plan = on_events.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan
