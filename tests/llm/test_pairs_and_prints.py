import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plyforge.llm import minhash, queries, simhash
from plyforge.llm.components import connected_components
from plyforge.llm.minhash import NearDupParams, near_duplicates, shingle_sets
from plyforge.llm.simhash import BITS, edited_pairs, fingerprint, fingerprints, within_radius


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    index, edges = defaultdict(list), []
    for i in sorted(sets):
        met = Counter(j for g in sets[i] for j in index[g])
        edges += [(i, j) for j, n in met.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
        for g in sets[i]:
            index[g].append(i)
    return sets, components(sets, edges)


@pytest.mark.parametrize("k, percent, limit", [(3, 85, 128), (5, 80, 2)])
def test_equals_brute_force(documents, k, percent, limit):
    """node_limit 2 sends nearly every node through the branching and the block comparison."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    sets, want = brute(rows, k, percent)
    got = near_duplicates(documents, NearDupParams(k, percent, node_limit=limit, max_depth=3, block=8)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_family_of_mutual_copies(spark):
    """Distinct near copies in a chain of edits, more than a node holds, and one stranger."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        words = base.copy()
        words[d * 3] = f"edit{d}"
        rows.append((d, " ".join(words)))
    rows.append((60, " ".join(f"z{i}" for i in range(200))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, NearDupParams(3, 85, node_limit=10)).collect()}
    assert got == brute(rows, 3, 85)[1] and len(set(got.values())) == 2


@pytest.mark.parametrize("in_block", [1 << 19, 500])
def test_links_are_counted_whole(spark, in_block):
    """All pairs of a family, also where it is dealt to blocks; copies don't add any."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(40):
        words = [f"w{i}" for i in range(120)]
        for e in range(d % 8):
            words[int(rng.integers(120))] = f"edit{d}x{e}"
        rows.append((d, " ".join(words)))
    rows += [(100, rows[3][1]), (101, "a text of its own, far from all others")]
    sets = {i: frozenset(shingles(t, 3)) for i, t in rows}
    want = {i: sum(100 * len(s & o) >= 85 * len(s | o) for o in set(sets.values()) - {s}) for i, s in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in near_duplicates(df, NearDupParams(3, 85, block_shingles=in_block)).collect()}
    assert got == want and max(want.values()) > 8


@pytest.mark.parametrize("n", range(1, 6))
def test_texts_of_few_words(n):
    text = " ".join("abcde"[:n])
    sets, offs = shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), NearDupParams().words)
    assert len(sets) == 1 and offs.tolist() == [0, 1]


def test_odd_rows(odd, empty):
    got = near_duplicates(odd, NearDupParams(3, 85)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert [by[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 3]
    assert by[11]["component_id"] == 5 and by[7]["component_id"] == 6 and by[9]["component_id"] == 8
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert near_duplicates(empty).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 80)]
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {i: r for i, r in want.items() if i in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_shingle_sets_count_whole_text():
    text = ("a b c " * 5 + "\x0bd\x1ce").encode()
    sets, off = minhash.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    assert len(sets) == off[-1] == len(shingles(text.decode(), 3))


def test_edited_pairs_equal_their_definition(spark, documents):
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    got = {r["doc_id"]: r for r in edited_pairs(documents).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = (fingerprints([x])[0] for x in (t, edited, nxt))
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.tobytes().hex(), b.tobytes().hex())
        for name, other in (("near_edited", b), ("near_next", c)):
            differ = int(np.unpackbits(a ^ other).sum())
            assert abs(r[name] - max(0.0, np.cos(np.pi * differ / BITS))) < 1e-9
    edited, following = (np.mean([r[c] for r in got.values()]) for c in ("near_edited", "near_next"))
    assert edited > 0.6 and following < 0.2


def test_edited_pairs_of_odd_rows(spark, odd, empty):
    got = edited_pairs(odd).collect()
    assert len(got) == odd.count() and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 32}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 11)}) == 1
    assert edited_pairs(empty).count() == 0
    one = edited_pairs(odd.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0


def test_within_radius_finds_all(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (30, 16), dtype=np.uint8)
    prints = []
    for b in base:
        for flips in (0, 1, 2, 3, 4, 5):
            bits = np.unpackbits(b)
            bits[rng.choice(BITS, flips, False)] ^= 1
            prints.append(np.packbits(bits).tobytes().hex())
    df = spark.createDataFrame([(p,) for p in prints] + [(None,)], "fingerprint string")
    for radius in (0, 3):
        got = {(r["query"], r["fingerprint"]): r["distance"] for r in within_radius(df, df, radius).collect()}
        raw = {p: np.unpackbits(np.frombuffer(bytes.fromhex(p), np.uint8)) for p in set(prints)}
        want = {(a, b): int((raw[a] ^ raw[b]).sum()) for a in raw for b in raw if (raw[a] ^ raw[b]).sum() <= radius}
        assert got == want


def test_fingerprint_rows(odd):
    assert fingerprint(odd).count() == odd.count()


def test_op6_counts_prints_in_the_radius(spark, sf_dir, documents):
    got = queries.op6_simhash(spark, sf_dir).collect()
    assert len(got) == documents.count()
    raw = {p: np.unpackbits(np.frombuffer(bytes.fromhex(p), np.uint8)) for p in {r["fingerprint"] for r in got}}
    for r in got:
        if r["doc_id"] % 50:
            assert r["near_prints"] is None
        else:
            assert r["near_prints"] == sum(0 < int((raw[r["fingerprint"]] ^ x).sum()) <= 3 for x in raw.values())


def test_edited_pairs_over_many_ranges(spark, documents, monkeypatch):
    whole = {r["doc_id"]: r for r in edited_pairs(documents).collect()}
    monkeypatch.setattr(simhash, "RANGE_BYTES", 5000)
    assert {r["doc_id"]: r for r in edited_pairs(documents).collect()} == whole


def test_texts_that_polynomials_confuse_are_not_linked(spark):
    """A Thue-Morse word and its inverse had one hash modulo 2^64, whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"one {a} two {a}"), (2, f"one {b} two {b}"), (3, f"ONE {a} two {a}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(df, NearDupParams(words=3, percent=85)).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 1]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint(df).collect()}
    assert prints[1] == prints[3] != prints[2]


def test_forest_of_many_sets_spans_the_likely_pairs():
    rng = np.random.default_rng(4)
    est = rng.random((90, 90))
    est = np.maximum(est, est.T)
    ok = est > 0.97
    np.fill_diagonal(ok, False)
    got = minhash._grown_forest(90, lambda v: (est[v], ok[v]))
    i, j = np.triu_indices(90, 1)
    want = minhash._forest(90, est[i, j], (i, j), ok[i, j])
    assert len(got) == len(want) and abs(sum(est[a, b] for a, b in got) - est[i[want], j[want]].sum()) < 1e-9
    assert components(range(90), got) == components(range(90), list(zip(i[want].tolist(), j[want].tolist(), strict=True)))


def test_many_near_copies_of_one_page(spark):
    """A family too large for one node, all of whose texts differ: one component, every link counted."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(700)], "doc_id long, text string")
    p = NearDupParams(words=3, percent=85, node_limit=8, max_depth=2, block=100)
    got = near_duplicates(docs, p).collect()
    assert {(r["component_id"], r["n_links"]) for r in got} == {(0, 699)} and len(got) == 700


def test_op9_equals_its_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = c.sql(queries.ORACLE["op9_near_duplicates"])
    got = queries.op9_near_duplicates(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
