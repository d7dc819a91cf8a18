import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plyforge.llm.mixing import MixParams, mix, mixed_order, numerators, schedule
from plyforge.llm.ogg import BLOCK, RATE, OggError, Writer, demux, encode_media, media_round_trip, mux, padded, page_checksum, read_streams
from plyforge.llm.sharding import balance, best_fit_decreasing, pack_runs, shard_documents


def test_checksum_is_the_plain_one():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        return c

    for data in (b"", b"OggS", bytes(range(256))):
        assert page_checksum(data) == slow(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=70_000), max_size=6))
def test_packets_survive_any_size(packets):
    w = Writer(9)
    media = b"".join([*w.pages([b"head"], [0], False, True), *w.pages(packets, list(range(1, len(packets) + 1)), True)])
    (s,) = read_streams(media)
    assert s.packets == [b"head", *packets] and s.ended


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 85 * 2, 576 * 171 + 5, 300_000])
def test_payload_and_times(n):
    payload = padded(bytes(i * 7 % 251 for i in range(n)))
    media = mux(payload)
    got, streams = demux(media)
    assert got == payload and len(payload) % BLOCK == 0 and payload
    assert streams[0].times() == pytest.approx([i * BLOCK / RATE for i in range(len(streams[0].packets) - 1)])


def test_damage_is_found():
    media = bytearray(mux(padded(b"x" * 5000)))
    for at in (5, 30, 100, len(media) - 1):
        bad = media.copy()
        bad[at] ^= 1
        with pytest.raises(OggError):
            demux(bytes(bad))
    for cut in (10, 27, len(media) - 3):
        with pytest.raises(OggError):
            demux(bytes(media[:cut]))
    first = 27 + media[26] + sum(media[27 : 27 + media[26]])
    with pytest.raises(OggError):
        demux(bytes(media[first:]))  # a page is missing


def test_media_rows(spark, documents, odd, empty):
    for df in (documents, odd):
        rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
        got = media_round_trip(df).collect()
        want = sorted((str(i), len(b), hashlib.sha256(padded(b)).hexdigest(), zlib.crc32(padded(b)[-32:])) for i, b in rows)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
        assert len({r["feature"] for r in got}) <= len({r["payload_sha256"] for r in got})
    stored = encode_media(odd).collect()
    assert all(demux(bytes(r["media"])) for r in stored)
    assert media_round_trip(empty).count() == 0
    assert struct.calcsize("<4sBBqIIIB") == 27


def test_best_fit_decreasing():
    assert best_fit_decreasing([5, 4, 3, 3, 3, 2], 10) is not None
    sizes = np.random.default_rng(1).integers(1, 100, 400).tolist()
    where = best_fit_decreasing(sizes, 150)
    loads = np.bincount(where, sizes)
    assert loads.max() <= 150 and len(loads) <= 1.25 * sum(sizes) / 150
    # the tightest bin that has room, against a plain scan
    free, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(free)
            free.append(150)
        free[b] -= sizes[i]
        want[i] = b
    assert where == want
    assert best_fit_decreasing([9, 9], 10, 1) is None and best_fit_decreasing([], 5) == [] and best_fit_decreasing([50], 10) == [0]


def one_by_one(sizes, bins):
    """Loads of the bins when every group is packed on its own, with the least capacity that fits."""
    low = high = max(-(-sum(sizes) // bins), max(sizes))
    while best_fit_decreasing(sizes, high, bins) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if best_fit_decreasing(sizes, mid, bins) is None else (low, mid)
    return np.bincount(best_fit_decreasing(sizes, high, bins), sizes, bins).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_sizes_are_packed_as_group_by_group(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, [5, 30, 400, 3000, 9, 100000][seed], int(rng.integers(1, 900))).tolist(), reverse=True)
    runs = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
    for capacity in (max(sizes), 2 * max(sizes), sum(sizes) // 5 + 9):
        for bins in (3, 7, 10**6):
            where, got = best_fit_decreasing(sizes, capacity, bins), pack_runs(runs, capacity, bins)
            if where is None:
                assert got is None
            else:
                assert [(s, b) for s, k, b in got for _ in range(k)] == list(zip(sizes, where, strict=True))
    loads = np.zeros(7, int)
    for s, k, b in balance(runs, 7):
        loads[b] += s * k
    assert loads.sum() == sum(sizes) and loads.max() - max(sum(sizes) / 7, max(sizes)) <= max(sizes)


@pytest.mark.parametrize("shards", [1, 16])
def test_shards(spark, documents, shards):
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    got = shard_documents(documents, shards).collect()
    assert len(got) == len(rows)
    place = {}
    for r in got:
        raw = rows[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert place.setdefault(raw, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    loads = np.bincount([r["shard"] for r in got], [r["size"] for r in got], shards)
    groups: dict = {}
    for raw in rows.values():
        groups[raw] = groups.get(raw, 0) + len(raw) + 1
    assert loads.tolist() == one_by_one(list(groups.values()), shards) and loads.max() <= 1.02 * loads.mean()


def test_shards_of_odd_rows(odd, empty):
    got = shard_documents(odd, 4).collect()
    assert len(got) == odd.count() and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert shard_documents(empty, 4).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=3), st.floats(0.001, 10), min_size=1, max_size=12), st.integers(12, 300))
def test_schedule_stays_within_a_block(weights, period):
    p = numerators(weights, period)
    assert sum(p.values()) == period and min(p.values()) >= 1
    sent = dict.fromkeys(p, 0)
    for t, s in enumerate(schedule(p), 1):
        sent[s] += 1
        for x in p:
            assert abs(sent[x] * period - t * p[x]) < period


def simulate(rows, params):
    """The mix one slot at a time."""
    p = numerators(params.weights, params.period)
    queue = {}
    for i, s in rows:
        queue.setdefault(s, []).append(i)
    for s in queue:
        queue[s].sort(key=lambda i: (hashlib.md5(f"{params.seed}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0))
    out, at, t, plan = [], dict.fromkeys(p, 0), 0, schedule(p)
    total = sum(len(queue.get(s, [])) for s in p)
    while len(out) < total:
        s = plan[t % params.period]
        block = queue.get(s, [])[at[s] : at[s] + params.block]
        at[s] += params.block
        out += block
        t += 1
    for s in sorted((s for s in queue if s not in p), key=lambda s: (s is not None, s or "")):
        out += queue[s]
    return out


@pytest.mark.parametrize("block, period", [(1, 20), (3, 7)])
def test_mix_equals_simulation(documents, block, period):
    params = MixParams({"src0": 5, "src1": 1, "src2": 1, "src3": 0.5, "none": 1}, block, period)
    rows = [(r["doc_id"], r["source"]) for r in documents.collect()]
    got = mix(documents, params).select("row.doc_id", "slot", "position", "in_mix").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    assert [r["doc_id"] for r in got] == simulate(rows, params)


def test_mix_of_odd_rows(odd, empty):
    params = MixParams({"src0": 2, "src1": 1}, 2, 6)
    out = mixed_order(odd, params)
    assert out.columns == odd.columns and sorted(map(json.dumps, map(list, out.collect()))) == sorted(map(json.dumps, map(list, odd.collect())))
    got = mix(odd, params).select("position", "slot", "row.source").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(odd.count())) and all((r["slot"] is None) == (r["source"] not in ("src0", "src1")) for r in got)
    assert mix(empty, params).count() == 0
    with pytest.raises(ValueError):
        numerators({"a": 0.0}, 10)
