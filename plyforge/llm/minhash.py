"""Near-duplicate documents: a chosen-path set similarity join over word shingles.

Every document becomes the set of its 64-bit word-shingle hashes and `FUNCS` minwise values of it. A tree is a
recursive branching: a node's documents go to the child named by the minwise token at one or two coordinates that the
node's own key selects (1 / threshold children in the mean). Nodes that hold one set end there, nodes of up to
`node_limit` sets are compared exhaustively, larger ones branch on; `trees` independent trees bring the recall of a
pair at the threshold to 1 - (1 - threshold^depth)^trees, over 0.9999 at the usual depth 1 or 2. Nodes that stay large
after `max_depth` levels hold sets that agree on all tokens of their path: they are compared block by block.

Comparing a node yields a spanning forest of its likely pairs, not all pairs; after these links are confirmed on the
full sets and contracted to components, a second pass yields every likely pair that still crosses components. So no
link that could join two components is lost, while a family of n mutual copies costs n links instead of n^2/2. The
links of a set are counted last, over all pairs of its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.components import connected_components
from plyforge.llm.pieces import mix, span_hashes
from plyforge.llm.textio import CHUNK_BYTES, chunks, discard, materialize, pick, small_batches, string_buffers

FUNCS = 96
_U = np.uint64
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(1, 2**63, FUNCS, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, FUNCS, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


@dataclass(frozen=True)
class NearDupParams:
    """words: shingle length; percent: 100 * Jaccard threshold; trees, node_limit, max_depth: see the module.

    block, block_shingles: sets or shingles of a block where large nodes or components are compared block by block.
    """

    words: int = 5
    percent: int = 80
    trees: int = 12
    node_limit: int = 128
    max_depth: int = 8
    block: int = 1024
    block_shingles: int = 1 << 19

    @property
    def floor(self) -> float:
        """Share of equal minwise bytes under which a pair can be passed over: 5 standard errors below the threshold."""
        p = self.percent / 100
        return p - 5 * (p * (1 - p) / FUNCS) ** 0.5


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and the words' offsets by text.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    """
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets.

    A text of fewer than k words is one shingle, a text without words none.
    """
    docs = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    word, woff = word_hashes(data, offs)
    count = np.diff(woff)
    w = len(word)
    rolled = np.zeros(w, np.uint64)
    for i in range(k):
        rolled[: max(0, w - i)] += word[i:] * _U(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64))
    rolled = mix(rolled)
    out: list[np.ndarray] = []
    for d in range(docs):
        n = count[d]
        if n >= k:
            s = rolled[woff[d] : woff[d + 1] - k + 1]
            s.sort()
            if n > k:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif n:
            whole = word[woff[d] : woff[d + 1]] * np.array([pow(0x9FB21C651E98DF25, i + 1, 1 << 64) for i in range(n)], np.uint64)
            s = mix(np.array([whole.sum(dtype=np.uint64) + _U(n)], np.uint64))
        else:
            s = rolled[:0]
        out.append(s)
    soff = np.zeros(docs + 1, np.int64)
    np.cumsum([len(s) for s in out], out=soff[1:])
    return np.concatenate(out) if out else rolled[:0], soff


def minwise(sets: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """FUNCS minwise values of each set that isn't empty, uint32."""
    full = np.flatnonzero(np.diff(soff))
    out = np.empty((len(full), FUNCS), np.uint32)
    if len(full):
        at, buf = soff[full], np.empty_like(sets)
        for f in range(FUNCS):
            np.bitwise_xor(sets, _XOR[f], out=buf)
            np.multiply(buf, _MUL[f], out=buf)
            out[:, f] = np.minimum.reduceat((buf >> _U(32)).astype(np.uint32), at)
    return out


_FEATURES = "id long, n long, set_key binary, node array<long>, sig binary"


def set_features(docs: DataFrame, p: NearDupParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, set_key, node, sig): set size, 128-bit key of the set, first-level node of each tree, minwise bytes."""
    k, trees = p.words, p.trees
    salt = np.arange(1, trees + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1)):
                sets, soff = shingle_sets(data, offs, k)
                size = np.diff(soff)
                full = np.flatnonzero(size)
                mh = minwise(sets, soff)
                node = mix((mh[:, :trees].astype(np.uint64) << _U(8)) + salt).view(np.int64)
                sig = np.ascontiguousarray((mh & 0xFF).astype(np.uint8))
                keys = [hashlib.blake2b(sets[soff[d] : soff[d + 1]].tobytes(), digest_size=16).digest() for d in range(j - i)]
                noff = np.zeros(j - i + 1, np.int32)
                noff[1:] = np.cumsum(np.where(size > 0, trees, 0))
                sigs = np.full(j - i, None, object)
                for row, d in enumerate(full):
                    sigs[d] = sig[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(noff, pa.int32()), pa.array(node.ravel(), pa.int64())),
                        pa.array(sigs, pa.binary()),
                    ],
                    names=["id", "n", "set_key", "node", "sig"],
                )

    return pick(docs, id_col, text_col).mapInArrow(run, _FEATURES)


def _live(rows: DataFrame) -> DataFrame:
    """Rows of nodes that at least two sets reach, with the node's size: sizes are combined before their shuffle."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "node")


def _children(rows: DataFrame, level: int, p: NearDupParams) -> DataFrame:
    """Branch: the node key selects one coordinate, and with chance 1 / threshold - 1 a second one, for all its sets."""
    chance = 100 / p.percent - 1
    draw = F.xxhash64("node", F.lit(level))
    first = F.pmod(draw, F.lit(FUNCS)).cast("int")
    second = F.pmod(F.xxhash64(draw), F.lit(FUNCS)).cast("int")
    also = F.pmod(F.xxhash64(draw, F.lit(1)), F.lit(1_000_000)) < int(chance * 1_000_000)

    def child(c):
        return F.xxhash64("node", c, F.substring(F.col("sig"), c + 1, F.lit(1)))

    picked = F.when(also & (first != second), F.array(child(first), child(second))).otherwise(F.array(child(first)))
    return rows.select(F.explode(picked).alias("node"), "id", "n", "sig")


def _forest(m: int, est: np.ndarray, ij: tuple[np.ndarray, np.ndarray], ok: np.ndarray) -> list[int]:
    """Positions of the pairs of a spanning forest, likeliest first."""
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    where = np.flatnonzero(ok)
    for e in where[np.argsort(-est[where], kind="stable")]:
        a, b = root(int(ij[0][e])), root(int(ij[1][e]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(int(e))
            if len(out) == m - 1:
                break
    return out


def _grown_forest(m: int, likely: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The same for many sets, one set's row of pairs at a time (Prim): likely(v) gives all estimates of v and which count."""
    best, link, todo, out = np.full(m, -1.0), np.full(m, -1), np.ones(m, bool), []
    for _ in range(m):
        v = int(np.where(todo, best, -2.0).argmax())
        todo[v] = False
        if link[v] >= 0:
            out.append((min(v, int(link[v])), max(v, int(link[v]))))
        est, ok = likely(v)
        nearer = ok & todo & (est > best)
        best[nearer], link[nearer] = est[nearer], v
    return out


def _compare(rows: DataFrame, p: NearDupParams, forest: bool) -> DataFrame:
    """Pairs of ids within each node that are likely to reach the threshold; rows: node, id, n, sig[, label].

    With forest, a spanning forest of them, likeliest first; else all whose labels differ. A node of m sets is compared
    row by row or in strips, so that a task holds some thousand pairs at a time beside the node.
    """
    floor, percent = p.floor, p.percent

    def node_pairs(ids, n, sig, label, a, b):
        est = (sig[a] == sig[b]).mean(axis=1)
        na, nb = n[a], n[b]
        ok = (est >= floor) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (ids[a] != ids[b])
        if label is not None:
            ok &= label[a] != label[b]
        return est, ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            node, ids, n = (t.column(c).to_numpy() for c in ("node", "id", "n"))
            label = None if forest else t.column("label").to_numpy()
            flat = t.column("sig").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            sig = np.frombuffer(flat.buffers()[2], np.uint8)[flat.offset * FUNCS : (flat.offset + len(flat)) * FUNCS].reshape(-1, FUNCS)
            at = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            size = np.diff(at)
            left, right = [], []
            two = at[:-1][size == 2]
            for s in range(0, len(two), 4096):
                a = two[s : s + 4096]
                _, ok = node_pairs(ids, n, sig, label, a, a + 1)
                left.append(a[ok])
                right.append(a[ok] + 1)
            for s, m in zip(at[:-1][size > 2], size[size > 2], strict=True):
                if label is not None and (label[s : s + m] == label[s]).all():
                    continue
                if forest and m > 64:
                    own = slice(s, s + m)
                    found = _grown_forest(m, lambda v, own=own: node_pairs(ids[own], n[own], sig[own], None, slice(v, v + 1), slice(None)))
                    left.append(np.array([a for a, _ in found], np.int64) + s)
                    right.append(np.array([b for _, b in found], np.int64) + s)
                    continue
                strip = m if forest else max(1, 65536 // m)
                for lo in range(0, m - 1, strip):
                    first = np.arange(lo, min(lo + strip, m - 1))
                    i = np.repeat(first, m - 1 - first)
                    j = np.concatenate([np.arange(k + 1, m) for k in first.tolist()])
                    est, ok = node_pairs(ids, n, sig, label, i + s, j + s)
                    e = np.array(_forest(m, est, (i, j), ok), np.int64) if forest else np.flatnonzero(ok)
                    left.append(i[e] + s)
                    right.append(j[e] + s)
            i = np.concatenate(left) if left else np.zeros(0, np.int64)
            j = np.concatenate(right) if right else np.zeros(0, np.int64)
            a, b = ids[i], ids[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            node = held.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if cut:
                yield work(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    cols = ["node", "id", "n", "sig"] + ([] if forest else ["label"])
    return rows.select(*cols).repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long").distinct()


def _blocks(rows: DataFrame, p: NearDupParams, forest: bool) -> DataFrame:
    """Sub-nodes of nodes of any size: the sets are dealt to blocks, and each pair of blocks is a node of its own.

    The number of blocks follows from the node's size, so a sub-node holds about 2 * block sets.
    """
    count = F.ceil(F.col("size") / p.block)
    mine = F.pmod(F.xxhash64("id"), count)
    other = F.sequence(F.lit(0).cast("long"), count - 1)
    keyed = rows.withColumn("mine", mine).withColumn("other", F.explode(other))
    keyed = keyed.withColumn("node", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")))
    return keyed.select("node", "id", "n", "sig", *([] if forest else ["label"]))


def _verify(pairs: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    k, percent = p.words, p.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[np.ndarray] = []
            (da, oa), (db, ob) = (string_buffers(batch.column(c)) for c in (2, 3))
            s = 0
            while s < batch.num_rows:  # runs of pairs by the bytes of both sides
                size = oa[s + 1 :] - oa[s] + ob[s + 1 :] - ob[s]
                e = s + max(1, int(np.searchsorted(size[:64], CHUNK_BYTES, side="right")))
                sa, fa = shingle_sets(da[oa[s] : oa[e]], oa[s : e + 1] - oa[s], k)
                sb, fb = shingle_sets(db[ob[s] : ob[e]], ob[s : e + 1] - ob[s], k)
                for d in range(e - s):
                    x, y = sa[fa[d] : fa[d + 1]], sb[fb[d] : fb[d + 1]]
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if common and 100 * common >= percent * (len(both) - common):
                        keep.append(s + d)
                s = e
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _overlaps(sets: np.ndarray, soff: np.ndarray, ids: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set, how many others reach the threshold with it; with side, only pairs across it count.

    The sets come in ascending size, so those that can reach it with a set follow it up to a size. The set's hashes are
    marked and the marks summed over these sets, which gives the intersections exactly.
    """
    size = np.diff(soff)
    _, code = np.unique(sets, return_inverse=True)
    mark = np.zeros(len(sets), np.int32)
    out = np.zeros(len(size), np.int64)
    last = np.searchsorted(100 * size, size * 10_000 // percent, side="right")
    for i in range(len(size) - 1):
        e = int(last[i])
        if e <= i + 1:
            continue
        own = code[soff[i] : soff[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[code[soff[i + 1] : soff[e]]], soff[i + 1 : e] - soff[i + 1])
        mark[own] = 0
        hit = (100 * common >= percent * (size[i] + size[i + 1 : e] - common)) & (ids[i + 1 : e] != ids[i])
        if side is not None:
            hit &= side[i + 1 : e] != side[i]
        out[i] += np.count_nonzero(hit)
        out[i + 1 : e] += hit
    return out


def _degrees(sets: DataFrame, labels: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(set_key, links): the confirmed links of every set of a component with links.

    A component's sets are dealt to blocks of about `block_shingles` shingles, and each pair of blocks is compared whole:
    no pair is written, only counts leave a task.
    """
    k, percent = p.words, p.percent
    rows = sets.select("set_key", "id", "n").join(labels, "id")
    sizes = rows.groupBy("label").agg(F.ceil(F.sum("n") / p.block_shingles).alias("blocks"))
    rows = rows.join(sizes, "label").withColumn("mine", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select(F.xxhash64("label", lo, hi).alias("node"), "id", "set_key", F.when(lo == hi, -1).otherwise((F.col("mine") == lo).cast("int")).alias("side"))
    rows = rows.join(texts.select("id", "text").hint("merge"), "id").select("node", "id", "set_key", "side", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, {}

        def work() -> pa.RecordBatch:
            found = sorted(held.items(), key=lambda x: len(x[1][0]))
            soff = np.zeros(len(found) + 1, np.int64)
            np.cumsum([len(s) for _, (s, _, _) in found], out=soff[1:])
            side = np.array([x for _, (_, _, x) in found])
            n = _overlaps(np.concatenate([s for _, (s, _, _) in found]), soff, np.array([i for _, (_, i, _) in found]), None if side[0] < 0 else side, percent)
            return pa.RecordBatch.from_arrays([pa.array([key for key, _ in found], pa.binary()), pa.array(n, pa.int64())], names=["set_key", "links"])

        for batch in batches:
            nodes, ids, keys, sides = (batch.column(c).to_pylist() for c in range(4))
            for i, j, data, offs in chunks(batch.column(4)):
                hashes, soff = shingle_sets(data, offs, k)
                for d in range(j - i):
                    if nodes[i + d] != node:
                        if len(held) > 1:
                            yield work()
                        node, held = nodes[i + d], {}
                    s = hashes[soff[d] : soff[d + 1]]
                    # texts of one id are told apart by their sets
                    if keys[i + d] not in held and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == keys[i + d]:
                        held[keys[i + d]] = (s.copy(), ids[i + d], sides[i + d])
        if len(held) > 1:
            yield work()

    counts = rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "set_key binary, links long")
    return counts.groupBy("set_key").agg(F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, params: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept and, with count_links, n_links.

    A link joins two documents with 100 * intersection >= percent * union of their shingle sets, confirmed on the full
    sets. n_links counts all links of the document's own set to the sets of other ids in its component; copies count as
    one set.

    Cases: null or empty text, or text without words: n_shingles 0, own component, kept. Null id: the row comes back
    with a null component, not kept. Repeated rows come back as often as they came, in one component; rows that share an
    id but not the text are classed by their own text. Ties: the smallest id is the component. Other columns of docs are
    not read. An empty table gives an empty result.
    """
    p = params or NearDupParams()
    small_batches(docs.sparkSession)
    feat = materialize(set_features(docs, p, id_col, text_col), "nd-feat")
    sets = materialize(
        feat.where("n > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("node").alias("nodes"), F.first("sig").alias("sig")), "nd-sets"
    )
    first = sets.select(F.explode("nodes").alias("node"), "id")
    level = materialize(_live(first).join(sets.select("id", "n", "sig"), "id").select("node", "id", "n", "sig", "size"), "nd-level")
    levels, rest = [level], None
    for depth in range(2, p.max_depth + 1):
        big = level.where(F.col("size") > p.node_limit)
        if big.isEmpty():
            break
        level = materialize(_live(_children(big, depth, p)).select("node", "id", "n", "sig", "size"), "nd-level")
        levels.append(level)
    else:
        rest = level.where(F.col("size") > p.node_limit)
        rest = None if rest.isEmpty() else rest
    small = levels[0].where(F.col("size") <= p.node_limit)
    for x in levels[1:]:
        small = small.unionByName(x.where(F.col("size") <= p.node_limit))
    likely = _compare(small, p, True)
    if rest is not None:
        likely = likely.unionByName(_compare(_blocks(rest, p, True), p, True)).distinct()
    tried = materialize(likely, "nd-pairs")
    need = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(need.hint("merge"), "id")
    texts = materialize(texts.dropDuplicates(["id", "text"]), "nd-texts")
    links = materialize(_verify(tried, texts, p), "nd-links")
    labels = connected_components(links)
    named = F.coalesce("label", "id").alias("label")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").select("node", "id", "n", "sig", "size", named)

    cross = _compare(_mixed(labelled(small)), p, False)
    if rest is not None:
        cross = cross.unionByName(_compare(_blocks(_mixed(labelled(rest)), p, False), p, False)).distinct()
    more = materialize(cross.join(tried, ["a", "b"], "left_anti"), "nd-pairs")
    if not more.isEmpty():
        links = materialize(links.unionByName(_verify(more, texts, p)), "nd-links")
        labels = connected_components(links)
    degree = materialize(_degrees(sets, labels, texts, p), "nd-degree") if count_links else None
    for x in (*levels, tried, more, texts):
        discard(x)
    of_set = sets.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("label", "id").alias("root"))
    named = feat.select("id", "n", "set_key").join(of_set, "set_key", "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(False)).alias("kept")]
    if degree is not None:
        named = named.join(degree, "set_key", "left")
        out.append(F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return named.select(*out)


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the nodes that hold more than one component; the others can't give a new link."""
    several = rows.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("node")
    return rows.join(several, "node", "left_semi")


def oracle(params: NearDupParams) -> str:
    """DuckDB SQL of near_duplicates over the documents table: shingles as texts, pairs by shared shingles, components by reach."""
    k, upper = params.words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shingle = " || ' ' || ".join(f"ws[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct([{shingle} FOR i IN range(1, len(ws) - {k} + 2)])) END AS sh FROM w),
sets AS (SELECT sh, min(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT id, n, unnest(sh) AS t FROM sets),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {params.percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, root) AS (SELECT id, id FROM sets UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
d AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, coalesce(c.root, s.doc_id) = s.doc_id AS kept, coalesce(d.links, 0) AS n_links
FROM s LEFT JOIN sets ON sets.sh = s.sh LEFT JOIN c ON c.id = sets.id LEFT JOIN d ON d.id = sets.id"""
