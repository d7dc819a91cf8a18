"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A text is the bag of character n-grams of its words; each n-gram bucket has a vector, the text is the vectors' mean, and
a linear softmax gives the two classes. Words that were never seen share n-gram vectors with those that were. As the
layers are linear, a trained model scores a text from one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.llm import ngrams
from plyforge.llm.textio import chunks, pick, small_batches

SIZES = (3, 4, 5, 6)
BITS = 18
#: Zero vectors that every bag holds besides, so that a few n-grams of a very short text don't decide alone.
PAD = 60
LEAST_TEXTS = 4


@dataclass
class ToxicModel:
    """vectors (buckets x dim), softmax (dim x 2), bias (2); logit = slope * (difference of the classes) + shift."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def bucket_scores(self) -> np.ndarray:
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)


def _bags(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buf, starts = ngrams.folded(data, offs, digits=True)
    all_grams = ngrams.grams(buf, SIZES, BITS, True)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        g = np.concatenate([x[a:b] for x in all_grams])
        yield np.unique(g[g >= 0], return_counts=True)


def fit(docs: DataFrame, labels: DataFrame, train: Column, positives: int = 1500, negatives: int = 3000, least: float = 6.0, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learn from at most about positives + negatives labelled rows where train (over id_col) holds, drawn by a hash of the id.

    A document with several labels counts as toxic if any of them says so. Where either class has no labelled document,
    all texts get the share of toxic labels as their score. The drawn ids (bounded by the two parameters)
    are broadcast, and n-gram counts are taken on the executors over whole texts.
    """
    small_batches(docs.sparkSession)
    known = pick(labels, id_col, label_col).where(train & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    count = {0: 0, 1: 0}
    for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect():
        count[r[0]] = r[1]
    p = (count[1] + 0.5) / (count[0] + count[1] + 1)
    alike = ToxicModel(np.zeros((1 << BITS, 1), np.float32), np.zeros((1, 2)), np.zeros(2), 1.0, float(np.log(p / (1 - p))))
    if not count[0] or not count[1]:
        return alike
    want = F.when(F.col("y") > 0, F.lit(min(1.0, positives / count[1]))).otherwise(F.lit(min(1.0, negatives / count[0])))
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < want * (1 << 30))
    rows = pick(docs, id_col, text_col).join(F.broadcast(drawn), id_col).select(text_col, (F.col("y") > 0).cast("int").alias("y"))
    used = informative(*_document_counts(rows), least)
    got = _bags_of(rows, used).collect()
    bags = [(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["share"], "<f4")) for r in got]
    y = np.array([r["y"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return alike
    return train_bags(bags, y, used, count[1] / (count[0] + count[1]), np.random.default_rng(seed))


def _document_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(texts of each class, texts of each class that hold each bucket): summed on the executors, a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, (1 << BITS) + 1), np.int64)  # the last column counts the texts
        for batch in batches:
            y = batch.column(1).to_numpy()
            for i, _, data, offs in chunks(batch.column(0)):
                for d, (at, _) in enumerate(_bags(data, offs)):
                    df[y[i + d], at] += 1
                    df[y[i + d], -1] += 1
        used = np.flatnonzero(df.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[0, used]), pa.array(df[1, used])], names=["bucket", "n0", "n1"])

    total = rows.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"n0 + n1 >= {LEAST_TEXTS} or bucket = {1 << BITS}")
    got = total.toPandas()
    df = np.zeros((2, (1 << BITS) + 1))
    df[:, got["bucket"].to_numpy(np.int64)] = got[["n0", "n1"]].to_numpy().T
    return df[:, -1], df[:, :-1]


def _bags_of(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """(y, at, share): place in `used` of each such bucket that a text holds, and its share of the text's n-grams."""
    local = np.full(1 << BITS, -1, np.int32)
    local[used] = np.arange(len(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(0)):
                at, share = [], []
                for a, n in _bags(data, offs):
                    place = local[a]
                    keep = place >= 0
                    at.append(place[keep].astype("<u4").tobytes())
                    share.append((n[keep] / (n.sum() + PAD)).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["y", "at", "share"])

    return rows.mapInArrow(run, "y int, at binary, share binary")


def informative(texts: np.ndarray, df: np.ndarray, least: float) -> np.ndarray:
    """Buckets held by shares of toxic and of other texts that differ by `least` standard errors, and by LEAST_TEXTS texts."""
    n = np.maximum(1, texts)[:, None]
    p = (df.sum(0) + 0.5) / (n.sum() + 1)
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero((np.abs(z) >= least) & (df.sum(0) >= LEAST_TEXTS))


def train_bags(lean: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, used: np.ndarray, prior: float, rng: np.random.Generator, dim: int = 8, epochs: int = 20, batch: int = 128) -> ToxicModel:
    """Adagrad over mini-batches of texts; every fifth text is held out to set slope and shift for the true share of toxic texts.

    lean: places in `used` and shares of the buckets that tell the classes apart. All other buckets keep the zero vector,
    so the many n-grams of a long text add no noise to its mean.
    """
    spread = 100.0  # a text's vector is a mean over thousands of n-grams: the scale of its inputs, kept in the model's vectors
    v = rng.normal(0, 0.01, (len(used), dim)).astype(np.float32)
    w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    sv = np.full(len(used), 1e-12, np.float32)
    hold = rng.random(len(y)) < 0.2
    if len(set(y[~hold])) < 2:
        hold[:] = False
    train = np.flatnonzero(~hold)
    weight = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * len(train)
    aw, ab = np.full_like(w, 1e-8), np.full_like(b, 1e-8)

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([lean[r][0] for r in rows])
        n = np.concatenate([lean[r][1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(lean[r][0]) for r in rows])
        mean = np.zeros((len(rows), dim), np.float32)
        for k in range(dim):
            mean[:, k] = np.bincount(owner, v[at, k] * n, len(rows))
        return at, n, owner, mean * spread

    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs)
        order = rng.permutation(train)
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            at, n, owner, mean = gather(rows)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            gw, gb, gm = mean.T @ p, p.sum(0), p @ w.T * spread
            touched, inverse = np.unique(at, return_inverse=True)
            g = np.empty((len(touched), dim), np.float32)
            for k in range(dim):
                g[:, k] = np.bincount(inverse, gm[owner, k] * n, len(touched))
            sv[touched] += (g * g).mean(1)
            v[touched] -= rate * 0.3 * g / np.sqrt(sv[touched])[:, None]
            aw += gw * gw
            ab += gb * gb
            w -= rate * 0.3 * gw / np.sqrt(aw)
            b -= rate * 0.3 * gb / np.sqrt(ab)
    vectors = np.zeros((1 << BITS, dim), np.float32)
    vectors[used] = v * spread
    model = ToxicModel(vectors, w, b)
    rows = np.flatnonzero(hold) if hold.any() else train
    z = gather(rows)[3] @ w + b
    model.slope, model.shift = calibrate(z[:, 1] - z[:, 0], y[rows], prior)
    return model


def calibrate(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit, classes weighted to the prior and the targets smoothed as Platt does."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0)
    scale = float(np.std(z)) or 1.0
    zs, a, b = z / scale, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * zs + b, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * zs).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * zs * zs).sum() + 1e-4, (h * zs).sum()], [(h * zs).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return max(a, 0.05) / scale, float(b)


def _scorer(model: ToxicModel):
    """A function from a string column to the scores of its texts, run by run."""
    table = np.append(model.bucket_scores(), np.float32(0))  # the last one is for positions without an n-gram
    offset = float(model.bias[1] - model.bias[0])
    slope, shift = model.slope, model.shift

    def scores(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, j, data, offs in chunks(col):
            buf, starts = ngrams.folded(data, offs, digits=True)
            total, n = np.zeros(j - i), np.zeros(j - i)
            for g in ngrams.grams(buf, SIZES, BITS, True):
                at = np.minimum(starts[:-1], len(g))
                g = np.append(g, -1)
                total += np.add.reduceat(table[g], at, dtype=np.float64)
                n += np.add.reduceat((g >= 0).astype(np.int64), at)
            z = slope * (total / (n + PAD) + offset) + shift
            yield i, j, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every whole text: the chance of label 1, and 1 where it reaches the threshold.

    Null, empty and wordless texts get the score of an empty bag. A score equal to the threshold counts as toxic. Null ids
    come back null. Repeated rows come back as often as they came; other
    columns aren't read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    scores = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, p in scores(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["id", "score", "predicted"])

    return pick(docs, id_col, text_col).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score stays below the threshold.

    Rows whose text is null or empty stay. Repeated rows, having one score, stay or go together; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    scores, at = _scorer(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            empty = np.asarray(pc.fill_null(pc.equal(pc.utf8_length(col), 0), True))
            for i, j, p in scores(col):
                yield batch.slice(i, j - i).filter(pa.array((p < threshold) | empty[i:j]))

    return docs.mapInArrow(run, docs.schema)
