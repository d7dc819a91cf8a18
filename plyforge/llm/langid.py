"""Language identification by error-correcting output codes.

Every language has a codeword of signs; for each bit a linear classifier over hashed byte n-grams predicts the sign. A
text gets the language whose codeword has the least summed logistic loss against the bits' margins (loss-weighted
decoding), so single wrong bits are outvoted; near ties are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.llm import ngrams
from plyforge.llm.textio import chunks, pick, small_batches

SIZES = (2, 3, 4)
BITS = 13
UND = "und"


@dataclass
class LangModel:
    """langs, their codewords (languages x bits), weights (buckets x bits), bias, and the temper of the losses."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temper: float = 1.0
    gap: float = 0.2


def codewords(k: int, rng: np.random.Generator) -> np.ndarray:
    """k codewords of signs: all 2^(k-1) - 1 splits up to 6 languages, else the best of many random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        cols = [[1 if r == 0 or (c >> (r - 1)) & 1 else -1 for r in range(k)] for c in range((1 << (k - 1)) - 1)]
        return np.array(cols, float).T
    size, best, far = int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(300):
        m = rng.choice([-1.0, 1.0], (k, size))
        d = ((size - m @ m.T) / 2 + size * np.eye(k)).min()
        split = np.abs(m.sum(0)).max() < k
        if split and d > far:
            best, far = m, d
    return best


def _counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buf, starts = ngrams.folded(data, offs)
    all_grams = ngrams.grams(buf, SIZES, BITS, False)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        c = np.bincount(np.concatenate([g[a:b] for g in all_grams]), minlength=1 << BITS)
        used = np.flatnonzero(c)
        yield used.astype("<u2"), c[used].astype("<u4")


def fit(docs: DataFrame, train: Column, sample: int = 2400, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from about `sample` rows where train holds and the language isn't null, equally many of each language.

    The rows are drawn by a hash of the id; their n-gram counts are taken on the executors over whole texts.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, lang_col)
    count = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(count)
    rng = np.random.default_rng(seed)
    code = codewords(len(langs), rng)
    if len(langs) < 2:
        return LangModel(langs, code, np.zeros((1 << BITS, code.shape[1] if langs else 1), np.float32), np.zeros(code.shape[1] if langs else 1))
    share = F.element_at(F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, sample / len(langs) / count[g])))]), F.col(lang_col))
    drawn = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(0)):
                found = list(_counts(data, offs))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())], names=["lang", "at", "n"])

    got = drawn.select(text_col, lang_col).mapInArrow(run, "lang string, at binary, n binary").collect()
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for row, r in enumerate(got):
        n = np.frombuffer(r["n"], "<u4").astype(np.float32)
        x[row, np.frombuffer(r["at"], "<u2")] = n / max(1.0, n.sum())
    y = np.array([langs.index(r["lang"]) for r in got])
    return train_bits(x, y, langs, code, rng)


def train_bits(x: np.ndarray, y: np.ndarray, langs: list[str], code: np.ndarray, rng: np.random.Generator, steps: int = 150) -> LangModel:
    """One logistic classifier a bit by full-batch Adam on standardised shares; the temper is set on every fifth row."""
    hold = rng.random(len(y)) < 0.2 if len(y) > 50 else np.zeros(len(y), bool)
    scale = 1 / (x[~hold].std(0) + 2e-4)
    xs, target = x[~hold] * scale, code[y[~hold]]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1])
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        z = target * (xs @ w + b)
        g = -target / (1 + np.exp(np.clip(z, -30, 30))) / max(1, len(xs))
        for p, m, v, d in ((w, mw, vw, xs.T @ g.astype(np.float32) + 1e-4 * w), (b, mb, vb, g.sum(0))):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model = LangModel(langs, code, (w * scale[:, None]).astype(np.float32), b)
    if hold.any():
        loss = losses(model, x[hold] @ model.weights + b)
        fits = [(-np.log(np.maximum(_share(loss * t)[np.arange(hold.sum()), y[hold]], 1e-9)).mean(), t) for t in (0.25, 0.5, 1, 2, 4)]
        model.temper = min(fits)[1]
    return model


def losses(model: LangModel, margins: np.ndarray) -> np.ndarray:
    """Mean logistic loss of each language's codeword against the margins (rows x bits)."""
    z = margins[:, None, :] * model.code[None]
    return np.logaddexp(0, -z).mean(2)


def _share(loss: np.ndarray) -> np.ndarray:
    e = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
    return e / e.sum(1, keepdims=True)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every whole text.

    A text that is null, empty or without a letter is `und`, score 0, not ambiguous; so is every text if no language was
    learned. Ties in the losses go to the first language by name. Null ids come back null. Repeated rows come back as often
    as they came; other columns aren't read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    langs = np.array([*model.langs, UND], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(batch.column(1)):
                buf, starts = ngrams.folded(data, offs)
                total = np.zeros((j - i, model.weights.shape[1]))
                n = np.zeros(j - i)
                for g in ngrams.grams(buf, SIZES, BITS, False):
                    total += np.add.reduceat(np.vstack((model.weights[g], np.zeros((1, total.shape[1]), np.float32))), np.minimum(starts[:-1], len(g)), axis=0)
                    n += np.diff(np.minimum(starts, len(g)))
                known = ngrams.letters(buf, starts)
                for d in np.flatnonzero(~known & (np.diff(offs) > 0)):
                    known[d] = any(c.isalpha() for c in data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace"))
                if model.langs:
                    loss = losses(model, total / np.maximum(n, 1)[:, None] + model.bias) * model.temper
                    share = _share(loss)
                    best = share.argmax(1)
                    score = share[np.arange(j - i), best]
                    two = np.sort(loss, 1)[:, :2]
                    tie = (two[:, -1] - two[:, 0] < model.gap * model.temper) if len(model.langs) > 1 else np.zeros(j - i, bool)
                else:
                    known[:] = False
                    best, score, tie = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(langs[np.where(known, best, len(langs) - 1)], pa.string()),
                        pa.array(np.where(known, score, 0.0), pa.float64()),
                        pa.array(known & tie, pa.bool_()),
                    ],
                    names=["id", "lang_pred", "score", "ambiguous"],
                )

    return pick(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)
