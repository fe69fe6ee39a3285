"""Quality classifier by positive-unlabelled learning.

A linear model over shape n-grams (letters, capitals, digits, spaces and each mark as
classes of characters) and repetition counts minimises the non-negative unbiased risk
``prior * P_loss(+) + max(0, U_loss(-) - prior * P_loss(-))`` with the logistic loss,
from trusted positives (rows labelled 1) and a bounded sample of unlabelled text. The
class prior is estimated from the scores that a positive-against-unlabelled classifier
gives to held-back positives and to all rows but those it learned from: the least ratio
of the unlabelled to the positive share above a threshold, with a margin for chance. No
negative label is read.

NULL texts count as empty; these and texts without words get the score of their (zero)
features. Very long texts are read whole, in overlapping pieces of about 1 MiB. Repeated rows give repeated results. Without positives every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import (buffers, chunks, documents, in_fold, labelled_sample, not_in_fold, per_batch,
                                   pieces, rate_filter, sample_key, staged)
from barsignals.llm.lm_scoring import words


@dataclass(frozen=True)
class QualityParams:
    positives: int = 3000  # bounds on the rows learned from
    unlabelled: int = 6000
    bits: int = 9  # shape buckets of each order
    orders: tuple[int, ...] = (2, 4)
    epochs: int = 60
    batch: int = 500
    rate: float = 0.01
    ridge: float = 1e-4
    threshold: float = 0.3
    seed: int = 17


def _shapes() -> np.ndarray:
    """Classes of bytes: other 0, small letter 1, capital 2, digit 3, space 4, line end 5, each mark its own."""
    out = np.zeros(256, np.uint8)
    mark = 6
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            out[b] = 1
        elif "A" <= c <= "Z":
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c in " \t":
            out[b] = 4
        elif c in "\n\r":
            out[b] = 5
        elif 32 < b < 127:
            out[b] = mark
            mark += 1
    return out


SHAPES = _shapes()
N_SHAPES = int(SHAPES.max()) + 1
N_REPEATS = 6


def _repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: shares of repeated words and word runs, mean word length, log length."""
    coded, counts = words(data, offsets)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(counts)
    row = np.repeat(np.arange(rows), counts)
    out = np.zeros((rows, N_REPEATS))
    total = np.maximum(counts, 1)
    same = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
    out[:, 0] = np.bincount(row[1:][same], minlength=rows) / total
    for col, k in ((1, 1), (2, 2), (3, 4)):
        n = max(0, len(ids) - k + 1)
        gram = np.zeros(n, np.uint64)
        for d in range(k):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + ids[d:d + n].astype(np.uint64) + np.uint64(1)
        ok = row[:n] == row[k - 1:k - 1 + n]
        key = np.unique((gram[ok] ^ (gram[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                        + row[:n][ok].astype(np.uint64) * np.uint64(0x94D049BB133111EB), return_index=True)[1]
        distinct = np.bincount(row[:n][ok][key], minlength=rows)
        grams = np.bincount(row[:n][ok], minlength=rows)
        out[:, col] = 1 - distinct / np.maximum(grams, 1)
        out[grams == 0, col] = 0
    size = np.diff(offsets)
    out[:, 4] = np.minimum(size / total, 40) / 10
    out[:, 5] = np.log1p(size) / 10
    return out


def features(column: pa.Array, p: QualityParams) -> np.ndarray:
    """Root frequencies of shapes and shape n-grams, and repetition shares, of each text."""
    data, offsets, _ = buffers(column)
    width = 1 << p.bits
    out = np.zeros((len(offsets) - 1, N_SHAPES + width * len(p.orders) + N_REPEATS), np.float32)
    for i, j, offs, own in pieces(offsets, max(p.orders) - 1):
        local = offs - offs[0]
        part = SHAPES[data[offs[0]:offs[-1]]]
        rows = j - i
        row = np.repeat(np.arange(rows), np.diff(local))
        at = N_SHAPES
        out[i:j, :at] += np.bincount((row * N_SHAPES + part)[:own], minlength=rows * N_SHAPES).reshape(rows, -1)
        for order in p.orders:
            n = max(0, len(part) - order + 1)
            gram = np.zeros(n, np.uint32)
            for d in range(order):
                gram = gram * np.uint32(64) + part[d:d + n]
            gram = ((gram + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - p.bits)
            ok = (row[:n] == row[order - 1:order - 1 + n])[:own]
            out[i:j, at:at + width] += np.bincount(
                (row[:n] * width + gram)[:own][ok], minlength=rows * width).reshape(rows, -1)
            at += width
    size = np.maximum(np.diff(offsets), 1).astype(np.float32)[:, None]
    out[:, :-N_REPEATS] = np.sqrt(out[:, :-N_REPEATS] / size)
    for i, j in chunks(offsets):
        out[i:j, -N_REPEATS:] = _repetition(data, offsets[i:j + 1])
    return out


def _sample_features(p: QualityParams):
    def run(batches):
        for b in batches:
            x = features(b.column("text"), p)
            yield pa.RecordBatch.from_arrays([b.column("order"), pa.array(list(x), pa.list_(pa.float32()))], ["order", "x"])
    return run


def _rows(sample: DataFrame, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """(features, order) of a sample."""
    got = sample.select("order", "text").mapInArrow(_sample_features(p), "order long, x array<float>").orderBy("order").toArrow()
    width = N_SHAPES + (1 << p.bits) * len(p.orders) + N_REPEATS
    return got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width), got.column("order").to_numpy()


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of raw features; the last is the intercept
    prior: float
    params: QualityParams

    def score(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(features(column, self.params) @ self.weights[:-1] + self.weights[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam over ``steps`` calls of ``gradient(w, step)``."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w, t - 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled, from scores in which positives are higher.

    Above any threshold the unlabelled share is at least prior times the positive
    share; the tightest such bound, with a margin for chance, estimates the prior.
    """
    return _prior(pos, _bins(unl, _cuts(pos)))


def _cuts(pos: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([[-np.inf], np.quantile(pos, np.linspace(0, 0.95, 200))]))


def _bins(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Scores by the number of cuts that they reach."""
    return np.bincount(np.searchsorted(cuts, scores, side="right"), minlength=len(cuts) + 1)


def _prior(pos: np.ndarray, bins: np.ndarray) -> float:
    """``estimate_prior`` from the unlabelled scores counted between the cuts."""
    n, cuts = int(bins.sum()), _cuts(pos)
    p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    u = (n - np.cumsum(bins)[:-1]) / n
    chance = np.sqrt(np.log(100) / 2 / n) + np.sqrt(np.log(100) / 2 / len(pos))
    best = np.argmin(u / p + chance / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.995))


def fit(pos: np.ndarray, unl: np.ndarray, p: QualityParams, hu: np.ndarray | None = None,
        tally: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> QualityModel:
    """Model from feature rows; ``hu`` marks the unlabelled ones that the prior's classifier leaves out.

    ``tally(weights, cuts)`` counts all rows it did not learn from in the bins of their
    scores (without it: the left-out rows).
    """
    mean, scale = unl.mean(0), unl.std(0) + 0.02
    hu = np.arange(len(unl)) % 3 == 0 if hu is None else hu
    raw = lambda w: np.append(w[:-1] / scale, w[-1] - (w[:-1] / scale) @ mean)
    held = pos[np.arange(len(pos)) % 3 == 0]
    one = lambda x: np.column_stack([(x - mean) / scale, np.ones(len(x))])
    pos, unl = one(pos), one(unl)
    rng = np.random.default_rng(p.seed)
    # prior: logistic regression of positive against unlabelled on two thirds, scores on the rest
    a, b = pos[np.arange(len(pos)) % 3 != 0], unl[~hu]

    def plain(w, _):
        return (a.T @ (_sigmoid(a @ w) - 1) / len(a) + b.T @ _sigmoid(b @ w) / len(b)) / 2 + 1e-3 * w

    w = _descend(plain, pos.shape[1], 150, 0.02) if len(a) and len(b) else np.zeros(pos.shape[1])
    scores = held @ raw(w)[:-1] + raw(w)[-1]
    bins = tally(raw(w), _cuts(scores)) if tally else _bins(unl[hu] @ w, _cuts(scores))
    prior = _prior(scores, bins) if bins.sum() else 0.5
    per = max(1, -(-len(unl) // p.batch))
    order: list = []

    def risk(w, step):
        if step % per == 0:
            order[:] = list(zip(np.array_split(rng.permutation(len(pos)), per), np.array_split(rng.permutation(len(unl)), per)))
        ip, iu = order[step % per]
        x, u = (pos[ip] if len(ip) else pos), unl[iu]
        zx, zu = x @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zx).mean()
        grad_negative = u.T @ _sigmoid(zu) / len(u) - prior * (x.T @ _sigmoid(zx)) / len(x)
        if negative < 0:
            return -grad_negative  # climb back to a risk that can be
        return prior * (x.T @ (_sigmoid(zx) - 1)) / len(x) + grad_negative + p.ridge * w

    w = _descend(risk, pos.shape[1], p.epochs * per, p.rate)
    return QualityModel(raw(w), prior, p)


def _tally(docs: DataFrame, p: QualityParams):
    """Counts of the rows of ``docs`` by the cuts that their scores reach."""
    def counts(weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        def run(batches):
            for b in batches:
                n = _bins(features(b.column("text"), p) @ weights[:-1] + weights[-1], cuts)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], ["bin", "n"])

        out = np.zeros(len(cuts) + 1, np.int64)
        for r in docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            out[r["bin"]] = r["n"]
        return out
    return counts


def train(docs: DataFrame, labels: DataFrame, eligible: Column, p: QualityParams = QualityParams()) -> QualityModel | None:
    """Learn from rows labelled 1 that are ``eligible`` (a column over doc_id) and unlabelled text.

    The risk reads a bounded sample of the text, the prior the scores of all of it.
    """
    per_batch(docs.sparkSession, 1000)
    positives = labelled_sample(docs, labels, "quality", eligible, {1: p.positives}, p.seed, "quality")
    total = docs.agg(F.count("*")).first()[0]
    sampled = rate_filter(sample_key(), F.lit(min(1.0, p.unlabelled / max(1, total))), p.seed + 2)
    order = F.xxhash64(F.lit(p.seed + 3), sample_key())
    unlabelled = staged(docs.filter(sampled).select(F.coalesce("text", F.lit("")).alias("text"), order.alias("order")),
                        "quality-unlabelled")
    (pos, _), (unl, by) = _rows(positives, p), _rows(unlabelled, p)
    rest = docs.filter(~sampled | (F.pmod(order, F.lit(3)) == 0))
    return fit(pos, unl, p, by % 3 == 0, _tally(rest, p)) if len(pos) and len(unl) else None


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, score and predicted of every row, from ``text`` alone."""
    per_batch(docs.sparkSession, 2000)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = model.score(b.column("text")) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    limit = model.params.threshold if model else QualityParams.threshold
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double").withColumn(
        "predicted", (F.col("score") >= limit).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold (crc32 mod 5 = 0)."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, not_in_fold(F.col("doc_id"), 5, 0))
    return score(docs, model).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
