"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised likelihood.

Two character models, of toxic and of ordinary labelled texts, share one backoff
distribution (Kneser-Ney continuation counts over both classes), so that expressions
which neither class has seen often cancel in the comparison. A text's evidence is the
log-likelihood ratio per character, over the whole text and over its most toxic
stretches (a short insult in a long text would vanish in the plain mean). A logistic
curve, fitted on labelled rows that the counts have not seen and weighted back to the
labels' frequencies, turns the evidence into the score. The final counts then take in the
held-back rows as well.

Counts are summed in Spark over a bounded, hash-chosen sample of labelled rows; only
the n-grams of that sample are sent to the tasks.

NULL and empty texts score as the curve says for no evidence. Very long texts are read
whole, in overlapping pieces of about 1 MiB. Repeated rows give repeated results, wherever
they stand in a batch. Without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import (LETTERS, Lookup, buffers, documents, in_fold, labelled_sample, logistic,
                                   not_in_fold, per_batch, pieces)


@dataclass(frozen=True)
class ToxicityParams:
    order: int = 5  # characters (bytes) of an n-gram, at most 7
    discount: float = 0.75
    toxic_rows: int = 2000  # bounds on the labelled rows learned from
    ordinary_rows: int = 4000
    windows: tuple[int, ...] = (6, 12, 24)  # stretches, in characters
    threshold: float = 0.3
    seed: int = 11


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as letters with a space before each and after the last; the positions of these spaces."""
    local = offsets - offsets[0]
    part = LETTERS[data[offsets[0]:offsets[-1]]]
    return np.insert(part, local, 32), local + np.arange(len(local))


def grams(part: np.ndarray, order: int) -> np.ndarray:
    n = max(0, len(part) - order + 1)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out <<= np.uint64(8)
        out |= part[k:k + n]
    return out


def spans(data: np.ndarray, offsets: np.ndarray, piece: tuple, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, lo, hi, end) of one of ``pieces``: text k's own n-grams start in [lo, hi), its last one before end.

    The spaces around a text take part once: those between the pieces of a long text do not.
    """
    i, _, offs, own = piece
    part, starts = padded(data, offs)
    first = bool(offs[0] == offsets[i])
    if not first:
        part, starts = part[1:], np.maximum(starts - 1, 0)
    lo = starts[:-1]
    end = np.maximum(starts[1:] + 2 - order, lo)
    hi = end if own == offs[-1] - offs[0] else np.minimum(end, own + first)
    return part, lo, hi, end


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of [lo[k], hi[k]), one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


class KneserNey:
    """Log-likelihood ratios of the toxic against the ordinary model, by n-gram."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, p: ToxicityParams):
        self.order = p.order
        shared = self._shared(keys, p)
        context = keys >> np.uint64(8)
        ctx, inv = np.unique(context, return_inverse=True)
        logs, backs = [], []
        for c in (toxic, ordinary):
            total = np.bincount(inv, c, len(ctx))
            types = np.bincount(inv, c > 0, len(ctx))
            back = np.where(total > 0, p.discount * types / np.maximum(total, 1), 1.0)
            prob = np.where(total[inv] > 0, np.maximum(c - p.discount, 0) / np.maximum(total[inv], 1), 0.0)
            logs.append(np.log(prob + back[inv] * shared))
            backs.append(np.log(back))
        self.seen = Lookup(keys, logs[0] - logs[1])
        self.unseen = Lookup(ctx, backs[0] - backs[1])

    @staticmethod
    def _shared(keys: np.ndarray, p: ToxicityParams) -> np.ndarray:
        """Backoff probability of each n-gram's last character, from pooled continuation counts."""
        levels = []
        for k in range(p.order - 1, 0, -1):
            keys_k = keys & np.uint64((1 << 8 * k) - 1)
            levels.append(keys_k)
        prob = np.full(len(keys), 1 / 64)
        for k in range(1, p.order):
            # types of (k+1)-grams that end in each k-gram
            longer = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1))
            gram, counts = np.unique(longer & np.uint64((1 << 8 * k) - 1), return_counts=True)
            ctx, inv = np.unique(gram >> np.uint64(8), return_inverse=True)
            total = np.bincount(inv, counts, len(ctx))
            types = np.bincount(inv, minlength=len(ctx))
            own = levels[p.order - 1 - k]
            at = np.searchsorted(gram, own)
            c, t, n = counts[at], total[inv[at]], types[inv[at]]
            prob = np.maximum(c - p.discount, 0) / t + p.discount * n / t * prob
        return prob

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        out, found = self.seen.get(keys)
        rest = np.flatnonzero(~found)
        if len(rest):
            out[rest] = self.unseen.get(keys[rest] >> np.uint64(8))[0]
        return out

    def evidence(self, column: pa.Array, windows: tuple[int, ...]) -> np.ndarray:
        """Per text: mean ratio, best mean of each stretch length, log of the length."""
        data, offsets, _ = buffers(column)
        rows = len(offsets) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        best = np.full((rows, len(windows)), -np.inf)
        for piece in pieces(offsets, max(windows) + self.order):
            i, j = piece[:2]
            part, lo, hi, end = spans(data, offsets, piece, self.order)
            n = hi - lo
            full = np.flatnonzero(n > 0)
            if not len(full):
                continue
            v = self.ratios(grams(part, self.order)).astype(np.float64)
            run = np.concatenate([[0.0], np.cumsum(v)])
            at, first = _ranges(lo, hi), (np.cumsum(n) - n)[full]
            total[i + full] += np.add.reduceat(v[at], first)
            count[i:j] += n
            for w, size in enumerate(windows):
                mean = (run[np.minimum(at + size, np.repeat(end, n))] - run[at]) / size
                best[i + full, w] = np.maximum(best[i + full, w], np.maximum.reduceat(mean, first))
        best[np.isinf(best)] = 0
        return np.column_stack([total / np.maximum(count, 1), best, np.log1p(np.diff(offsets)) / 10])


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray
    toxic: np.ndarray
    ordinary: np.ndarray
    curve: np.ndarray
    params: ToxicityParams

    def scorer(self):
        lm = KneserNey(self.keys, self.toxic, self.ordinary, self.params)
        return lambda column: _curve(lm.evidence(column, self.params.windows), self.curve)


def _curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _counts(p: ToxicityParams):
    def run(batches):
        for b in batches:
            y = b.column("label").to_numpy(zero_copy_only=False)
            data, offsets, _ = buffers(b.column("text"))
            for piece in pieces(offsets, p.order):
                part, lo, hi, _ = spans(data, offsets, piece, p.order)
                label = np.repeat(y[piece[0]:piece[1]], hi - lo)
                g, inv = np.unique(grams(part, p.order)[_ranges(lo, hi)], return_inverse=True)
                t = np.bincount(inv, label == 1, len(g))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.astype(np.int64)), pa.array(t.astype(np.int64)),
                     pa.array((np.bincount(inv, minlength=len(g)) - t).astype(np.int64))], ["gram", "toxic", "ordinary"])
    return run


def _count(sample: DataFrame, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-grams of a bounded sample with their counts in toxic and ordinary texts."""
    got = (sample.select("text", "label").mapInArrow(_counts(p), "gram long, toxic long, ordinary long")
           .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).orderBy("gram").toArrow())
    return tuple(got.column(c).to_numpy().astype(t) for c, t in (("gram", np.uint64), ("toxic", np.float64), ("ordinary", np.float64)))


def train(docs: DataFrame, labels: DataFrame, eligible, p: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """Fit both models on a bounded sample of the labelled rows that are ``eligible`` (a column over doc_id)."""
    per_batch(docs.sparkSession, 2000)
    sample = labelled_sample(docs, labels, "toxic", eligible, {1: p.toxic_rows, 0: p.ordinary_rows}, p.seed, "toxicity")
    held = F.pmod(F.col("order"), F.lit(4)) == 0
    keys, t, o = _count(sample.filter(~held), p)
    if not len(keys):
        return None
    windows = p.windows

    def features(batches):
        lm = KneserNey(keys, t, o, p)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("weight"), b.column("order"), pa.array(
                list(lm.evidence(b.column("text"), windows)), pa.list_(pa.float64()))], ["label", "weight", "order", "x"])

    rows = (sample.filter(held).mapInArrow(features, "label int, weight double, order long, x array<double>")
            .orderBy("order", "label").toPandas())
    if rows["label"].nunique() < 2:
        return None
    weight = rows["weight"].to_numpy()
    curve = logistic(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(), weight * len(weight) / weight.sum(), 0.05)
    return ToxicityModel(*_count(sample, p), curve, p)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """All columns of ``docs`` that the caller needs are its own; here: doc_id, score, predicted by row."""
    per_batch(docs.sparkSession, 2000)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        f = model.scorer() if model else None
        for b in batches:
            s = f(b.column("text")) if f else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    limit = model.params.threshold if model else ToxicityParams.threshold
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double").withColumn(
        "predicted", (F.col("score") >= limit).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Rows of ``docs``, with their columns, that the model does not reject."""
    if model is None:
        return docs
    per_batch(docs.sparkSession, 2000)

    def run(batches):
        f = model.scorer()
        for b in batches:
            yield b.filter(pa.array(f(b.column("text")) < model.params.threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold (crc32 mod 4 = 2)."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, not_in_fold(F.col("doc_id"), 4, 2))
    return score(docs, model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
