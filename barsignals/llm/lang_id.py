"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of lower-cased words with one boundary mark at each
end, hashed into buckets. A text is the average of its subwords' embeddings; a linear
softmax reads it. Embeddings and weights are trained in numpy by stochastic gradient
descent on a bounded, hash-chosen sample of labelled rows. A temperature fitted on a
held-back part of that sample calibrates the probabilities, and the rejection
threshold is the least confidence at which accepted texts reach ``target_precision``.

Prediction is linear before the softmax, so tasks use one table of per-bucket logits
(``buckets`` x languages, the only thing broadcast; its size doesn't grow with data).

NULL texts and texts without a letter give ``und``, score 0, rejected. Very long texts are
read whole, in overlapping pieces of about 1 MiB. Equal logits go to the first language in
order of their names. Repeated rows
give repeated results; NULL ids are predicted but never learned from. Without any
labelled row every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import (LETTERS, buffers, documents, in_fold, not_in_fold, per_batch, pieces, rate_filter,
                                   segment_sums)

UND = "und"


@dataclass(frozen=True)
class LangIdParams:
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 15
    dim: int = 16
    per_language: int = 400  # bound on the labelled rows learned from, per language
    epochs: int = 4
    rate: float = 1.0
    batch: int = 32
    target_precision: float = 0.98
    seed: int = 7


def subwords(data: np.ndarray, offsets: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the subword starting at each byte; ``1 << bits`` where there is none.

    ``offsets`` are relative to ``data``; subwords don't cross texts.
    """
    none = 1 << bits
    n = len(data)
    out = np.full(n, none, np.int32)
    m = n - order + 1
    if m <= 0:
        return out
    gram = np.zeros(m, np.uint32)
    for k in range(order):
        gram <<= np.uint32(8)
        gram |= data[k:k + m]
    space = data == 32
    if order == 2:
        ok = ~(space[:m] & space[1:])
    else:
        ok = ~space[1:1 + m]
        for k in range(2, order - 1):
            ok &= ~space[k:k + m]
    for k in range(1, order):  # starts too close to the end of their text
        ends = offsets[1:] - k
        ok[ends[(ends >= 0) & (ends < m)]] = False
    gram += np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x85EBCA77)
    gram ^= gram >> np.uint32(13)
    gram *= np.uint32(0xC2B2AE3D)
    out[:m] = np.where(ok, (gram >> np.uint32(32 - bits)).astype(np.int32), none)
    return out


@dataclass(frozen=True)
class LangIdModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # (buckets + 1, languages): the last row is "no subword"
    bias: np.ndarray
    temperature: float
    threshold: float
    params: LangIdParams

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language index, calibrated probability) of each text."""
        data, offsets, _ = buffers(column)
        rows, size = len(offsets) - 1, len(self.languages)
        total, counts = np.zeros((rows, size)), np.zeros(rows)
        p = self.params
        table = np.ascontiguousarray(self.logits.T)
        for i, j, offs, own in pieces(offsets, max(p.orders) - 1):
            part = LETTERS[data[offs[0]:offs[-1]]]
            local = offs - offs[0]
            for order in p.orders:
                ids = subwords(part, local, order, p.bits)
                ids[own:] = 1 << p.bits
                counts[i:j] += segment_sums(ids < 1 << p.bits, local)
                for c in range(size):
                    total[i:j, c] += segment_sums(table[c][ids], local)
        z = (total / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        prob = e / e.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        return best, prob[np.arange(rows), best]


def _features(p: LangIdParams):
    def run(batches):
        for b in batches:
            data, offsets, _ = buffers(b.column("text"))
            ids, counts = [], []
            for r in range(len(offsets) - 1):
                local = np.array([0, offsets[r + 1] - offsets[r]])
                acc = np.zeros((1 << p.bits) + 1, np.int64)
                for _, _, offs, own in pieces(local, max(p.orders) - 1):
                    part = LETTERS[data[offsets[r] + offs[0]:offsets[r] + offs[-1]]]
                    for order in p.orders:
                        acc += np.bincount(subwords(part, offs - offs[0], order, p.bits)[:own], minlength=len(acc))
                k = np.flatnonzero(acc[:-1])
                ids.append(k.astype(np.int32))
                counts.append(acc[k].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("order"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.float32()))], ["label", "order", "ids", "counts"])
    return run


def train(docs: DataFrame, label: Column, eligible: Column, p: LangIdParams = LangIdParams()) -> LangIdModel | None:
    """Learn from a bounded sample of ``docs`` rows that are ``eligible`` and have a label."""
    rows = docs.select(F.col("text"), label.alias("label"), F.col("doc_id"), eligible.alias("ok"))
    rows = rows.filter(F.col("ok") & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # of the rows that can be learned from; a language without any is not in the model
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, p.per_language / n)))])
    sample = rows.filter(rate_filter(F.col("doc_id"), rate[F.col("label")], p.seed))
    sample = sample.select("label", F.xxhash64(F.lit(p.seed + 1), "doc_id").alias("order"), "text")
    got = sample.mapInArrow(_features(p), "label string, order long, ids array<int>, counts array<float>").toArrow()
    return fit(got, tuple(sorted(sizes)), p)


def fit(sample: pa.Table, languages: tuple[str, ...], p: LangIdParams) -> LangIdModel:
    """Stochastic gradient descent over the sample's hashed subword counts."""
    order = pc.sort_indices(sample, sort_keys=[("order", "ascending"), ("label", "ascending")])
    sample = sample.take(order)
    y = np.array([languages.index(v) for v in sample.column("label").to_pylist()], np.int64)
    ids = [np.asarray(v, np.int32) for v in sample.column("ids").combine_chunks().to_numpy(zero_copy_only=False)]
    cnt = [np.asarray(v, np.float32) for v in sample.column("counts").combine_chunks().to_numpy(zero_copy_only=False)]
    cnt = [c / max(c.sum(), 1) for c in cnt]
    rng = np.random.default_rng(p.seed)
    held = np.arange(len(y)) % 5 == 0
    tr = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    emb = rng.uniform(-1, 1, ((1 << p.bits) + 1, p.dim)).astype(np.float32) / p.dim
    w = np.zeros((p.dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, total = 0, max(1, p.epochs * -(-len(tr) // p.batch))
    for _ in range(p.epochs):
        for part in np.array_split(rng.permutation(tr), max(1, -(-len(tr) // p.batch))):
            lr = p.rate * (1 - steps / total) + 0.01
            steps += 1
            k = np.concatenate([ids[i] for i in part])
            c = np.concatenate([cnt[i] for i in part])
            at = np.concatenate([[0], np.cumsum([len(ids[i]) for i in part])])
            if not len(k):
                continue
            doc = np.repeat(np.arange(len(part)), np.diff(at))
            x = np.stack([np.bincount(doc, emb[k, d] * c, len(part)) for d in range(p.dim)], 1).astype(np.float32)
            g = _softmax(x @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            back = (g @ w.T)[doc] * c[:, None]
            w -= lr * (x.T @ g) / len(part) * p.dim
            bias -= lr * g.mean(0)
            uniq, inv = np.unique(k, return_inverse=True)
            for d in range(p.dim):
                emb[uniq, d] -= lr * np.bincount(inv, back[:, d]).astype(np.float32) * p.dim
    emb[-1] = 0
    logits = (emb @ w).astype(np.float32)
    cal = np.flatnonzero(held) if held.any() else tr
    z = np.stack([(logits[ids[i]] * cnt[i][:, None]).sum(0) for i in cal]) + bias
    temperature = min(np.geomspace(0.02, 20, 80), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(cal)), y[cal]] + 1e-12).mean())
    prob = _softmax(z / temperature)
    best = prob.max(1)
    right = prob.argmax(1) == y[cal]
    by = np.argsort(-best, kind="stable")
    precise = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= p.target_precision)
    threshold = float(best[by][precise[-1]]) if len(precise) else 1.0
    return LangIdModel(languages, logits, bias, float(temperature), threshold, p)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: LangIdModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, from ``text`` alone."""
    spark = docs.sparkSession
    per_batch(spark, 2000)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = model
        for b in batches:
            ok = b.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if m is None:
                names, score = np.full(len(ok), UND, object), np.zeros(len(ok))
                rejected = np.ones(len(ok), bool)
            else:
                best, prob = m.predict(b.column("text"))
                names = np.where(ok, np.array(m.languages, object)[best], UND)
                score = np.where(ok, prob, 0.0)
                rejected = ~ok | (prob < m.threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score),
                                              pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows outside the held-out fold (crc32 mod 4 = 2)."""
    docs = documents(spark, sf_dir)
    model = train(docs, F.col("lang"), not_in_fold(F.col("doc_id"), 4, 2))
    return identify(docs, model).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred",
                                        "score", "rejected")
