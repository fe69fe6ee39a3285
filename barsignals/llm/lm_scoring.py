"""Language-model scoring: marginal probability of a text over all subword segmentations.

Texts are scored as the lower-cased words of the base score and one end. A vocabulary
gives the pieces; their weights are learned from the distinct words of the training
rows, in a few rounds: best segmentations of all words, then the pieces' shares of them.
The first round weights the pieces by the vocabulary's own scores. A vocabulary of merge
ranks (its scores are minus the rank) gets Zipf weights, 1 / (rank + 1); log
probabilities are kept. Characters without a piece are written in bytes. A log-space
forward recursion over the lattice of a space and a word sums every segmentation of
pieces; a training word is one more edge across its lattice, weighted by its own count
less a discount, and the discounts of all words are the share of the pieces. A word that
the text already held is also expected by its count there (``cache``). All shares are a
distribution over words and end, so scores of rows outside the training fold compare
with base scores.

The base score is a unigram word model with add-half counts of the training rows. Word
counts are summed in Spark. Words above a count chosen from a histogram, at most
``frequent`` of them and each of at most ``frequent_bytes`` bytes, are sent to the
tasks (a size bound that doesn't depend on the data); all other words of a text meet
their counts in a join, and such words are rare, so no key of that join is hot.

NULL texts count as empty: one token, the end. Repeated rows give repeated results.
Without training rows all counts are 0, V is 0, and pieces keep the vocabulary's weights.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import buffers, chunks, documents, in_fold, not_in_fold, per_batch, segment_sums, staged
from barsignals.llm.lattice import PieceModel, Vocabulary, by_size, stretches, take_stretches
from barsignals.llm.sentencepieces import VOCABULARY, _parts

CHUNK = 1 << 21


@dataclass(frozen=True)
class ScoringParams:
    vocabulary: str = VOCABULARY
    frequent: int = 200_000
    frequent_bytes: int = 32
    rounds: int = 2  # of learning the weights of pieces
    unseen: float = 0.1  # added to the count of every piece and byte
    discount: float = 0.6  # of the count of each training word, given to the pieces
    cache: float = 0.2  # greatest share of the words that the text held before
    delay: float = 20.0  # words of a text after which that share is at half


def piece_model(path: str) -> tuple[PieceModel, float]:
    """(lattice weights as log probabilities, log probability of the end)."""
    v = Vocabulary.load(path)
    scores = v.scores[v.normal]
    usual = scores[scores > -1e8]
    if len(usual) and (usual == np.round(usual)).all() and usual.min() < -1000:  # merge ranks
        rank = np.where(v.scores > -1e8, -v.scores, len(v.pieces))
        logs = -np.log1p(rank)
    else:
        logs = v.scores.astype(np.float64)
    last = logs[v.normal].min()
    end = logs[v.normal].max()
    byte = np.full(256, last)
    norm = np.logaddexp.reduce(np.concatenate([logs[v.normal], byte, [end]]))
    return PieceModel.of(v, np.where(v.normal, logs - norm, -np.inf), last - norm, byte - norm), float(end - norm)


def lattice_sums(model: PieceModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all segmentations of each stretch, a bounded part of them at a time."""
    out = np.zeros(len(offsets) - 1)
    for at in (part for group in by_size(offsets) for part in _parts(group, offsets)):
        out[at] = model.forward(*take_stretches(data, offsets, at))
    return out


def log_probability(column: pa.Array, model: PieceModel, end: float) -> np.ndarray:
    """log10 of each text's marginal probability, its end included."""
    data, offsets, _ = buffers(column)
    out = np.full(len(offsets) - 1, end)
    for i, j in chunks(offsets, CHUNK):
        coded, counts = stretches(data, offsets[i:j + 1])
        d, o, _ = buffers(coded.dictionary)
        value = lattice_sums(model, d, o)
        which = coded.indices.to_numpy(zero_copy_only=False)
        out[i:j] += segment_sums(value[which], np.concatenate([[0], np.cumsum(counts)]))
    return out / np.log(10)


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


SPACE = _is_space()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct-coded lower-cased words, count by text)."""
    local = offsets - offsets[0]
    part = LOWER[data[offsets[0]:offsets[-1]]]
    inside = ~SPACE[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = local[1:-1]
    at = at[(at > 0) & (at < len(part))]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, local))
    kept = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.append(kept[starts], kept[-1]).astype(np.int32)
    array = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(part[inside])])
    return array.dictionary_encode(), counts


def _count_words(batches):
    for b in batches:
        data, offsets, _ = buffers(b.column("text"))
        for i, j in chunks(offsets, 4 * CHUNK):
            coded, _ = words(data, offsets[i:j + 1])
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], ["word", "n"])


def word_counts(docs: DataFrame, eligible: Column) -> DataFrame:
    """(word, n) over the texts of ``eligible`` rows."""
    per_batch(docs.sparkSession, 2000)
    rows = docs.filter(eligible).select("text").mapInArrow(_count_words, "word string, n long")
    return staged(rows.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of words with a leading space: the stretches of a lattice."""
    data, offsets, _ = buffers(column)
    return np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))


def _count_pieces(model: PieceModel):
    """Uses of each piece in the best segmentations of words; the bytes of bare characters as -1 - byte."""
    def run(batches):
        for b in batches:
            n, raw = np.zeros(len(model.weights), np.int64), np.zeros(256, np.int64)
            data, offsets = spaced(b.column("word"))
            for at in (part for group in by_size(offsets) for part in _parts(group, offsets)):
                d, o = take_stretches(data, offsets, at)
                ids, start, _ = model.best(d, o)
                n += np.bincount(ids, minlength=len(n))
                bare = np.repeat(ids == model.unknown, np.diff(np.append(start, len(d))))  # pieces tile the bytes
                raw += np.bincount(d[bare], minlength=256)
            n[model.unknown] = 0
            used, used_raw = np.flatnonzero(n), np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, -1 - used_raw]).astype(np.int32)),
                                              pa.array(np.concatenate([n[used], raw[used_raw]]))], ["piece", "n"])
    return run


def learned_model(counts: DataFrame, p: ScoringParams) -> PieceModel:
    """Lattice weights learned from the distinct words of ``counts``; what is collected is one count per piece."""
    model, _ = piece_model(p.vocabulary)
    normal = Vocabulary.load(p.vocabulary).normal
    per_batch(counts.sparkSession, 20_000, CHUNK)
    for _ in range(p.rounds):
        got = counts.select("word").mapInArrow(_count_pieces(model), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not got:
            break
        n, raw = np.where(normal, p.unseen, 0.0), np.full(256, p.unseen)
        for piece, k in got:
            if piece >= 0:
                n[piece] += k
            else:
                raw[-1 - piece] += k
        norm = np.log(n.sum() + raw.sum())
        logs = np.log(n, out=np.full(len(n), -np.inf), where=n > 0) - norm
        model = replace(model, weights=logs, unknown_weight=float(np.log(p.unseen) - norm), byte_weights=np.log(raw) - norm)
    return model


def _earlier(words_of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by text and word, first of each such group in that order, how often a text held each word before)."""
    by = np.lexsort((words_of, row))
    first = np.concatenate([[True], (row[by][1:] != row[by][:-1]) | (words_of[by][1:] != words_of[by][:-1])])[:len(by)]
    at = np.flatnonzero(first)
    rank = np.arange(len(by)) - np.repeat(at, np.diff(np.append(at, len(by))))
    times = np.empty(len(by), np.int64)
    times[by] = rank
    return by, first, times


def _frequent(counts: DataFrame, p: ScoringParams) -> pa.Table:
    """The commonest short words with their counts: at most ``frequent``."""
    short = counts.filter(F.octet_length("word") <= p.frequent_bytes)
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    sizes = sorted(((r["level"], r["k"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for lv, k in sizes:
        total += k
        if total > p.frequent:
            break
        least = lv
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    got = short.filter(level >= least).select("word", "n").toArrow()
    return pa.table({"word": got.column("word").combine_chunks().cast(pa.string()), "n": got.column("n").combine_chunks()})


def score(docs: DataFrame, eligible: Column, p: ScoringParams = ScoringParams()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; counts from ``eligible`` rows."""
    spark = docs.sparkSession
    counts = word_counts(docs, eligible)
    ends = docs.filter(eligible).count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = int(total[0]) + ends, int(total[1]) + (ends > 0)
    norm = float(np.log10(n + 0.5 * (v + 1)))
    common = _frequent(counts, p)
    model = learned_model(counts, p)
    end_part = float(np.log10(ends + 0.5))
    # shares of a distribution over words and end: counts less the discounts, the pieces, the end
    spelled = float(np.log10((p.discount * int(total[1]) + 0.5) / (n + 1)))
    end_score = float(np.log10((ends + 0.5) / (n + 1)))
    schema = "rid long, doc_id long, word string, spelled double, at array<int>, n_tokens long, n_known long, base double, score double"
    names = ["rid", "doc_id", "word", "spelled", "at", "n_tokens", "n_known", "base", "score"]

    def run(batches):
        known = common.column("word").combine_chunks()
        logs = np.log10(common.column("n").to_numpy() + 0.5)
        share = np.append(np.maximum(common.column("n").to_numpy() - p.discount, 0) / (n + 1), 0.0)
        for b in batches:
            data, offsets, _ = buffers(b.column("text"))
            rids = b.column("rid").to_numpy()
            for i, j in chunks(offsets, 4 * CHUNK):
                coded, size = words(data, offsets[i:j + 1])
                at = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                by_pieces = spelled + lattice_sums(model, *spaced(coded.dictionary)) / np.log(10)
                which = coded.indices.to_numpy(zero_copy_only=False)
                cut = np.concatenate([[0], np.cumsum(size)])
                place = at[which]
                part = np.append(logs, 0.0)[place]
                base = segment_sums(part, cut) + end_part
                seen = segment_sums(place >= 0, cut).astype(np.int64) + (ends > 0)
                row = np.repeat(np.arange(j - i), size)
                nth = np.arange(len(which)) - cut[row]
                by, first, times = _earlier(which, row)
                again = p.cache / (nth + p.delay)
                own = (1 - nth * again) * (share[place] + 10.0 ** by_pieces[which]) + times * again
                score = segment_sums(np.where(place < 0, 0.0, np.log10(own, out=np.zeros(len(own)), where=place >= 0)), cut) + end_score
                empty = (pa.nulls(j - i, pa.string()), pa.nulls(j - i, pa.float64()), pa.nulls(j - i, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[i:j]), b.column("doc_id").slice(i, j - i), *empty,
                     pa.array(size + 1), pa.array(seen), pa.array(base), pa.array(score)], names)
                first, by = first[place[by] < 0], by[place[by] < 0]
                if not len(by):
                    continue
                lead = np.flatnonzero(first)
                rare = by[lead]  # one row of a text and word, with the places of the word
                k = len(rare)
                places = pa.ListArray.from_arrays(pa.array(np.append(lead, len(by)).astype(np.int32)), pa.array(nth[by].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[i + row[rare]]), pa.nulls(k, pa.int64()), coded.dictionary.take(pa.array(which[rare])),
                     pa.array(by_pieces[which[rare]]), places, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                     pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], names)

    per_batch(spark, 1000)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    rows = staged(rows, "lm-rows")  # once: row numbers must not change between uses
    rare = rows.filter(F.col("word").isNotNull()).select("rid", "word", "spelled", "at").join(counts, "word", "left")
    tf, zero = F.size("at"), F.lit(0).cast("long")
    share = F.coalesce(F.greatest(F.col("n") - p.discount, F.lit(0.0)) / float(n + 1), F.lit(0.0))

    def of_place(nth: Column, times: Column) -> Column:
        again = p.cache / (nth + p.delay)
        other = F.lit(1.0) - nth * again
        whole = F.log10(other * (F.col("share") + F.pow(F.lit(10.0), F.col("spelled"))) + times * again)
        # a new word's pieces alone can weigh less than a double holds
        return F.when((F.col("share") > 0) | (times > 0), whole).otherwise(F.log10(other) + F.col("spelled"))

    rare = rare.withColumn("share", share)
    rare = rare.select("rid", F.lit(None).cast("long").alias("doc_id"), zero.alias("n_tokens"),
                       F.when(F.col("n") > 0, tf).otherwise(0).cast("long").alias("n_known"),
                       (tf * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("base"),
                       F.aggregate(F.transform("at", of_place), F.lit(0.0), lambda x, y: x + y).alias("score"))
    main = rows.filter(F.col("word").isNull()).select("rid", "doc_id", "n_tokens", "n_known", "base", "score")
    out = main.unionAll(rare).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base"), F.sum("score").alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document; counts and weights from rows outside the held-out fold (crc32 mod 5 = 1)."""
    docs = documents(spark, sf_dir)
    out = score(docs, not_in_fold(F.col("doc_id"), 5, 1))
    return out.select("doc_id", in_fold(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")
