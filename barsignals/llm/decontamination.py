"""Benchmark decontamination: an FM-index per training shard, searched for benchmark windows.

A shard is one Arrow batch of documents inside a task. Its words become numbers of the
benchmark's vocabulary; only runs of such words that are long enough to hold a window
enter the index (other words cannot take part in a match, so nothing is lost). The
index is a Burrows-Wheeler transform with a wavelet tree; all windows are searched
backward at once through its ranks, occurrences are located by walking to sampled
suffix positions, and hit words are merged into removal spans.

The benchmark is the stated query set: it is read in blocks of ``block_chars`` at
most on average (chosen by hash of the item), and one pass over the documents per
block adds to each row's hits, so no block outgrows a task and no row is shuffled.

NULL and empty texts have no words, no hits and are not contaminated. An empty
benchmark hits nothing. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import Lookup, buffers, chunks, documents, per_batch

WINDOW = 13


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = WINDOW
    share: int = 20  # contaminated from one hit word in this many words
    block_chars: int = 4_000_000
    sample_rate: int = 8  # one suffix position in this many is stored


def _word_map() -> np.ndarray:
    """Lower-cased word bytes (digits, letters, all beyond ASCII); 0 for the others."""
    m = np.zeros(256, np.uint8)
    m[48:58] = np.arange(48, 58)
    m[97:123] = np.arange(97, 123)
    m[65:91] = np.arange(97, 123)
    m[128:] = np.arange(128, 256)
    return m


WORD_MAP = _word_map()
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB) | np.uint64(1)


MIXED = _mixed()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, 64-bit hashes) of the words; they don't cross texts."""
    low = WORD_MAP[data]
    is_word = low != 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edges = offsets[1:-1]
    at = edges[(edges > 0) & (edges < len(data))]
    first[at] |= is_word[at]
    last[at - 1] |= is_word[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(MIXED[low] * _powers(BASE, len(data)), out=total[1:])
    hashes = (total[ends] - total[starts]) * _powers(INVERSE, len(data) + 1)[starts]
    return low, starts, ends, hashes ^ (hashes >> np.uint64(31))


def word_pieces(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges with their byte offsets; a text beyond ``limit`` comes in pieces cut between words."""
    for i, j in chunks(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        while hi - lo > 2 * limit:
            gaps = np.flatnonzero(WORD_MAP[data[lo + limit:lo + 2 * limit]] == 0)
            if not len(gaps):
                break
            cut = lo + limit + int(gaps[0])
            yield i, j, np.array([lo, cut])
            lo = cut
        yield i, j, np.concatenate([[lo], offsets[i + 1:j + 1]])


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    rank, h = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        follow = np.zeros(len(rank), np.int64)
        follow[:max(0, len(rank) - h)] = rank[h:] + 1
        key = rank * (len(rank) + 1) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        h *= 2
        if rank[order[-1]] == len(rank) - 1:
            return order


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector with running counts per level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        s = symbols
        for k in range(self.levels - 1, -1, -1):
            bit = (s >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before position ``at``."""
        lo, hi = np.zeros_like(at), at.copy()
        for d in range(self.levels):
            one = ((symbol >> (self.levels - 1 - d)) & 1).astype(bool)
            a, b = self.ones[d][lo], self.ones[d][hi]
            lo = np.where(one, self.zeros[d] + a, lo - a)
            hi = np.where(one, self.zeros[d] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, its rank there)."""
        symbol, pos, lo = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for d in range(self.levels):
            a, b, c = self.ones[d][pos], self.ones[d][pos + 1], self.ones[d][lo]
            one = b > a
            symbol = symbol * 2 + one
            lo = np.where(one, self.zeros[d] + c, lo - c)
            pos = np.where(one, self.zeros[d] + a, pos - a)
        return symbol, pos - lo


class FMIndex:
    """Backward search over a sequence of numbers from 0 to ``top`` (0 parts the runs)."""

    def __init__(self, symbols: np.ndarray, top: int, sample_rate: int):
        symbols = np.concatenate([[0], symbols]).astype(np.int64)
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.tree = WaveletTree(before, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        stored = (order % sample_rate == 0) | (before == 0)  # no walk crosses the start of a run
        self.stored = stored
        self.slot = np.cumsum(stored) - 1
        self.positions = order[stored]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern (one per row of the matrix)."""
        lo, hi = self.first[patterns[:, -1]], self.first[patterns[:, -1] + 1]
        alive = np.flatnonzero(hi > lo)
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[alive, k]
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a stored one."""
        out, steps = np.zeros_like(rows), np.zeros_like(rows)
        rows, left = rows.copy(), np.arange(len(rows))
        while len(left):
            done = self.stored[rows[left]]
            hit = left[done]
            out[hit] = self.positions[self.slot[rows[hit]]] + steps[hit]
            left = left[~done]
            c, r = self.tree.access(rows[left])
            rows[left] = self.first[c] + r
            steps[left] += 1
        return out - 1  # without the leading separator


@dataclass(frozen=True)
class Benchmark:
    """A block of the query set: vocabulary, and per length the windows with their items."""

    hashes: np.ndarray
    vocabulary: list[bytes]
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # patterns, item offsets, item numbers
    items: list[str]

    @staticmethod
    def of(ids: list[str], texts: pa.Array, window: int) -> Benchmark:
        data, offsets, _ = buffers(texts)
        low, starts, ends, hashes = words(data, offsets)
        raw = low.tobytes()
        uniq, at, inv = np.unique(hashes, return_index=True, return_inverse=True)
        vocabulary = [b""] + [raw[starts[k]:ends[k]] for k in at]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        by_length: dict[int, dict[tuple, set[int]]] = {}
        for k in range(len(ids)):
            seq = tuple((inv[bounds[k]:bounds[k + 1]] + 1).tolist())
            size = min(window, len(seq))
            for p in range(len(seq) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(seq[p:p + size], set()).add(k)
        windows = []
        for size, found in sorted(by_length.items()):
            owners = [sorted(v) for v in found.values()]
            windows.append((np.array(list(found), np.int64), np.concatenate([[0], np.cumsum([len(v) for v in owners])]),
                            np.concatenate(owners)))
        return Benchmark(uniq, vocabulary, windows, ids)


@dataclass
class Runs:
    """Vocabulary numbers of the runs that may hold a window, and where each word stands."""

    symbols: list
    row: list
    word: list
    start: list
    end: list


def _candidate_runs(data, offsets, lookup: Lookup, b: Benchmark, least: int, n_words: np.ndarray):
    """(symbols, row, word number, start, end) of words in long enough runs; row -1 parts runs."""
    out = [[], [], [], [], []]
    pending = None  # words of a long text's earlier pieces that may go on
    for i, j, offs in word_pieces(data, offsets):
        part = data[offs[0]:offs[-1]]
        local = offs - offs[0]
        low, starts, ends, hashes = words(part, local)
        if not len(starts):
            continue  # a gap; the pending run may go on behind it
        ids, known = lookup.get(hashes)
        row = np.searchsorted(local, starts, side="right") - 1 + i
        count = np.bincount(row - i, minlength=j - i)
        number = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count) + n_words[row]
        n_words[i:j] += count
        block = [np.where(known, ids, 0).astype(np.int64), row, number, starts + offs[0], ends + offs[0]]
        if pending is not None and len(block[1]) and pending[1][-1] == block[1][0]:
            block = [np.concatenate([x, y]) for x, y in zip(pending, block)]
        elif pending is not None:
            _keep(pending, out, least, data, b)
        pending = None
        more = offs[-1] < offsets[j]
        if more and len(block[0]):
            tail = np.flatnonzero(block[0] == 0)
            cut = int(tail[-1]) + 1 if len(tail) else 0
            if cut < len(block[0]):
                pending = [x[cut:] for x in block]
            block = [x[:cut] for x in block]
        _keep(block, out, least, data, b)
    if pending is not None:
        _keep(pending, out, least, data, b)
    if not out[0]:
        return None
    return [np.concatenate(x) for x in out]


def _keep(block, out, least: int, data: np.ndarray, b: Benchmark) -> None:
    """Append the runs of known words that have at least ``least`` words, each closed by a separator."""
    ids, row = block[0], block[1]
    if not len(ids):
        return
    known = ids > 0
    same = np.concatenate([[False], known[1:] & known[:-1] & (row[1:] == row[:-1])])
    run = np.cumsum(~same)
    size = np.bincount(run)
    good = known & (size[run] >= least)
    at = np.flatnonzero(good)
    if not len(at):
        return
    ids = ids.copy()
    for k in at.tolist():  # the hash named the word; its bytes decide
        if WORD_MAP[data[block[3][k]:block[4][k]]].tobytes() != b.vocabulary[ids[k]]:
            ids[k] = 0
    ends = np.flatnonzero(np.append(run[at[1:]] != run[at[:-1]], True)) + 1
    for col, (x, sep) in enumerate(((ids, 0), (row, -1), (block[2], -1), (block[3], -1), (block[4], -1))):
        out[col].append(np.insert(x[at], ends, sep))


def find(column: pa.Array, b: Benchmark, lookup: Lookup, p: DecontaminationParams, n_words: np.ndarray):
    """Hits in a shard: (row, word number, byte start, byte end) of hit words, and (row, item) pairs."""
    data, offsets, _ = buffers(column)
    least = min((len(w[0][0]) for w in b.windows), default=p.window)
    got = _candidate_runs(data, offsets, lookup, b, least, n_words)
    none = np.zeros((0, 2), np.int64)
    if got is None or not b.windows:
        return np.zeros((0, 4), np.int64), none
    symbols, row, number, start, end = got
    index = FMIndex(symbols, len(b.vocabulary), p.sample_rate)
    marks = np.zeros(len(symbols) + 1, np.int64)
    pairs = []
    for patterns, item_at, items in b.windows:
        lo, hi = index.search(patterns)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        if not len(which):
            continue
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        at = index.locate(rows)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + patterns.shape[1], -1)
        seen = np.unique(np.column_stack([row[at], which]), axis=0)
        n = item_at[seen[:, 1] + 1] - item_at[seen[:, 1]]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(item_at[seen[:, 1]], n)
        pairs.append(np.column_stack([np.repeat(seen[:, 0], n), items[k]]))
    hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    return (np.column_stack([row[hit], number[hit], start[hit] - offsets[row[hit]], end[hit] - offsets[row[hit]]]),
            np.unique(np.concatenate(pairs), axis=0) if pairs else none)


def _merge(old: list[int], hits: np.ndarray) -> list[int]:
    """Runs (first word, end word, first byte, end byte, flattened) with the hit words added."""
    runs = [tuple(old[k:k + 4]) for k in range(0, len(old), 4)] + [(w, w + 1, s, e) for w, s, e in hits.tolist()]
    out: list[list[int]] = []
    for w0, w1, s, e in sorted(runs):
        if out and w0 <= out[-1][1]:
            if w1 > out[-1][1]:
                out[-1][1], out[-1][3] = w1, e
        else:
            out.append([w0, w1, s, e])
    return [x for r in out for x in r]


def benchmark_blocks(bench: DataFrame, p: DecontaminationParams) -> Iterator[Benchmark]:
    """The query set in blocks of about ``block_chars``."""
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // p.block_chars))
    for k in range(n):
        rows = (bench.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(n)) == k))
                .select(F.col("item_id").cast("string").alias("item_id"), "text").toArrow())
        ids = ["" if v is None else v for v in rows.column("item_id").to_pylist()]
        yield Benchmark.of(ids, rows.column("text"), p.window)


def mark(docs: DataFrame, bench: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` with _n_words, _runs (hit runs, four numbers each: words, then bytes) and _items of every row."""
    per_batch(docs.sparkSession, 2000)
    out = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_runs": F.array().cast("array<long>"),
                            "_items": F.array().cast("array<string>")})
    for block in benchmark_blocks(bench, p):
        out = out.mapInArrow(_marker(block, p), out.schema)
    return out


def _marker(b: Benchmark, p: DecontaminationParams):
    def run(batches):
        lookup = Lookup(b.hashes, np.arange(1, len(b.hashes) + 1))
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            hits, pairs = find(batch.column("text"), b, lookup, p, n_words)
            runs = batch.column("_runs").to_pylist()
            items = batch.column("_items").to_pylist()
            for block, use in ((hits, "runs"), (pairs, "items")):
                at = np.flatnonzero(np.diff(block[:, 0], prepend=-1)) if len(block) else []
                for lo, hi in zip(at, [*at[1:], len(block)]):
                    r = int(block[lo, 0])
                    if use == "runs":
                        runs[r] = _merge(runs[r], block[lo:hi, 1:])
                    else:
                        items[r] = sorted({*items[r], *(b.items[k] for k in block[lo:hi, 1])})
            for name, values in (("_n_words", n_words), ("_runs", runs), ("_items", items)):
                k = batch.schema.get_field_index(name)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
            yield batch
    return run


def _n_hit():
    step = F.sequence(F.lit(0), F.size("_runs") - 4, F.lit(4))
    return F.when(F.size("_runs") == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(step, F.lit(0).cast("long"), lambda a, k: a + F.get("_runs", k + 1) - F.get("_runs", k)))


def decontaminate(docs: DataFrame, bench: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """Clean rows of ``docs``: contaminated ones go, and the others lose their hit runs (n_chars follows)."""
    keep = docs.columns
    rows = mark(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), bench, p)
    rows = rows.filter(~((_n_hit() > 0) & (p.share * _n_hit() >= F.col("_n_words"))))
    # byte ranges that stay, cut and joined on the binary form of the text
    raw = F.col("text").cast("binary")
    starts = F.transform(F.sequence(F.lit(0), F.size("_runs") - 4, F.lit(4)), lambda k: k)
    parts = F.transform(starts, lambda k: F.substr(
        raw, (F.when(k == 0, F.lit(0)).otherwise(F.get("_runs", k - 1)) + 1).cast("int"),
        (F.get("_runs", k + 2) - F.when(k == 0, F.lit(0)).otherwise(F.get("_runs", k - 1))).cast("int")).cast("string"))
    rest = F.substr(raw, (F.element_at("_runs", -1) + 1).cast("int"), F.octet_length(raw)).cast("string")
    text = F.when(F.size("_runs") == 0, F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    rows = rows.select(F.col("doc"), text.alias("text"))
    out = []
    for c in keep:
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("doc").getField(c).alias(c))
    return rows.select(*out)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    p = DecontaminationParams()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = mark(documents(spark, sf_dir).select("doc_id", "text"), bench, p)
    rows = rows.select("doc_id", F.col("_n_words").alias("n_words"), _n_hit().alias("n_hit"), "_items")
    return rows.select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (p.share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
