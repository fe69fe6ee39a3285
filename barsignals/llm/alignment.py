"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes; a token of one and a token of the other are linked
where their byte ranges overlap, and offsets where both end cut a text into groups. The
ends of both are merged: binary searches on diagonals of the merge divide it into pieces
of equal work that need nothing of each other; each piece emits its overlaps and the
common ends in it, and what crosses a piece's edge is stitched into groups afterwards.

Texts are read with one leading space, which the second tokenizer adds itself. They are
cut before single spaces between characters that aren't white, where both tokenizers end
a token whatever surrounds it, so each distinct stretch is encoded and aligned once.

NULL and empty texts, and texts that a tokenizer does not give back byte by byte (as
U+2581, which the second one reads as a space), have no tokens: zeros and an empty
digest. Texts of any length are read whole. Special tokens' strings are plain text.
Repeated rows have equal results and count as documents of their own; a NULL id stays.
An empty table gives no rows; extra columns are not read. Ties for the highest count of
a first-tokenizer id all count as best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsignals.llm.common import buffers, chunks, documents, per_batch, staged

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"


@dataclass(frozen=True)
class AlignParams:
    byte_level: str = BYTE_LEVEL
    pieces: str = PIECES
    work: int = 65536  # ends that one piece of the merge holds
    held: int = 400_000  # distinct stretches that a task remembers, about
    frequent: int = 1 << 18  # commonest pairs whose counts go to every task; the others meet theirs in a join
    batch: int = 1000


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-path split points: (i, j) on every ``work``-th diagonal of the merge of two sorted arrays (ties: a first)."""
    n, m = len(a), len(b)
    d = np.append(np.arange(0, n + m, work), n + m)
    lo, hi = np.maximum(d - m, 0), np.minimum(d, n)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        take = np.zeros(len(d), bool)
        take[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        lo, hi = np.where(open_ & take, mid + 1, lo), np.where(open_ & ~take, mid, hi)
    return lo, d - lo


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common) of the ends that the piece holds: the two tokens there, and whether both end.

    Each end closes one stretch of bytes that lies in one token of each side: one
    overlap. An end of both is emitted with ``a``, which may be in the piece before.
    """
    x, y = a[i0:i1], b[j0:j1]
    j = j0 + np.searchsorted(y, x, "left")
    common = b[j] == x
    i = i0 + np.searchsorted(x, y, "left")
    own = np.ones(len(y), bool)
    inside = i < i1
    own[inside] = a[i[inside]] != y[inside]
    if i0 and len(y) and a[i0 - 1] == y[0]:
        own[0] = False
    return (np.concatenate([np.arange(i0, i1), i[own]]), np.concatenate([j, np.arange(j0, j1)[own]]),
            np.concatenate([common, np.zeros(int(own.sum()), bool)]))


def overlaps(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of all overlapping tokens in order, and (i, j) of the tokens that end a group, of two arrays of ends.

    Both arrays must end with the same end.
    """
    at_a, at_b = diagonals(a, b, work)
    parts = [piece(a, b, *edges) for edges in zip(at_a[:-1].tolist(), at_a[1:].tolist(), at_b[:-1].tolist(), at_b[1:].tolist())]
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    i, j, common = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(np.minimum(a[i], b[j]), kind="stable")  # the ends by which they were emitted
    i, j, common = i[order], j[order], common[order]
    return i, j, i[common], j[common]


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary file (added tokens: their own text)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    out = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def piece_tokens(model) -> list[bytes]:
    """Bytes of every id of a piece vocabulary."""
    out = []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        out.append(bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace(SPACE_MARK, " ").encode())
    return out


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _csr(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Integer lists as (flat, offsets)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
    return flat, np.concatenate([[0], np.cumsum(size)])


def _take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a CSR array, as (flat, sizes)."""
    size = offsets[rows + 1] - offsets[rows]
    total = np.cumsum(size)
    n = int(total[-1]) if len(total) else 0
    return flat[np.arange(n) + np.repeat(offsets[rows] - total + size, size)], size


def _joined(ids: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, byte offsets of the rows)."""
    data, size = _take(*table, ids)
    ends = np.concatenate([[0], np.cumsum(size)])
    return data, ends[at]


def white_edges(t: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two characters that surely are not white (UTF-8 bytes)."""
    at = np.flatnonzero(t[1:-1] == 32) + 1
    ascii_ok = lambda c: (c > 32) & (c < 127)
    before, after = t[at - 1], t[at + 1]
    # white characters beyond ASCII start with the bytes C2, E1, E2 or E3
    end2, end3 = t[np.maximum(at - 2, 0)], t[np.maximum(at - 3, 0)]
    odd = lambda c: (c == 0xC2) | (c == 0xE1) | (c == 0xE2) | (c == 0xE3)
    ok = ascii_ok(before) | ((before >= 0x80) & ~odd(end2) & ~odd(end3))
    return at[ok & (ascii_ok(after) | ((after >= 0xC3) & ~odd(after)))]


class Aligner:
    """Encodes and aligns distinct stretches, and remembers them for later texts of the same task."""

    def __init__(self, p: AlignParams):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers
        self.p = p
        self.one = tokenizers.Tokenizer.from_file(p.byte_level)
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_file=p.pieces)
        pieces = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        # a piece with a space behind another character could reach over a cut
        self.cuts = not any(SPACE_MARK in x[1:] and x.strip(SPACE_MARK) for x in pieces)
        self.table_one, self.table_two = _table(byte_level_tokens(p.byte_level)), _table(piece_tokens(self.two))
        self.width = len(pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_one = self.n_two = self.n_groups = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.text: list[str] = []
        self.pairs, self.pair_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        one, two = [], []
        for k in range(0, len(new), 8192):  # an encoding object is large
            part = [s.decode() for s in new[k:k + 8192]]
            one += [e.ids for e in self.one.encode_batch_fast(part, add_special_tokens=False)]
            two += self.two.encode([s[1:] for s in part], num_threads=1)
        (a, a_at), (b, b_at) = _csr(one), _csr(two)
        data = np.frombuffer(b"".join(new), np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])
        # no tokenizer adds bytes, so a text with a stretch that isn't given back isn't either
        fits = np.ones(len(new), bool)
        for ids, id_at, table in ((a, a_at, self.table_one), (b, b_at, self.table_two)):
            back, back_at = _joined(ids, id_at, table)
            fits &= np.diff(back_at) == np.diff(at)
            same = np.flatnonzero(fits)
            (x, size), (y, _) = _take(back, back_at, same), _take(data, at, same)
            differ = np.concatenate([[0], np.cumsum(x != y)])
            ends = np.cumsum(size)
            fits[same] = differ[ends] == differ[ends - size]
        good = np.flatnonzero(fits)
        (a, na), (b, nb) = _take(a, a_at, good), _take(b, b_at, good)
        ends = lambda ids, table: np.cumsum(table[1][ids + 1] - table[1][ids])
        i, j, group_i, group_j = overlaps(ends(a, self.table_one), ends(b, self.table_two), self.p.work)
        row_a = np.repeat(np.arange(len(good)), na)
        n_links = np.bincount(row_a[i], minlength=len(good))
        n_groups = np.bincount(row_a[group_i], minlength=len(good))
        texts = self._group_text(a, b, group_i, group_j, np.cumsum(n_groups))
        spread = lambda v: np.bincount(good, weights=v, minlength=len(new)).astype(np.int64)
        first = len(self.fits)
        self.known.update(zip(new, range(first, first + len(new))))
        self.fits = np.append(self.fits, fits)
        self.n_one, self.n_two = np.append(self.n_one, spread(na)), np.append(self.n_two, spread(nb))
        self.n_groups = np.append(self.n_groups, spread(n_groups))
        mine = [""] * len(new)
        for k, t in zip(good.tolist(), texts):
            mine[k] = t
        self.text += mine
        self.pairs = np.append(self.pairs, a[i] * self.width + b[j])
        self.pair_at = np.append(self.pair_at, self.pair_at[-1] + np.cumsum(spread(n_links)))

    @staticmethod
    def _group_text(a: np.ndarray, b: np.ndarray, group_i: np.ndarray, group_j: np.ndarray, upto: np.ndarray) -> list[str]:
        """Of each row (its groups are numbers up to ``upto``): ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.searchsorted(group_i, np.arange(len(a))), np.searchsorted(group_j, np.arange(len(b)))
        sign_a, sign_b = np.full(len(a), 0), np.full(len(b), 0)  # what follows a token
        sign_a[group_i], sign_b[group_j] = 1, 2
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = [w + ",|;"[s] for w, s in zip(map(str, np.concatenate([a, b])[order].tolist()), np.concatenate([sign_a, sign_b])[order].tolist())]
        ends = np.searchsorted(np.concatenate([2 * group_a, 2 * group_b + 1])[order], 2 * upto - 1, "right").tolist()
        return ["".join(words[s:e])[:-1] for s, e in zip([0, *ends[:-1]], ends)]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known stretch of each place, number of stretches by text); empty texts have none."""
        local = offsets - offsets[0]
        full = np.flatnonzero(np.diff(local) > 0)
        t = np.insert(data[offsets[0]:offsets[-1]], local[full], 32)
        text_at = local[full] + np.arange(len(full))
        starts = text_at
        if self.cuts and len(t):
            edges = white_edges(t)
            starts = np.union1d(text_at, edges)
        counts = np.zeros(len(offsets) - 1, np.int64)
        counts[full] = np.diff(np.append(np.searchsorted(starts, text_at), len(starts)))
        bounds = np.append(starts, len(t)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(t)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.known]
        if len(self.known) + len(new) > self.p.held:
            self._forget()
            new = distinct
        if new:
            self._learn(new)
        at = np.fromiter((self.known[s] for s in distinct), np.int64, len(distinct))
        return at[coded.indices.to_numpy(zero_copy_only=False)], counts

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs with their numbers, of each text."""
        at, counts = self.rows(data, offsets)
        n = len(counts)
        cut = np.concatenate([[0], np.cumsum(counts)])
        of = np.repeat(np.arange(n), counts)
        total = lambda v, rows: np.bincount(of, weights=v[rows], minlength=n).astype(np.int64)
        good = (total(~self.fits, at) == 0) & (counts > 0)
        link, size = _take(self.pairs, self.pair_at, at)
        link_of = np.repeat(of, size)
        kept = good[link_of]
        key, times = np.unique(link_of[kept] * (1 << 40) + link[kept], return_counts=True)
        per = np.bincount(key >> 40, minlength=n)
        text = self.text
        digests = []
        for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            whole = ";".join([text[x] for x in at[s:e].tolist()]) if good[k] else None
            digests.append("" if whole is None else hashlib.sha256(whole.encode()).hexdigest())
        return {"n_a": total(self.n_one, at) * good, "n_b": total(self.n_two, at) * good, "n_groups": total(self.n_groups, at) * good,
                "n_links": np.bincount(link_of[kept], minlength=n), "groups_sha256": digests,
                "pairs": key & ((1 << 40) - 1), "times": times, "pair_at": np.concatenate([[0], np.cumsum(per)])}


def aligned(docs: DataFrame, p: AlignParams = AlignParams()) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs (first id * size of the
    second vocabulary + second id) with how often the text links them."""
    per_batch(docs.sparkSession, p.batch)
    size = len(byte_level_tokens(p.byte_level)) * _vocabulary_size(p.pieces)
    kind = "int" if size < 1 << 31 else "long"
    names = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]):
        aligner = Aligner(p)
        ints = np.int32 if kind == "int" else np.int64
        for b in batches:
            data, offsets, _ = buffers(b.column("text"))
            for s, e in chunks(offsets):
                x = aligner.texts(data, offsets[s:e + 1])
                at = pa.array(x["pair_at"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid").slice(s, e - s), b.column("doc_id").slice(s, e - s), *[pa.array(x[c]) for c in names[2:6]],
                     pa.array(x["groups_sha256"], pa.string()), pa.ListArray.from_arrays(at, pa.array(x["pairs"].astype(ints))),
                     pa.ListArray.from_arrays(at, pa.array(x["times"].astype(np.int32)))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                f"pairs array<{kind}>, times array<int>")


def _vocabulary_size(path: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def pair_counts(rows: DataFrame, p: AlignParams = AlignParams()) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its first id has more)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # a window group holds one id's pairs: never more than the second vocabulary has ids
    of_first = Window.partitionBy(F.floor(F.col("pair") / F.lit(_vocabulary_size(p.pieces))))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_first))


def _commonest(counts: DataFrame, most: int) -> dict[str, np.ndarray]:
    """The commonest pairs with their counts in order, at most ``most`` of them."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for lv, k in sizes:
        total += k
        if total > most:
            break
        least = lv
    got = counts.withColumn("level", level).filter(F.col("level") >= (least if least is not None else 1 << 30)).orderBy("pair").toArrow()
    return {c: got.column(c).to_numpy() for c in ("pair", "n", "best")}


def linked_counts(rows: DataFrame, counts: DataFrame, p: AlignParams = AlignParams()) -> DataFrame:
    """rid, n_best, count_sum of every row: over its links, those that are best and the sum of the pairs' counts.

    Every task holds the commonest pairs; the others, each of few documents, meet their
    counts in a join that has no hot keys.
    """
    common = _commonest(counts, p.frequent)
    names = ["rid", "pair", "times", "n_best", "count_sum"]
    kind = rows.schema["pairs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        key, n, best = common["pair"], common["n"].astype(np.int64), common["best"]
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            size = pairs.value_lengths().to_numpy(zero_copy_only=False)
            flat = pairs.flatten().to_numpy()
            of = np.repeat(np.arange(len(b)), size)
            at = np.minimum(np.searchsorted(key, flat), max(len(key) - 1, 0))
            hit = key[at] == flat if len(key) else np.zeros(len(flat), bool)
            sums = np.zeros((2, len(b)), np.int64)
            np.add.at(sums[0], of[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], of[hit], times[hit] * n[at[hit]])
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.nulls(len(b), flat_type), pa.nulls(len(b), pa.int64()),
                                              pa.array(sums[0]), pa.array(sums[1])], names)
            rare = np.flatnonzero(~hit)
            if len(rare):
                none = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(of[rare])), pa.array(flat[rare], flat_type), pa.array(times[rare]),
                                                  none, none], names)

    flat_type = pa.int32() if kind == "int" else pa.int64()
    per_batch(rows.sparkSession, p.batch)
    part = staged(rows.select("rid", "pairs", "times").mapInArrow(run, f"rid long, pair {kind}, times long, n_best long, count_sum long"), "links")
    rare = part.filter(F.col("pair").isNotNull()).select("rid", "pair", "times").join(counts, "pair")
    rare = rare.select("rid", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    known = part.filter(F.col("pair").isNull()).select("rid", "n_best", "count_sum")
    return known.unionAll(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the two vocabularies over every document, with corpus-wide counts of the linked pairs."""
    rows = staged(aligned(documents(spark, sf_dir)), "aligned")  # once: row numbers must not change between uses
    counts = staged(pair_counts(rows), "pairs")
    out = rows.drop("pairs", "times").join(linked_counts(rows, counts), "rid")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
