"""Suffix-array deduplication: bytes covered by long strings that also start elsewhere.

The test itself is threshold-bounded interval expansion: a breadth-first backward
extension on a Burrows-Wheeler transform derives common-prefix values in increasing
order and stops at the least length, so every boundary still open then joins suffixes
that share at least ``length`` bytes (``open_boundaries``).

Spark first brings together only what can match. Every window of ``length`` bytes is
represented by its anchor, the ``gram``-byte string in it with the least hash, so equal
windows have equal anchors at equal offsets. Windows of one text that share an anchor
form a range. Anchors that occur once are done. Ranges whose whole byte segment occurs
again are repeated entirely, whatever the number of copies. The other ranges of an
anchor (one for each distinct segment) are cut from the texts and meet in one
transform. An anchor with more than ``group`` distinct segments is split by longer
strings around narrower ranges (``_narrow``) until its groups are small enough; a
range of a single window is decided by its own bytes. So no group outgrows a task and
none is cut short.

NULL texts count as empty. Texts shorter than ``length`` keep all their bytes. Equal
rows are copies of each other. Ids may be NULL or repeated: ranges belong to the pair
of id and text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import buffers, documents, per_batch, pieces, staged


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400
    gram: int = 200  # bytes of an anchor
    group: int = 256  # distinct segments of an anchor that meet in one transform
    block: int = 1 << 20  # bytes of segments in one transform, about
    common: int = 1000  # a segment of over 1 / common of all ranges is looked up without a shuffle


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from running minima of fixed blocks."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def ranges(data: np.ndarray, offsets: np.ndarray, own: int, p: RepeatParams, power: np.ndarray, inverse: np.ndarray):
    """(row, first window, last window, anchor, anchor's hash, segment's hash) of each range in a piece."""
    n, width = len(data), p.length - p.gram + 1
    ends = np.minimum(offsets[1:] - p.length, offsets[:-1] + own - 1 if len(offsets) == 2 else offsets[1:])
    rows = np.flatnonzero(ends >= offsets[:-1])
    if not len(rows):
        return None
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * power[:n], out=total[1:])
    gram = _mix((total[p.gram:] - total[:-p.gram]) * inverse[:n - p.gram + 1])
    place = np.arange(len(gram), dtype=np.uint64)
    least = sliding_least((gram >> np.uint64(22) << np.uint64(22)) | place, width)
    anchor = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    size = ends[rows] - offsets[rows] + 1
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[rows], size)
    first = change[at]
    first[np.cumsum(size) - size] = True
    k = np.flatnonzero(first)
    lo, hi = at[k], at[np.append(k[1:], len(at)) - 1]
    segment = (total[hi + p.length] - total[lo]) * inverse[lo]
    segment = _mix(segment ^ (hi - lo).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
                   ^ (anchor[lo] - lo).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53))
    return np.repeat(rows, np.add.reduceat(first, np.cumsum(size) - size)), lo, hi, anchor[lo], gram[anchor[lo]], segment


def _range_rows(p: RepeatParams, id_type: pa.DataType):
    def run(batches):
        power, inverse = _powers(BASE, 2 * PIECE + p.length + 1), _powers(INVERSE, 2 * PIECE + p.length + 1)
        names = ["doc_id", "th", "lo", "hi", "anchor", "a", "s"]
        for b in batches:
            data, offsets, _ = buffers(b.column("text"))
            ids, hashes = b.column("doc_id"), b.column("th")
            for i, _, offs, own in pieces(offsets, p.length - 1, PIECE):
                got = ranges(data[offs[0]:offs[-1]], offs - offs[0], own, p, power, inverse)
                if got is None:
                    continue
                row, lo, hi, anchor, a, s = got
                back = offs[0] - offsets[i + row]  # positions in the text
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), hashes.take(take), *(pa.array((x + back).astype(np.int32)) for x in (lo, hi, anchor)),
                     pa.array(a.astype(np.int64)), pa.array(s.astype(np.int64))], names)
    return run


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols at least (prefix doubling from packed symbols below 512)."""
    n = len(symbols)
    key, h = np.zeros(n, np.int64), 7
    for k in range(h):
        key <<= 9
        key[:max(0, n - k)] |= symbols[k:].astype(np.int64) + 1
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if h >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[:max(0, n - h)] += rank[h:] + 1
        h *= 2


def open_boundaries(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, open): whether each suffix shares ``length`` symbols with its forerunner.

    Interval expansion: the interval of a string, extended backward by each symbol
    before it, ends at a boundary; the first string to end there is one longer than
    the common prefix across it. Strings grow by one symbol a round and stop at ``length``.
    """
    n = len(symbols)
    order = suffix_order(symbols, length + 1)
    before = symbols[order - 1]  # the transform
    to = np.empty(n, np.int64)
    to[np.argsort(before, kind="stable")] = np.arange(n)
    first = symbols[order]  # first symbol of each suffix
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        one = size == 1
        at = to[lo[one]]
        many = np.flatnonzero(~one)
        starts, ends = [at], [at + 1]
        if len(many):
            m = size[many]
            row = np.arange(int(m.sum())) + np.repeat(lo[many] - (np.cumsum(m) - m), m)
            group = np.repeat(np.arange(len(many)), m)
            v = np.sort(group * n + to[row])
            group = v // n
            v -= group * n
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (first[v[1:]] != first[v[:-1]])])
            k = np.flatnonzero(new)
            starts.append(v[k])
            ends.append(v[np.append(k[1:], len(v)) - 1] + 1)
        lo, hi = np.concatenate(starts), np.concatenate(ends)
        fresh = ~closed[hi]
        lo, hi = lo[fresh], hi[fresh]
        hi, k = np.unique(hi, return_index=True)
        lo = lo[k]
        closed[hi] = True
        if not len(lo):
            break
    return order, ~closed


def repeated_windows(segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each segment, whether each of its windows also starts elsewhere in the segments."""
    size = np.array([len(s) + 1 for s in segments])
    symbols = np.full(int(size.sum()), 256, np.int64)
    starts = np.cumsum(size) - size
    for s, at in zip(segments, starts.tolist()):
        symbols[at:at + len(s)] = s
    order, open_ = open_boundaries(symbols, length)
    twice = np.empty(len(symbols), bool)
    twice[order] = open_[:-1] | open_[1:]
    return [twice[at:at + len(s) - length + 1] for s, at in zip(segments, starts.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _decide(p: RepeatParams):
    """Sorted groups to one transform after another; gives covered byte ranges of single segments."""
    def run(batches):
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for key, doc, th, lo, single, seg in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "th", "lo", "single", "seg"))):
                if size >= p.block and key != last:
                    yield _covered(held, p)
                    held, size = [], 0
                held.append((doc, th, lo, single, np.frombuffer(seg, np.uint8)))
                size, last = size + len(seg), key
        yield _covered(held, p)
    return run


def _covered(held: list[tuple], p: RepeatParams) -> pa.RecordBatch:
    out = []
    if len(held) > 1:
        for (doc, th, lo, single, _), flags in zip(held, repeated_windows([h[4] for h in held], p.length)):
            if single:
                out += [(doc, th, lo + s, lo + e - 1 + p.length) for s, e in _runs(flags)]
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                                      ["doc_id", "th", "start", "end"])


COVER = "doc_id long, th long, start int, end int"


def _cut(batches):
    """Segments of the ranges wanted from each text."""
    for b in batches:
        data, offsets, _ = buffers(b.column("text"))
        out = []
        for r, wanted in enumerate(b.column("wanted").to_pylist()):
            at = int(offsets[r])
            out += [(w["key"], r, w["lo"], w["hi"], w["anchor"], w["single"],
                     data[at + w["lo"]:at + w["hi"] + w["length"]].tobytes()) for w in wanted]
        cols = list(zip(*out)) if out else [[]] * 7
        take = pa.array(cols[1], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), b.column("doc_id").take(take), b.column("th").take(take),
             pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()),
             pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.binary())],
            ["key", "doc_id", "th", "lo", "hi", "anchor", "single", "seg"])


def _narrow(rows: DataFrame, width: int, p: RepeatParams) -> DataFrame:
    """Ranges cut into ranges of at most ``width`` windows, keyed by the bytes that all windows of one share.

    Windows lie at ``anchor - d``; a range is the part of one with d in a block of
    ``width`` consecutive offsets. The shared bytes don't depend on where the text ends.
    """
    d0, d1 = F.col("anchor") - F.col("hi"), F.col("anchor") - F.col("lo")
    parts = rows.select("*", F.explode(F.sequence(F.floor(d0 / width), F.floor(d1 / width))).alias("part"))
    low, high = F.col("part") * width, F.col("part") * width + (width - 1)
    parts = parts.withColumns({"_lo": F.greatest(F.col("lo"), F.col("anchor") - high).cast("int"),
                               "_hi": F.least(F.col("hi"), F.col("anchor") - low).cast("int"),
                               "_core": (F.col("anchor") - low - F.col("lo") + 1).cast("int")})
    core = F.substr("seg", F.col("_core"), F.lit(p.length - width + 1))
    seg = F.substr("seg", F.col("_lo") - F.col("lo") + 1, F.col("_hi") - F.col("_lo") + p.length)
    return parts.select(F.xxhash64("key", "part", core).alias("key"), "doc_id", "th", F.col("_lo").alias("lo"),
                        F.col("_hi").alias("hi"), "anchor", "single", seg.alias("seg"))


def _whole(rows: DataFrame, p: RepeatParams) -> DataFrame:
    return rows.select("doc_id", "th", F.col("lo").alias("start"), (F.col("hi") + p.length).alias("end"))


def _of(rows: DataFrame, many: DataFrame, on: list[str], total: int, p: RepeatParams) -> DataFrame:
    """Rows whose segment is in ``many`` (with its count ``n`` of all ``total`` rows).

    Fewer than ``common`` segments can have over 1 / common of the rows each, so these go
    to every task, and no key of the join with the others has more rows than that.
    """
    is_common = F.col("n") > F.lit(total) / p.common
    common = F.broadcast(many.filter(is_common).select(*on))
    others = rows.join(common, on, "left_anti").join(many.filter(~is_common).select(*on), on, "left_semi")
    return rows.join(common, on, "left_semi").unionAll(others)


def _total(segments: DataFrame) -> int:
    return segments.agg(F.sum("n")).first()[0] or 0


def _hot(rows: DataFrame, p: RepeatParams) -> list[DataFrame]:
    """Covered ranges of the anchors with too many segments, by ever narrower ranges."""
    out, width = [], p.length - p.gram + 1
    while width > 1 and not rows.isEmpty():
        width = -(-width // 3)
        rows = staged(_narrow(rows, width, p).withColumn("s", F.xxhash64(F.lit(1), "seg", F.col("anchor") - F.col("lo"))), "repeats-narrow")
        segments = staged(rows.groupBy("key", "s").agg(
            F.count("*").alias("n"), F.min(F.col("single").cast("int")).alias("alone")), "repeats-narrow-segments")
        groups = staged(segments.groupBy("key").agg(F.count("*").alias("segments"), F.sum("n").alias("ranges"))
                        .filter("ranges > 1"), "repeats-narrow-groups")
        # a segment that occurs twice, or stands for copies, is repeated whole
        many = segments.filter((F.col("n") > 1) | (F.col("alone") == 0)).select("key", "s", "n")
        out.append(_whole(_of(rows.filter("single"), many, ["key", "s"], _total(segments), p), p))
        # one range of each segment, which stands for its copies
        rest = rows.dropDuplicates(["key", "s"]).join(groups.filter("segments > 1"), "key").drop("ranges")
        marked = rest.join(many.select("key", "s", F.lit(True).alias("twice")), ["key", "s"], "left")
        marked = marked.withColumn("single", F.col("single") & F.col("twice").isNull()).drop("twice")
        marked = staged(marked, "repeats-marked")
        if width > 1:
            out.append(_transform(marked.filter(F.col("segments") <= p.group), p))
            rows = marked.filter(F.col("segments") > p.group).drop("segments", "s")
    return out


def _transform(rows: DataFrame, p: RepeatParams) -> DataFrame:
    rows = rows.select("key", "doc_id", "th", "lo", "single", "seg")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_decide(p), COVER)


def covered(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """Distinct byte ranges (doc_id, th, start, end) of ``docs`` (doc_id, text, th) that repeat."""
    per_batch(docs.sparkSession, 2000)
    schema = "doc_id long, th long, lo int, hi int, anchor int, a long, s long"
    found = staged(docs.select("doc_id", "th", "text").mapInArrow(_range_rows(p, pa.int64()), schema), "repeats-ranges")
    # written, so that the joins with them stay splittable where one anchor has many rows
    again = staged(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "repeats-again")
    shared = staged(found.join(again, "a", "left_semi"), "repeats-shared")
    segments = staged(shared.groupBy("a", "s").agg(F.count("*").alias("n")), "repeats-segments")
    whole = _whole(_of(shared, segments.filter("n > 1"), ["a", "s"], _total(segments), p), p)
    groups = segments.groupBy("a").agg(F.count("*").alias("segments"), F.min("n").alias("fewest"))
    groups = staged(groups.filter("segments > 1 and fewest = 1").select("a", "segments"), "repeats-groups")
    one = segments.join(groups, "a").select("a", "s", "segments", (F.col("n") == 1).alias("single"))
    chosen = shared.dropDuplicates(["a", "s"]).join(one, ["a", "s"])
    wanted = chosen.groupBy("doc_id", "th").agg(F.collect_list(F.struct(
        F.col("a").alias("key"), "lo", "hi", "anchor", "single", F.lit(p.length).alias("length"))).alias("wanted"))
    # one of the rows that repeat both id and text is cut for all of them; grouped by the keys of the join, so texts move once
    keys = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("th")]
    texts = docs.groupBy(*keys).agg(F.first("text").alias("text"))
    cut = texts.join(wanted.select(*keys, "doc_id", "wanted"), ["id", "none", "th"]).select("doc_id", "th", "text", "wanted")
    cut = staged(cut.mapInArrow(_cut, "key long, doc_id long, th long, lo int, hi int, anchor int, single boolean, seg binary"), "repeats-cut")
    sizes = groups.select(F.col("a").alias("key"), "segments")
    few = cut.join(sizes.filter(F.col("segments") <= p.group), "key", "left_semi")
    out = whole.unionAll(_transform(few, p))
    for part in _hot(cut.join(sizes.filter(F.col("segments") > p.group), "key", "left_semi"), p):
        out = out.unionAll(part)
    return out.distinct()


def _finish(batches):
    """Counts and digest of the bytes that stay."""
    for b in batches:
        data, offsets, _ = buffers(b.column("text"))
        rows = []
        for r, cover in enumerate(b.column("cover").to_pylist()):
            text = data[offsets[r]:offsets[r + 1]]
            spans: list[list[int]] = []
            for c in sorted(cover or [], key=lambda c: c["start"]):
                if spans and c["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], c["end"])
                else:
                    spans.append([c["start"], c["end"]])
            digest, at = hashlib.sha256(), 0
            for s, e in spans:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            rows.append((len(text), sum(e - s for s, e in spans), len(spans), digest.hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated 400-byte strings cover, and what stays."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    cover = covered(docs).groupBy(F.col("doc_id").alias("cid"), F.col("th").alias("cth")).agg(
        F.collect_list(F.struct("start", "end")).alias("cover"))
    joined = docs.join(cover, F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
    return joined.select("doc_id", "text", "cover").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
