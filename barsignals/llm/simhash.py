"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints are the majority bits of the hashes of 3-word shingles. Distinct
fingerprints within ``radius`` bits are linked. The comparison is exact and tiled:
of ``blocks`` bit blocks (radius + 2 unless stated), two linked fingerprints agree in
all but ``radius`` at least, so fingerprints meet by the values of every choice of
blocks - radius blocks (radius 3: 10 choices of two blocks, about 25 bits each; with 6
blocks 20 choices of 32 bits: more rows, smaller groups). Inside a value, tiles of
fingerprints ordered by population count are compared by exclusive-or, and tile pairs
whose population counts differ beyond the radius are skipped, for they cannot hold a
link. A value with more than ``tile`` fingerprints is split into tiles by population
count and hash, and each pair of tiles is a row of its own, so no group meets in one
task. A tile pair gives a spanning forest of its links, not all of them, which leaves
the classes the same.

NULL texts, empty texts and texts without words have fingerprint zero and link like
any other. Very long texts are hashed whole, in pieces of about 1 MiB cut between words.
Equal rows share a class. A class whose ids are all NULL has id NULL.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import buffers, documents, per_batch, staged
from barsignals.llm.components import components

# Fixed values of the contract.
SHINGLE, SEED, RADIUS = 3, 42, 3

TILE = 1024
SPREAD = 16
_PIECE = 1 << 20
_GAP = re.compile(rb"[ \t-\r]")


def _bit_sums(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the words' shingles, and their number."""
    n = len(words) - SHINGLE + 1
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE - 1:].tolist())), np.uint64, n)
    sums = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k:k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int32)
    return sums, n


def fingerprint(text: bytes) -> int:
    """Majority bits over the hashes of all shingles (A-Z lower-cased)."""
    sums, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        end = at + _PIECE
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= SHINGLE:
            s, k = _bit_sums(words)
            sums, n = sums + s, n + k
        carry = words[-(SHINGLE - 1):]
    if n == 0:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).astype(np.int64), pa.int64())


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` (its text column named ``text``) without the text, plus ``fp``."""
    per_batch(docs.sparkSession, 2000)
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            data, offsets, _ = buffers(b.column("text"))
            raw = data.tobytes()
            fps = [fingerprint(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [_signed(fps)], rest + ["fp"])

    return docs.mapInArrow(run, schema)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between two tiles connect (each node to its least one)."""
    near = _near(a, b, radius)
    i, j = np.nonzero(near)
    if not len(i):
        return a[:0], a[:0]
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[:len(a)][i], inv[len(a):][j]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _small_groups(values: np.ndarray, starts: np.ndarray, radius: int):
    """Links inside many small groups at once: each value against the k-th after it."""
    size = np.diff(starts)
    left = np.repeat(starts[1:], size) - np.arange(len(values))
    out_u, out_v = [], []
    for k in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(left > k)
        hit = at[np.bitwise_count(values[at] ^ values[at + k]) <= radius]
        out_u.append(values[hit])
        out_v.append(values[hit + k])
    return out_u, out_v


def _tiled(values: np.ndarray, radius: int, tile: int = 256):
    """Links inside one group: tiles by population count, pairs beyond the radius skipped."""
    count = np.bitwise_count(values).astype(np.int64)
    by = np.argsort(count, kind="stable")
    values, count = values[by], count[by]
    for s in range(0, len(values), tile):
        e = min(len(values), s + tile)
        for t in range(s, len(values), tile):
            if count[t] - count[e - 1] > radius:
                break
            yield forest(values[s:e], values[t:t + tile], radius)


def _inside(radius: int):
    def run(batches):
        for b in batches:
            lists = b.column("fps")
            starts = lists.offsets.to_numpy().astype(np.int64)
            values = lists.flatten().to_numpy().astype(np.uint64)
            starts = starts - starts[0]
            small = np.diff(starts) <= 32
            us, vs = [], []
            if small.any():
                keep = np.repeat(small, np.diff(starts))
                us, vs = _small_groups(values[keep], np.concatenate([[0], np.cumsum(np.diff(starts)[small])]), radius)
            for g in np.flatnonzero(~small).tolist():
                for u, v in _tiled(values[starts[g]:starts[g + 1]], radius):
                    us.append(u)
                    vs.append(v)
            yield _edges(us, vs)
    return run


def _across(radius: int):
    def run(batches):
        for b in batches:
            us, vs = [], []
            for x, y in zip(b.column("a"), b.column("b")):
                for s, t in _blocks(np.array(x.values, np.int64).astype(np.uint64), np.array(y.values, np.int64).astype(np.uint64)):
                    u, v = forest(s, t, radius)
                    us.append(u)
                    vs.append(v)
            yield _edges(us, vs)
    return run


def _blocks(a: np.ndarray, b: np.ndarray, tile: int = 256):
    for s in range(0, len(a), tile):
        for t in range(0, len(b), tile):
            yield a[s:s + tile], b[t:t + tile]


def _edges(us: list, vs: list) -> pa.RecordBatch:
    u = np.concatenate(us) if us else np.zeros(0, np.uint64)
    v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - radius blocks: within the radius, one choice agrees at least."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    part = [(1 << e) - (1 << s) for s, e in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(part, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) that connect all distinct values of ``fp`` within ``radius`` bits of each other."""
    nodes = fps.select("fp").distinct()
    # a hash of the agreeing bits: a collision only brings more candidates together
    key = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m)))
                    for k, m in enumerate(_masks(radius, blocks or radius + 2))])
    keyed = staged(nodes.select("fp", F.bit_count("fp").alias("pc"), F.explode(key).alias("key")), "simhash-keys")
    parts = keyed.groupBy("key", "pc").agg(F.count("*").alias("n"))
    hot = parts.groupBy("key").agg(F.sum("n").alias("total")).filter(F.col("total") > tile).select("key")
    cold = (keyed.join(hot, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("fps"))
            .filter(F.size("fps") > 1).select("fps"))
    found = cold.mapInArrow(_inside(radius), "u long, v long")
    # the fingerprints of a hot (key, pc) meet their number of tiles in SPREAD join groups
    cut = parts.join(hot, "key", "left_semi").select(
        "key", "pc", F.ceil(F.col("n") / tile).alias("cuts"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("s"))
    spread = keyed.withColumns({"h": F.xxhash64("fp"), "s": F.pmod(F.xxhash64(F.lit(SPREAD), F.col("fp")), F.lit(SPREAD)).cast("int")})
    tiles = staged(spread.join(cut, ["key", "pc", "s"]).withColumn("salt", F.pmod("h", F.col("cuts")))
                   .groupBy("key", "pc", "salt").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    one = tiles.select("key", F.col("pc").alias("pa"), F.col("salt").alias("sa"))
    two = tiles.select("key", F.col("pc").alias("pb"), F.col("salt").alias("sb"))
    pairs = one.join(two, "key").filter(
        F.col("pb").between(F.col("pa"), F.col("pa") + radius)
        & ((F.col("pa") < F.col("pb")) | (F.col("sa") <= F.col("sb"))))
    a = tiles.select("key", F.col("pc").alias("pa"), F.col("salt").alias("sa"), F.col("fps").alias("a"))
    b = tiles.select("key", F.col("pc").alias("pb"), F.col("salt").alias("sb"), F.col("fps").alias("b"))
    compared = pairs.join(a, ["key", "pa", "sa"]).join(b, ["key", "pb", "sb"]).select("a", "b")
    return found.unionAll(compared.mapInArrow(_across(radius), "u long, v long"))


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint, named by its least fingerprint."""
    found = components(links(fps, radius), "simhash-edges")
    nodes = fps.select("fp").distinct()
    return nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    fps = staged(with_fingerprint(documents(spark, sf_dir).select("doc_id", "text")), "simhash")
    named = staged(classes(fps), "simhash-classes")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = named.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class of ``docs``: the least id (NULL last), of these the least fingerprint.

    Rows that share id and text count as repeated; one of them stays. Texts are
    fingerprinted once; the rows that stay are found again by their id and text hash.
    """
    mark = F.xxhash64("text")
    rows = docs.select("doc_id", "text", mark.alias("th"))
    fps = staged(with_fingerprint(rows), "simhash")
    named = classes(fps, radius)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"), F.col("th")))
    kept = (named.join(fps.groupBy("fp").agg(first.alias("k")), "fp").groupBy("root").agg(F.min("k").alias("k"))
            .select(F.col("k.doc_id").alias("kid"), F.col("k.th").alias("kth")))
    kept = staged(kept, "simhash-kept")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), mark.alias("th"))
    found = rows.join(kept, F.col("th").eqNullSafe(F.col("kth")) & F.col("id").eqNullSafe(F.col("kid")))
    found = found.dropDuplicates(["kth", "kid"])
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
