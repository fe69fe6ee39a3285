"""Helpers shared by the training-data operators: folds, Arrow text buffers, staged tables.

Operators read only the columns they name, so extra columns (also ones that share a
name with a result column) never clash. ``doc_id`` may be NULL (then in no training
fold) and texts may be NULL, empty or very long; each operator states its results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL id: NULL)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def not_in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, modulus) != remainder, F.lit(False))


def per_batch(spark: SparkSession, rows: int, size: int = 1 << 26) -> None:
    """Most rows and about the most bytes of one Arrow batch (a longer text is a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where unset, one in its warehouse."""
    sc = spark.sparkContext
    return (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
            or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage).

    The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is valid) of a string column; NULL has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0], valid


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(offsets: np.ndarray, halo: int, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first row, end row, offsets, own) to walk all texts in bounded memory.

    A text longer than ``limit`` comes in several pieces of one row; each but the
    last reads ``halo`` bytes past the ``own`` start positions that belong to it.
    """
    for i, j in chunks(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * limit:
            yield i, j, offsets[i:j + 1], hi - lo
            continue
        for s in range(lo, hi, limit):
            yield i, j, np.array([s, min(hi, s + limit + halo)]), min(limit, hi - s)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [offsets[i], offsets[i+1]); empty ranges give 0."""
    out = np.zeros(len(offsets) - 1, np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.float64)
    return out


def _byte_map() -> np.ndarray:
    """A-Z to a-z, other ASCII but letters to a space, the rest as it is."""
    m = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        m[b] = ord(c.lower()) if c.isalpha() else 32
    return m


LETTERS = _byte_map()


def sample_key() -> Column:
    """What a sample of documents is chosen by: the id, or where it is NULL the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def rate_filter(key: Column, rate: Column, seed: int) -> Column:
    """Keep a row with probability ``rate`` by a hash of its key (the same rows each run)."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < rate * float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, eligible: Column, per_class: dict[int, int],
                    seed: int, name: str) -> DataFrame:
    """Bounded sample of labelled rows: text, label, weight (rows that one sampled row stands for), order.

    About ``per_class[k]`` rows of each label, chosen by a hash of the id, so the
    broadcast side has that many rows whatever the input. ``eligible`` reads doc_id.
    A document labelled twice counts once, with its larger label.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(list(per_class)) & eligible)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for k, n in sizes.items():
        rate = F.when(F.col("label") == k, min(1.0, per_class[k] / n)).otherwise(rate)
    chosen = known.withColumn("rate", rate).filter(rate_filter(F.col("doc_id"), F.col("rate"), seed))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("rate").alias("rate"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return staged(rows.select(F.coalesce("text", F.lit("")).alias("text"), "label", (1 / F.col("rate")).alias("weight"),
                              F.xxhash64(F.lit(seed + 1), "doc_id").alias("order")), name)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Lookup:
    """Exact vectorised map from uint64 keys to floats: one slot per hash, the rest sorted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        rest = np.ones(len(keys), bool)
        rest[first] = False
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, np.float32)
        self.shared = np.zeros(1 << self.bits, bool)
        self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
        self.shared[slot[rest]] = True
        by = np.argsort(keys[rest])
        self.more, self.more_values = keys[rest][by], values[rest][by].astype(np.float32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        slot = self._slot(keys)
        found = self.keys[slot] == keys
        out = np.where(found, self.values[slot], np.float32(0))
        again = np.flatnonzero(~found & self.shared[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.more, keys[again]), len(self.more) - 1)
            hit = self.more[at] == keys[again]
            out[again[hit]], found[again[hit]] = self.more_values[at[hit]], True
        return out, found
