"""Exact top-k inner products over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key,
the table is cut into annuli (runs of one pivot's vectors between two distances) and
cells (what one task holds at once). For a query q, a vector x of an annulus around p
lies at least ``max(|q - p| - hi, lo - |q - p|, 0)`` away (triangle inequality), so with
the annulus's largest squared norm N

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + N - distance^2) / 2.

A query opens its annuli by falling bound, first one, then ``growth`` times as many in
each round, and stops when no unopened annulus reaches its k-th best score. Annuli that
could tie are opened too. Pivots come from a bounded sample and change only the speed:
every vector is indexed and the scores are exact integers.

Rows whose vector is NULL, or holds a NULL, NaN or infinite component, take no part. An
empty vector has score 0 with every other; where lengths differ, missing components
count as zero. Rows with a NULL id are candidates (last among ties) and never queries.
Repeated rows are rows of their own: each is a query and a candidate of its copies. An
empty table gives an empty result. Quantised components beyond 2^26 are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsignals.llm.common import per_batch, rate_filter, staged

LARGEST = float(1 << 26)  # components up to here, and 2^10 of them, keep every score below 2^63


@dataclass(frozen=True)
class AnnulusParams:
    k: int = 5
    pivots: int = 64
    sample: int = 8192  # vectors that the pivots are fitted on, about
    steps: int = 8
    cell: int = 65536  # vectors that a task holds at once
    least_cell: int = 4096  # not fewer in a partition of a small table
    annulus: int = 1024  # vectors of one annulus, more where ``most_annuli`` asks for it
    most_annuli: int = 65536  # bounds the table of annuli that every task gets
    growth: int = 8  # annuli of a round against those of the round before
    seed: int = 17


def quantised(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """Rows with ``z``: floor(scale * component) of each component; rows without a usable vector go."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    large = F.raise_error(F.lit("a quantised vector component is too large for exact scores")).cast("long")
    z = F.transform(wide, lambda x: F.when(F.abs(x * scale) > LARGEST, large).otherwise(F.floor(x * scale)))
    return rows.filter(F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))).withColumn("z", z)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an integer list column, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max(initial=0))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    pad = lambda m: m if m.shape[1] == w else np.pad(m, ((0, 0), (0, w - m.shape[1])))
    return pad(a), pad(b)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows (the missing tail of a shorter row is zero)."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if w * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)  # every partial sum is an integer that a double holds
    if w * np.abs(a).max() * np.abs(b).max() >= 2.0 ** 63:
        raise OverflowError("a score may not fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = _same_width(x, pivots)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(vectors: DataFrame, total: int, p: AnnulusParams = AnnulusParams()) -> np.ndarray:
    """Centres of a hash-chosen sample (of distinct vectors) by a few rounds of k-means."""
    chosen = vectors.select("z").filter(rate_filter(F.xxhash64("z"), F.lit(min(1.0, p.sample / max(total, 1))), p.seed))
    found = _matrix(chosen.distinct().orderBy(F.xxhash64("z")).limit(2 * p.sample).toArrow().column("z"))
    if not len(found):
        return np.zeros((1, 0))
    centre = np.unique(found[np.random.default_rng(p.seed).permutation(len(found))[:p.pivots]], axis=0)
    for _ in range(p.steps):
        near = _distances(found, centre).argmin(1)
        size = np.bincount(near, minlength=len(centre))
        total_by = np.zeros_like(centre)
        np.add.at(total_by, near, found)
        centre = np.where(size[:, None] > 0, total_by / np.maximum(size, 1)[:, None], centre)
    return centre


@dataclass(frozen=True)
class Annuli:
    """The index: rows by cell, the pivots, and one line per annulus."""
    rows: DataFrame  # cell, ann, rid, vec_id, z
    pivots: np.ndarray
    ann: dict[str, np.ndarray]  # first, last (cell), pivot, lo, hi, norm; by falling position


def build(vectors: DataFrame, p: AnnulusParams = AnnulusParams()) -> Annuli:
    """Index ``vectors`` (rid, vec_id, z): one sort by (nearest pivot, distance)."""
    spark = vectors.sparkSession
    total = vectors.count()
    centre = fit_pivots(vectors, total, p)
    per_batch(spark, 4096)

    def keyed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = _matrix(b.column("z"))
            d = _distances(x, centre)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array((x * x).sum(1)),
                 b.column("rid"), b.column("vec_id"), b.column("z")], ["pivot", "dist", "norm", "rid", "vec_id", "z"])

    parts = max(-(-total // p.cell), min(spark.sparkContext.defaultParallelism, -(-total // p.least_cell)), 1)
    most = max(p.annulus, -(-total // p.most_annuli))
    schema = "pivot int, dist double, norm double, rid long, vec_id long, z array<long>"
    ordered = (vectors.mapInArrow(keyed, schema).repartitionByRange(parts, "pivot", "dist", "rid")
               .sortWithinPartitions("pivot", "dist", "rid").withColumn("part", F.spark_partition_id()))

    def cut(batches: Iterator[pa.RecordBatch]):
        row, ann, run, last = 0, -1, 0, -1
        for b in batches:
            pivot = b.column("pivot").to_numpy()
            out = np.zeros(len(pivot), np.int64)
            for i, v in enumerate(pivot.tolist()):
                if v != last or run == most:
                    ann, run, last = ann + 1, 0, v
                run += 1
                out[i] = ann
            part = b.column("part").to_numpy().astype(np.int64) << 32
            cell = part + (row + np.arange(len(pivot))) // p.cell
            row += len(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part + out), *[b.column(c) for c in
                                             ("pivot", "dist", "norm", "rid", "vec_id", "z")]],
                                             ["cell", "ann", "pivot", "dist", "norm", "rid", "vec_id", "z"])

    rows = staged(ordered.mapInArrow(cut, "cell long, ann long, " + schema), "annuli")
    # one line per annulus: about most_annuli of them, and one more per partition and pivot
    got = rows.groupBy("ann").agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.first("pivot").alias("pivot"),
                                  F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"))
    table = got.orderBy("ann").toArrow()
    return Annuli(rows, centre, {c: table.column(c).to_numpy() for c in ("ann", "first", "last", "pivot", "lo", "hi", "norm")})


def _bounds(q: np.ndarray, to_pivot: np.ndarray, ann: dict[str, np.ndarray]) -> np.ndarray:
    """For each query (row) and annulus, a number that no score in it exceeds."""
    d = to_pivot[:, ann["pivot"]]
    gap = np.maximum(np.maximum(d - ann["hi"][None, :], ann["lo"][None, :] - d), 0)
    norm = (q * q).sum(1)[:, None]
    slack = 1e-6 * (1 + norm + ann["norm"][None, :])  # far above the rounding of the distances
    gap = np.maximum(gap - 1e-6 * (1 + d), 0)
    return (norm + ann["norm"][None, :] - gap * gap) / 2 + slack


def _visits(queries: DataFrame, index: Annuli, done: int, upto: int) -> DataFrame:
    """(cell, rid, z, theta) for the cells that a query opens next: of its annuli by falling bound, numbers
    ``done`` to ``upto``, as far as their bound reaches ``theta``, in cells that no earlier number opened."""
    centre, ann = index.pivots, index.ann

    def run(batches: Iterator[pa.RecordBatch]):
        cells = np.unique(np.concatenate([ann["first"], ann["last"]]))  # of one annulus: all between these two
        first, last = np.searchsorted(cells, ann["first"]), np.searchsorted(cells, ann["last"])
        some = max(1, (1 << 21) // len(first))

        def mark(chosen: np.ndarray, allowed: np.ndarray) -> np.ndarray:
            out = np.zeros((len(chosen), len(cells)), bool)
            row, col = np.nonzero(allowed)
            a = chosen[row, col]
            for k in range(int((last - first).max()) + 1):
                inside = first[a] + k <= last[a]
                out[row[inside], first[a][inside] + k] = True
            return out

        for batch in batches:
            for at in range(0, len(batch), some):
                b = batch.slice(at, some)
                q = _matrix(b.column("z"))
                top = _bounds(q, _distances(q, centre), ann)
                order = np.argsort(-top, axis=1, kind="stable")
                theta = b.column("theta").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                seen, new = order[:, :done], order[:, done:upto]
                reach = np.take_along_axis(top, new, 1) >= theta[:, None]
                row, col = np.nonzero(mark(new, reach) & ~mark(seen, np.ones(seen.shape, bool)))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cells[col]), *[b.column(c).take(pick) for c in ("rid", "z", "theta")]],
                                                 ["cell", "rid", "z", "theta"])

    return queries.select("rid", "z", "theta").mapInArrow(run, "cell long, rid long, z array<long>, theta long")


class _Cell:
    """One cell's vectors in memory, and the scan of its annuli for a batch of queries."""

    def __init__(self, batches: list[pa.RecordBatch], index: dict[str, np.ndarray], centre: np.ndarray, k: int):
        whole = pa.Table.from_batches(batches)
        self.x, self.rid = _matrix(whole.column("z")), whole.column("rid").to_numpy()
        ids = whole.column("vec_id")
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.no_id = ids.is_null().to_numpy()
        ann = whole.column("ann").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, ann[1:] != ann[:-1])), len(ann))
        at = np.searchsorted(index["ann"], ann[edge[:-1]])
        self.lines = {c: index[c][at] for c in ("pivot", "lo", "hi", "norm")}
        self.runs, self.centre, self.k = list(zip(edge[:-1].tolist(), edge[1:].tolist())), centre, k

    def best(self, b: pa.RecordBatch) -> pa.RecordBatch:
        q, rid = _matrix(b.column("z")), b.column("rid").to_numpy()
        least = b.column("theta").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
        top = _bounds(q, _distances(q, self.centre), self.lines)
        none = np.iinfo(np.int64).min
        score = np.full((len(q), self.k), none)
        place = np.full((len(q), self.k), -1)
        for a in np.argsort(-top.max(0, initial=0), kind="stable").tolist():
            s, e = self.runs[a]
            who = np.flatnonzero(top[:, a] >= np.maximum(least, score[:, -1]))
            if not len(who):
                continue
            found = _products(q[who], self.x[s:e])
            found[rid[who][:, None] == self.rid[None, s:e]] = none  # the query's own row
            everything = np.concatenate([score[who], found], 1)
            where = np.concatenate([place[who], np.broadcast_to(np.arange(s, e), found.shape)], 1)
            if everything.shape[1] > 4 * self.k:  # what is below the k-th best goes before the sort by ties
                cut = np.partition(everything, -self.k, axis=1)[:, -self.k]
                keep = int((everything >= cut[:, None]).sum(1).max())
                pick = np.argpartition(~everything, min(keep, everything.shape[1]) - 1, axis=1)[:, :keep]
                everything, where = np.take_along_axis(everything, pick, 1), np.take_along_axis(where, pick, 1)
            by = np.lexsort((self.ids[where], self.no_id[where], ~everything), axis=1)[:, :self.k]
            score[who], place[who] = np.take_along_axis(everything, by, 1), np.take_along_axis(where, by, 1)
        row, col = np.nonzero(score != none)
        at = place[row, col]
        return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(self.ids[at], mask=self.no_id[at]), pa.array(score[row, col]),
                                           pa.array(self.rid[at])], ["rid", "vec_id", "score", "crid"])


def _search(visits: DataFrame, index: Annuli, p: AnnulusParams) -> DataFrame:
    """(rid, vec_id, score, crid): the best ``k`` of each query in each cell that it opens.

    A cell's rows come before its queries (one sort), so a task holds one cell and
    streams the queries past it, however many they are.
    """
    lines, centre, k = index.ann, index.pivots, p.k
    wanted = visits.select("cell").distinct()
    none = lambda t: F.lit(None).cast(t)
    held = index.rows.join(wanted, "cell", "left_semi").select(
        "cell", F.lit(0).alias("kind"), "ann", "rid", "vec_id", "z", none("long").alias("theta"))
    asked = visits.select("cell", F.lit(1).alias("kind"), none("long").alias("ann"), "rid", none("long").alias("vec_id"), "z", "theta")
    dealt = held.unionAll(asked).repartition("cell").sortWithinPartitions("cell", "kind", "ann")

    def run(batches: Iterator[pa.RecordBatch]):
        now, parts, cell = None, [], None
        for b in batches:
            key = b.column("cell").to_numpy() * 2 + b.column("kind").to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                of, piece = int(key[s]), b.slice(s, e - s)
                if of % 2 == 0:
                    if now != of:
                        now, parts, cell = of, [], None
                    parts.append(piece)
                    continue
                if cell is None:
                    cell, parts = _Cell(parts, lines, centre, k), []
                for at in range(0, len(piece), 512):
                    yield cell.best(piece.slice(at, 512))

    return dealt.mapInArrow(run, "rid long, vec_id long, score long, crid long")


def top_k(vectors: DataFrame, is_query: Column, p: AnnulusParams = AnnulusParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query row with all other rows.

    ``vectors`` has vec_id (long) and z (integer components); ``is_query`` reads vec_id.
    """
    numbered = staged(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "z"), "vectors")
    index = build(numbered, p)
    queries = numbered.filter(F.coalesce(is_query, F.lit(False))).select("rid", "vec_id", "z")
    per_query = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "crid")
    best = None
    state = queries.withColumn("theta", F.lit(None).cast("long"))
    done, step, total = 0, 1, len(index.ann["ann"])
    while done < total:
        upto = min(total, done + step)
        visits = staged(_visits(state, index, done, upto), "visits")
        found = _search(visits, index, p)
        found = found if best is None else best.unionAll(found)
        best = staged(found.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= p.k).drop("rank"), "best")
        full = best.groupBy("rid").agg(F.when(F.count("*") == p.k, F.min("score")).alias("theta"))
        state = queries.join(full, "rid", "left")
        done, step = upto, step * p.growth
    if best is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    ranked = best.withColumn("rank", F.row_number().over(per_query))
    return ranked.join(queries.select("rid", F.col("vec_id").alias("query_id")), "rid").select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every query (ids divisible by 50)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return top_k(quantised(rows, "embedding").select("vec_id", "z"), F.col("vec_id") % 50 == 0)
