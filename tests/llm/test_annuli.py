"""The exact top-k search against plain loops, on awkward vectors and with small cells and annuli."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barsignals.llm.annuli import AnnulusParams, _bounds, _distances, build, op13_exact_top_k, quantised, top_k


def write(folder, rows):
    """embeddings with extra columns whose names clash with those used inside."""
    n = len(rows)
    extra = {c: pa.array([float(k) for k in range(n)], pa.float64()) for c in ("z", "rid", "score", "rank", "cell", "query_id")}
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()),
                             "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), **extra}), f"{folder}/embeddings.parquet")
    return str(folder)


def plain(rows, k=5):
    """Sorted result rows by brute force."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    z = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in usable]
    out = []
    for a, (i, _) in enumerate(usable):
        if i is None or i % 50:
            continue
        found = [(-sum(p * q for p, q in zip(z[a], z[b])), j is None, j or 0) for b, (j, _) in enumerate(usable) if b != a]
        for rank, (score, none, j) in enumerate(sorted(found)[:k], 1):
            out.append((i, rank, None if none else j, -score))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def awkward_vectors():
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(120)]
    common = rng.normal(size=8).tolist()
    rows += [(200 + k, common) for k in range(60)]  # a third are copies: ties by the smaller id
    rows += [(50, rows[3][1]), (100, rows[100][1]), (None, common), (None, rows[0][1]), (300, None), (301, []), (350, []),
             (302, [1.0, None] * 4), (400, [float("nan")] + [0.0] * 7), (450, [float("inf")] + [0.0] * 7),
             (500, [0.0] * 8), (501, [-1e-9] * 8), (550, [9.0] * 3), (551, [1000.0] * 8)]
    return rows


def test_query_on_awkward_vectors(spark, tmp_path, awkward_vectors):
    got = result(op13_exact_top_k(spark, write(tmp_path, awkward_vectors)))
    assert got == plain(awkward_vectors)


def test_empty_table_and_few_rows(spark, tmp_path):
    out = op13_exact_top_k(spark, write(tmp_path, []))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 0.0])]
    (tmp_path / "few").mkdir()
    assert result(op13_exact_top_k(spark, write(tmp_path / "few", few))) == plain(few)
    (tmp_path / "one").mkdir()
    assert op13_exact_top_k(spark, write(tmp_path / "one", few[:1])).count() == 0


@pytest.mark.parametrize("p", [AnnulusParams(k=3, pivots=4, cell=16, least_cell=8, annulus=5, growth=2),
                               AnnulusParams(k=3, pivots=1, cell=8, least_cell=64, annulus=30, most_annuli=4)])
def test_cells_and_annuli_of_any_size(spark, tmp_path, awkward_vectors, p):
    """An annulus over several cells, a cell of several annuli, and many rounds give the same rows."""
    rows = spark.read.parquet(write(tmp_path, awkward_vectors) + "/embeddings.parquet").select("vec_id", "embedding")
    got = result(top_k(quantised(rows, "embedding").select("vec_id", "z"), F.col("vec_id") % 50 == 0, p))
    assert got == plain(awkward_vectors, 3)


def test_bounds_hold_and_stop_the_search(spark):
    """No score exceeds its annulus's bound; on clustered vectors most annuli are never opened."""
    rng = np.random.default_rng(4)
    centres = 40 * rng.normal(size=(12, 6))
    x = np.floor(centres[rng.integers(12, size=600)] + rng.normal(size=(600, 6))).astype(int)
    df = spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(x)], "rid long, vec_id long, z array<long>")
    index = build(df, AnnulusParams(pivots=12, annulus=10, least_cell=64))
    ann = {r["rid"]: r["ann"] for r in index.rows.select("rid", "ann").collect()}
    line = {a: k for k, a in enumerate(index.ann["ann"].tolist())}
    q = x[:50].astype(float)
    top = _bounds(q, _distances(q, index.pivots), index.ann)
    score = x[:50] @ x.T
    at = np.array([line[ann[k]] for k in range(600)])
    assert (top[:, at] >= score).all()
    fifth = np.sort(score, axis=1)[:, -6]
    assert (top >= fifth[:, None]).mean() < 0.35


def test_too_large_components_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        op13_exact_top_k(spark, write(tmp_path, [(0, [1e20]), (1, [1.0])])).collect()
