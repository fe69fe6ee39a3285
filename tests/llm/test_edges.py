"""Every query and pipeline stage on awkward and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barsignals.llm.queries import QUERIES

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op3_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op6_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_sentencepiece": ["doc_id", "n_tokens", "ids"],
    "op9_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_rows_and_columns(spark, awkward, empty, name):
    folder, docs = awkward
    out = QUERIES[name](spark, folder).toPandas()
    assert list(out.columns)[:len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(out.columns)
    assert sorted(out["doc_id"].fillna(-1)) == sorted(-1 if d[0] is None else d[0] for d in docs)
    if "held_out" in out:
        assert out["held_out"].notna().all() and not out.loc[out["doc_id"].isna(), "held_out"].any()
    for c in ("near_edited", "near_next") + (("score",) if name in ("op1_language_id", "op2_quality_classifier", "op7_toxicity") else ()):
        if c in out:
            assert out[c].between(0, 1).all()
    if name == "op1_language_id":
        none = out["doc_id"].isin([70, 71, 72])
        assert (out.loc[none, "lang_pred"] == "und").all() and (out.loc[~none & out["doc_id"].notna(), "lang_pred"] != "und").all()
    nothing = QUERIES[name](spark, empty)
    assert set(nothing.columns) == set(out.columns) and nothing.count() == 0


def test_repeated_rows_have_repeated_results(spark, awkward):
    folder, _ = awkward
    for name in ("op3_secret_scans", "op4_suffix_array_dedup", "op5_simhash_near_dedup", "op6_benchmark_decontamination",
                 "op8_sentencepiece", "op9_lm_scoring"):
        out = QUERIES[name](spark, folder).filter("doc_id = 78")
        assert out.count() == 2 and out.distinct().count() == 1, name


@pytest.fixture(scope="module")
def stages(spark, awkward):
    """(docs before, rows after) of each stage over the awkward table."""
    folder, _ = awkward
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder).cache()
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString(), name
        assert 0 < after.count() <= before.count()
    before, after = stages["sentencepiece"]
    assert after.count() == before.count()


def test_near_duplicates_leave_one_of_each_class(spark, stages):
    from barsignals.llm import simhash
    before, after = stages["simhash_near_dedup"]
    fps = simhash.with_fingerprint(before.select("doc_id", "text"))
    assert after.count() == simhash.classes(fps).select("root").distinct().count()


def test_contaminated_go_and_clean_stay(stages):
    before, after = stages["benchmark_decontamination"]
    ids = {r["doc_id"] for r in after.select("doc_id").collect()}
    had = {r["doc_id"] for r in before.select("doc_id").collect()}
    assert not ids & {60, 61, 63} and (had - {60, 61, 63}) <= ids
    assert {r["n_chars"] == len(r["text"]) for r in after.filter(F.col("text").isNotNull()).collect()} == {True}


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_are_the_contracts():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination",
                                                      "secret_scans", "sentencepiece"]
