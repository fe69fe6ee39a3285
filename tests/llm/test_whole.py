"""Whole results where a sample, a gap or a common key used to cut them."""

import random
import string

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barsignals.llm import quality, repeats
from barsignals.llm.queries import QUERIES

from tables import write


@pytest.mark.parametrize("table, share", [("sf0.001", 0.05), ("sf0.1", 0.001), ("sf0.1", 0.3)])
def test_bare_keys_are_found_in_and_out_of_the_sample(spark, tmp_path, table, share):
    """The small table is sampled whole, the large one (10,000 rows) in part."""
    rng = random.Random(3)
    have = pq.read_table(f"/root/testdata/{table}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    sets = [string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    docs, keys, names = [], {}, {}
    for k, d in enumerate(have):
        text = d["text"] or ""
        if rng.random() < share:
            keys[d["doc_id"]] = key = "".join(rng.choice(sets[k % 3]) for _ in range(rng.choice((20, 32, 40))))
            text += " see " + key
        elif k % 8 == 0:
            names[d["doc_id"]] = name = rng.choice(("server_index_", "windowBufferElement", "client-handler-")) + str(rng.randrange(100))
            text += " see " + name
        docs.append((d["doc_id"], text, d["lang"]))
    out = QUERIES["op3_secret_scans"](spark, write(tmp_path, docs))
    texts = {d: t for d, t, _ in docs}
    found = {}
    for r in out.select("doc_id", "spans").collect():
        for kind, start, end in (s.split(":") for s in r["spans"].split(",") if s):
            if kind == "random":
                found.setdefault(r["doc_id"], set()).add(texts[r["doc_id"]][int(start):int(end)])
    assert len(keys) >= 5
    assert {d for d, key in keys.items() if key not in found.get(d, ())} == set()
    assert sum(name in found.get(d, ()) for d, name in names.items()) <= len(names) // 100


def test_a_language_of_mostly_empty_rows_is_learned(spark, tmp_path):
    rng = random.Random(4)
    text = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(60))
    docs = [(k, text(["ka", "lo", "mi"]), "aa") for k in range(400)]
    docs += [(1000 + k, text(["sch", "ung", "ver"]), "bb") for k in range(12)]
    docs += [(2000 + k, (None, "", "12 %")[k % 3], "bb") for k in range(9000)]
    docs += [(20000 + k, " - ", "cc") for k in range(20)]
    out = QUERIES["op1_language_id"](spark, write(tmp_path, docs)).filter("doc_id < 2000").collect()
    assert {(r["doc_id"] >= 1000, r["lang_pred"]) for r in out} == {(False, "aa"), (True, "bb")}


def test_a_window_around_a_long_gap_is_found(spark, tmp_path):
    item = [f"word{k}x" for k in range(13)]
    gap = " -" * (2 << 20)
    texts = [" ".join(item[:6]) + gap + " ".join(item[6:]), " ".join(item[:6]) + gap, " ".join(item[6:]),
             "a b " + " ".join(item[:1]) + gap + " ".join(item[1:]) + gap + "c"]
    out = QUERIES["op6_benchmark_decontamination"](
        spark, write(tmp_path, [(k, t, "en") for k, t in enumerate(texts)], bench=[(7, " ".join(item))]))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in out.collect()}
    assert got == {0: (13, 13, 1), 1: (6, 0, 0), 2: (7, 0, 0), 3: (16, 13, 1)}


def test_the_class_prior_comes_from_all_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "ta"]) for _ in range(3)) for _ in range(12)) + "."
    junk = lambda: " ".join(str(rng.randrange(10 ** 6)) + rng.choice("%#|") for _ in range(12))
    docs = spark.createDataFrame([(k, good() if k % 5 < 2 else junk()) for k in range(12_000)], "doc_id long, text string")
    labels = docs.filter("doc_id % 5 < 2").select("doc_id", F.lit(1).alias("quality"))
    for seed in (17, 18, 19):
        model = quality.train(docs, labels, F.lit(True), quality.QualityParams(positives=600, unlabelled=150, epochs=2, seed=seed))
        assert abs(model.prior - 0.4) < 0.02, seed


def test_rows_that_repeat_id_and_text_are_cut_once(spark, monkeypatch):
    sizes, write_table = {}, repeats.staged

    def staged(df, name):
        out = write_table(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "staged", staged)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage = word(90)
    one, two = word(50) + passage + word(50), word(50) + passage + word(50)
    docs = spark.createDataFrame([(1, one)] * 60 + [(None, two)] * 60 + [(3, word(20) + passage)], "doc_id long, text string")
    cover = repeats.covered(docs.withColumn("th", F.xxhash64("text")), repeats.RepeatParams(length=40, gram=20)).collect()
    marks = {(r["doc_id"], k) for r in cover for k in range(r["start"], r["end"])}
    assert [sum(d == k for d, _ in marks) for k in (1, None, 3)] == [len(one), len(two), 90]
    assert 0 < sizes["repeats-cut"] < 20 and len(set(cover)) == len(cover)
