"""The learned score of op9 against a plain statement of its model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from barsignals.llm import lm_scoring
from barsignals.llm.lattice import Vocabulary
from barsignals.llm.queries import QUERIES
from pyspark.sql import functions as F
from tables import prose, write


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def test_held_out_scores_are_near_base_scores(spark, tmp_path):
    rng = random.Random(7)
    known = prose(rng, 400).split(" ")
    text = lambda: " ".join(rng.choice(known) if rng.random() < 0.95 else prose(rng, 1) for _ in range(rng.randint(50, 150)))
    docs = [(k, text(), "en") for k in range(300)] + [(300, "x" * 3000, "en"), (301, None, "en"), (None, "th er", "en")]
    got = [r for r in QUERIES["op9_lm_scoring"](spark, write(tmp_path, docs)).collect()]
    assert len(got) == len(docs) and all(r["score"] is not None and math.isfinite(r["score"]) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(held) > 30
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / tokens > -0.5


def test_score_sums_segmentations_and_the_word_itself(spark):
    p = lm_scoring.ScoringParams(frequent=3)
    texts = ["the Then other the", "then the 日 x the", "Zorn the zorn  zorn\tthe 日", None, "", "ünï then " + "q" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [0, 1]
    eligible = F.col("doc_id").isin(train)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, eligible, p).collect()}
    count = Counter(w for k in train for w in words_of(texts[k]))
    n, ends = sum(count.values()) + len(train), len(train)
    model = lm_scoring.learned_model(lm_scoring.word_counts(docs, eligible), p)
    v = Vocabulary.load(p.vocabulary)
    weight = {q: model.weights[i] for i, q in enumerate(v.pieces) if v.normal[i]}
    assert math.isclose(sum(map(math.exp, weight.values())) + np.exp(model.byte_weights).sum(), 1, rel_tol=1e-9)

    def by_pieces(word):
        text = " " + word
        alpha = [0.0] + [-math.inf] * len(text)
        for a, c in enumerate(text):
            for b in range(a + 1, min(len(text), a + 48) + 1):
                if text[a:b].encode() in weight:
                    alpha[b] = np.logaddexp(alpha[b], alpha[a] + weight[text[a:b].encode()])
            if c.encode() not in weight:
                alpha[a + 1] = np.logaddexp(alpha[a + 1], alpha[a] + sum(model.byte_weights[x] for x in c.encode()))
        return alpha[-1]

    share = (p.discount * len(count) + 0.5) / (n + 1)
    for k, text in enumerate(texts):
        want, before = math.log((ends + 0.5) / (n + 1)), Counter()
        for t, w in enumerate(words_of(text)):
            cache = p.cache * t / (t + p.delay)
            parts = [math.log(1 - cache) + math.log(share) + by_pieces(w)]
            if count[w]:
                parts.append(math.log((1 - cache) * (count[w] - p.discount) / (n + 1)))
            if before[w]:
                parts.append(math.log(cache * before[w] / t))
            want += np.logaddexp.reduce(parts)
            before[w] += 1
        assert math.isclose(got[k]["score"], want / math.log(10), rel_tol=1e-9), text
    alone = lm_scoring.score(docs, eligible).collect()  # all words common
    assert all(math.isclose(r["score"], got[r["doc_id"]]["score"], rel_tol=1e-9) for r in alone)


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = lm_scoring.score(docs, F.lit(False)).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in got)
