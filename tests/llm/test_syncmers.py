"""Document fingerprints against a plain statement of closed syncmers, and groups under hot ids."""

import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from barsignals.llm.queries import QUERIES
from barsignals.llm.syncmers import SyncmerParams, with_next


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values, seed=42):
    """The engine's hash of several longs: each one's hash seeds the next."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def anchors(text, p=SyncmerParams()):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(rf"[^\x20\x09-\x0D]{{1,{p.word_chars}}}", text)]
    if not words:
        return []
    if len(words) < p.k:
        return [chain(words)]
    inner = [chain(words[i:i + p.s]) for i in range(len(words) - p.s + 1)]
    out = []
    for i in range(len(words) - p.k + 1):
        window = inner[i:i + p.k - p.s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(chain([window[d] for d in sorted({*range(0, p.k - p.s, p.s), p.k - p.s})]))
    return out


def alike(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(docs):
    """Result rows of the query for (doc_id, text) rows."""
    text_hash = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    rows = sorted(((d is not None, d or 0, text_hash(t or ""), t or "") for d, t in docs), reverse=True)
    digest = lambda a: hashlib.sha256(",".join(f"{x & (1 << 64) - 1:X}" for x in a).encode()).hexdigest()
    out = Counter()
    for k, (known, d, _, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][3]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + follow[:cut]
        a, e, b = anchors(t), anchors(edited), anchors(follow)
        out[(d if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(e),
             round(alike(a, e), 9), round(alike(a, b), 9))] += 1
    return out


def result(df):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                    round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_query(spark, awkward):
    folder, docs = awkward
    assert result(QUERIES["op10_document_fingerprints"](spark, folder)) == expected([(d[0], d[1]) for d in docs])


@pytest.mark.parametrize("bucket_rows", [7, 40])
def test_hot_ids_are_split(spark, bucket_rows):
    """A third of the rows without an id, a third with one id: no group above two buckets, the same neighbours."""
    rng = random.Random(3)
    text = lambda: " ".join(str(rng.random()) for _ in range(3))
    docs = [(None, text()) for _ in range(400)] + [(77, text()) for _ in range(400)] + [(rng.randint(-50, 200), text()) for _ in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    rows, order = with_next(df, SyncmerParams(bucket_rows=bucket_rows))
    found = rows.withColumn("next", F.lead("text").over(order)).cache()
    sizes = found.filter("NOT _copy").groupBy("_bucket", "_sub").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2.5 * bucket_rows
    key = lambda d, t: (d is not None, d or 0, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t)
    line = sorted((key(d, t) for d, t in docs), reverse=True)
    want = {line[k][3]: line[(k + 1) % len(line)][3] for k in range(len(line))}
    assert {r["text"]: r["next"] for r in found.filter("NOT _copy").collect()} == want
