"""Document fingerprints: closed syncmers of words, with DataFrame functions only.

A k-mer is ``k`` consecutive words; its inner substrings are its runs of ``s`` words.
It is chosen if the one with the least hash lies at an edge (first or last). Whether a
k-mer is chosen depends on its own words alone, so equal passages give equal anchors
wherever they stand. Anchors keep their word position. A fingerprint is the set of its
anchors' hashes; likeness is the shared part of two sets (intersection over union).

Words are runs without white space, cut after ``word_chars`` characters so that texts
without spaces have anchors too. A text of fewer than ``k`` words has one anchor, its
whole word sequence; NULL and empty texts and texts without words have none. Two
fingerprints without anchors are alike (1), one alone is not (0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsignals.llm.common import documents


@dataclass(frozen=True)
class SyncmerParams:
    k: int = 5
    s: int = 2
    word_chars: int = 24
    bucket_rows: int = 1000  # documents that meet in one window group, about
    most_buckets: int = 1 << 16  # of a larger table each group holds more (a window streams its rows and spills)


def with_anchors(df: DataFrame, text: str, out: str, p: SyncmerParams = SyncmerParams()) -> DataFrame:
    """``df`` with ``out``: array of (pos, hash) anchors of the column ``text``, in order."""
    h, m = f"_{out}_h", f"_{out}_m"
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{p.word_chars}}}"), F.lit(0))
    df = df.withColumn(h, F.transform(found, lambda w: F.xxhash64(w)))
    n = F.size(h)
    inner = F.col(h)
    for d in range(1, p.s):
        inner = F.zip_with(inner, F.slice(F.col(h), d + 1, F.greatest(n - d, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(m, F.slice(inner, 1, F.greatest(n - p.s + 1, F.lit(0))))
    last = p.k - p.s
    at = lambda i, d: F.get(F.col(m), i + d)
    closed = lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, d) for d in range(1, last)])
    own = lambda i: F.xxhash64(*[at(i, d) for d in sorted({*range(0, last, p.s), last})])
    chosen = F.filter(F.sequence(F.lit(0), n - p.k), closed)
    anchors = F.transform(chosen, lambda i: F.struct(i.alias("pos"), own(i).alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.col(h)).alias("hash")))
    none = F.slice(whole, 1, 0)
    return df.withColumn(out, F.when(n >= p.k, anchors).when(n > 0, whole).otherwise(none)).drop(h, m)


def digest(anchors: str) -> Column:
    """The fingerprint as text: a digest of the anchors' hashes in order."""
    return F.sha2(F.array_join(F.transform(F.col(anchors), lambda a: F.hex(a["hash"])), ","), 256)


def likeness(a: str, b: str) -> Column:
    """Shared part of two arrays of distinct hashes."""
    union = F.size(a) + F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / (union - shared))


def aligned(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Positional match of two anchor columns: per ``key`` (unique) the commonest shift and the anchors that agree.

    A hash that a text repeats stands at its first position, so a text gives each hash
    once. Rows that share no anchor are left out.
    """
    first = lambda c, pos: rows.select(key, F.explode(c).alias("x")).groupBy(key, F.col("x.hash").alias("hash")).agg(F.min("x.pos").alias(pos))
    both = first(a, "p").join(first(b, "q"), [key, "hash"])
    shifts = both.groupBy(key, (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("n"))
    return shifts.groupBy(key).agg(F.max_by("shift", "n").alias("shift"), F.max("n").alias("agree"))


def _with_bucket(docs: DataFrame, p: SyncmerParams) -> DataFrame:
    """``docs`` (doc_id, text, th) with ``_bucket`` and ``_sub``, both rising in the order of (doc_id, th).

    Buckets are ranges of ids by quantiles of all ids (two levels of splitters); NULL ids
    are in bucket -1. An id that holds more than two buckets' rows has a bucket of its
    own, and that (like the NULL one) is cut into ranges of text hashes, so only rows
    that repeat id and text can outgrow a bucket.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    total = ids.count()
    size = max(p.bucket_rows, -(-total // p.most_buckets))
    n = max(1, -(-total // size))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0]
    # ids with over two buckets' rows: fewer than half of ``most_buckets``
    hot = [(r["doc_id"], -(-r["count"] // size)) for r in ids.groupBy("doc_id").count().filter(F.col("count") > 2 * size).collect()]
    own = [h for h, _ in hot if h is not None]
    cuts = sorted({*(cuts or [] if n > 1 else []), *own, *[h + 1 for h in own if h < (1 << 63) - 1]})
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k:k + side] for k in range(0, len(cuts), side)]
    bucket = F.lit(0)
    if groups:
        coarse = F.array(*[F.lit(g[0]).cast("long") for g in groups])
        fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
        below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
        group = below(coarse)
        inner = F.when(group > 0, below(F.get(fine, group - 1))).otherwise(0)
        bucket = F.when(group > 0, (group - 1) * side + inner).otherwise(0)
    docs = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket))
    if not hot:
        return docs.withColumn("_sub", F.lit(0))
    parts = spark.createDataFrame(hot, "hid long, parts long")
    docs = docs.join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("hid")), "left")
    # equal ranges of the hash; its highest value must not open one more
    sub = F.least(F.floor((F.col("th") / float(1 << 64) + 0.5) * F.col("parts")), F.col("parts") - 1)
    return docs.withColumn("_sub", F.coalesce(sub, F.lit(0)).cast("int")).drop("hid", "parts")


def with_next(docs: DataFrame, p: SyncmerParams = SyncmerParams()) -> tuple[DataFrame, object]:
    """Rows of ``docs`` (doc_id, text, th) laid out so that a window sees the next document.

    Order is by descending doc_id (NULL last), then by text hash; the first follows the
    last. Documents meet in buckets of ids (and text hashes); the top row of each bucket is
    copied to the end of the bucket above, so the next row is always in the same bucket.
    Returns the rows (``_copy`` marks copies) and the window.
    """
    spark = docs.sparkSession
    docs = _with_bucket(docs, p)
    # a few times ``most_buckets`` rows at most: the top of each bucket
    tops = (docs.select("_bucket", "_sub", "doc_id", "th").groupBy("_bucket", "_sub")
            .agg(F.max(F.struct("doc_id", "th")).alias("top")).orderBy("_bucket", "_sub").collect())
    above = [tops[(k + 1) % len(tops)] for k in range(len(tops))]
    to = spark.createDataFrame([(r["top"]["doc_id"], r["top"]["th"], t["_bucket"], t["_sub"]) for r, t in zip(tops, above)],
                               "tid long, tth long, _to int, _to_sub int")
    rows = docs.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("tid")) & (F.col("th") == F.col("tth")), "left")
    own = F.struct(F.col("_bucket").cast("int").alias("b"), F.col("_sub").alias("s"), F.lit(False).alias("c"))
    copy = F.struct(F.col("_to").alias("b"), F.col("_to_sub").alias("s"), F.lit(True).alias("c"))
    rows = rows.withColumn("_place", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = rows.select("doc_id", "text", "th", F.col("_place.b").alias("_bucket"), F.col("_place.s").alias("_sub"), F.col("_place.c").alias("_copy"))
    return rows, Window.partitionBy("_bucket", "_sub").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.col("th").desc())


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"),
                                           F.coalesce("text", F.lit("")).alias("text"))
    rows, order = with_next(docs.withColumn("th", F.xxhash64("text")))
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)))
    rows = with_anchors(with_anchors(rows, "text", "a"), "edited", "e")
    hashes = lambda c: F.array_distinct(F.transform(F.col(c), lambda x: x["hash"]))
    rows = rows.select("doc_id", "th", "_bucket", "_sub", "_copy", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       digest("a").alias("fingerprint"), digest("e").alias("edited_fingerprint"),
                       hashes("a").alias("a"), hashes("e").alias("e"))
    rows = rows.withColumn("b", F.lead("a").over(order)).filter(~F.col("_copy"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness("a", "e").alias("near_edited"), likeness("a", "b").alias("near_next"))
