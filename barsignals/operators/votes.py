"""V1 / A4: vote labels as rows, and each label's share per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.sources.votes import VOTE_LABELS


def votes_long(votes: DataFrame, labels: Sequence[str] = VOTE_LABELS) -> DataFrame:
    """V1 with P5: unpivot the label columns that exist; an absent count is 0."""
    existing = [c for c in labels if c in votes.columns]
    if not existing:
        return votes.select("symbol", F.lit(None).cast("string").alias("label"),
                            F.lit(None).cast("long").alias("n")).filter(F.lit(False))
    wide = votes.select("symbol", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in existing])
    return wide.unpivot("symbol", existing, "label", "n")


def vote_share(votes: DataFrame, labels: Sequence[str] = VOTE_LABELS) -> DataFrame:
    """A4: ``n / sum(n)`` per symbol (NULL when a symbol has no votes at all).

    The total is a sum over the row's label columns before the unpivot: no shuffle.
    """
    existing = [c for c in labels if c in votes.columns]
    if not existing:
        return votes_long(votes, labels).withColumn("share", F.lit(None).cast("double"))
    counts = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in existing}
    total = sum(counts.values(), F.lit(0)).cast("double")
    wide = votes.select("symbol", total.alias("_total"), *[n.alias(c) for c, n in counts.items()])
    long = wide.unpivot(["symbol", "_total"], existing, "label", "n")
    return long.select("symbol", "label", "n", F.try_divide(F.col("n").cast("double"), F.col("_total")).alias("share"))
