"""The analyst-style vote summary, one wide row per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vote labels, in the order the reference plots them.
VOTE_LABELS = ["BUY", "SELL", "NEUTRAL", "STRONG_BUY", "STRONG_SELL"]


def load_votes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a stored wide vote table (symbol plus any subset of the labels)."""
    df = spark.read.format(fmt).load(path)
    labels = [c for c in df.columns if c in VOTE_LABELS]
    return df.select(F.col("symbol").cast("string").alias("symbol"),
                     *[F.col(c).cast("long").alias(c) for c in labels])


def votes_from_tall(df: DataFrame, symbol: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Wide vote counts from one row per vote: one aggregation with a conditional count per label.

    A label without votes counts 0; votes of labels not named are not counted.
    """
    return (df.groupBy(F.col(symbol).cast("string").alias("symbol"))
            .agg(*[F.count(F.when(F.col(label) == lb, 1)).alias(lb) for lb in labels]))
