"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a grouped minimum (pre-aggregated before its shuffle) and a join; its
edges are written to the shared folder, so lineage stays short and nothing is gathered
on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.llm.common import staged


def _with_least(directed: DataFrame) -> DataFrame:
    """Edges (u, v) with m: the least node among u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node that has an edge and is not the root: the least node it reaches.

    ``edges`` has long columns u and v; self-loops and repeated edges do no harm.
    """
    current = staged(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), name)
    before = None
    while True:
        current = staged(_small_star(_large_star(current)), name)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)
