"""Stored bars that are already laid out: bucketed by symbol and block, with their positions.

Indicators over such a table move no bar: the buckets are the partitioning that every
window needs. Blocks of one symbol fall into many buckets, so a hot symbol is spread
like any other. The layout stands in the table's properties.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from barsignals.operators.indicators import DEFAULT, Params
from barsignals.operators.layout import DEFAULT_CARRY_FANOUT, SYMBOL, Layout, lay_out
from barsignals.operators.signals import RULES
from barsignals.plans.enrich import DEFAULT_BLOCK_ROWS, GROUPS, _expand, _over_blocks, _rules, series_layout
from barsignals.schema import SchemaError, conform_bars

LAYOUT_PROPERTY = "bars.layout"
LAYOUT_COLUMNS = ("_t", "_role", "_blk", "_sub", "_fine", "_more")


def write_blocks(bars: DataFrame, table: str, buckets: int, params: Params = DEFAULT, block_rows: int = DEFAULT_BLOCK_ROWS,
                 segment: str | None = None, path: str | None = None) -> Layout:
    """Store ``bars`` as the bucketed table ``table`` (an external one at ``path``, if given).

    Rows come once per block that reads them (``back / block_rows`` more than the bars).
    One file per bucket, in the windows' order. ``buckets`` should give files of 128 to
    256 MB. An existing table is not replaced.
    """
    bars = conform_bars(bars)
    if segment is None:
        segment = "year" if dict(bars.dtypes)["bar_date"] == "date" else "month"
    layout = series_layout(params, block_rows, segment)
    order = [SYMBOL, "_blk", "_sub", "_fine", "_t"]
    laid = lay_out(bars, layout).repartition(buckets, SYMBOL, "_blk").sortWithinPartitions(*order)
    writer = laid.write.format("parquet").bucketBy(buckets, SYMBOL, "_blk").sortBy(*order)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    text = json.dumps(asdict(layout)).replace("'", "''")
    bars.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{LAYOUT_PROPERTY}' = '{text}')")
    return layout


def stored_layout(spark: SparkSession, table: str) -> Layout:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    found = {r["key"]: r["value"] for r in rows}
    if LAYOUT_PROPERTY not in found:
        raise SchemaError(f"{table} was not written by write_blocks")
    return Layout(**json.loads(found[LAYOUT_PROPERTY]))


def enrich_blocks(spark: SparkSession, table: str, params: Params = DEFAULT, include: Iterable[str] = GROUPS,
                  carry_fanout: int = DEFAULT_CARRY_FANOUT, rules: Iterable[str] = RULES) -> DataFrame:
    """``enrich`` of a table of ``write_blocks``, without an exchange of its bars.

    ``params`` may differ from those that it was written with as far as its blocks hold
    the rows that they read; otherwise this raises.
    """
    have = stored_layout(spark, table)
    need = series_layout(params, have.block, have.segment)
    if need.back > have.back or (need.sub, need.fine) != (have.sub, have.fine):
        raise SchemaError(f"{table} is laid out for other spans: it holds {have}, these indicators need {need}")
    used = _rules(rules) if "signals" in set(include) else ()
    laid = spark.read.table(table)
    columns = [c for c in laid.columns if c not in LAYOUT_COLUMNS]
    return _over_blocks(laid, columns, params, _expand(include, used), used, carry_fanout)
