"""Ad-hoc questions become Spark SQL over registered views, with indicators to call.

The reference sends free-text questions about its frame to a language-model
service; here the same frame (and the derived tables) are SQL views, so a user's
question is a ``spark.sql`` query planned by Catalyst like any other. Indicators that
the frame does not hold (other spans, other columns) are SQL functions over the last
rows of a series, which the view ``recent_bars`` gives with every bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.functions.scalar import TIE_RTOL
from barsignals.operators.layout import block_window, lay_out, make_layout, own_rows
from barsignals.schema import BAR_COLUMNS, conform_bars

# name: (parameters, result, body). Arrays hold the last rows of a series, the newest last; a value is NULL where
# fewer than n of the rows it reads are there or one of them is NULL (rule Q1).
FUNCTIONS = {
    "bar_last": ("vals ARRAY<DOUBLE>, n INT", "ARRAY<DOUBLE>",
                 "CASE WHEN size(vals) >= n AND forall(slice(vals, greatest(size(vals) - n + 1, 1), n), x -> x IS NOT NULL) "
                 "THEN slice(vals, greatest(size(vals) - n + 1, 1), n) END"),
    "bar_sma": ("vals ARRAY<DOUBLE>, n INT", "DOUBLE",
                "aggregate(bar_last(vals, n), DOUBLE(0), (acc, x) -> acc + x) / n"),
    "bar_std": ("vals ARRAY<DOUBLE>, n INT", "DOUBLE",
                "sqrt(aggregate(transform(bar_last(vals, n), x -> pow(x - bar_sma(vals, n), 2)), DOUBLE(0), (acc, x) -> acc + x) "
                "/ nullif(n - 1, 0))"),
    "bar_ema": ("vals ARRAY<DOUBLE>, span INT", "DOUBLE",
                "aggregate(vals, named_struct('num', DOUBLE(0), 'den', DOUBLE(0), 'ema', CAST(NULL AS DOUBLE)), "
                "(acc, x) -> named_struct("
                "'num', acc.num * (1 - 2 / (span + 1D)) + coalesce(x, 0D), "
                "'den', acc.den * (1 - 2 / (span + 1D)) + CASE WHEN x IS NULL THEN 0D ELSE 1D END, "
                "'ema', CASE WHEN x IS NULL THEN acc.ema ELSE (acc.num * (1 - 2 / (span + 1D)) + x) / (acc.den * (1 - 2 / (span + 1D)) + 1D) END), "
                "acc -> acc.ema)"),
    "bar_stoch_k": ("closes ARRAY<DOUBLE>, highs ARRAY<DOUBLE>, lows ARRAY<DOUBLE>, n INT", "DOUBLE",
                    "100D * try_divide(element_at(closes, -1) - array_min(bar_last(lows, n)), "
                    "array_max(bar_last(highs, n)) - array_min(bar_last(lows, n)))"),
    "bar_moves": ("vals ARRAY<DOUBLE>, n INT", "ARRAY<DOUBLE>",
                  "CASE WHEN size(vals) >= n THEN transform(sequence(size(vals) - n, size(vals) - 1), "
                  "i -> coalesce(get(vals, i) - get(vals, i - 1), 0D)) END"),
    "bar_rsi": ("vals ARRAY<DOUBLE>, n INT", "DOUBLE",
                "100D * try_divide(aggregate(bar_moves(vals, n), 0D, (acc, x) -> acc + greatest(x, 0D)), "
                "aggregate(bar_moves(vals, n), 0D, (acc, x) -> acc + abs(x)))"),
    "bar_cross": ("fast DOUBLE, slow DOUBLE", "INT",
                  f"CASE WHEN abs(fast - slow) <= {TIE_RTOL!r}D * greatest(abs(fast), abs(slow)) THEN NULL WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 END"),
}


def register_views(enriched: DataFrame, name: str = "bars_enriched", **others: DataFrame) -> list[str]:
    """Register ``enriched`` (and any keyword frames) as temporary views."""
    enriched.createOrReplaceTempView(name)
    for view, df in others.items():
        df.createOrReplaceTempView(view)
    return [name, *others]


def register_functions(spark: SparkSession) -> list[str]:
    """Indicators as temporary SQL functions, inlined by Catalyst into the query that calls them."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


def recent_bars(bars: DataFrame, rows: int, block_rows: int = 8192, segment: str = "year") -> DataFrame:
    """Bars with ``closes``, ``highs``, ``lows``, ``volumes``: arrays of the last ``rows`` bars up to each, its own last.

    They come from the skew-safe layout, so a query that calls indicators on them needs no
    window over a whole symbol.
    """
    bars = conform_bars(bars)
    kept = bars.columns
    last = F.collect_list(F.struct("close", "high", "low", "volume")).over(block_window().rowsBetween(-(rows - 1), 0))
    df = own_rows(lay_out(bars, make_layout(rows, 0, block_rows, segment)).withColumn("_last", last))
    arrays = {"closes": "close", "highs": "high", "lows": "low", "volumes": "volume"}
    return df.select(*[c for c in kept if c in BAR_COLUMNS or not c.startswith("_")], *[F.col(f"_last.{c}").alias(a) for a, c in arrays.items()])
