"""As-of facts, clusters of levels and callable indicators against plain loops."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from barsignals import enrich
from barsignals.operators.asof import as_of
from barsignals.operators.levels import level_clusters
from barsignals.plans import bindings as B
from barsignals.plans.catalog import FUNCTIONS, recent_bars, register_functions
from barsignals.schema import SchemaError
from barsignals.sources.fundamentals import load_any_document
from paths import SF_SMALL

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.mark.parametrize("segment,fanout", [("year", 4096), ("month", 1), ("day", 3)])
def test_as_of_equals_a_plain_scan(spark, segment, fanout):
    rng = random.Random(3)
    bars = [(s, day(rng.randint(0, 900)), float(k)) for k, s in enumerate(["A"] * 200 + ["B"] * 20 + ["C"] * 5 + [None, "A"])] + [("A", None, -1.0)]
    facts = [(s, day(rng.randint(-50, 900)), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice(["x", None])) for s in ["A"] * 30 + ["B"] * 60 + ["D"] * 3]
    facts += [("A", None, 9.0, "y"), (None, day(3), 9.0, "y")]
    got = as_of(spark.createDataFrame(bars, "symbol string, bar_date date, close double"),
                spark.createDataFrame(facts, "symbol string, at date, eps double, note string"), ["eps", "note"], at="at", segment=segment, fanout=fanout)
    low = lambda v: (v is not None, v if v is not None else 0)
    want = []
    for s, d, c in bars:
        past = [f for f in facts if s is not None and d is not None and f[0] == s and f[1] is not None and f[1] <= d]
        best = max(past, key=lambda f: (f[1], low(f[2]), (f[3] is not None, f[3] or "")), default=None)
        want.append((s, d, c, *(best[1:] if best else (None, None, None))))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_as_of_has_no_range_join_and_bounded_groups(spark):
    bars = B.lineitem_bars(spark, SF_SMALL, "day").select("symbol", "bar_date", "close")
    out = as_of(bars, B.order_reports(spark, SF_SMALL), ["revenue"], at="reported")
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().executedPlan().toString())
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    over = re.findall(r"Window \[last\(_fact.*?\], \[([^\]]*)\]", plan)
    # the facts of a segment, then two levels of one row per segment
    assert sorted(over) == ["symbol", "symbol, _grp", "symbol, _seg"]
    assert out.filter("reported IS NOT NULL").count() > 0
    with pytest.raises(SchemaError, match="already"):
        as_of(bars, bars.withColumnRenamed("bar_date", "reported"), ["close"], at="reported")


@pytest.mark.parametrize("gap", [0.001, 0.03, 0.5])
def test_clusters_are_islands_of_sorted_levels(spark, gap):
    rng = random.Random(5)
    rows = [(s, k, day(n), v) for n, (s, k, v) in enumerate(
        [("A", "support", round(100 * 1.01 ** rng.uniform(0, 80), 3)) for _ in range(300)] +
        [("A", "resistance", 50.0)] * 3 + [("B", "support", v) for v in (-10.0, -9.9, 0.0, 0.0, 1e-9, 5.0, 5.15, 5.3045, None)])]
    got = {}
    for r in level_clusters(spark.createDataFrame(rows, "symbol string, kind string, bar_date date, level double"), gap).collect():
        got[(r["symbol"], r["kind"], r["cluster"])] = (r["low"], r["high"], r["hits"], r["first_date"], r["last_date"])
    want = {}
    for key in {(s, k) for s, k, _, _ in rows}:
        points = sorted((v, d) for s, k, d, v in rows if (s, k) == key and v is not None)
        groups = []
        for v, d in points:
            if not groups or v - groups[-1][-1][0] > gap * abs(groups[-1][-1][0]):
                groups.append([])
            groups[-1].append((v, d))
        for n, g in enumerate(groups):
            want[(*key, n)] = (g[0][0], g[-1][0], len(g), min(d for _, d in g), max(d for _, d in g))
    assert got == want


def test_callable_indicators_equal_the_frame(spark):
    bars = B.lineitem_bars(spark, SF_SMALL, "month").cache()
    assert register_functions(spark) == list(FUNCTIONS)
    recent_bars(bars, 100, block_rows=200).createOrReplaceTempView("recent")
    got = spark.sql("""SELECT symbol, bar_date, bar_sma(closes, 5) AS sma5, bar_sma(closes, 15) AS sma15, bar_std(closes, 15) AS std15,
        bar_ema(closes, 5) AS ema5, bar_rsi(closes, 5) AS rsi, bar_stoch_k(closes, highs, lows, 5) AS stoch_k FROM recent""")
    both = enrich(bars).alias("a").join(got.alias("b"), ["symbol", "bar_date"])
    for c in ("sma5", "sma15", "std15", "ema5", "rsi", "stoch_k"):
        differ = (F.col(f"a.{c}").isNull() != F.col(f"b.{c}").isNull()) | (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 1e-8 * F.greatest(F.abs(f"a.{c}"), F.lit(1)))
        assert both.filter(differ).count() == 0, c
    assert both.count() == bars.count()


def test_documents_of_any_shape(spark):
    rows = [("a", '{"totalCash": 5, "x": {"debt": [1.5, 2]}, "longBusinessSummary": "s"}'),
            ("b", '{"totalCash": "5", "longBusinessSummary": 7, "profitMargins": true, "y": {"totalDebt": 9}}'),
            ("c", "nope"), ("d", None), ("e", '{"totalCash": null, "totalDebt": {"a": 1}, "profitMargins": 3, "ebitdaMargins": 1e3}'), ("f", "")]
    got = load_any_document(spark.createDataFrame(rows, "symbol string, info string"), "info",
                            paths={"totalDebt": ["$.totalDebt", "$.y.totalDebt"], "debtToEquity": ["$.x.debt[0]"]})
    values = {r["symbol"]: {k: v for k, v in r.asDict().items() if v is not None and k != "symbol"} for r in got.collect()}
    assert values == {"a": {"totalCash": 5, "debtToEquity": 1.5, "longBusinessSummary": "s"}, "b": {"totalDebt": 9}, "c": {}, "d": {},
                      "e": {"profitMargins": 3.0, "ebitdaMargins": 1000.0}, "f": {}}
