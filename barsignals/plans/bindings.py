"""How the driver's tables stand in for price data (the reference downloads bars).

- Ticks: ``lineitem`` rows; symbol = ``l_suppkey``, time = ``l_shipdate``, price =
  ``l_extendedprice``, volume = ``l_quantity``. ``(l_shipdate, l_orderkey,
  l_linenumber, l_extendedprice)`` orders a supplier's ticks uniquely.
- Intraday ticks: ``events``; symbol = ``event_type``, price = ``value``,
  order ``(ts, event_id)``; hourly bars have a TIMESTAMP ``bar_date``.
- Votes: one ``events`` row is one vote of ``user_id`` (the symbol); every event type maps
  to a vote label below. No type maps to STRONG_SELL, so that label is absent (P5).
- Fundamentals: ``events.props`` JSON documents, and a document per supplier (one with
  the name and balance, and one with all nine keys, some of them missing).
- Corrected bars: daily bars delivered as revision 1, some of them again as 2 and 0.
- Dated facts: a customer's order stands for a report of the company with that number.
- Documents of unknown shape: a supplier's values at the top, nested or with a wrong type.
- Watch list: suppliers of the nations of one region (a semi-join, P3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsignals.sources.bars import bars_from_ticks
from barsignals.sources.fundamentals import FUNDAMENTALS_SCHEMA, load_any_document, load_fundamentals
from barsignals.sources.votes import VOTE_LABELS, votes_from_tall

# Fixed values for the bindings.
ADJ_FACTOR = 0.97
TICK_TIEBREAK = ("l_orderkey", "l_linenumber", "l_extendedprice")
EVENT_VOTE_LABELS = {"click": "BUY", "error": "SELL", "view": "NEUTRAL", "purchase": "STRONG_BUY",
                     "signup": "NEUTRAL"}
WATCH_REGION = "ASIA"
RANGE_START = "1997-01-01"
RANGE_END = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_bars(spark: SparkSession, sf_dir: str, unit: str = "month", start=None, end=None, symbols=None) -> DataFrame:
    return bars_from_ticks(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice",
                           "l_quantity", unit=unit, tiebreak=TICK_TIEBREAK, adj_factor=ADJ_FACTOR,
                           start=start, end=end, symbols=symbols)


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return bars_from_ticks(table(spark, sf_dir, "events"), "event_type", "ts", "value", None,
                           unit=unit, tiebreak=("event_id",), adj_factor=ADJ_FACTOR)


def event_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_VOTE_LABELS.items() for x in kv])
    labelled = ev.select("user_id", mapping[F.col("event_type")].alias("label"))
    labels = [lb for lb in VOTE_LABELS if lb in EVENT_VOTE_LABELS.values()]
    return votes_from_tall(labelled, "user_id", "label", labels)


EVENT_DOC_SCHEMA = T.StructType([T.StructField("k", T.LongType()), *FUNDAMENTALS_SCHEMA.fields])


def event_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_fundamentals(table(spark, sf_dir, "events"), "props", keys=("event_id",), schema=EVENT_DOC_SCHEMA)


def supplier_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fundamentals document per supplier (name as summary, balance as cash)."""
    s = table(spark, sf_dir, "supplier")
    doc = F.to_json(F.struct(F.col("s_name").alias("longBusinessSummary"),
                             F.col("s_acctbal").cast("long").alias("totalCash")))
    return load_fundamentals(s.select(F.col("s_suppkey").alias("symbol"), doc.alias("info")), "info")


def supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per supplier with all nine keys, built from its columns; to_json leaves out missing ones."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    when = lambda m, x: F.when(k % m != 0, x)
    doc = F.to_json(F.struct(
        when(2, bal / 16384).alias("profitMargins"), when(3, F.floor(bal * 8)).alias("netIncomeToCommon"),
        when(5, (k % 64) / 4).alias("enterpriseToEbitda"), when(7, F.floor(bal)).alias("totalCash"),
        when(4, F.floor(bal / 2)).alias("totalDebt"), when(6, bal / 8192).alias("ebitdaMargins"),
        when(9, bal / 4096).alias("operatingMargins"), when(10, (k % 32) / 8).alias("debtToEquity"),
        when(11, F.col("s_name")).alias("longBusinessSummary")))
    return load_fundamentals(table(spark, sf_dir, "supplier").select(k.alias("symbol"), doc.alias("info")), "info")


def watchlist(spark: SparkSession, sf_dir: str, region: str = WATCH_REGION) -> DataFrame:
    r = table(spark, sf_dir, "region").filter(F.col("r_name") == region)
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return s.select(F.col("s_suppkey").alias("symbol"))


def revised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a ``revision``: all as 1, every third day of the month corrected by 2, every fourth preceded by 0."""
    first = lineitem_bars(spark, sf_dir, "day").withColumn("revision", F.lit(1))
    day = F.dayofmonth("bar_date")
    scaled = lambda k: {c: F.col(c) * k for c in ("high", "low", "close", "adj_close")}
    better = first.filter(day % 3 == 0).withColumns(scaled(1.25)).withColumn("revision", F.lit(2))
    stale = first.filter(day % 4 == 0).withColumns(scaled(0.5)).withColumn("revision", F.lit(0))
    return stale.unionByName(better).unionByName(first)


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("reported"),
                    F.col("o_totalprice").cast("double").alias("revenue"), F.col("o_orderstatus").alias("status"))


# Where a supplier's document may hold a value.
DOCUMENT_PATHS = {"totalCash": ["$.totalCash", "$.balance.totalCash"], "totalDebt": ["$.balance.debts[0]", "$.totalDebt"],
                  "debtToEquity": ["$.ratios.debt.toEquity"], "longBusinessSummary": ["$.about.summary", "$.longBusinessSummary"]}


def supplier_any_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose shape depends on the supplier: values nested, at the top, as text, or missing."""
    k, bal, name = F.col("s_suppkey"), F.col("s_acctbal"), F.col("s_name")
    cash = F.floor(bal)
    nested = F.to_json(F.struct(F.struct(cash.alias("totalCash"), F.array(F.floor(bal / 2), F.lit(1)).alias("debts")).alias("balance"),
                                F.struct(F.struct(((k % 32) / 8).alias("toEquity")).alias("debt")).alias("ratios"),
                                F.struct(name.alias("summary")).alias("about"), (bal / 16384).alias("profitMargins")))
    flat = F.to_json(F.struct(cash.alias("totalCash"), F.floor(bal / 4).alias("totalDebt"), name.alias("longBusinessSummary"),
                              F.lit("n/a").alias("profitMargins")))
    wrong = F.to_json(F.struct(F.concat(cash.cast("string"), F.lit(" EUR")).alias("totalCash"), F.struct(F.array(name).alias("debts")).alias("balance"),
                               F.lit(7).alias("longBusinessSummary"), (k % 2 == 0).alias("profitMargins"), F.floor(bal * 8).alias("netIncomeToCommon")))
    doc = F.when(k % 4 == 0, nested).when(k % 4 == 1, flat).when(k % 4 == 2, wrong).otherwise(F.concat(F.lit("{"), name))
    return load_any_document(table(spark, sf_dir, "supplier").select(k.alias("symbol"), doc.alias("info")), "info", paths=DOCUMENT_PATHS)
