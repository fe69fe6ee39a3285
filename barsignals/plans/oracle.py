"""DuckDB SQL for every named query: an independent statement of the same semantics.

Written as plain window SQL over one ``PARTITION BY symbol`` per series (no blocks,
no halo, closed-form EMA), so it checks the Spark layout, the block EMA and the
cross-block carry rather than repeating them. The EMA closed form is exact for
the few hundred bars per symbol of the driver data (it overflows after ~1,700); the
minute bars of ``ema_long`` use truncated weighted sums instead.
"""

from __future__ import annotations

from barsignals.plans import bindings as B
from barsignals.plans.queries import BAND, CLUSTER_GAP, DECIMALS, FINE_PRICE, LOOSE, LOOSE_DECIMALS, RECENT_AS_OF
from barsignals.operators.filters import default_range
from barsignals.operators.indicators import DEFAULT
from barsignals.functions.scalar import TIE_RTOL

D = DECIMALS
P = DEFAULT

# Fixed values, stated here once more so that a wrong list elsewhere shows: vote labels,
# traces of each chart, titles.
LABELS = ("BUY", "SELL", "NEUTRAL", "STRONG_BUY", "STRONG_SELL")
CHARTS = {
    "price_overlay": ["adj_close", "sma5", "sma15", "ema5", "ema15", "bb_upper", "bb_lower",
                      "sma_buy", "sma_sell", "ema_buy", "ema_sell"],
    "sma_chart": ["adj_close", "sma5", "sma15", "sma_buy", "sma_sell"],
    "ema_chart": ["adj_close", "ema5", "ema15", "ema_buy", "ema_sell"],
    "bollinger_chart": ["adj_close", "bb_upper", "bb_lower"],
    "level_chart": ["adj_close"],
    "stochastic_chart": ["stoch_k", "stoch_d", "stoch_buy", "stoch_sell"],
    "rsi_chart": ["rsi"],
    "volume_chart": ["volume"],
}
TITLES = {
    "price_overlay": "Price History with buy and sell signals",
    "sma": "Price History with Buy and Sell Signals (SMA)",
    "ema": "Price History with Buy and Sell Signals (EMA)",
    "bollinger": "Price History with Bollinger Bands",
    "levels": "Price History with Support-Resistance levels",
}
ADHOC = """SELECT symbol, count(*) AS n_bars, round(avg(rsi), 4) AS avg_rsi,
       count(sma_buy) AS sma_buys, count(sma_sell) AS sma_sells,
       count(stoch_buy) AS stoch_buys, round(max(stoch_k), 4) AS max_k
FROM enr GROUP BY symbol"""


def places(name: str) -> int:
    return LOOSE_DECIMALS if name.startswith(LOOSE) and not name.endswith(("_buy", "_sell", "_price")) else D


def r(expr: str, alias: str) -> str:
    return f"round({expr}, {places(alias)}) AS {alias}"


def even2(expr: str) -> str:
    return f"round_even(({expr}) * 100, 0) / 100"


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def lineitem_bars_cte(unit: str) -> str:
    key = "CAST(l_shipdate AS DATE)" if unit == "day" else f"CAST(date_trunc('{unit}', l_shipdate) AS DATE)"
    asc = "l_shipdate, l_orderkey, l_linenumber, l_extendedprice"
    desc = "l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC"
    return f"""bars AS (
  SELECT l_suppkey AS symbol, {key} AS bar_date,
         first(l_extendedprice ORDER BY {asc}) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         first(l_extendedprice ORDER BY {desc}) AS close,
         first(l_extendedprice ORDER BY {desc}) * {_dbl(B.ADJ_FACTOR)} AS adj_close,
         sum(l_quantity) AS volume
  FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_shipdate IS NOT NULL
  GROUP BY 1, 2)"""


def event_bars_cte(unit: str = "hour") -> str:
    return f"""bars AS (
  SELECT event_type AS symbol, date_trunc('{unit}', ts) AS bar_date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         first(value ORDER BY ts DESC, event_id DESC) AS close,
         first(value ORDER BY ts DESC, event_id DESC) * {_dbl(B.ADJ_FACTOR)} AS adj_close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL
  GROUP BY 1, 2)"""


def _full(agg: str, x: str, n: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def _state(a: str, b: str) -> str:
    tie = f"abs({a} - {b}) <= {TIE_RTOL!r} * greatest(abs({a}), abs({b}))"
    return f"CASE WHEN {a} > {b} AND NOT ({tie}) THEN 1 WHEN {a} < {b} AND NOT ({tie}) THEN -1 END"


def enriched_ctes(src: str = "bars") -> str:
    """CTEs ending in ``enr``: the bars with every indicator, extremum and signal."""
    w = "(PARTITION BY symbol ORDER BY t)"
    cum = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ema_sums, ema_vals, ema_last = [], [], []
    for span in (P.ema_fast, P.ema_slow):
        ratio = 1.0 - 2.0 / (span + 1.0)
        weight = f"power({_dbl(ratio)}, -t)"
        ema_sums.append(f"sum(CASE WHEN close IS NOT NULL THEN close * {weight} ELSE 0 END) OVER {cum} AS en{span}")
        ema_sums.append(f"sum(CASE WHEN close IS NOT NULL THEN {weight} ELSE 0 END) OVER {cum} AS eq{span}")
        ema_vals.append(f"CASE WHEN close IS NOT NULL THEN en{span} / eq{span} END AS e{span}")
        ema_last.append(f"last_value(e{span} IGNORE NULLS) OVER {cum} AS ema{span}")
    k, d = "stoch_k", "stoch_d"
    up = f"{k} < {P.stoch_low} AND {d} < {P.stoch_low} AND ({_state(k, d)}) = 1"
    down = f"{k} > {P.stoch_high} AND {d} > {P.stoch_high} AND ({_state(k, d)}) = -1"
    sig_cols = []
    for rule in ("sma", "ema", "stoch"):
        sig_cols.append(f"CASE WHEN s_{rule} = 1 AND p_{rule} = -1 THEN adj_close END AS {rule}_buy")
        sig_cols.append(f"CASE WHEN s_{rule} = -1 AND p_{rule} = 1 THEN adj_close END AS {rule}_sell")
    return f"""pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS t FROM {src}),
ind1 AS (
  SELECT *,
    {_full('avg', 'close', P.sma_fast)} AS sma5,
    {_full('avg', 'close', P.sma_slow)} AS sma15,
    {_full('stddev_samp', 'close', P.bb_n)} AS std15,
    {_full('max', 'high', P.stoch_n)} AS hh5,
    {_full('min', 'low', P.stoch_n)} AS ll5,
    close - lag(close) OVER {w} AS delta,
    CASE WHEN close < lag(close) OVER {w} AND close < lead(close) OVER {w} THEN 'support'
         WHEN close > lag(close) OVER {w} AND close > lead(close) OVER {w} THEN 'resistance' END AS extremum,
    {', '.join(ema_sums)}
  FROM pos),
ind2 AS (
  SELECT *,
    sma15 + {P.bb_k} * std15 AS bb_upper, sma15 - {P.bb_k} * std15 AS bb_lower,
    100.0 * ((close - ll5) / nullif(hh5 - ll5, 0)) AS stoch_k,
    CASE WHEN delta > 0 THEN delta ELSE 0.0 END AS gain,
    CASE WHEN delta < 0 THEN -delta ELSE 0.0 END AS loss,
    {', '.join(ema_vals)}
  FROM ind1),
ind3 AS (
  SELECT *,
    {_full('avg', 'stoch_k', P.stoch_d)} AS stoch_d,
    {_full('avg', 'gain', P.rsi_n)} AS avg_gain,
    {_full('avg', 'loss', P.rsi_n)} AS avg_loss,
    {', '.join(ema_last)}
  FROM ind2),
ind4 AS (
  SELECT *,
    CASE WHEN avg_loss = 0 AND avg_gain = 0 THEN NULL WHEN avg_loss = 0 THEN 100.0
         ELSE 100.0 - 100.0 / (1.0 + avg_gain / avg_loss) END AS rsi,
    {_state('sma5', 'sma15')} AS s_sma,
    {_state('ema5', 'ema15')} AS s_ema,
    CASE WHEN {up} THEN 1 WHEN {down} THEN -1 END AS s_stoch
  FROM ind3),
sig AS (
  SELECT *,
    coalesce(last_value(s_sma IGNORE NULLS) OVER {before}, -1) AS p_sma,
    coalesce(last_value(s_ema IGNORE NULLS) OVER {before}, -1) AS p_ema,
    coalesce(last_value(s_stoch IGNORE NULLS) OVER {before}, -1) AS p_stoch
  FROM ind4),
enr AS (
  SELECT symbol, bar_date, open, high, low, close, adj_close, volume,
         sma5, sma15, std15, bb_upper, bb_lower, ema5, ema15, hh5, ll5, stoch_k, stoch_d, rsi, extremum,
         {', '.join(sig_cols)}
  FROM sig)"""


def levels_ctes(sensitivity: float = P.level_sensitivity) -> str:
    """Extrema, the band filter written as its EXISTS definition, and last levels."""
    s = _dbl(sensitivity)
    return f"""ext AS (SELECT symbol, extremum AS kind, bar_date, close AS level FROM enr WHERE extremum IS NOT NULL),
lev AS (SELECT a.* FROM ext a WHERE EXISTS (
  SELECT 1 FROM ext b WHERE b.symbol = a.symbol AND b.kind = a.kind AND abs(a.level - b.level) > {s} * a.level)),
last_lev AS (SELECT symbol, kind, arg_max_null(level, bar_date) AS level, max(bar_date) AS bar_date
             FROM lev GROUP BY symbol, kind)"""


def votes_cte() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.EVENT_VOTE_LABELS.items())
    labels = [lb for lb in LABELS if lb in B.EVENT_VOTE_LABELS.values()]
    counts = ", ".join(f"count(*) FILTER (WHERE label = '{lb}') AS {lb}" for lb in labels)
    return f"""ev AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CASE event_type {cases} END AS label FROM events),
votes AS (SELECT symbol, {counts} FROM ev GROUP BY symbol)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _month() -> str:
    return lineitem_bars_cte("month")


ENRICHED_COLS = ["open", "high", "low", "close", "adj_close", "volume", "sma5", "sma15", "std15", "bb_upper",
                 "bb_lower", "ema5", "ema15", "hh5", "ll5", "stoch_k", "stoch_d", "rsi"]
SIGNAL_COLS = [f"{rule}_{side}" for rule in ("sma", "ema", "stoch") for side in ("buy", "sell")]


def _enriched_select() -> str:
    cols = [r(c, c) for c in ENRICHED_COLS + SIGNAL_COLS]
    return "SELECT symbol, bar_date, " + ", ".join(cols[:len(ENRICHED_COLS)]) + ", extremum, " + \
        ", ".join(cols[len(ENRICHED_COLS):]) + " FROM enr"


def _cols(*cols: str, where: str = "") -> str:
    return f"SELECT symbol, bar_date, {', '.join(r(c, c) for c in cols)} FROM enr {where}"


def _bars_select() -> str:
    return "SELECT symbol, bar_date, " + ", ".join(r(c, c) for c in ENRICHED_COLS[:6]) + " FROM bars"


def _fired(rule: str) -> str:
    return _cols(f"{rule}_buy", f"{rule}_sell", where=f"WHERE {rule}_buy IS NOT NULL OR {rule}_sell IS NOT NULL")


def _chart(columns: list[str], with_levels: bool) -> str:
    parts = [f"SELECT symbol, bar_date, '{c}' AS series, round({c}, {places(c)}) AS value FROM enr WHERE {c} IS NOT NULL"
             for c in columns]
    if with_levels:
        for edge in ("min", "max"):
            parts.append(f"""SELECT l.symbol, s.{edge}_date AS bar_date, l.kind AS series, round(l.level, {D}) AS value
  FROM last_lev l JOIN (SELECT symbol, min(bar_date) AS min_date, max(bar_date) AS max_date FROM enr GROUP BY symbol) s
  ON l.symbol = s.symbol""")
    ctes = [_month(), enriched_ctes()] + ([levels_ctes()] if with_levels else [])
    return _with(*ctes) + "\nUNION ALL\n".join(parts)


def _profile() -> str:
    last = ["max(bar_date) AS last_date"]
    last += [f"round({even2(f'arg_max_null({c}, bar_date)')}, {D}) AS {c}" for c in ("close", "high", "low")]
    last += [f"round(arg_max_null({c}, bar_date), {places(c)}) AS {c}"
             for c in ("sma5", "sma15", "ema5", "ema15", "bb_upper", "bb_lower", "stoch_k", "stoch_d", "rsi")]
    for rule in ("sma", "ema", "stoch"):
        fired = f"CASE WHEN {rule}_buy IS NOT NULL OR {rule}_sell IS NOT NULL THEN bar_date END"
        side = f"CASE WHEN {rule}_buy IS NOT NULL THEN 'BUY' WHEN {rule}_sell IS NOT NULL THEN 'SELL' END"
        last += [f"arg_max_null({side}, {fired}) AS {rule}_last_signal",
                 f"round(arg_max_null(coalesce({rule}_buy, {rule}_sell), {fired}), {D}) AS {rule}_last_price",
                 f"max({fired}) AS {rule}_last_date"]
    fund = """fund AS (SELECT s_suppkey AS symbol,
    CAST(NULL AS DOUBLE) AS profitMargins, CAST(NULL AS BIGINT) AS netIncomeToCommon,
    CAST(NULL AS DOUBLE) AS enterpriseToEbitda, CAST(trunc(s_acctbal) AS BIGINT) AS totalCash,
    CAST(NULL AS BIGINT) AS totalDebt, CAST(NULL AS DOUBLE) AS ebitdaMargins,
    CAST(NULL AS DOUBLE) AS operatingMargins, CAST(NULL AS DOUBLE) AS debtToEquity,
    s_name AS longBusinessSummary FROM supplier)"""
    labels = [lb for lb in LABELS if lb in B.EVENT_VOTE_LABELS.values()]
    return _with(_month(), enriched_ctes(), levels_ctes(), votes_cte(), fund,
                 f"lv AS (SELECT symbol, {', '.join(last)} FROM enr GROUP BY symbol)",
                 """lw AS (SELECT symbol, max(CASE WHEN kind = 'support' THEN level END) AS last_support,
                 max(CASE WHEN kind = 'resistance' THEN level END) AS last_resistance FROM last_lev GROUP BY symbol)""") + \
        f"""SELECT lv.*, CAST(lv.symbol AS VARCHAR) || ' Price History with buy and sell signals' AS title,
       round(lw.last_support, {D}) AS last_support, round(lw.last_resistance, {D}) AS last_resistance,
       f.profitMargins, f.netIncomeToCommon, f.enterpriseToEbitda, f.totalCash, f.totalDebt, f.ebitdaMargins,
       f.operatingMargins, f.debtToEquity, f.longBusinessSummary, {', '.join('v.' + lb for lb in labels)}
FROM lv LEFT JOIN lw ON lv.symbol = lw.symbol LEFT JOIN fund f ON lv.symbol = f.symbol
LEFT JOIN votes v ON split_part(CAST(lv.symbol AS VARCHAR), '.', 1) = v.symbol"""


def _fundamentals() -> str:
    doubles = ["profitMargins", "enterpriseToEbitda", "ebitdaMargins", "operatingMargins", "debtToEquity"]
    longs = ["netIncomeToCommon", "totalCash", "totalDebt"]
    cols = ["CAST(json_extract(props, '$.k') AS BIGINT) AS k"]
    cols += [f"round(CAST(json_extract(props, '$.{c}') AS DOUBLE), {D}) AS {c}" for c in doubles]
    cols += [f"CAST(json_extract(props, '$.{c}') AS BIGINT) AS {c}" for c in longs]
    cols += ["json_extract_string(props, '$.longBusinessSummary') AS longBusinessSummary"]
    return f"SELECT event_id, {', '.join(cols)} FROM events"


def _recent() -> str:
    start, end = default_range(RECENT_AS_OF)
    src = f"(SELECT * FROM bars WHERE bar_date >= DATE '{start}' AND bar_date < DATE '{end}')"
    return _with(lineitem_bars_cte("day"), enriched_ctes(src)) + _cols("close", "sma5", "rsi")


def _ema_long() -> str:
    """Each value as weighted sums over the rows that still count (weights below 1e-18 left out)."""
    parts, joins = [], []
    for span, rows in ((5, 110), (100, 2200)):
        ratio = _dbl(1.0 - 2.0 / (span + 1.0))
        parts.append(f"""e{span} AS (SELECT a.symbol, a.t, sum(b.close * power({ratio}, a.t - b.t)) / sum(power({ratio}, a.t - b.t)) AS ema{span}
  FROM pos a JOIN pos b ON a.symbol = b.symbol AND b.t BETWEEN a.t - {rows} AND a.t WHERE b.close IS NOT NULL GROUP BY 1, 2)""")
        joins.append(f"LEFT JOIN e{span} USING (symbol, t)")
    pos = "pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS t FROM bars)"
    return _with(event_bars_cte("minute"), pos, *parts) + \
        f"SELECT symbol, bar_date, {r('ema5', 'ema5')}, {r('ema100', 'ema100')} FROM pos {' '.join(joins)}"


def _fundamentals_full() -> str:
    keys = {"profitMargins": (2, "s_acctbal / 16384"), "netIncomeToCommon": (3, "CAST(floor(s_acctbal * 8) AS BIGINT)"),
            "enterpriseToEbitda": (5, "(s_suppkey % 64) / 4.0::DOUBLE"), "totalCash": (7, "CAST(floor(s_acctbal) AS BIGINT)"),
            "totalDebt": (4, "CAST(floor(s_acctbal / 2) AS BIGINT)"), "ebitdaMargins": (6, "s_acctbal / 8192"),
            "operatingMargins": (9, "s_acctbal / 4096"), "debtToEquity": (10, "(s_suppkey % 32) / 8.0::DOUBLE"),
            "longBusinessSummary": (11, "s_name")}
    cols = []
    for name, (m, expr) in keys.items():
        value = f"CASE WHEN s_suppkey % {m} <> 0 THEN {expr} END"
        exact = "BIGINT" in expr or name == "longBusinessSummary"
        cols.append(f"{value} AS {name}" if exact else f"round({value}, {D}) AS {name}")
    return f"SELECT s_suppkey AS symbol, {', '.join(cols)} FROM supplier"


def _roundtrip(watch: str) -> str:
    src = (f"(SELECT * FROM bars WHERE bar_date >= DATE '{B.RANGE_START}' AND bar_date < DATE '{B.RANGE_END}' "
           f"AND symbol IN ({watch}))")
    return _with(lineitem_bars_cte("day"), enriched_ctes(src)) + _cols("close", "volume", "sma15", "rsi")


def _revised() -> str:
    """Every delivery as a row, the latest revision of each day by rank, then the plain averages."""
    versions = [("1", "1.0", "TRUE"), ("2", "1.25", "day(bar_date) % 3 = 0"), ("0", "0.5", "day(bar_date) % 4 = 0")]
    rows = " UNION ALL ".join(f"SELECT symbol, bar_date, {v} AS revision, high * {k} AS high, close * {k} AS close, adj_close * {k} AS adj_close "
                              f"FROM bars WHERE {w}" for v, k, w in versions)
    latest = f"""latest AS (SELECT * FROM ({rows}) WHERE bar_date >= DATE '{B.RANGE_START}' AND bar_date < DATE '{B.RANGE_END}'
  QUALIFY row_number() OVER (PARTITION BY symbol, bar_date ORDER BY revision DESC) = 1)"""
    pos = "pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS t FROM latest)"
    return _with(lineitem_bars_cte("day"), latest, pos) + f"""SELECT symbol, bar_date, revision, round(high, {D}) AS high, round(close, {D}) AS close,
  round(adj_close, {D}) AS adj_close, round({_full('avg', 'close', 5)}, {D}) AS sma5 FROM pos"""


def _fundamentals_any() -> str:
    kind = "s_suppkey % 4"
    value = {
        "profitMargins": f"CASE WHEN {kind} = 0 THEN round(s_acctbal / 16384, {D}) END",
        "netIncomeToCommon": f"CASE WHEN {kind} = 2 THEN CAST(floor(s_acctbal * 8) AS BIGINT) END",
        "enterpriseToEbitda": "CAST(NULL AS DOUBLE)",
        "totalCash": f"CASE WHEN {kind} IN (0, 1) THEN CAST(floor(s_acctbal) AS BIGINT) END",
        "totalDebt": f"CASE {kind} WHEN 0 THEN CAST(floor(s_acctbal / 2) AS BIGINT) WHEN 1 THEN CAST(floor(s_acctbal / 4) AS BIGINT) END",
        "ebitdaMargins": "CAST(NULL AS DOUBLE)", "operatingMargins": "CAST(NULL AS DOUBLE)",
        "debtToEquity": f"CASE WHEN {kind} = 0 THEN (s_suppkey % 32) / 8.0::DOUBLE END",
        "longBusinessSummary": f"CASE WHEN {kind} IN (0, 1) THEN s_name END"}
    return "SELECT s_suppkey AS symbol, " + ", ".join(f"{v} AS {c}" for c, v in value.items()) + " FROM supplier"


def _as_of() -> str:
    return _with(lineitem_bars_cte("day"), """reports AS (
  SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS reported, CAST(o_totalprice AS DOUBLE) AS revenue, o_orderstatus AS status FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, o_orderstatus DESC) = 1)""") + \
        f"""SELECT b.symbol, b.bar_date, round(b.close, {D}) AS close, round(b.volume, {D}) AS volume, r.reported, round(r.revenue, {D}) AS revenue, r.status
FROM bars b ASOF LEFT JOIN reports r ON b.symbol = r.symbol AND b.bar_date >= r.reported"""


def _clusters(gap: float) -> str:
    return _with(lineitem_bars_cte("day"), enriched_ctes(), levels_ctes(),
                 f"""edge AS (SELECT *, CASE WHEN level - lag(level) OVER w > {_dbl(gap)} * abs(lag(level) OVER w) THEN 1 ELSE 0 END AS fresh,
                 row_number() OVER w AS n FROM ext WINDOW w AS (PARTITION BY symbol, kind ORDER BY level, bar_date))""",
                 "island AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY symbol, kind ORDER BY n) AS BIGINT) AS cluster FROM edge)") + \
        f"""SELECT symbol, kind, cluster, round(min(level), {D}) AS low, round(max(level), {D}) AS high, round(avg(level), {D}) AS mean,
  count(*) AS hits, min(bar_date) AS first_date, max(bar_date) AS last_date FROM island GROUP BY symbol, kind, cluster"""


def _functions() -> str:
    """Spans that the enriched frame lacks, as windows; the EMA in closed form."""
    ratio = _dbl(1.0 - 2.0 / 10.0)
    cum = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    moves = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    return _with(_month(), "pos AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS t FROM bars)",
                 "step AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) AS d FROM pos)",
                 f"""f AS (SELECT symbol, bar_date, {_full('avg', 'close', 7)} AS sma7, {_full('avg', 'close', 3)} AS sma3,
  {_full('stddev_samp', 'close', 7)} AS std7, sum(close * power({ratio}, -t)) OVER {cum} / sum(power({ratio}, -t)) OVER {cum} AS ema9,
  CASE WHEN t >= 13 THEN 100 * sum(greatest(d, 0)) OVER {moves} / nullif(sum(abs(d)) OVER {moves}, 0) END AS rsi14,
  100 * (close - {_full('min', 'low', 9)}) / nullif({_full('max', 'high', 9)} - {_full('min', 'low', 9)}, 0) AS k9 FROM step)""") + \
        f"""SELECT symbol, bar_date, round(sma7, {D}) AS sma7, {r('std7', 'std7')}, {r('ema9', 'ema9')}, round(rsi14, {D}) AS rsi14, round(k9, {D}) AS k9,
  {_state('sma3', 'sma7')} AS crossing FROM f"""


def _snapshot(scale: float = 1.0) -> str:
    cols = ", ".join(f"round({even2(f'arg_max_null({c}, bar_date) * {_dbl(scale)}')}, {D}) AS {c}" for c in ("close", "high", "low"))
    return _with(_month()) + f"SELECT symbol, max(bar_date) AS bar_date, {cols} FROM bars GROUP BY symbol"


def oracle_sql() -> dict[str, str]:
    month_enr = _with(_month(), enriched_ctes())
    month_lev = _with(_month(), enriched_ctes(), levels_ctes())
    watch = f"""SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{B.WATCH_REGION}'"""
    return {
        "bars_month": _with(_month()) + _bars_select(),
        "bars_day": _with(lineitem_bars_cte("day")) + _bars_select(),
        "bars_events_hour": _with(event_bars_cte()) + _bars_select(),
        "bars_range": _with(_month()) + _bars_select() +
        f" WHERE bar_date >= DATE '{B.RANGE_START}' AND bar_date < DATE '{B.RANGE_END}' AND symbol IN ({watch})",
        "recent_window": _recent(),
        "sma": month_enr + _cols("sma5", "sma15"),
        "bollinger": month_enr + _cols("std15", "bb_upper", "bb_lower"),
        "ema": month_enr + _cols("ema5", "ema15"),
        "stochastic": month_enr + _cols("hh5", "ll5", "stoch_k", "stoch_d"),
        "rsi": month_enr + _cols("rsi"),
        "sma_signals": month_enr + _fired("sma"),
        "ema_signals": month_enr + _fired("ema"),
        "stochastic_signals": month_enr + _fired("stoch"),
        "extrema": month_lev + f"SELECT symbol, kind, bar_date, round(level, {D}) AS level FROM ext",
        "levels": month_lev + f"SELECT symbol, kind, bar_date, round(level, {D}) AS level FROM lev",
        "last_levels": month_lev + f"SELECT symbol, kind, round(level, {D}) AS level, bar_date FROM last_lev",
        "latest_snapshot": _snapshot(),
        "snapshot_rounded": _snapshot(FINE_PRICE),
        "vote_share": _with(votes_cte()) + f"""SELECT symbol, label, n,
            round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY symbol), 0), {D}) AS share FROM (
            {' UNION ALL '.join(f"SELECT symbol, '{lb}' AS label, coalesce({lb}, 0) AS n FROM votes"
                                for lb in LABELS
                                if lb in B.EVENT_VOTE_LABELS.values())})""",
        "fundamentals": _fundamentals(),
        "symbol_base": """SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || '.NS' AS ticker,
            split_part(CAST(s_suppkey AS VARCHAR) || '.NS', '.', 1) AS base,
            split_part(s_name || '.BO.X', '.', 1) AS name_base FROM supplier""",
        **{name: _chart(cols, name in ("price_overlay", "sma_chart", "ema_chart", "bollinger_chart", "level_chart"))
           for name, cols in CHARTS.items()},
        "chart_titles": _with(_month()) + " UNION ALL ".join(
            f"SELECT DISTINCT symbol, '{k}' AS chart, CAST(symbol AS VARCHAR) || ' {t}' AS title FROM bars" for k, t in TITLES.items()),
        "symbol_profile": _profile(),
        "adhoc_sql": month_enr + ADHOC,
        "enriched": month_enr + _enriched_select(),
        "enriched_daily": _with(lineitem_bars_cte("day"), enriched_ctes()) + _enriched_select(),
        "enriched_events": _with(event_bars_cte(), enriched_ctes()) + _enriched_select(),
        "enriched_blocks": _with(lineitem_bars_cte("day"), enriched_ctes()) + _enriched_select(),
        "enriched_bucketed": _with(lineitem_bars_cte("day"), enriched_ctes()) + _enriched_select(),
        "enriched_resumed": _with(lineitem_bars_cte("day"), enriched_ctes()) + _enriched_select(),
        "signals_daily": _with(lineitem_bars_cte("day"), enriched_ctes()) + _cols(*SIGNAL_COLS),
        "levels_daily": _with(lineitem_bars_cte("day"), enriched_ctes(), levels_ctes()) +
        f"SELECT symbol, kind, bar_date, round(level, {D}) AS level FROM lev",
        "levels_band": _with(_month(), enriched_ctes(), levels_ctes(BAND.level_sensitivity)) +
        f"SELECT symbol, kind, bar_date, round(level, {D}) AS level FROM lev",
        "ema_long": _ema_long(),
        "fundamentals_full": _fundamentals_full(),
        "load_roundtrip": _roundtrip(watch),
        "bars_revised": _revised(),
        "fundamentals_any": _fundamentals_any(),
        "bars_as_of": _as_of(),
        "level_clusters": _clusters(CLUSTER_GAP),
        "adhoc_functions": _functions(),
    }
