"""Golden series from FIXTURES.md (our own fixture, worked out with pandas)."""

from __future__ import annotations

import datetime as dt
import pathlib

FIXTURES = pathlib.Path(__file__).resolve().parent.parent / "FIXTURES.md"
GOLDEN_COLS = ["t", "high", "low", "close", "adj_close", "volume", "sma5", "sma15", "bb_up", "bb_lo",
               "ema5", "ema15", "k", "d", "rsi", "sma", "ema", "sto", "ext"]
START = dt.date(2024, 1, 1)


def golden_rows() -> list[dict]:
    rows = []
    for line in FIXTURES.read_text().splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if len(cells) != len(GOLDEN_COLS) or not cells[0].isdigit():
            continue
        row = {}
        for name, cell in zip(GOLDEN_COLS, cells):
            if name in ("sma", "ema", "sto", "ext"):
                row[name] = cell or None
            elif name == "t":
                row[name] = int(cell)
            else:
                row[name] = float(cell) if cell else None
        rows.append(row)
    return rows


def golden_bars(symbol: str = "AAA.NS") -> list[tuple]:
    return [(symbol, START + dt.timedelta(days=r["t"]), r["close"], r["high"], r["low"], r["close"],
             r["adj_close"], r["volume"]) for r in golden_rows()]


BARS_DDL = ("symbol string, bar_date date, open double, high double, low double, close double, "
            "adj_close double, volume double")
