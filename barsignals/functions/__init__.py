from barsignals.functions.scalar import (TIE_RTOL, chart_title, crossing_state, is_above, is_below,
                                        nan_to_null, null_double, round2, safe_div, symbol_base, tie)

__all__ = ["TIE_RTOL", "chart_title", "crossing_state", "is_above", "is_below", "nan_to_null",
           "null_double", "round2", "safe_div", "symbol_base", "tie"]
