"""Technical feature panel: one shuffle by symbol, then window passes on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.series import (
    RollingMeans, Smoothing, over, ratio_return, rolling_zscore, series_window,
)

FEATURE_COLUMNS = (
    "ret_1", "ret_20", "ret_126", "ma20", "ma50", "ma200", "ema20", "ema50", "ema200",
    "atr14", "atr_pct", "rsi14", "volume_z60", "turnover_z60", "displacement_atr",
    "trend_confirmed", "signal_pullback", "signal_reversal", "setup_quality",
    "volume_confirmation",
)


def add_baseline_features(bars: DataFrame, sessions: int | None = None) -> DataFrame:
    """Returns, averages, volatility, signals and setup quality per bar.

    Looks only at the current and earlier bars of the same symbol. Every window
    column that needs no other one is computed in the same pass. ``sessions`` is a
    proven bound on the bars of a symbol; a small one saves sorts.
    """
    w = over("symbol", "trading_date")
    names = bars.columns
    value = "value" if "value" in names else "close * volume"
    short, longer, n = P.PULLBACK_VOLUME_SHORT, min(P.MA_WINDOWS), P.RSI_WINDOW
    means = RollingMeans(
        bars,
        [("close", k, k, f"ma{k}") for k in P.MA_WINDOWS]
        + [("volume", short, short, "__vshort"), ("volume", longer, longer, "__vlong")],
    )
    smooth = Smoothing(
        [("close", 2 / (k + 1), k, f"ema{k}") for k in P.MA_WINDOWS]
        + [("__tr", 1 / n, n, "atr14"), ("__up", 1 / n, n, "__au", 1), ("__down", 1 / n, n, "__ad", 1)],
        rows=sessions,
    )
    d = bars.withColumns(
        {
            "__prev": F.expr(f"double(lag(close) {w})"),
            "volume_z60": rolling_zscore("volume", P.ZSCORE_WINDOW, P.ZSCORE_MIN_OBS),
            "turnover_z60": rolling_zscore(value, P.ZSCORE_WINDOW, P.ZSCORE_MIN_OBS),
            **{
                f"ret_{k}": F.expr(f"try_divide(double(close), double(lag(close, {k}) {w})) - 1")
                for k in (1, *P.RS_HORIZONS)
            },
            **means.totals(),
            **smooth.position(),
        }
    )
    d = d.withColumns(
        {
            # greatest skips nulls, so the first bar's range is high - low
            "__tr": F.expr("double(greatest(abs(high - low), abs(high - __prev), abs(low - __prev)))"),
            "__up": F.expr("CASE WHEN __prev IS NOT NULL THEN greatest(close - __prev, 0D) END"),
            "__down": F.expr("CASE WHEN __prev IS NOT NULL THEN greatest(__prev - close, 0D) END"),
            **means.means(),
            **smooth.blocks(),
        }
    )
    d = d.withColumns(smooth.local()).withColumns(smooth.smoothed())
    d = d.withColumns({k: F.expr(e) for k, e in _BASE.items()})
    final = {k: f"{e} AS {k}" for k, e in _SIGNALS.items()}
    return d.selectExpr(*names, *[final.get(k, k) for k in FEATURE_COLUMNS])


# row-level expressions over the windowed columns
_BASE = {
    "atr_pct": "try_divide(atr14, double(close))",
    "rsi14": "CASE WHEN __ad = 0 THEN 100D ELSE 100 - 100 / (1 + __au / __ad) END",
    "trend_confirmed": "coalesce(ma20 > ma50 AND ma50 > ma200 AND close > ma200, false)",
    "__distance": "close / ma20 - 1",
    "__reclaim": "coalesce(close > open AND close > __prev, false)",
}
_SIGNALS = {
    "displacement_atr": "abs(close - __prev) / nullif(atr14, 0D)",
    "signal_pullback": (
        f"coalesce(trend_confirmed AND close > ma200 * {1 + P.PULLBACK_TREND_BUFFER}D"
        f" AND __distance BETWEEN {P.PULLBACK_MA_DISTANCE[0]}D AND {P.PULLBACK_MA_DISTANCE[1]}D"
        f" AND __vshort < __vlong * {P.PULLBACK_VOLUME_MULTIPLIER}D AND __reclaim, false)"
    ),
    "signal_reversal": (
        f"coalesce(rsi14 < {P.REVERSAL_RSI_MAX} AND close > __prev AND close > ma200"
        f" AND (close - low) / nullif(double(high - low), 0D) > {P.REVERSAL_CLOSE_LOCATION_MIN}D, false)"
    ),
    # least skips nulls, hence the guard
    "setup_quality": (
        "CASE WHEN __distance IS NOT NULL AND atr_pct IS NOT NULL THEN greatest(0D, least(1D,"
        f" {P.SETUP_WEIGHTS['trend']}D * int(trend_confirmed)"
        f" + {P.SETUP_WEIGHTS['ma_distance']}D * (1 - least(1D, abs(__distance) / {P.SETUP_MA_DISTANCE_SCALE}D))"
        f" + {P.SETUP_WEIGHTS['reclaim']}D * int(__reclaim)"
        f" + {P.SETUP_WEIGHTS['volatility']}D * (1 - least(1D, atr_pct / {P.SETUP_ATR_SCALE}D)))) END"
    ),
    "volume_confirmation": (
        f"greatest(0D, least(1D, {P.VOLUME_SCORE_NEUTRAL}D + {P.VOLUME_SCORE_SLOPE}D * coalesce(volume_z60, 0D)))"
    ),
}


def factor_jumps(prices: DataFrame, minimum: float = P.MIN_FACTOR_JUMP) -> DataFrame:
    """Sessions where the adjusted/raw factor moves by at least ``minimum``."""
    w = series_window()
    factor = F.try_divide(F.col("adj_close").cast("double"), F.col("close").cast("double"))
    d = prices.withColumn("factor", factor).withColumn("previous_factor", F.lag("factor").over(w))
    d = d.withColumn("factor_change", ratio_return(F.col("factor"), F.col("previous_factor")))
    return d.where(F.abs("factor_change") >= minimum).select(
        "symbol", "trading_date", "previous_factor", "factor", "factor_change",
        F.lit("UNKNOWN").alias("action_type"), F.lit("UNRESOLVED").alias("resolution_status"),
    )
