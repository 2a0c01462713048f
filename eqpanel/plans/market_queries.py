"""Queries over the panel: windows, features, relative strength, market state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.ordered import with_rank_pct
from eqpanel.functions.series import (
    ewm, ratio_return, rolling_means, rolling_zscore, series_window,
)
from eqpanel.operators import features as FE
from eqpanel.operators import market as MK
from eqpanel.operators import relative_strength as RS
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D

_SECTOR_FLOATS = (
    "rs20:8 rs126:8 breadth volume_impulse:8 rs20_rank rs126_rank breadth_rank volume_impulse_rank leadership_score"
)
INDEX_PRIORITY = ("IDXA", "IDXB")


def _features(spark, sf) -> DataFrame:
    return FE.add_baseline_features(D.bars(spark, sf))


def _rs(spark, sf) -> DataFrame:
    return RS.add_cross_sectional_rs(_features(spark, sf), symbols_bound=D.symbol_bound(spark, sf))


@query("panel_bars")
def panel_bars(spark, sf):
    return D.bars(spark, sf)


@query("e01_returns", "ret_1:8 ret_20:8 ret_126:8")
def e01(spark, sf):
    w, c = series_window(), F.col("close").cast("double")
    return D.bars(spark, sf, with_sector=False).select(
        "symbol", "trading_date", *[ratio_return(c, F.lag(c, k).over(w)).alias(f"ret_{k}") for k in (1, 20, 126)]
    )


@query("e02_difference")
def e02(spark, sf):
    w = series_window()
    return D.bars(spark, sf, with_sector=False).select(
        "symbol", "trading_date", F.lag("close").over(w).alias("previous_close"),
        (F.col("close") - F.lag("close").over(w)).alias("diff"),
    )


@query("e03_rolling_mean", "ma20:4 ma50:4 ma200:4 vol5:4 vol20:4")
def e03(spark, sf):
    specs = [("close", n, n, f"ma{n}") for n in P.MA_WINDOWS] + [("volume", 5, 5, "vol5"), ("volume", 20, 20, "vol20")]
    return rolling_means(D.bars(spark, sf, with_sector=False), specs).select(
        "symbol", "trading_date", "ma20", "ma50", "ma200", "vol5", "vol20"
    )


@query("e04_rolling_mean_min_obs", "value_ma20:4")
def e04(spark, sf):
    return rolling_means(D.bars(spark, sf, with_sector=False), [("value", 20, 10, "value_ma20")]).select(
        "symbol", "trading_date", "value_ma20"
    )


@query("e05_rolling_zscore", "volume_z60:8")
def e05(spark, sf):
    z = rolling_zscore("volume", P.ZSCORE_WINDOW, P.ZSCORE_MIN_OBS)
    return D.bars(spark, sf, with_sector=False).select("symbol", "trading_date", z.alias("volume_z60"))


@query("e06_ema", "ema20:4 ema50:4 ema200:4")
def e06(spark, sf):
    return ewm(
        D.bars(spark, sf, with_sector=False), [("close", 2 / (n + 1), n, f"ema{n}") for n in P.MA_WINDOWS]
    ).select("symbol", "trading_date", "ema20", "ema50", "ema200")


@query("e07_wilder_average", "rma14:4")
def e07(spark, sf):
    return ewm(D.bars(spark, sf, with_sector=False), [("volume", 1 / 14, 14, "rma14")]).select(
        "symbol", "trading_date", "rma14"
    )


@query("e08_atr", "atr14:4 atr_pct:8")
def e08(spark, sf):
    return _features(spark, sf).select("symbol", "trading_date", "atr14", "atr_pct")


@query("e09_rsi", "rsi14:6")
def e09(spark, sf):
    return _features(spark, sf).select("symbol", "trading_date", "rsi14")


@query("e10_displacement", "displacement_atr:8")
def e10(spark, sf):
    return _features(spark, sf).select("symbol", "trading_date", "displacement_atr")


@query("e11_percentile_rank", "volume_rank")
def e11(spark, sf):
    return with_rank_pct(
        D.bars(spark, sf, with_sector=False), ["trading_date"], "volume", "volume_rank", D.symbol_bound(spark, sf)
    ).select("symbol", "trading_date", "volume_rank")


@query("e11_percentile_rank_split", "volume_rank")
def e11_split(spark, sf):
    """The same ranks with no bound on the group: ordered blocks instead of a window."""
    return with_rank_pct(
        D.bars(spark, sf, with_sector=False), ["trading_date"], "volume", "volume_rank"
    ).select("symbol", "trading_date", "volume_rank")


@query("e13_winsorize", "ret_1_clipped:8")
def e13(spark, sf):
    w, c = series_window(), F.col("close").cast("double")
    d = D.bars(spark, sf, with_sector=False).withColumn("ret_1", ratio_return(c, F.lag(c).over(w)))
    return RS.winsorize(d, "ret_1", "ret_1_clipped", group_bound=D.symbol_bound(spark, sf)).select(
        "symbol", "trading_date", "ret_1_clipped"
    )


@query("e14_running_product", "wealth:6 peak:6")
def e14(spark, sf):
    w, c = series_window(), F.col("close").cast("double")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = D.bars(spark, sf, with_sector=False).withColumn("r", F.coalesce(ratio_return(c, F.lag(c).over(w)), F.lit(0.0)))
    d = d.withColumn("wealth", F.product(1 + F.col("r")).over(run))
    return d.select("symbol", "trading_date", "wealth", F.max("wealth").over(run).alias("peak"))


@query("e15_factor_jumps", "previous_factor factor factor_change")
def e15(spark, sf):
    panel = D.bars(spark, sf, with_sector=False)
    cal = D.sessions(panel)
    half = cal.agg(F.floor(F.max("session_no") / 2).alias("half"))
    # calendar-bounded, and one row
    d = panel.join(F.broadcast(cal), "trading_date").join(F.broadcast(half))
    split = F.substring("symbol", -1, 1).isin("0", "4", "8") & (F.col("session_no") < F.col("half"))
    adj = F.when(split, F.col("close") * 0.9).otherwise(F.col("close").cast("double"))
    return FE.factor_jumps(d.withColumn("adj_close", adj))


@query("e19_next_session_bar")
def e19(spark, sf):
    w = series_window()
    return D.bars(spark, sf, with_sector=False).select(
        "symbol", "trading_date", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("trading_date", "open", "high", "low")]
    )


@query(
    "h01_baseline_features",
    "ret_1:8 ret_20:8 ret_126:8 ma20:4 ma50:4 ma200:4 ema20:4 ema50:4 ema200:4 atr14:4 atr_pct:8 rsi14:6 "
    "volume_z60:8 turnover_z60:8 displacement_atr:8 setup_quality:8 volume_confirmation:8",
)
def h01(spark, sf):
    return _features(spark, sf).select("symbol", "trading_date", *FE.FEATURE_COLUMNS)


_RS_FLOATS = " ".join(
    f"market_return_{h}:8 sector_return_{h}:8 rs_stock_market_{h}:8 rs_stock_sector_{h}:8 rs_sector_market_{h}:8 "
    f"rs_stock_market_rank_{h} rs_stock_sector_rank_{h} rs_sector_market_rank_{h}"
    for h in P.RS_HORIZONS
)


@query("h02_relative_strength", _RS_FLOATS)
def h02(spark, sf):
    d = RS.add_cross_sectional_rs(D.bars(spark, sf), symbols_bound=D.symbol_bound(spark, sf))
    return d.select("symbol", "trading_date", *[w.split(":")[0] for w in _RS_FLOATS.split()])


@query("h02_relative_strength_split", _RS_FLOATS)
def h02s(spark, sf):
    """The same with no bound on the cross-section: joins and ordered blocks."""
    d = RS.add_cross_sectional_rs(D.bars(spark, sf))
    return d.select("symbol", "trading_date", *[w.split(":")[0] for w in _RS_FLOATS.split()])


@query("d09_h06_sector_scores_split", _SECTOR_FLOATS)
def d09s(spark, sf):
    """Sector scores with exact medians from ordered blocks."""
    cols = ["symbol", "trading_date", "sector", "close", "ma50", "volume_z60"]
    cols += [f"rs_sector_market_{h}" for h in P.RS_HORIZONS]
    return RS.sector_scores(checkpointed(_rs(spark, sf).select(*cols)))


@query("d01_d02_group_returns", "market_return_20:8 sector_return_20:8")
def d01(spark, sf):
    w, c = series_window(), F.col("close").cast("double")
    d = D.bars(spark, sf).withColumn("r", ratio_return(c, F.lag(c, 20).over(w)))
    market = d.groupBy("trading_date").agg(F.avg("r").alias("market_return_20"))
    sector = d.groupBy("trading_date", "sector").agg(F.avg("r").alias("sector_return_20"))
    return sector.join(F.broadcast(market), "trading_date")  # one row per session


@query("d03_equal_weight_index", "close:6 ma20:6 ma50:6 ma200:6")
def d03(spark, sf):
    return MK.equal_weight_index(D.bars(spark, sf, with_sector=False))


@query("d04_d08_breadth", "pct_ma20 pct_ma50 pct_ma200 turnover_ma20:2 turnover_ratio:8")
def d04(spark, sf):
    return MK.breadth(D.bars(spark, sf, with_sector=False))


def _sector_scores(spark, sf, **kw):
    cols = ["symbol", "trading_date", "sector", "close", "ma50", "volume_z60"]
    cols += [f"rs_sector_market_{h}" for h in P.RS_HORIZONS]
    return RS.sector_scores(_rs(spark, sf).select(*cols), symbols_bound=D.symbol_bound(spark, sf), **kw)


@query("d09_h06_sector_scores", _SECTOR_FLOATS)
def d09(spark, sf):
    return _sector_scores(spark, sf)


@query("h06_sector_scores_latest", _SECTOR_FLOATS)
def h06(spark, sf):
    return _sector_scores(spark, sf, latest_only=True)


def _index_bars(spark, sf, panel: DataFrame | None = None) -> DataFrame:
    """Two official series: the first lacks the last session, the second has it."""
    panel = D.bars(spark, sf, with_sector=False) if panel is None else panel
    last = panel.agg(F.max("trading_date").alias("last"))  # one row
    first = D.official_index(panel, INDEX_PRIORITY[0]).join(F.broadcast(last)).where("trading_date < last").drop("last")
    return first.unionByName(D.official_index(panel, INDEX_PRIORITY[1]))


def _cap(spark, sf) -> DataFrame:
    cal = D.sessions(D.bars(spark, sf, with_sector=False))
    return MK.official_index(_index_bars(spark, sf), cal, INDEX_PRIORITY)


@query("e18_index_indicators", "close ma20 ma50 ma200 turnover:2 turnover_ma20:2 turnover_ratio:8")
def e18(spark, sf):
    return MK.index_indicators(_index_bars(spark, sf))


@query("h05_official_index", "close ma20 ma50 ma200 turnover_ratio:8")
def h05(spark, sf):
    return _cap(spark, sf)


@query("h04_regime", "breadth_pct_ma50 turnover_ratio:8")
def h04(spark, sf):
    panel = D.bars(spark, sf, with_sector=False)
    return MK.regimes(_cap(spark, sf), MK.equal_weight_index(panel), MK.breadth(panel))
