"""Queries for evidence about strategies: Sharpe, resampling, direction, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.operators import outcomes as O
from eqpanel.operators import profiles as PR
from eqpanel.operators import research as R
from eqpanel.operators import validation as V
from eqpanel.plans import market_queries as M
from eqpanel.plans import signal_queries as SQ
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D

#: The panel is weekly, so its folds are wider than the daily ones of the other queries.
HORIZON, TEST, TRAIN = 5, 60, 120
INPUTS = ("rsi14", "volume_z60", "atr_pct", "ret_20", "displacement_atr", "setup_quality")


@query("l18_deflated_sharpe", "sharpe:8 skewness:8 kurtosis:8 sharpe_threshold:8 deflated_sharpe:8")
def l18(spark, sf):
    """Each sector's equal-weight return under three declared numbers of variants."""
    d = PR.with_returns(D.bars(spark, sf)).groupBy("sector", "trading_date").agg(F.avg("r").alias("ret"))
    m = R.sharpe_moments(d, ["sector"])
    return R.deflated_sharpe(m.withColumn("trials", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 24, 500)]))))


def _trades(spark, sf, *extra: str) -> DataFrame:
    return O.trades(SQ._taken(spark, sf, "trend_confirmed", *extra), "sector", *extra).withColumnRenamed("signal_date", "trading_date")


_BOOT = "hit_rate:8 hit_rate_low:8 hit_rate_high:8 expectancy:10 expectancy_low:10 expectancy_high:10 effective_sample:4"


@query("l19_block_bootstrap", _BOOT)
def l19(spark, sf):
    return R.block_bootstrap(_trades(spark, sf), D.bars(spark, sf, with_sector=False), ["sector"])


@query("l19_concentration", "largest_share:8 concentration:8")
def l19c(spark, sf):
    """How far each sector's trades lie in one year."""
    return R.concentration(_trades(spark, sf).withColumn("year", F.year("trading_date")), ["sector"], "year")


def _direction_rows(spark, sf) -> DataFrame:
    f = M._features(spark, sf)
    f = f.withColumn("ret_20", F.expr("try_divide(double(close), double(lag(close, 20) OVER (PARTITION BY symbol ORDER BY trading_date))) - 1"))
    return f.select("symbol", "trading_date", *INPUTS).join(R.forward_direction(f, HORIZON), ["symbol", "trading_date"])


def _direction_folds(spark, sf) -> DataFrame:
    days = D.bars(spark, sf, with_sector=False).select("trading_date")
    return V.fold_dates(days, V.purged_folds(days, HORIZON, TEST, TRAIN))


@query("l24_direction_folds")
def l24f(spark, sf):
    """What each fold trains and tests on: rows with all inputs, labelled rows, positives."""
    d = _direction_rows(spark, sf).dropna(subset=list(INPUTS))
    d = d.join(F.broadcast(_direction_folds(spark, sf)), "trading_date")  # folds times sessions
    return d.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.count("label").alias("labelled"), F.sum("label").alias("positives"),
        F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"),
    )


@query("l24_direction_verdict", "auc:4")
def l24(spark, sf):
    return R.directional_verdict(R.directional_scores(_direction_rows(spark, sf), _direction_folds(spark, sf), INPUTS))


@query("l24_direction_probabilities", "probability:4")
def l24p(spark, sf):
    s = R.directional_scores(_direction_rows(spark, sf), _direction_folds(spark, sf), INPUTS)
    return R.gated_probabilities(s, R.directional_verdict(s))


@query("l24_single_factor_auc", "auc:8")
def l24a(spark, sf):
    """Area under the curve of the setup quality alone, per year."""
    d = _direction_rows(spark, sf).withColumn("year", F.year("trading_date"))
    return R.auc(d, ["year"], "setup_quality", "label")
