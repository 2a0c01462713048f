"""Queries for walk-forward validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.operators import outcomes as O
from eqpanel.operators import validation as V
from eqpanel.plans import market_queries as M
from eqpanel.plans.registry import query
from eqpanel.plans.signal_queries import COSTS
from eqpanel.sources import derived as D

HORIZON, TEST, TRAIN = 5, 10, 30


def _dates(spark, sf) -> DataFrame:
    return D.bars(spark, sf, with_sector=False).select("trading_date")


@query("h13_purged_folds")
def h13(spark, sf):
    return V.purged_folds(_dates(spark, sf), HORIZON, TEST, TRAIN)


@query("h13_fold_dates")
def h13d(spark, sf):
    d = _dates(spark, sf)
    return V.fold_dates(d, V.purged_folds(d, HORIZON, TEST, TRAIN))


def _rows(spark, sf) -> DataFrame:
    """Every trend signal as an attempt of its family, placed in its test fold."""
    f = M._features(spark, sf)
    o = O.signal_outcomes(
        f.select("symbol", "trading_date", "open", "high", "low", "close", "sector", "setup_quality", "trend_confirmed"),
        COSTS, signal="trend_confirmed",
    )
    d = _dates(spark, sf)
    folds = V.fold_dates(d, V.purged_folds(d, HORIZON, TEST, TRAIN)).where("role = 'test'")
    o = o.join(F.broadcast(folds), "trading_date")  # bounded by the calendar
    r = F.col("net_return")
    return o.select(
        F.concat(F.lit("TREND_"), F.col("sector")).alias("family"), "fold", F.lit("conservative").alias("execution_mode"),
        "attempt_status", r.alias("net_return"), F.when(F.col("attempt_status") == "FILLED", F.col("entry_price") * 0.003).alias("cost"),
        F.col("entry_price").alias("turnover"), ((F.col("setup_quality") + 1) / 2).alias("probability"),
        F.when(r.isNotNull(), (r > 0).cast("int")).alias("outcome"), "trading_date", "symbol",
    )


@query("d13_fold_stability", "fold_positive_rate")
def d13(spark, sf):
    return V.fold_stability(_rows(spark, sf), ["family"])


@query("d15_calibration", "brier_score:8 expected_calibration_error:8")
def d15(spark, sf):
    return V.calibration(_rows(spark, sf), ["family"])


@query("d16_max_drawdown", "max_drawdown:8")
def d16(spark, sf):
    return V.max_drawdown(_rows(spark, sf), ["family"], ["trading_date", "symbol"])


@query("d16_max_drawdown_overall", "max_drawdown:8")
def d16a(spark, sf):
    """One path over all rows: a single group of any size."""
    return V.max_drawdown(_rows(spark, sf), [], ["trading_date", "symbol"])


@query("l20_placebo_grouping", "placebo_sharpe:8")
def l20(spark, sf):
    return V.placebo_sharpes(_rows(spark, sf), 20, 5)


_REPORT = (
    "fill_rate total_cost:4 turnover:2 max_drawdown:8 oos_mean_return:8 fold_positive_rate auc brier_score:8 "
    "expected_calibration_error:8 placebo_advantage:8"
)


@query("h14_family_report", _REPORT)
def h14(spark, sf):
    rows = _rows(spark, sf)
    sharpe = F.avg("net_return") / F.nullif(F.stddev_samp("net_return"), F.lit(0.0))
    evidence = rows.groupBy("family").agg(
        sharpe.alias("real_sharpe"), F.lit(True).alias("stability_passed"),
        (F.count("net_return") % 2 == 0).alias("multiple_testing_passed"), F.lit(True).alias("calibration_passed"),
        (0.5 + (F.count("net_return") % 7) / 100).alias("auc"),
    )
    random = V.placebo_sharpes(rows, 20, 5)
    placebo = evidence.select("family").join(F.broadcast(random))  # twenty replicates
    ledger = rows.select("family", F.concat(F.lit("fold-"), F.col("fold").cast("string")).alias("variant")).distinct()
    r = V.family_report(rows, evidence, placebo, ledger, ["trading_date", "symbol"])
    return r.withColumn("failures", F.concat_ws(";", "failures"))


@query("h15_shadow_completion")
def h15(spark, sf):
    """Shadow families that have been observed long enough."""
    rows = _rows(spark, sf).groupBy("family").agg(F.count_distinct("trading_date").alias("sessions_observed"))
    r = rows.withColumns({"state": F.lit("SHADOW_ONLY"), "no_capital": F.lit(True)})
    return V.complete_shadow_period(r, 60)
