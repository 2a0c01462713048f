"""Walk-forward folds, family reports and publication verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed

REQUIRED = ("family", "fold", "execution_mode", "attempt_status", "net_return", "cost", "turnover")


def purged_folds(
    dates: DataFrame, horizon: int, test_sessions: int, minimum_train: int, buffer: int = P.EMBARGO_BUFFER
) -> DataFrame:
    """Expanding folds by position of the distinct dates (0-based, ends inclusive).

    Training stops ``horizon + buffer`` sessions before the test window begins.
    """
    if min(horizon, test_sessions, minimum_train) <= 0:
        raise ValueError("horizon, test_sessions and minimum_train must be positive")
    embargo = horizon + buffer
    first = minimum_train + embargo
    n = dates.agg(F.count_distinct("trading_date").alias("n"))
    starts = F.when(
        F.col("n") >= first + test_sessions, F.sequence(F.lit(first), (F.col("n") - test_sessions).cast("int"), F.lit(test_sessions))
    ).otherwise(F.array().cast("array<int>"))
    return n.select(F.posexplode(starts).alias("fold", "test_start")).select(
        "fold", F.lit(embargo).alias("embargo_sessions"), (F.col("test_start") - embargo - 1).alias("train_end"),
        "test_start", (F.col("test_start") + test_sessions - 1).alias("test_end"),
    )


def fold_dates(dates: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, role, trading_date): train, embargo or test. Both sides are calendar-sized."""
    pos = dates.select("trading_date").distinct().withColumn(
        "position", F.row_number().over(Window.orderBy("trading_date")) - 1
    )
    # a row for each fold and date up to its end, which is what the answer holds
    reach = folds.select("*", F.explode(F.sequence(F.lit(0), "test_end")).alias("position"))
    d = pos.join(reach, "position")
    role = (
        F.when(F.col("position") <= F.col("train_end"), "train").when(F.col("position") < F.col("test_start"), "embargo").otherwise("test")
    )
    return d.select("fold", role.alias("role"), "trading_date")


def max_drawdown(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "net_return") -> DataFrame:
    """Deepest fall of the compounded path of each group, in the given total order.

    The ordered rows are cut into blocks; a block is summarised by its growth, its
    peak, its lowest point and its own deepest fall, and the few block rows are then
    combined. Group size does not matter.
    """
    by, order = list(by), list(order)
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = rows.where(F.col(value).isNotNull()).select(*dict.fromkeys([*by, *order, value]))
    d = checkpointed(d.repartitionByRange(parts, *by, *order).withColumn("blk", F.spark_partition_id()))
    run = Window.partitionBy(*by, "blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("wealth", F.product(1 + F.col(value)).over(run))
    d = d.withColumn("fall", F.col("wealth") / F.max("wealth").over(run) - 1)
    b = d.groupBy(*by, "blk").agg(
        F.product(1 + F.col(value)).alias("growth"), F.max("wealth").alias("peak"), F.min("wealth").alias("low"), F.min("fall").alias("fall")
    )
    before = Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("start", F.coalesce(F.product("growth").over(before), F.lit(1.0)))
    b = b.withColumn("top", F.max(F.col("start") * F.col("peak")).over(before))
    # a row's fall is the deeper of: against its block's peak, against an earlier one
    deepest = F.least("fall", F.col("start") * F.col("low") / F.col("top") - 1)
    return b.groupBy(*by).agg(F.min(deepest).alias("max_drawdown"))


def calibration(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier score and expected calibration error over fixed probability bins.

    The first bin includes 0; probabilities outside 0..1 are in no bin but still count
    in the denominator.
    """
    by = list(by)
    p, y = F.col("probability"), F.col("outcome").cast("double")
    v = rows.where(p.isNotNull() & y.isNotNull())
    bucket = F.lit(None).cast("int")
    for i, edge in reversed(list(enumerate(P.CALIBRATION_EDGES))):
        bucket = F.when(p <= edge, F.lit(i)).otherwise(bucket)
    bucket = F.when(p >= 0, bucket)
    bins = v.groupBy(*by, bucket.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"), F.sum((p - y) * (p - y)).alias("se")
    )
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("p") - F.col("y"))).otherwise(F.lit(0.0))
    return bins.groupBy(*by).agg(
        (F.sum("se") / F.sum("n")).alias("brier_score"), (F.sum(gap) / F.sum("n")).alias("expected_calibration_error")
    )


def fold_stability(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    means = rows.where("net_return is not null").groupBy(*by, "fold").agg(F.avg("net_return").alias("m"))
    return means.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.avg((F.col("m") > 0).cast("int")).alias("fold_positive_rate")
    )


def placebo_advantage(real: DataFrame, placebo: DataFrame) -> DataFrame:
    """Real minus mean placebo Sharpe per family; null without both."""
    p = placebo.groupBy("family").agg(F.avg("placebo_sharpe").alias("__mean"))
    return real.join(p, "family", "left").select("family", (F.col("real_sharpe") - F.col("__mean")).alias("placebo_advantage"))


def trial_counts(ledger: DataFrame) -> DataFrame:
    """Declared trials per family; repeated identifiers raise when read."""
    d = ledger.groupBy("family").agg(F.count("variant").alias("n"), F.count_distinct("variant").alias("u"))
    checked = F.when(
        F.col("n") != F.col("u"), F.raise_error(F.lit("tried variants are not unique: one is listed twice")).cast("long")
    ).otherwise(F.col("n"))
    return d.select("family", checked.alias("trials_accounted"))


def family_report(
    rows: DataFrame, evidence: DataFrame, placebo: DataFrame, ledger: DataFrame, order: Sequence[str]
) -> DataFrame:
    """One verdict per strategy family; every required gate fails closed.

    ``evidence``: family, real_sharpe, stability_passed, multiple_testing_passed,
    calibration_passed, auc. ``order`` makes the path of the drawdown unique.
    """
    missing = sorted(set(REQUIRED) - set(rows.columns))
    if missing:
        raise ValueError(f"missing validation columns: {missing}")
    filled = F.col("attempt_status") == "FILLED"
    agg = rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("signals_evaluated"), F.count_if(filled).alias("filled"),
        F.count(F.when(filled, F.col("net_return"))).alias("samples"),
        F.coalesce(F.sum(F.when(filled, F.col("cost"))), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(F.when(filled, F.col("turnover"))), F.lit(0.0)).alias("turnover"),
        F.avg(F.when(filled, F.col("net_return"))).alias("oos_mean_return"),
        F.bool_and(F.col("execution_mode") == "conservative").alias("__conservative"),
    )
    f = rows.where(filled)
    d = agg
    parts = [max_drawdown(f, ["family"], order), fold_stability(f, ["family"]), placebo_advantage(evidence, placebo), trial_counts(ledger)]
    if {"probability", "outcome"} <= set(rows.columns):
        parts.append(calibration(f, ["family"]))
    else:
        d = d.withColumns({c: F.lit(None).cast("double") for c in ("brier_score", "expected_calibration_error")})
    for part in [*parts, evidence.drop("real_sharpe")]:
        d = d.join(part, "family", "left")
    d = d.withColumns(
        {
            "fill_rate": F.col("filled") / F.col("signals_evaluated"),
            "unfilled_attempts": F.col("signals_evaluated") - F.col("filled"),
            "trials_accounted": F.coalesce("trials_accounted", F.lit(0)),
        }
    )
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    forecast = F.col("auc").isNotNull() | F.col("brier_score").isNotNull()
    gates = {
        "INSUFFICIENT_SAMPLE": F.col("samples") < P.MIN_SAMPLES,
        "EXECUTION_FILL_RATE": no(F.col("fill_rate") >= P.MIN_FILL_RATE),
        "NON_CONSERVATIVE_EXECUTION": no(F.col("__conservative")),
        "STABILITY": no(F.col("stability_passed") & (F.col("folds") > 0)),
        "MULTIPLE_TESTING": no(F.col("multiple_testing_passed") & (F.col("trials_accounted") >= 1)),
        "GROUPING_PLACEBO": no(F.col("placebo_advantage") >= P.MIN_PLACEBO_ADVANTAGE),
        "FORECAST_AUC": forecast & no(F.col("auc") >= P.MIN_AUC),
        "CALIBRATION": forecast & no(
            F.col("calibration_passed") & F.col("brier_score").isNotNull() & F.col("expected_calibration_error").isNotNull()
        ),
    }
    failures = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in gates.items()]))
    d = d.withColumn("failures", failures)
    return d.select(
        "family", F.when(F.size("failures") > 0, "SUPPRESSED").otherwise("SHADOW_ONLY").alias("state"), "failures", "samples",
        "signals_evaluated", "filled", "fill_rate", "unfilled_attempts", "total_cost", "turnover", "max_drawdown", "oos_mean_return",
        "fold_positive_rate", "auc", "brier_score", "expected_calibration_error", "placebo_advantage", "trials_accounted",
        F.lit(P.VERSION).alias("parameters_version"),
    )


def complete_shadow_period(reports: DataFrame, minimum_sessions: int) -> DataFrame:
    """Promote shadow families with enough observed sessions and no capital.

    Columns ``sessions_observed`` and ``no_capital``. A family in another state, or
    one run with capital, raises when its row is evaluated.
    """
    def stop(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("string")

    state = (
        F.when(F.col("state") != "SHADOW_ONLY", stop("shadow operation ends only for validated families"))
        .when(~F.col("no_capital"), stop("capital was used in shadow operation"))
        .when(F.col("sessions_observed") < minimum_sessions, F.col("state"))
        .otherwise(F.lit("ELIGIBLE_FOR_ACCEPTANCE_REVIEW"))
    )
    return reports.withColumn("state", state)


def hash_number(*parts: Column) -> Column:
    """A reproducible whole number from text, for seeded grouping and sampling."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long")


def placebo_sharpes(rows: DataFrame, replicates: int, groups: int) -> DataFrame:
    """Sharpe of the best group when symbols are grouped at random, per replicate.

    Symbols are assigned by seeded hash; each return is repeated once per replicate
    and shrinks again in the map-side aggregate.
    """
    d = rows.where("net_return is not null").select(
        "symbol", "net_return", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    )
    g = hash_number(F.col("replicate").cast("string"), F.col("symbol")) % groups
    stats = d.groupBy("replicate", g.alias("grp")).agg(F.avg("net_return").alias("m"), F.stddev_samp("net_return").alias("s"))
    return stats.groupBy("replicate").agg(F.max(F.col("m") / F.nullif(F.col("s"), F.lit(0.0))).alias("placebo_sharpe"))
