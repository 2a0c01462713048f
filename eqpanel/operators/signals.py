"""Ranked candidates, their pricing, and the recommendation gate chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.asof import as_of_calendar
from eqpanel.functions.rules import ceiling_price, finite_positive, floor_price, round_down_to_tick
from eqpanel.functions.series import Smoothing, ewm, rolling_extreme, rolling_means, series_window
from eqpanel.operators.outcomes import entry_fill
from eqpanel.operators.risk import decide

DAY = "trading_date"


def apply_dq_policy(confidence: Column, dq_score: Column) -> tuple[Column, Column]:
    """Confidence capped at a low quality score, and whether acting is allowed."""
    capped = F.when(dq_score < P.DQ_CONFIDENCE_CAP, F.least(confidence, dq_score.cast("double"))).otherwise(confidence)
    return capped, dq_score >= P.DQ_ACTIONABLE_BLOCK


def downside_atr(bars: DataFrame, n: int = P.RSI_WINDOW, sessions: int | None = None) -> DataFrame:
    """Wilder range of sessions that closed lower, carried forward to all sessions.

    With ``sessions``, a proven bound on the bars of a symbol, that fits one block of
    the average the lower sessions are a flag of the series, and no series of their own.
    """
    w = series_window()
    d = bars.withColumn("__prev", F.lag("close").over(w))
    d = d.withColumns(
        {
            "__tr": F.greatest(
                F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - F.col("__prev")), F.abs(F.col("low") - F.col("__prev"))
            ).cast("double"),
            "__fell": F.coalesce(F.col("close") < F.col("__prev"), F.lit(False)),
        }
    )
    average = [("__tr", 1 / n, n, "__y")]
    if Smoothing(average, rows=sessions).single:
        d = ewm(d, average, rows=sessions, among="__fell")
    else:
        d = ewm(d, average, keys=["symbol", "__fell"])
    fill = F.last(F.when(F.col("__fell"), F.col("__y")), ignorenulls=True)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("downside_atr14", fill.over(upto)).select(*bars.columns, "downside_atr14")


def price_plan(
    features: DataFrame,
    premium: float = P.ENTRY_PREMIUM,
    atr_multiple: float = 2.5,
    max_stop: float = 0.08,
    structure_sessions: int = 10,
    high_sessions: int = 252,
    min_reward: float = 1.7,
) -> DataFrame:
    """Entry, both stops, targets with the overhead trim, and average volume.

    Needs ``atr14`` and ``downside_atr14``. Adds entry_price, exit_stop, risk_stop
    (the sizing stop), r_unit, target_1, target_2, risk_reward, adv_shares and
    ``plan_valid``.
    """
    w = series_window()
    d = rolling_means(features, [("volume", 20, 20, "adv_shares")])
    d = rolling_extreme(d, "double(high)", high_sessions, "__ceiling").withColumns(
        {
            "__low": F.min("low").over(w.rowsBetween(-(structure_sessions - 1), 0)).cast("double"),
            "entry_price": round_down_to_tick(F.col("close") * (1 + premium)),
        }
    )
    e, atr = F.col("entry_price"), F.col("atr14")
    # greatest skips a missing downside range
    wide = F.greatest(atr, 1.3 * F.col("downside_atr14"))
    known = atr.isNotNull()
    d = d.withColumns(
        {
            "exit_stop": F.when(known, round_down_to_tick(F.least(F.col("__low") - 0.5 * atr, e * (1 - max_stop)))),
            "risk_stop": F.when(known, round_down_to_tick(F.least(e - atr_multiple * wide, e * (1 - max_stop * 1.25)))),
        }
    )
    d = d.withColumn("r_unit", e - F.col("exit_stop"))
    ceiling, full = F.col("__ceiling"), e + 2.0 * F.col("r_unit")
    trimmed = F.when(~F.col("trend_confirmed") & (e < ceiling) & (ceiling < full), ceiling * 0.99).otherwise(full)
    d = d.withColumns({"target_1": trimmed, "target_2": e + 3.5 * F.col("r_unit")})
    d = d.withColumn("risk_reward", F.try_divide(F.col("target_1") - e, F.col("r_unit")))
    no_room = ~F.col("trend_confirmed") & (ceiling < e * 1.03)
    valid = (
        (F.col("risk_stop") > 0) & (F.col("risk_stop") < F.col("exit_stop")) & (F.col("exit_stop") < e)
        & ~no_room & (F.col("risk_reward") >= min_reward)
    )
    return d.withColumn("plan_valid", F.coalesce(valid, F.lit(False))).drop("__low", "__ceiling")


def detect_candidates(
    features: DataFrame, regimes: DataFrame, sector_scores: DataFrame, dq_score: Column, dq_actionable: Column
) -> DataFrame:
    """Candidates of every session, ranked by score within it.

    ``features`` carries the relative-strength ranks. A row with a missing rank or
    score is no candidate; the sector score defaults to neutral.
    """
    # one regime row per session: bounded by the calendar
    d = features.join(F.broadcast(regimes.select(DAY, "regime", "regime_level")), DAY)
    d = d.where(F.col("regime_level") > 0)
    d = d.join(sector_scores.select(DAY, "sector", "leadership_score"), [DAY, "sector"], "left")
    long_rank, short = F.col("rs_stock_market_rank_126"), F.col("rs_stock_market_rank_20")
    level = F.col("regime_level")
    family = (
        F.when(F.col("signal_pullback") & (long_rank >= P.RS_LONG_MIN) & (short <= P.RS_SHORT_PULLBACK_MAX), "TREND_PULLBACK")
        .when(
            (level == 4) & (long_rank >= P.RS_LONG_MIN) & (short >= P.RS_SHORT_MOMENTUM_MIN)
            & F.col("trend_confirmed") & (F.coalesce("volume_z60", F.lit(0.0)) >= P.MOMENTUM_VOLUME_Z_MIN),
            "MOMENTUM_CONTINUATION",
        )
        .when(F.col("signal_reversal") & (short <= P.RS_SHORT_REVERSAL_MAX) & (level >= 2), "STRUCTURAL_REVERSAL")
    )
    d = d.withColumns({"family": family, "sector_score": F.coalesce("leadership_score", F.lit(P.NEUTRAL_SECTOR_SCORE))})
    d = d.where(
        F.col("family").isNotNull() & long_rank.isNotNull() & short.isNotNull() & (F.col("sector_score") >= P.SECTOR_MIN)
    )
    wt = P.SCORE_WEIGHTS
    neutral = F.lit(P.NEUTRAL_COMPONENT)
    short_part = F.when(F.col("family") == "MOMENTUM_CONTINUATION", short).otherwise(P.SCORE_MAX - short)
    score = (
        wt["long_rs"] * long_rank + wt["short_rs"] * short_part + wt["sector"] * F.col("sector_score")
        + P.SCORE_MAX * wt["setup"] * F.coalesce("setup_quality", neutral)
        + P.SCORE_MAX * wt["volume"] * F.coalesce("volume_confirmation", neutral)
    )
    reason = (
        F.when(F.col("family") == "TREND_PULLBACK", "long-term leader in short-term pullback")
        .when(F.col("family") == "MOMENTUM_CONTINUATION", "long+short RS strong in Strong Bull")
        .otherwise("oversold reversal with market gate")
    )
    d = d.withColumn("score", F.least(F.lit(P.SCORE_MAX), score)).where(F.col("score").isNotNull())
    confidence, allowed = apply_dq_policy(F.col("score"), dq_score)
    plan = {c: F.col(c) if c in d.columns else F.lit(None).cast("double") for c in ("entry_price", "risk_stop", "adv_shares")}
    group = F.col("correlated_group") if "correlated_group" in d.columns else F.col("sector")
    return d.select(
        "symbol", DAY, "family", "score", long_rank.alias("rs_long_rank"), short.alias("rs_short_rank"),
        "sector_score", reason.alias("reason"), confidence.alias("confidence"),
        (dq_actionable & allowed).alias("actionable"), F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"),
        F.coalesce(group, F.col("sector"), F.lit("UNKNOWN")).alias("correlated_group"),
        *[c.cast("double").alias(n) for n, c in plan.items()], "regime",
    )


def select_signals(candidates: DataFrame, top: int = 3, per_sector: int = 2) -> DataFrame:
    """The day's report: best composites, with a limit per sector and overall.

    The limits are the feature; Spark prunes each group to them before the shuffle.
    """
    composite = 0.6 * F.col("score") / 100 + 0.4 * F.col("win_probability")
    d = candidates.withColumn("composite", composite)
    best = [F.col("composite").desc(), F.col("symbol")]
    d = d.withColumn("__s", F.row_number().over(Window.partitionBy(DAY, "sector").orderBy(*best))).where(F.col("__s") <= per_sector)
    d = d.withColumn("selection_rank", F.row_number().over(Window.partitionBy(DAY).orderBy(*best)))
    return d.where(F.col("selection_rank") <= top).drop("__s")


def gate_funnel(features: DataFrame) -> DataFrame:
    """First failing gate of every row: regime, profile, dual condition, setup, geometry.

    Needs regime_level, archetype, the relative-strength ranks, the signals and the
    price plan. ``PASSED`` rows go on to scoring.
    """
    ok = lambda c: F.coalesce(c, F.lit(False))
    long_rank, short = F.col("rs_stock_market_rank_126"), F.col("rs_stock_market_rank_20")
    gate = F.coalesce(
        F.when(~ok(F.col("regime_level") > 0), "GATE0_REGIME"),
        F.when(~ok(F.col("archetype") != "EXCLUDED"), "GATE1_ELIGIBILITY"),
        F.when(~ok((long_rank >= P.RS_LONG_MIN) & (short <= P.RS_SHORT_PULLBACK_MAX)), "GATE4A_DUAL_CONDITION"),
        F.when(~ok(F.col("signal_pullback") | F.col("signal_reversal")), "GATE4B_SETUP"),
        F.when(~ok(F.col("plan_valid") & (F.col("r_unit") / F.col("atr14") >= 0.8)), "GATE5_GEOMETRY"),
        F.lit("PASSED"),
    )
    return features.withColumn("gate", gate)


def gap_action(gap: Column, threshold: Column, at_ceiling: Column) -> Column:
    """What to do before an order when the price has moved since the signal."""
    return (
        F.when(at_ceiling, "CANCEL")
        .when(gap < -0.02, "REVIEW")
        .when(gap <= threshold * 0.5, "PROCEED")
        .when(gap <= threshold, "REDUCE")
        .when(gap > threshold, "CANCEL")
    )


LINEAGE_KEYS = ("provider", "snapshot_id", "canonical_revision", "ingested_at")


def settlement_calendar(calendar: DataFrame) -> DataFrame:
    """Each session with the next one and that one's sellable and policy-exit dates."""
    w = Window.orderBy(DAY)  # the session calendar itself
    return calendar.select(
        DAY,
        F.lead(DAY, 1).over(w).alias("attempt_date"),
        F.lead(DAY, 3).over(w).alias("sellable_date"),
        F.lead(DAY, 4).over(w).alias("policy_exit_date"),
    )


def build_recommendations(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """Run every request through the ordered gates; the first failing one is named.

    One row per request. Request columns follow the recommendation contract; account
    columns are equity, cash, max_loss, buy_rate, sell_rate, fixed_cost, positions.
    Signal dates between sessions take the next session after them.
    """
    days = settlement_calendar(calendar)
    # the session a signal date falls on or after says what comes next
    d = as_of_calendar(requests, "signal_date", days, DAY, ["attempt_date", "sellable_date", "policy_exit_date"])
    text = ("symbol", "setup", "entry_trigger", "invalidation", "forecast_status", "dq_status", "sector", "correlated_group")
    blank = F.lit(False)
    for t in text:
        blank = blank | (F.length(F.trim(F.coalesce(F.col(t), F.lit("")))) == 0)
    lineage = F.lit(True)
    for k in LINEAGE_KEYS:
        lineage = lineage & (F.length(F.coalesce(F.try_element_at("source_lineage", F.lit(k)), F.lit(""))) > 0)
    low, high, close = F.col("zone_low"), F.col("zone_high"), F.col("signal_close").cast("double")
    numbers = F.lit(True)
    for c in ("signal_close", "zone_low", "zone_high", "technical_stop", "risk_stop", "adv_shares"):
        numbers = numbers & finite_positive(F.col(c))
    d = d.withColumns(
        {"planned_low": round_down_to_tick(low), "planned_entry": round_down_to_tick(high)}
    )
    entry = F.col("planned_entry")
    bar = F.col("attempt_bar")
    fill = entry_fill(close, bar["open"].cast("double"), bar["low"].cast("double"), entry / close - 1, F.col("maximum_gap"), "conservative")
    bar_ok = (
        finite_positive(bar["open"]) & finite_positive(bar["high"]) & finite_positive(bar["low"])
        & (bar["low"] <= bar["open"]) & (bar["open"] <= bar["high"])
    )
    row = {
        "symbol": F.col("symbol"), "entry": entry, "stop": F.col("risk_stop").cast("double"),
        "adv": F.col("adv_shares").cast("double"), "sector": F.col("sector"), "group": F.col("correlated_group"),
        "regime": F.col("regime"),
    }
    account = {c: F.col(c) for c in ("equity", "cash", "max_loss", "buy_rate", "sell_rate", "fixed_cost")}
    d = d.withColumns({"__fill": fill, "__risk": decide(row, account, F.col("positions"))})
    risk = F.col("__risk")
    reward = F.transform(
        "targets",
        lambda t: risk["quantity"] * (t - entry - entry * F.col("buy_rate") - t * F.col("sell_rate")) - F.col("fixed_cost"),
    )
    d = d.withColumn("__rewards", reward)
    first_reward, loss = F.get("__rewards", F.lit(0)), risk["estimated_loss"]
    p = F.col("win_probability")
    value = p * first_reward - (1 - p) * loss
    no = lambda cond: F.coalesce(~cond, F.lit(True))  # noqa: E731  unknown fails closed
    has_bar = bar.isNotNull()
    gates = [
        (blank, F.lit("REQUIRED_DATA_MISSING")),
        (~lineage, F.lit("SOURCE_LINEAGE_INCOMPLETE")),
        (no(F.col("dq_actionable") & (F.col("dq_status") == "PASS")), F.lit("DQ_GATE_FAILED")),
        (no(F.col("strategy_validated")), F.lit("STRATEGY_GATE_FAILED")),
        (
            no((F.col("forecast_status") == "AVAILABLE") & p.between(0, 1) & F.col("confidence").between(0, 100)),
            F.lit("FORECAST_GATE_FAILED"),
        ),
        (F.col("attempt_date").isNull(), F.lit("ATTEMPT_DATE_UNAVAILABLE")),
        (~numbers | no(low <= high), F.lit("PRICE_OR_LIQUIDITY_INVALID")),
        (no(F.col("planned_low") <= entry), F.lit("ENTRY_PLAN_INVALID")),
        (
            no((floor_price(close) <= F.col("planned_low")) & (entry <= ceiling_price(close))),
            F.lit("PRICE_BAND_GATE_FAILED"),
        ),
        (no((F.col("technical_stop") < entry) & (F.col("risk_stop") < entry)), F.lit("STOP_GATE_FAILED")),
        (
            no((F.size("targets") > 0) & F.forall("targets", lambda t: finite_positive(t) & (t > entry))),
            F.lit("TARGET_GATE_FAILED"),
        ),
        (no((F.col("maximum_gap") >= 0) & (F.col("maximum_gap") < float("inf"))), F.lit("GAP_GATE_INVALID")),
        (has_bar & no(bar["trading_date"] == F.col("attempt_date")), F.lit("ATTEMPT_BAR_DATE_MISMATCH")),
        (has_bar & no(bar_ok), F.lit("ATTEMPT_BAR_INVALID")),
        (has_bar & no(F.col("__fill.filled")), F.concat(F.lit("EXECUTION_GATE_FAILED:"), F.col("__fill.reason"))),
        (no(risk["status"] != "REJECTED"), F.concat(F.lit("PORTFOLIO_GATE_FAILED:"), risk["binding_constraint"])),
        (no((loss > 0) & (F.array_min("__rewards") > 0)), F.lit("COST_ADJUSTED_PAYOFF_INVALID")),
        (no(value > 0), F.lit("EXPECTED_VALUE_GATE_FAILED")),
        (F.col("sellable_date").isNull() | F.col("policy_exit_date").isNull(), F.lit("SETTLEMENT_CALENDAR_INCOMPLETE")),
    ]
    reason = F.coalesce(*[F.when(bad, name) for bad, name in gates], F.lit("ALL_GATES_PASSED"))
    d = d.withColumn("reason", reason)
    ok = F.col("reason") == "ALL_GATES_PASSED"
    plan = {
        "attempt_date": F.col("attempt_date"),
        "planned_zone_low": F.col("planned_low"),
        "planned_entry_limit": entry,
        "expected_reward_to_risk": F.try_divide(first_reward, loss),
        "expected_value": value,
        "nav_fraction": F.try_divide(risk["notional"], F.col("equity")),
        "execution_feasibility": F.when(has_bar, "ATTEMPT_FEASIBLE_NOT_A_FILL").otherwise("ELIGIBLE_FOR_FUTURE_ATTEMPT"),
        "regulatory_sellable_date": F.col("sellable_date"),
        "policy_earliest_exit_fill_date": F.col("policy_exit_date"),
    }
    return d.select(
        "symbol", "signal_date",
        F.when(ok, "ACTIONABLE").otherwise("NO_ACTIONABLE_RECOMMENDATION").alias("status"), "reason",
        *[F.when(ok, c).alias(n) for n, c in plan.items()],
        F.lit(None).cast("double").alias("fill_price"),
    )
