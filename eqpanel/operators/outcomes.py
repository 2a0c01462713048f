"""What happened after a signal: entry attempts, exits, trades and their metrics.

These columns look at later bars, so they live apart from the features. All per
symbol steps share the one shuffle by symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.ordered import fits_one_task, join_null_safe, quantiles
from eqpanel.functions.rules import Costs, floor_price, net_return, round_down_to_tick
from eqpanel.functions.series import series_window

MODES = ("optimistic", "base", "conservative")
SETTLEMENT_SELLABLE = 2  # sessions after entry
SETTLEMENT_POLICY = 3


def entry_fill(close: Column, nxt_open: Column, nxt_low: Column, premium, max_gap, mode: str) -> Column:
    """struct(filled, price, reason, gap) of a buy limit placed for the next bar."""
    gap = nxt_open / close - 1
    limit = round_down_to_tick(close * (1 + premium))
    touch = (nxt_low == limit) if mode == "optimistic" else F.lit(False)
    reason = (
        F.when(nxt_open.isNull(), F.lit(None).cast("string"))
        .when(gap > max_gap, "gap_gate")
        .when(nxt_open <= limit, "open_better_than_limit")
        .when(nxt_low < limit, "traded_through_limit")
        .when(touch, "touch_fill_optimistic")
        .otherwise("limit_not_provably_filled")
    )
    filled = reason.isin("open_better_than_limit", "traded_through_limit", "touch_fill_optimistic")
    price = F.when(reason == "open_better_than_limit", nxt_open.cast("double")).when(filled, limit)
    return F.struct(
        filled.alias("filled"), price.alias("price"), reason.alias("reason"), gap.alias("gap")
    )


def label_entries(
    panel: DataFrame, mode: str = "conservative", premium: float = P.ENTRY_PREMIUM, max_gap: float = P.MAXIMUM_GAP
) -> DataFrame:
    """The attempt every bar would make on its next bar."""
    w = series_window()
    d = panel.withColumns(
        {"entry_date": F.lead("trading_date").over(w), **{f"__n_{c}": F.lead(c).over(w) for c in ("open", "low")}}
    )
    fill = entry_fill(F.col("close").cast("double"), F.col("__n_open"), F.col("__n_low"), premium, max_gap, mode)
    return d.withColumn("__f", fill).select(
        *panel.columns,
        F.when(F.col("__f.reason").isNotNull(), F.when(F.col("__f.filled"), "FILLED").otherwise("REJECTED")).alias("attempt_status"),
        F.col("__f.reason").alias("attempt_reason"),
        F.when(F.col("__f.filled"), F.col("entry_date")).alias("entry_date"),
        F.col("__f.price").alias("entry_price"),
        F.col("__f.gap").alias("overnight_gap"),
    )


def label_exits(panel: DataFrame, mode: str = "conservative", hold_sessions: int = P.HOLD_SESSIONS) -> DataFrame:
    """For a signal on each bar: its position and when an exit could be sold.

    The planned exit bar is a fixed number of bars ahead, or the last bar. A bar
    pinned at the floor cannot be sold, so the exit rolls to the next bar that can:
    the running minimum, walked from the end, of sellable positions.
    """
    w = series_window()
    back = Window.partitionBy("symbol").orderBy(F.col("trading_date").desc())
    from_here = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pin_floor = floor_price(F.lag("close").over(w).cast("double"))
    d = panel.withColumns({"idx": F.row_number().over(w) - 1, "__floor": pin_floor})
    pinned = F.lit(False)
    if mode != "optimistic":
        pinned = F.coalesce((F.col("open") <= F.col("__floor")) & (F.col("high") <= F.col("__floor")), F.lit(False))
    spot = F.struct("idx", "trading_date", F.col("open").cast("double").alias("price"))
    d = d.withColumn("pinned", pinned)
    d = d.withColumns(
        {
            "__sell": F.min(F.when(~F.col("pinned"), spot)).over(from_here),
            "bars_left": F.row_number().over(back) - 1,
        }
    )
    offset = max(hold_sessions + 1, SETTLEMENT_POLICY) + 1
    d = d.withColumns(
        {
            # beyond the end the planned exit is the last bar itself
            "__exit": F.when(F.col("bars_left") >= offset, F.lead("__sell", offset).over(w)).otherwise(
                F.first("__sell").over(from_here)
            ),
            "sellable_date": F.lead("trading_date", 1 + SETTLEMENT_SELLABLE).over(w),
            "policy_exit_date": F.lead("trading_date", 1 + SETTLEMENT_POLICY).over(w),
        }
    )
    return d.select(
        *panel.columns, "idx", "bars_left", "pinned", "sellable_date", "policy_exit_date",
        F.col("__exit.idx").alias("exit_idx"), F.col("__exit.trading_date").alias("exit_date"),
        F.col("__exit.price").alias("exit_price"),
    )


def signal_outcomes(
    panel: DataFrame,
    costs: Costs,
    signal: str = "signal_pullback",
    mode: str = "conservative",
    hold_sessions: int = P.HOLD_SESSIONS,
    premium: float = P.ENTRY_PREMIUM,
    max_gap: float = P.MAXIMUM_GAP,
) -> DataFrame:
    """Every eligible signal with the attempt and exit it would have."""
    need = ["symbol", "trading_date", "open", "high", "low", "close", signal]
    extra = [c for c in panel.columns if c not in need]
    d = label_exits(label_entries(panel.select(*need, *extra), mode, premium, max_gap), mode, hold_sessions)
    d = d.where(F.col(signal) & (F.col("bars_left") >= 4))
    last = F.col("idx") + F.col("bars_left")
    gross = F.col("exit_price") / F.col("entry_price") - 1
    return d.withColumns(
        {
            "free_at": F.when(
                F.col("attempt_status") == "FILLED", F.greatest(F.col("idx") + 1, F.coalesce("exit_idx", last))
            ).otherwise(F.col("idx") + 1),
            "net_return": net_return(gross, costs.buy_rate, costs.sell_rate),
        }
    )


def without_overlap(outcomes: DataFrame) -> DataFrame:
    """Signals actually taken: one position at a time per symbol, earliest first.

    A per-symbol fold over its signals, which the calendar bounds.
    """
    cols = [c for c in outcomes.columns if c != "symbol"]
    item = F.struct("idx", *[c for c in cols if c != "idx"])
    grouped = outcomes.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = outcomes.sparkSession.createDataFrame([], outcomes.select(item.alias("s")).schema).schema["s"].dataType
    start = F.struct(F.lit(0).cast("int").alias("free"), F.array().cast(f"array<{kind.simpleString()}>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(
            s["idx"] >= acc["free"],
            F.struct(s["free_at"].cast("int").alias("free"), F.array_append(acc["kept"], s).alias("kept")),
        ).otherwise(acc)

    kept = grouped.select("symbol", F.explode(F.aggregate("all", start, step)["kept"]).alias("s"))
    return kept.select("symbol", *[F.col(f"s.{c}").alias(c) for c in cols])


def attempts(taken: DataFrame) -> DataFrame:
    return taken.select(
        "symbol", F.col("trading_date").alias("signal_date"), F.col("attempt_status").alias("status"),
        F.col("attempt_reason").alias("reason"), "entry_date", "entry_price", "overnight_gap",
    )


def trades(taken: DataFrame, *extra: str) -> DataFrame:
    sold = F.col("exit_date").isNotNull()
    return taken.where("attempt_status = 'FILLED'").select(
        "symbol", *extra, F.col("trading_date").alias("signal_date"), "entry_date", "entry_price",
        F.col("sellable_date").alias("regulatory_sellable_date"),
        F.col("policy_exit_date").alias("policy_earliest_exit_date"),
        "exit_date", "exit_price", "net_return", F.when(sold, "time_stop").alias("exit_reason"),
    )


def trade_metrics(trade_rows: DataFrame, by: Sequence[str] = (), group_bound: int | None = None) -> DataFrame:
    """Count, hit rate, mean, median, profit factor and worst trade per slice.

    The exact median runs in ordered blocks unless ``group_bound`` shows that a
    slice fits one task.
    """
    by = list(by)
    if not fits_one_task(group_bound):
        # read twice below; two narrow columns instead of the labelling again
        trade_rows = checkpointed(trade_rows.select(*by, "net_return"))
    r = F.col("net_return")
    won, lost = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    aggs = [
        F.when(F.count(r) > 0, F.count(r)).otherwise(F.count(F.lit(1))).alias("trades"),
        F.avg((r > 0).cast("int")).alias("hit_rate"),
        F.avg(r).alias("mean_net_return"),
        F.when(lost > 0, F.coalesce(won, F.lit(0.0)) / lost).alias("profit_factor"),
        F.min(r).alias("max_trade_loss"),
    ]
    middle = quantiles(trade_rows, by, "net_return", {"median_net_return": 0.5}, group_bound)
    if not by:
        # two one-row tables
        return trade_rows.agg(*aggs).join(F.broadcast(middle), how="left")
    # a null slice is a slice, and has its median
    return join_null_safe(trade_rows.groupBy(*by).agg(*aggs), middle, by, "left")


def slice_metrics(trade_rows: DataFrame, dims: Sequence[str], group_bound: int | None = None) -> DataFrame:
    """``trade_metrics`` overall, by each dimension and by all of them.

    Unused dimensions read ``ALL``. Each trade is repeated once per grouping set.
    """
    sets = [()] + [(d,) for d in dims] + ([tuple(dims)] if len(dims) > 1 else [])
    rows = [
        F.struct(*[(F.col(d).cast("string") if d in s else F.lit("ALL")).alias(d) for d in dims]) for s in sets
    ]
    spread = trade_rows.select(F.explode(F.array(*rows)).alias("__s"), "net_return").select("__s.*", "net_return")
    return trade_metrics(spread, dims, group_bound)


def execution_summary(attempt_rows: DataFrame) -> DataFrame:
    """Signals, fill rate and mean gap (one row)."""
    return attempt_rows.agg(
        F.count(F.lit(1)).alias("signals"),
        F.avg((F.col("status") == "FILLED").cast("int")).alias("fill_rate"),
        F.avg("overnight_gap").alias("mean_overnight_gap"),
    )


def rejection_counts(attempt_rows: DataFrame) -> DataFrame:
    return attempt_rows.where("status = 'REJECTED'").groupBy("reason").agg(F.count(F.lit(1)).alias("rejections"))


def govern_results(summary: DataFrame, index_name: str) -> DataFrame:
    """Label guard: add warnings and capital eligibility to backtest summaries.

    Columns used: ``result_label``, ``universe_mode``, ``sector_mode``. A label that
    claims index history under a proxy universe raises when the row is evaluated.
    """
    label = F.replace(F.upper("result_label"), F.lit("_"), F.lit(" "))
    claims = label.contains(f"HISTORICAL {index_name.upper()}")
    strict_u, strict_s = F.col("universe_mode") == "STRICT_PIT", F.col("sector_mode") == "STRICT_PIT"
    bad = claims & ~strict_u
    eligible = F.when(
        bad, F.raise_error(F.lit("a historical index label requires STRICT_PIT universe mode")).cast("boolean")
    ).otherwise(strict_u & strict_s)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("universe_mode") == "CURRENT_UNIVERSE_PROXY", F.lit(f"NOT_TRUE_HISTORICAL_{index_name.upper()}: CURRENT_UNIVERSE_PROXY")),
            F.when(F.col("sector_mode") == "CURRENT_ICB_PROXY", F.lit("NOT_TRUE_HISTORICAL_SECTOR_CLASSIFICATION: current-sector proxy")),
            F.when(~(strict_u & strict_s), F.lit("NOT_ELIGIBLE_FOR_REAL_CAPITAL_STRATEGY_QUALIFICATION")),
        )
    )
    return summary.withColumns({"warnings": warnings, "capital_qualification_eligible": eligible})
