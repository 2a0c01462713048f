"""Market-level series: equal-weight index, breadth, regime, official index pick.

Everything here has one row per session (and universe), so its windows are
bounded by the calendar; the panel itself is only aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.series import ratio_return, rolling_means, series_window

DAY = "trading_date"


def session_window(keys: Sequence[str] = ()):
    return Window.partitionBy(*keys).orderBy(DAY)


def equal_weight_index(panel: DataFrame, base: float = P.EQUAL_WEIGHT_BASE, keys: Sequence[str] = ()) -> DataFrame:
    """Mean daily return compounded from ``base``, with its moving averages."""
    c = F.col("close").cast("double")
    returns = panel.select(*keys, DAY, ratio_return(c, F.lag(c).over(series_window())).alias("r"))
    daily = returns.groupBy(*keys, DAY).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("r"))
    run = session_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = daily.select(*keys, DAY, (base * F.product(1 + F.col("r")).over(run)).alias("close"))
    return rolling_means(out, [("close", n, n, f"ma{n}") for n in P.MA_WINDOWS], keys=keys, order=DAY)


def breadth(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share above each average, advances, declines, turnover and their trends.

    A missing average counts as not above. Averages already on the panel are used.
    """
    missing = [n for n in P.MA_WINDOWS if f"ma{n}" not in panel.columns]
    turnover = "value" if "value" in panel.columns else "volume"
    have = [f"ma{n}" for n in P.MA_WINDOWS if n not in missing]
    d = panel.select(*dict.fromkeys(["symbol", *keys, DAY, "close", turnover, *have]))
    if missing:
        d = rolling_means(d, [("close", n, n, f"ma{n}") for n in missing])
    d = d.withColumn("__diff", F.col("close") - F.lag("close").over(series_window()))

    def share(n: int) -> Column:
        return F.avg(F.coalesce(F.col("close") > F.col(f"ma{n}"), F.lit(False)).cast("int"))

    agg = d.groupBy(*keys, DAY).agg(
        *[share(n).alias(f"pct_ma{n}") for n in P.MA_WINDOWS],
        F.count_if(F.col("__diff") > 0).alias("advances"),
        F.count_if(F.col("__diff") < 0).alias("decreases"),
        F.coalesce(F.sum(turnover), F.lit(0)).alias("turnover"),
    )
    w = session_window(keys)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agg = agg.withColumn("ad_net", F.col("advances") - F.col("decreases"))
    agg = agg.withColumn("ad_line", F.sum("ad_net").over(run))
    agg = agg.withColumn("ad_slope_10", F.col("ad_line") - F.lag("ad_line", P.AD_SLOPE_WINDOW).over(w))
    return add_turnover_ratio(agg, keys)


def add_turnover_ratio(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    d = rolling_means(
        daily, [("turnover", P.TURNOVER_WINDOW, P.TURNOVER_MIN_OBS, "turnover_ma20")], keys=keys, order=DAY
    )
    ratio = F.col("turnover").cast("double") / F.nullif(F.col("turnover_ma20"), F.lit(0.0))
    return d.withColumn("turnover_ratio", ratio)


def index_indicators(index_bars: DataFrame) -> DataFrame:
    """Averages and turnover ratio of every official index series."""
    d = rolling_means(index_bars, [("close", n, n, f"ma{n}") for n in P.MA_WINDOWS], keys="index_code")
    return add_turnover_ratio(d, ["index_code"])


def verified_index_bars(index_bars: DataFrame, raw_snapshots: DataFrame) -> DataFrame:
    """Index bars whose lineage matches exactly one stored raw snapshot."""
    keys = ["provider", "raw_snapshot_id"]
    known = raw_snapshots.groupBy("provider", F.col("snapshot_id").alias("raw_snapshot_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("payload_sha256").alias("payload_sha256"),
        F.min("source_reference").alias("source_reference"),
    )
    match = [*keys, "payload_sha256", "source_reference"]
    return index_bars.join(known.where("n = 1"), match, "left_semi")


def official_index(index_bars: DataFrame, calendar: DataFrame, priority: Sequence[str]) -> DataFrame:
    """The preferred index available on each session, or why there is none.

    ``index_bars`` are already lineage-checked. Output: one row per session with
    close, averages, turnover ratio, ``cap_index_mode`` and ``cap_index_warning``.
    """
    series = index_indicators(index_bars.withColumn("index_code", F.upper("index_code")))
    order = F.array_position(F.array(*[F.lit(c) for c in priority]), F.col("index_code"))
    ranked = series.where(F.col("index_code").isin(*priority)).withColumn("__p", order)
    cols = ["index_code", "close", *[f"ma{n}" for n in P.MA_WINDOWS], "turnover_ratio"]
    picked = ranked.groupBy(DAY).agg(F.min_by(F.struct(*cols), "__p").alias("__ix"))
    # one row: the best series that exists at all
    present = index_bars.select(F.upper("index_code").alias("index_code")).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.min(F.nullif(F.array_position(F.array(*[F.lit(c) for c in priority]), F.col("index_code")), F.lit(0))).alias("__best"),
    )
    # picked is bounded by the calendar
    d = calendar.select(DAY).join(F.broadcast(picked), DAY, "left").join(F.broadcast(present))
    mode = (
        F.when(F.col("__ix").isNotNull(), F.concat(F.lit("OFFICIAL_"), F.col("__ix.index_code")))
        .when(F.col("__best").isNull(), F.lit("DEGRADED_PROXY_UNAVAILABLE"))
        .otherwise(F.lit("DEGRADED_PROXY_STALE"))
    )
    names = F.array(*[F.lit(c) for c in priority])
    warning = (
        F.when(F.col("__ix").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("__rows") == 0, F.lit("no index rows with known origin"))
        .when(F.col("__best").isNull(), F.lit("none of the listed series is there"))
        .otherwise(
            F.concat(F.lit("official "), F.try_element_at(names, F.col("__best").cast("int")), F.lit(" lacks the newest session"))
        )
    )
    return d.select(
        DAY, mode.alias("cap_index_mode"), warning.alias("cap_index_warning"),
        *[F.col(f"__ix.{c}").alias(c) for c in cols[1:]],
    )


def index_score(close: Column, ma50: Column, ma200: Column) -> Column:
    points = (close > ma50).cast("int") + (close > ma200).cast("int") + (ma50 > ma200).cast("int")
    return F.coalesce(points, F.lit(0))


def regimes(cap: DataFrame, equal_weight: DataFrame, breadth_days: DataFrame) -> DataFrame:
    """Regime of every session from official index, equal-weight index and breadth.

    Missing turnover never confirms a bull regime; the ratio is the official one.
    """
    c = cap.select(DAY, index_score(F.col("close"), F.col("ma50"), F.col("ma200")).alias("cap_score"), "turnover_ratio")
    e = equal_weight.select(DAY, index_score(F.col("close"), F.col("ma50"), F.col("ma200")).alias("ew_score"))
    b = breadth_days.select(DAY, F.coalesce("pct_ma50", F.lit(0.0)).alias("breadth_pct_ma50"), "ad_slope_10")
    # three tables with one row per session
    d = b.join(e, DAY, "left").join(c, DAY, "left")
    d = d.withColumns({s: F.coalesce(s, F.lit(0)) for s in ("cap_score", "ew_score")})
    s = F.least("cap_score", "ew_score")
    b50, tr = F.col("breadth_pct_ma50"), F.col("turnover_ratio")
    up = F.coalesce(F.col("ad_slope_10") > 0, F.lit(False))
    tr_at_least = lambda x: F.coalesce(tr >= x, F.lit(False))
    level = (
        F.when((s == 3) & (b50 >= P.STRONG_BREADTH_MIN) & up & tr_at_least(P.STRONG_TURNOVER_MIN), 4)
        .when((s >= 2) & (b50 >= P.CONCENTRATED_BREADTH_MIN) & tr_at_least(P.CONCENTRATED_TURNOVER_MIN), 3)
        .when((s >= 1) & (b50 >= P.RANGE_BREADTH_MIN), 2)
        .when((s >= 1) | (b50 >= P.RISK_OFF_BREADTH_MIN), 1)
        .otherwise(0)
    )
    names = F.array(*[F.lit(r) for r in P.REGIMES])
    lv = F.col("regime_level")
    reason = (
        F.when(lv == 4, "both indices trend, breadth and turnover agree")
        .when(lv == 3, "upward trend, breadth or turnover only in part")
        .when((lv == 2) & tr.isNull(), "sideways; without turnover no bull state")
        .when(lv == 2, "trend and breadth disagree")
        .when(lv == 1, "trend or breadth is poor")
        .otherwise("trend and breadth are poor")
    )
    return d.withColumn("regime_level", level).select(
        DAY, F.element_at(names, lv + 1).alias("regime"), "regime_level", "cap_score", "ew_score",
        "breadth_pct_ma50", "turnover_ratio", reason.alias("reason"),
    )
