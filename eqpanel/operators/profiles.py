"""Per-symbol statistics, archetypes, trend-state transitions and labels.

A symbol's history is bounded by the calendar, so per-symbol exact percentiles and
windows fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.normal import normal_quantile
from eqpanel.functions.ordered import join_null_safe, quantiles, with_rank_pcts
from eqpanel.functions.series import ewm, over, rolling_means, series_window


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds the symbol's return, the equal-weight market return and the overnight gap."""
    w = series_window()
    d = bars.withColumns(
        {
            "r": F.expr("try_divide(double(close), double(lag(close) OVER (PARTITION BY symbol ORDER BY trading_date))) - 1"),
            "gap": F.expr("try_divide(double(open), double(lag(close) OVER (PARTITION BY symbol ORDER BY trading_date))) - 1"),
            "n": F.row_number().over(w),
        }
    )
    m = d.groupBy("trading_date").agg(F.avg("r").alias("m"))
    return d.join(F.broadcast(m), "trading_date")  # one row per session


def profiles(bars: DataFrame, sessions_per_year: int = 250, limit_move: float = 0.069, by=("symbol",)) -> DataFrame:
    """Volatility, beta, idiosyncratic share, liquidity, gaps, limit hits, variance ratio.

    ``by`` may add a period of the bars to the symbol; returns still reach back over its start.
    """
    d = with_returns(bars)
    w = series_window()
    down = F.coalesce(F.col("r") <= -limit_move, F.lit(False))
    # consecutive limit-down sessions share the count of other sessions before them
    d = d.withColumns({"down": down, "isle": F.count_if(~down).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    streak = d.where("down").groupBy(*by, "isle").count().groupBy(*by).agg(F.max("count").alias("max_floor_streak"))
    five = d.where("r IS NOT NULL").groupBy(*by, F.expr("(n - 2) div 5").alias("b")).agg(
        F.sum(F.log1p("r")).alias("x"), F.count("r").alias("k")
    ).where("k = 5").groupBy(*by).agg(F.var_samp("x").alias("v5"))
    agg = d.groupBy(*by).agg(
        (F.stddev_samp("r") * float(sessions_per_year) ** 0.5).alias("vol_annual"),
        (F.covar_samp("r", "m") / F.nullif(F.var_samp(F.when(F.col("r").isNotNull(), F.col("m"))), F.lit(0.0))).alias("beta"),
        (1 - F.pow(F.corr("r", "m"), 2)).alias("idio_share"),
        F.avg("value").alias("adv_value"),
        F.avg(F.abs("r") / F.nullif(F.col("value"), F.lit(0))).alias("amihud"),
        F.percentile(F.abs("gap"), F.lit(0.5)).alias("gap_median"), F.percentile(F.abs("gap"), F.lit(0.9)).alias("gap_p90"),
        F.avg((F.abs("r") >= limit_move).cast("int")).alias("limit_hit_freq"), F.var_samp(F.log1p("r")).alias("v1"),
    )
    d = agg.join(streak, list(by), "left").join(five, list(by), "left")
    return d.select(
        *agg.columns[:-1], F.coalesce("max_floor_streak", F.lit(0)).alias("max_floor_streak"),
        (F.col("v5") / F.nullif(5 * F.col("v1"), F.lit(0.0))).alias("variance_ratio_5"),
    )


def archetypes(stats: DataFrame, adv_floor: float, adv_large: float, overrides: DataFrame | None = None, by=("symbol",)) -> DataFrame:
    """Decision tree over the measured profile; every row carries its reason and all tags that apply.

    ``overrides(symbol, override, override_reason)`` names securities whose sector
    explains them better than their statistics do; exclusions still come first.
    The tags are the archetypes of every rule met, the override among them.
    """
    adv, vol, beta, vr = F.col("adv_value"), F.col("vol_annual"), F.col("beta"), F.col("variance_ratio_5")
    hits, streak, gap = F.col("limit_hit_freq"), F.col("max_floor_streak"), F.col("gap_p90")
    tree = [
        (adv < adv_floor, "EXCLUDED", "cannot size a position"),
        (streak >= 5, "EXCLUDED", "tail risk when locked"),
        (gap > 0.045, "EXCLUDED", "unusable for EOD entry"),
        ((vol < 0.28) & (beta < 0.85) & (hits < 0.02), "DEFENSIVE", "low volatility, beta and limit hits"),
        ((beta > 1.25) & (vol > 0.38), "HIGH_BETA", "high beta and volatility"),
        ((vol > 0.45) | (hits > 0.05) | (streak >= 3), "SPECULATIVE", "volatile or often at its limit"),
        ((adv > 2 * adv_large) & (vol < 0.35), "LARGE_CAP", "liquid and calm"),
        ((vr > 1.15) & (adv >= adv_large) & (vol < 0.38), "LARGE_CAP", "trending and liquid"),
        ((vr < 0.85) & (vol < 0.33), "DEFENSIVE", "mean-reverting and calm"),
    ]
    if overrides is not None:
        stats = stats.join(overrides.select("symbol", "override", "override_reason"), "symbol", "left")
        tree.insert(3, (F.col("override").isNotNull(), F.col("override"), F.col("override_reason")))
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    met = [F.when(c, F.struct(text(a).alias("a"), text(r).alias("r"))) for c, a, r in tree]
    rest = F.struct(F.lit("SPECULATIVE").alias("a"), F.lit("no clear signature; assigned conservatively").alias("r"))
    pick = F.coalesce(*met, rest)
    tags = F.array_sort(F.array_distinct(F.transform(F.array_compact(F.array(*met)), lambda m: m["a"])))
    return stats.select(*by, pick["a"].alias("archetype"), pick["r"].alias("archetype_reason"), F.when(F.size(tags) > 0, tags).otherwise(F.array(pick["a"])).alias("tags"))


def archetype_stability(assigned: DataFrame, period: str, least: float = 0.60) -> DataFrame:
    """Per period: securities classified before too, the share that kept its archetype, and whether that is too few.

    ``assigned``: symbol, period (consecutive whole numbers) and archetype. Periods
    in which no security has a predecessor are absent.
    """
    w = Window.partitionBy("symbol").orderBy(period)
    d = assigned.withColumns({"__p": F.lag("archetype").over(w), "__q": F.lag(period).over(w)}).where(F.col("__q") == F.col(period) - 1)
    share = F.avg((F.col("archetype") == F.col("__p")).cast("int"))
    return d.groupBy(period).agg(F.count(F.lit(1)).alias("securities"), share.alias("stability"), (share < least).alias("unstable"))


def trend_transitions(bars: DataFrame, least: int = 200) -> DataFrame:
    """Next-session trend-state probabilities per symbol, with Laplace counts.

    Symbols with fewer than ``least`` observed transitions are left out.
    """
    d = rolling_means(bars, [("close", 50, 50, "ma50"), ("close", 200, 200, "ma200")]).where("ma200 IS NOT NULL")
    up = (F.col("close") > F.col("ma50")) & (F.col("ma50") > F.col("ma200"))
    down = (F.col("close") < F.col("ma50")) & (F.col("ma50") < F.col("ma200"))
    d = d.withColumn("state", F.when(up, "UP").when(down, "DOWN").otherwise("SIDE"))
    d = d.withColumn("next_state", F.lead("state").over(series_window())).where("next_state IS NOT NULL")
    states = ("UP", "DOWN", "SIDE")
    counts = d.groupBy("symbol", "state").agg(
        *[F.count_if(F.col("next_state") == s).alias(s) for s in states], F.count(F.lit(1)).alias("n")
    )
    counts = counts.withColumn("transitions", F.sum("n").over(Window.partitionBy("symbol"))).where(F.col("transitions") >= least)
    p = {f"p_{s.lower()}": (F.col(s) + 1) / (F.col("n") + 3) for s in states}
    stay = F.coalesce(*[F.when(F.col("state") == s, p[f"p_{s.lower()}"]) for s in states])
    return counts.select("symbol", "state", "n", *[e.alias(k) for k, e in p.items()], (1 / (1 - stay)).alias("expected_duration"))


def h_step_transitions(one_step: DataFrame, steps: int) -> DataFrame:
    """Trend-state probabilities ``steps`` sessions ahead: rows of the matrix power per symbol.

    ``one_step`` comes from ``trend_transitions``. A state a symbol was never in has
    only its Laplace counts, so its row is uniform.
    """
    states = ("UP", "DOWN", "SIDE")
    row = F.map_from_entries(F.collect_list(F.struct("state", F.array("p_up", "p_down", "p_side"))))  # three states
    flat = F.array(*[F.lit(1 / 3)] * 3)
    d = one_step.groupBy("symbol").agg(row.alias("__m"))
    d = d.withColumn("__p", F.array(*[F.coalesce(F.try_element_at("__m", F.lit(s)), flat) for s in states]))
    product = "transform(m, r -> transform(sequence(0, 2), j -> r[0] * __p[0][j] + r[1] * __p[1][j] + r[2] * __p[2][j]))"
    d = d.withColumn("__h", F.expr(f"aggregate(sequence(1, {steps}), __p, (m, k) -> if(k = 1, m, {product}))"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, states)).alias("state"), F.col("__h").alias("p")))
    d = d.select("symbol", each.alias("__r"))
    p = F.col("__r.p")
    return d.select("symbol", F.col("__r.state").alias("state"), F.lit(steps).alias("steps"), p[0].alias("p_up"), p[1].alias("p_down"), p[2].alias("p_side"))


def ewma_volatility(bars: DataFrame, decay: float = 0.94, sessions_per_year: int = 250) -> DataFrame:
    d = with_returns(bars).withColumn("r2", F.col("r") * F.col("r"))
    d = ewm(d, [("r2", 1 - decay, 1, "y", 1)])
    return d.select("symbol", "trading_date", F.sqrt(F.col("y") * sessions_per_year).alias("ewma_vol"))


def forward_excess(bars: DataFrame, index: DataFrame, horizons=(5, 10, 20)) -> DataFrame:
    """Return over the next sessions less the index over the same dates."""
    w = series_window()
    d = bars.select("symbol", "trading_date", F.col("close").cast("double").alias("c"))
    d = d.withColumns(
        {f"d{h}": F.lead("trading_date", h).over(w) for h in horizons} | {f"c{h}": F.lead("c", h).over(w) for h in horizons}
    )
    ix = index.select(F.col("trading_date").alias("__d"), F.col("close").alias("__c"))
    d = d.join(F.broadcast(ix.withColumnRenamed("__c", "b0")), F.col("trading_date") == F.col("__d")).drop("__d")
    for h in horizons:  # the index has one row per session
        d = d.join(F.broadcast(ix.withColumnRenamed("__c", f"b{h}")), F.col(f"d{h}") == F.col("__d"), "left").drop("__d")
    return d.select(
        "symbol", "trading_date",
        *[((F.col(f"c{h}") / F.col("c")) - (F.col(f"b{h}") / F.col("b0"))).alias(f"excess_{h}") for h in horizons],
    )


def triple_barrier(plan: DataFrame, hold: int = 20) -> DataFrame:
    """Which is met first after entry on the next bar: target, stop or time.

    Bars are looked at from the first session a policy exit may fill (three after
    entry). Needs exit_stop and target_1. A bar touching both counts as the stop.
    With a column ``filled`` an entry that was not filled is NOT_FILLED, and
    unlabelled where the attempt is still to come.
    """
    w = series_window()
    first, last = 4, hold + 1
    ahead = [F.struct(F.lead("high", k).over(w).alias("h"), F.lead("low", k).over(w).alias("l"), F.lit(k).alias("k")) for k in range(first, last + 1)]
    d = plan.withColumns({"__a": F.array(*ahead), "__n": F.lead("trading_date", last).over(w)})
    hit = F.filter("__a", lambda b: (b["l"] <= F.col("exit_stop")) | (b["h"] >= F.col("target_1")))
    d = d.withColumn("__hit", F.get(hit, F.lit(0)))
    label = (
        F.when(F.col("__hit").isNotNull(), F.when(F.col("__hit.l") <= F.col("exit_stop"), "STOP").otherwise("TARGET"))
        .when(F.col("__n").isNotNull(), "TIME")
    )
    sessions = F.col("__hit.k")
    if "filled" in plan.columns:
        sessions = F.when(F.col("filled"), sessions)
        label = F.when(F.col("filled"), label).when(~F.col("filled"), "NOT_FILLED")
    return d.select("symbol", "trading_date", label.alias("barrier"), sessions.alias("sessions"))


def rank_ic(factors: DataFrame, factor: str, outcome: str, symbols_bound: int | None = None) -> DataFrame:
    """Rank correlation of a factor with what followed, per session."""
    d = factors.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    day = ["trading_date"]
    d = with_rank_pcts(d, [(day, factor, "__x"), (day, outcome, "__y")], symbols_bound)
    return d.groupBy(*day).agg(F.count(F.lit(1)).alias("symbols"), F.corr("__x", "__y").alias("rank_ic"))


def rolling_ic(daily: DataFrame, by, size: int = 60, least: int = 20, level: float = 0.95) -> DataFrame:
    """Mean rank correlation of the last ``size`` sessions with its interval and t-ratio.

    ``daily``: by, trading_date, rank_ic; one row per factor and session, so a
    factor's rows are bounded by the calendar.
    """
    f = over(list(by), "trading_date", f"ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW")
    d = daily.withColumns(
        {"sessions": F.expr(f"count(rank_ic) {f}"), "mean_ic": F.expr(f"avg(rank_ic) {f}"), "__s": F.expr(f"stddev_samp(rank_ic) {f}")}
    )
    half = normal_quantile(f"{1 - (1 - level) / 2!r}D") * F.expr("__s / sqrt(sessions)")
    enough = lambda c: F.when(F.col("sessions") >= least, c)
    return d.select(
        *by, "trading_date", "sessions", enough(F.col("mean_ic")).alias("mean_ic"), enough(F.col("mean_ic") - half).alias("ic_low"),
        enough(F.col("mean_ic") + half).alias("ic_high"), enough(F.expr("mean_ic / nullif(__s / sqrt(sessions), 0D)")).alias("t_ratio"),
    )


def drift(rows: DataFrame, by, value: str, period: str, bins: int = 10, flag_at: float = 0.2) -> DataFrame:
    """Population stability index of ``value`` in each period against the group's first one.

    Bins are the first period's quantiles (equal ones merge); shares are counted
    with half a row added, so that an empty bin does not make the index infinite.
    ``by`` and ``period`` are kept; the first period itself has 0.
    """
    by = list(by)
    d = checkpointed(rows.where(F.col(value).isNotNull()).select(*by, F.col(period).alias("period"), F.col(value).cast("double").alias("__x")))
    first = d.groupBy(*by).agg(F.min("period").alias("__first")) if by else d.agg(F.min("period").alias("__first"))
    attach = lambda left, right: join_null_safe(left, right, by) if by else left.crossJoin(F.broadcast(right))  # noqa: E731  one row
    base = attach(d, first).where("period = __first").drop("__first")
    cuts = quantiles(base, by, "__x", {f"__q{i}": i / bins for i in range(1, bins)})
    cuts = cuts.select(*by, F.array(*[f"__q{i}" for i in range(1, bins)]).alias("__q"))
    at = F.size(F.filter("__q", lambda q: q < F.col("__x")))
    counts = attach(d, cuts).groupBy(*by, "period", "__q", at.alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    # a period has at most ``bins`` counts
    shares = counts.groupBy(*by, "period", "__q").agg(F.map_from_entries(F.collect_list(F.struct("__b", "n"))).alias("__m"), F.sum("n").alias("rows"))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    shares = shares.withColumn("__p", F.transform(every, lambda b: (F.coalesce(F.try_element_at("__m", b), F.lit(0)) + 0.5) / (F.col("rows") + 0.5 * bins)))
    start = attach(shares, first).where("period = __first").select(*by, F.col("__p").alias("__p0"))
    terms = F.zip_with("__p", "__p0", lambda p, q: (p - q) * F.ln(p / q))
    out = attach(shares, start).withColumn("drift", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return out.select(*by, "period", "rows", "drift", (F.col("drift") >= flag_at).alias("drifted"))


def hit_rates(trades: DataFrame, by, least: int = 30) -> DataFrame:
    """Win share per bucket; buckets with too few trades publish nothing."""
    r = F.col("net_return")
    d = trades.where(r.isNotNull()).groupBy(*by).agg(F.count(r).alias("n"), F.avg((r > 0).cast("int")).alias("win_probability"))
    return d.where(F.col("n") >= least)


def period_metrics(daily: DataFrame, by, sessions_per_year: int = 250) -> DataFrame:
    """Growth, volatility, Sharpe, Sortino and worst session of daily returns.

    ``daily``: by, trading_date, ret.
    """
    year = float(sessions_per_year)
    agg = daily.groupBy(*by).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2))).alias("ds"), F.sum(F.log1p("ret")).alias("g"), F.min("ret").alias("worst"),
    )
    return agg.select(
        *by, F.col("n").alias("sessions"), (F.exp(F.col("g") * year / F.col("n")) - 1).alias("cagr"), (F.col("s") * year**0.5).alias("volatility"),
        (F.col("m") / F.nullif(F.col("s"), F.lit(0.0)) * year**0.5).alias("sharpe"),
        (F.col("m") / F.nullif(F.col("ds"), F.lit(0.0)) * year**0.5).alias("sortino"), F.col("worst").alias("tail_loss"),
    )


def fundamentals_as_of(dates: DataFrame, facts: DataFrame) -> DataFrame:
    """Latest fact published on or before each date, per symbol and metric.

    A merge of both by time: facts and requests are sorted together within a symbol
    and metric, and each request takes the last fact seen.
    """
    metrics = facts.select("metric").distinct()  # a short list of statement lines
    asked = dates.join(F.broadcast(metrics)).select(
        "symbol", "metric", F.col("trading_date").alias("at"), F.lit(1).alias("__q"), F.lit(None).cast("struct<published_at:date,period_end:date,value:double>").alias("__f")
    )
    known = facts.select(
        "symbol", "metric", F.col("published_at").alias("at"), F.lit(0).alias("__q"),
        F.struct("published_at", "period_end", F.col("value").cast("double").alias("value")).alias("__f"),
    )
    period = F.coalesce(F.col("__f")["period_end"], F.lit("9999-12-31").cast("date"))
    w = Window.partitionBy("symbol", "metric").orderBy("at", "__q", period).rowsBetween(Window.unboundedPreceding, 0)
    d = known.unionByName(asked).withColumn("__f", F.last("__f", ignorenulls=True).over(w)).where("__q = 1")
    return d.select(
        "symbol", "metric", F.col("at").alias("trading_date"), F.col("__f.published_at").alias("published_at"),
        F.col("__f.period_end").alias("period_end"), F.col("__f.value").alias("value"),
    )
