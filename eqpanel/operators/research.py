"""Evidence about a strategy: deflated Sharpe, block bootstrap, directional model.

Everything that resamples or fits works on what the calendar bounds (sessions,
blocks of sessions, folds); rows per symbol are aggregated first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.normal import normal_cdf, normal_quantile
from eqpanel.functions.ordered import join_null_safe, value_positions
from eqpanel.operators.validation import hash_number, max_drawdown

#: Fixed value: the Euler-Mascheroni constant.
GAMMA = 0.5772156649015329


def sharpe_moments(returns: DataFrame, by: Sequence[str], value: str = "ret") -> DataFrame:
    """Observations, Sharpe ratio per period, skewness and kurtosis (3 for a normal), from one aggregate."""
    d = returns.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"),
        F.skewness(value).alias("skewness"), (F.kurtosis(value) + 3).alias("kurtosis"),
    )
    return d.select(*by, "n", F.expr("__m / nullif(__s, 0D)").alias("sharpe"), "skewness", "kurtosis")


def deflated_sharpe(moments: DataFrame, trials: str = "trials", variance: str | None = None) -> DataFrame:
    """Adds ``sharpe_threshold`` and ``deflated_sharpe``: the chance that the Sharpe ratio beats the best of the declared trials.

    ``trials`` counts the variants tried (below 1 there is no answer, 1 deflates
    nothing). ``variance`` names the variance of the Sharpe ratio over the trials;
    without it the sampling variance of a ratio of zero, 1 / (n - 1), stands in.
    """
    spread = f"sqrt({variance})" if variance else "sqrt(1D / nullif(n - 1, 0))"
    best = f"({1 - GAMMA!r}D * __a + {GAMMA!r}D * __b)"
    d = moments.withColumns(
        {"__a": normal_quantile(f"1 - 1D / nullif({trials}, 0)"), "__b": normal_quantile(f"1 - 1D / (nullif({trials}, 0) * {math.e!r}D)")}
    )
    d = d.withColumn("sharpe_threshold", F.expr(f"CASE WHEN {trials} = 1 THEN 0D WHEN {trials} > 1 THEN {spread} * {best} END"))
    error = "nullif(1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 0D)"
    d = d.withColumn("__z", F.expr(f"(sharpe - sharpe_threshold) * sqrt(n - 1D) / sqrt({error})"))
    return d.withColumn("deflated_sharpe", normal_cdf("__z")).drop("__a", "__b", "__z")


def session_blocks(days: DataFrame, size: int) -> DataFrame:
    """(trading_date, block): runs of ``size`` consecutive sessions, numbered from 0. Calendar-sized."""
    w = Window.orderBy("trading_date")
    return days.select("trading_date").distinct().select("trading_date", F.floor((F.row_number().over(w) - 1) / size).alias("block"))


def block_draws(blocks: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(replicate, block, times): as many blocks as there are, drawn with replacement by seeded hash.

    At most replicates x blocks rows, whatever the number of trades.
    """
    n = blocks.agg((F.max("block") + 1).alias("__n"))
    each = n.select("__n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    each = each.select("__n", "replicate", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k"))
    drawn = hash_number(F.lit(seed), F.col("replicate").cast("string"), F.col("__k").cast("string")) % F.col("__n")
    return each.groupBy("replicate", drawn.alias("block")).agg(F.count(F.lit(1)).alias("times"))


def block_bootstrap(
    trades: DataFrame, days: DataFrame, by: Sequence[str], size: int = 5, replicates: int = 1000, level: float = 0.95,
    seed: str = "blocks", power: float = 0.8, value: str = "net_return",
) -> DataFrame:
    """Intervals of hit rate and expectancy when whole blocks of sessions are resampled.

    Trades are summed per group and block before a replicate meets them, so ten
    trades of one day weigh as one draw. Draws are the same for all groups. A
    replicate without a trade of a group says nothing about that group. Also:
    ``effective_sample`` (the number of independent trades with the same standard
    error) and ``trades_needed`` to tell the expectancy from zero with ``power``.
    """
    by = list(by)
    r = F.col(value)
    d = trades.where(r.isNotNull()).select("trading_date", *by, r.cast("double").alias("__r"))
    calendar = checkpointed(session_blocks(days, size))
    sums = checkpointed(
        d.join(F.broadcast(calendar), "trading_date").groupBy(*by, "block").agg(  # one row per session
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("__r") > 0).alias("wins"), F.sum("__r").alias("total"),
            F.sum(F.col("__r") * F.col("__r")).alias("squares"),
        )
    )
    t = F.col("times")
    each = sums.join(block_draws(calendar, replicates, seed), "block").groupBy(*by, "replicate").agg(
        F.sum(t * F.col("n")).alias("n"), F.sum(t * F.col("wins")).alias("wins"), F.sum(t * F.col("total")).alias("total")
    )
    ends = {"low": (1 - level) / 2, "high": 1 - (1 - level) / 2}
    rate, mean = F.col("wins") / F.col("n"), F.col("total") / F.col("n")
    # one value per replicate and group
    spread = each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("replicates"), F.var_samp(mean).alias("__v"),
        *[F.percentile(x, F.lit(q)).alias(f"{name}_{end}") for name, x in (("hit_rate", rate), ("expectancy", mean)) for end, q in ends.items()],
    )
    whole = sums.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.sum("wins").alias("__w"), F.sum("total").alias("__t"), F.sum("squares").alias("__q")
    )
    whole = whole.withColumns({"hit_rate": F.expr("__w / n"), "expectancy": F.expr("__t / n")})
    whole = whole.withColumn("__s2", F.expr("CASE WHEN n > 1 THEN greatest((__q - n * expectancy * expectancy) / (n - 1), 0D) END"))
    z = normal_quantile(f"{1 - (1 - level) / 2!r}D") + normal_quantile(f"{power!r}D")
    joined = whole.join(spread, by, "left") if by else whole.crossJoin(spread)  # one row each
    return joined.select(
        *by, "n", "blocks", "replicates", "hit_rate", "hit_rate_low", "hit_rate_high", "expectancy", "expectancy_low", "expectancy_high",
        F.expr("least(double(n), __s2 / nullif(__v, 0D))").alias("effective_sample"),
        F.ceil(z * z * F.expr("__s2 / nullif(expectancy * expectancy, 0D)")).alias("trades_needed"),
    )


def concentration(trades: DataFrame, by: Sequence[str], over: str, value: str = "net_return") -> DataFrame:
    """How much a group's trades depend on one value of ``over``: largest share and sum of squared shares."""
    d = trades.where(F.col(value).isNotNull()).groupBy(*by, over).agg(F.count(F.lit(1)).alias("k"))
    d = d.groupBy(*by).agg(F.sum("k").alias("n"), F.max("k").alias("__m"), F.sum(F.col("k") * F.col("k")).alias("__q"))
    return d.select(*by, "n", F.expr("__m / n").alias("largest_share"), F.expr("__q / (double(n) * n)").alias("concentration"))


def extended_metrics(daily: DataFrame, benchmark: DataFrame, by: Sequence[str], sessions_per_year: int = 250) -> DataFrame:
    """Maximum drawdown, Calmar and information ratio per group, beside growth.

    ``daily``: by, trading_date, ret; ``benchmark``: trading_date, bench (one row
    per session). Sessions without a benchmark do not count for the information
    ratio; without a fall there is no Calmar ratio.
    """
    by, year = list(by), float(sessions_per_year)
    d = checkpointed(daily.where("ret IS NOT NULL").join(F.broadcast(benchmark.select("trading_date", "bench")), "trading_date", "left"))
    active = F.col("ret") - F.col("bench")
    agg = d.groupBy(*by).agg(
        F.count("ret").alias("sessions"), F.sum(F.log1p("ret")).alias("__g"), F.avg(active).alias("__m"), F.stddev_samp(active).alias("__s")
    )
    fall = max_drawdown(d, by, ["trading_date"], "ret")
    joined = join_null_safe(agg, fall, by, "left") if by else agg.crossJoin(fall)  # one row each
    joined = joined.withColumn("cagr", F.exp(F.col("__g") * year / F.col("sessions")) - 1)
    return joined.select(
        *by, "sessions", "cagr", "max_drawdown", F.expr("cagr / nullif(-max_drawdown, 0D)").alias("calmar"),
        (F.expr("__m / nullif(__s, 0D)") * year**0.5).alias("information_ratio"),
    )


def score_deciles(rows: DataFrame, score: str, outcome: str = "net_return") -> DataFrame:
    """Trades, hit rate and mean outcome per decile of the score, 1 the lowest; ties share a decile."""
    d = checkpointed(rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).select(F.col(score).alias("__x"), F.col(outcome).alias("__y")))
    at = value_positions(d, [], "__x").select("__x", F.least(F.lit(10), F.floor((F.col("before") + (F.col("n") + 1) / 2 - 0.5) / F.col("total") * 10) + 1).alias("decile"))
    return d.join(at, "__x").groupBy("decile").agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("__y") > 0).cast("int")).alias("hit_rate"), F.avg("__y").alias("mean_outcome")
    )


def auc(rows: DataFrame, by: Sequence[str], score: str, outcome: str) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half; null without both outcomes.

    Needs the number of rows below each distinct score, which ordered blocks give
    for groups of any size.
    """
    by = list(by)
    d = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).select(*by, F.col(score).alias("__x"), F.col(outcome).alias("__y"))
    d = checkpointed(d)
    at = value_positions(d, by, "__x").select(*by, "__x", (F.col("before") + (F.col("n") + 1) / 2).alias("__rank"))
    hits = d.where("__y = 1").groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__k"))
    ranks = hits.join(at, [*by, "__x"]).groupBy(*by).agg(F.sum(F.col("__rank") * F.col("__k")).alias("__ranks"))
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__y") == 1).alias("positives"))
    joined = sizes.join(ranks, by, "left") if by else sizes.crossJoin(ranks)  # one row each
    area = F.expr("(__ranks - double(positives) * (positives + 1) / 2) / nullif(double(positives) * (rows - positives), 0D)")
    return joined.select(*by, "rows", "positives", area.alias("auc"))


def forward_direction(bars: DataFrame, horizon: int) -> DataFrame:
    """symbol, trading_date, ``label`` (1 when the close ``horizon`` sessions on is higher, 0 when lower or equal, else null)."""
    later = F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("trading_date"))
    return bars.select("symbol", "trading_date", F.when(later.isNotNull(), (later > F.col("close")).cast("int")).alias("label"))


def directional_scores(rows: DataFrame, folds: DataFrame, features: Sequence[str], regularisation: float = 0.01) -> DataFrame:
    """Out-of-sample probability of every test row: symbol, trading_date, fold, label, raw, probability.

    ``rows`` holds symbol, trading_date, features and label; ``folds`` comes from
    ``validation.fold_dates`` and keeps a purge and an embargo between training and
    test. Rows with a missing feature get no score and rows without label do not
    train. Each fold fits standardised features on its own training dates.
    ``probability`` passes the raw score through a sigmoid fitted on earlier
    test scores whose dates lie in the fold's training window; a fold without
    such rows of both outcomes keeps its raw score. A fold whose training rows
    show one outcome only gives no score.
    """
    usable = rows.dropna(subset=list(features))
    vectors = VectorAssembler(inputCols=list(features), outputCol="__x").transform(usable.withColumns({f: F.col(f).cast("double") for f in features}))
    vectors = checkpointed(vectors.select("symbol", "trading_date", "label", "__x"))
    # folds and their dates are bounded by the calendar
    dates = checkpointed(folds)
    model = LogisticRegression(featuresCol="__x", labelCol="label", regParam=regularisation, standardization=True, maxIter=100, tol=1e-10)
    sigmoid = LogisticRegression(featuresCol="__x", labelCol="label", maxIter=100, tol=1e-10)
    hit = vector_to_array("probability")[1]
    scored: DataFrame | None = None
    for fold in [r.fold for r in dates.select("fold").distinct().orderBy("fold").collect()]:
        part = dates.where(F.col("fold") == fold)
        train = vectors.where("label IS NOT NULL").join(F.broadcast(part.where("role = 'train'").select("trading_date")), "trading_date", "left_semi")
        test = vectors.join(F.broadcast(part.where("role = 'test'").select("trading_date")), "trading_date", "left_semi")
        if not _both_outcomes(train):
            continue
        raw = model.fit(train).transform(test).select("symbol", "trading_date", F.lit(fold).alias("fold"), "label", hit.alias("raw"))
        raw = checkpointed(raw.withColumn("probability", F.col("raw")))
        if scored is not None:
            past = scored.where("label IS NOT NULL").join(F.broadcast(part.where("role = 'train'").select("trading_date")), "trading_date", "left_semi")
            if _both_outcomes(past):
                fitted = sigmoid.fit(_logit(past))
                raw = checkpointed(fitted.transform(_logit(raw)).select("symbol", "trading_date", "fold", "label", "raw", hit.alias("probability")))
        scored = raw if scored is None else scored.unionByName(raw)
    empty = "symbol string, trading_date date, fold int, label int, raw double, probability double"
    return scored if scored is not None else rows.sparkSession.createDataFrame([], empty)


def _both_outcomes(rows: DataFrame) -> bool:
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    return low == 0 and high == 1


def _logit(rows: DataFrame) -> DataFrame:
    """The raw score's log odds as a one-column vector."""
    p = F.least(F.greatest(F.col("raw"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return VectorAssembler(inputCols=["__odds"], outputCol="__x").transform(rows.drop("probability").withColumn("__odds", F.ln(p / (1 - p)))).drop("__odds")


def directional_verdict(scored: DataFrame, gate: float = P.MIN_AUC) -> DataFrame:
    """One row: rows, positives, folds, auc over all test rows, and whether a number may be shown."""
    folds = scored.agg(F.count_distinct("fold").alias("folds"))
    d = auc(scored, [], "probability", "label").crossJoin(folds)  # one row each
    ok = F.coalesce(F.col("auc") >= gate, F.lit(False))
    return d.select("rows", "positives", "folds", "auc", F.when(ok, "SHOWN").otherwise("SUPPRESSED").alias("state"))


def gated_probabilities(scored: DataFrame, verdict: DataFrame) -> DataFrame:
    """Test rows with their probability, null for all of them when the gate is shut."""
    shown = F.when(F.col("state") == "SHOWN", F.col("probability"))
    d = scored.crossJoin(F.broadcast(verdict.select("state")))  # one row
    return d.select("symbol", "trading_date", "fold", "state", shown.alias("probability"))
