"""Cross-sectional relative strength and sector roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.ordered import average_rank_pct, fits_one_task, quantiles, with_rank_pcts
from eqpanel.functions.series import many, ratio_return, series_window, spread

DAY = "trading_date"


def add_cross_sectional_rs(
    panel: DataFrame, horizons: Sequence[int] = P.RS_HORIZONS, symbols_bound: int | None = None, carried: bool = False
) -> DataFrame:
    """Stock against market, stock against sector, sector against market.

    ``symbols_bound`` is a proven upper bound on the symbols of one session, such
    as the row count of the security master. With a small bound the cross-section
    is one window per session; without it, means are aggregated and joined back
    and ranks are computed in ordered blocks. The sorts carry only what they rank;
    a panel of many symbols meets the result again by its key. With ``carried`` its
    rows go through the sorts instead, and are shuffled once: for callers that read
    few of its columns.
    """
    w = series_window()
    c = F.col("close").cast("double")
    base = panel
    dealt = fits_one_task(symbols_bound) and many(panel, symbols_bound)
    narrow = dealt and not carried
    if narrow:
        panel = panel.select("symbol", DAY, "sector", "close")
    d = panel.withColumns({f"return_{h}": ratio_return(c, F.lag(c, h).over(w)) for h in horizons})
    if dealt:
        # sessions are few: more partitions, so that seldom two of them meet in one
        d = spread(d.drop("close") if narrow else d, 4 * symbols_bound, DAY)
    d = _group_means(d, horizons, symbols_bound)
    excess = {}
    for h in horizons:
        stock, market, sector = (F.col(f"{p}_{h}") for p in ("return", "market_return", "sector_return"))
        excess |= {
            f"rs_stock_market_{h}": stock - market,
            f"rs_stock_sector_{h}": stock - sector,
            f"rs_sector_market_{h}": sector - market,
        }
    d = d.withColumns(excess)
    ranks = [
        (name, keys)
        for h in horizons
        for name, keys in (
            (f"rs_stock_market_{h}", [DAY]),
            (f"rs_stock_sector_{h}", [DAY, "sector"]),
            (f"rs_sector_market_{h}", [DAY]),
        )
    ]
    named = {n: f"{n.rsplit('_', 1)[0]}_rank_{n.rsplit('_', 1)[1]}" for n, _ in ranks}
    # null sectors have no sector return, so their sector rank stays null
    d = with_rank_pcts(d, [(keys, n, named[n]) for n, keys in ranks], symbols_bound)
    if not narrow:
        return d
    # one key that is never null: the null-safe equality of two columns would be dealt out anew, by Spark's own number
    left, right = (spread(x.withColumn("__key", F.struct("symbol", DAY)), symbols_bound, "__key") for x in (base, d.drop("sector")))
    return left.join(right.drop("symbol", DAY), "__key", "left").drop("__key")


def _group_means(d: DataFrame, horizons: Sequence[int], symbols_bound: int | None) -> DataFrame:
    if fits_one_task(symbols_bound):
        market, sector = Window.partitionBy(DAY), Window.partitionBy(DAY, "sector")
        return d.withColumns(
            {f"market_return_{h}": F.avg(f"return_{h}").over(market) for h in horizons}
            | {
                f"sector_return_{h}": F.when(F.col("sector").isNotNull(), F.avg(f"return_{h}").over(sector))
                for h in horizons
            }
        )
    by_day = d.groupBy(DAY).agg(*[F.avg(f"return_{h}").alias(f"market_return_{h}") for h in horizons])
    by_sector = d.where("sector is not null").groupBy(DAY, "sector").agg(
        *[F.avg(f"return_{h}").alias(f"sector_return_{h}") for h in horizons]
    )
    # by_day has one row per session: bounded by the calendar
    return d.join(F.broadcast(by_day), DAY, "left").join(by_sector, [DAY, "sector"], "left")


def winsorize(
    panel: DataFrame,
    value: str,
    out: str,
    bounds: tuple[float, float] = P.WINSOR,
    keys: Sequence[str] = (DAY,),
    group_bound: int | None = None,
) -> DataFrame:
    """Clamp a column to its cross-sectional quantiles."""
    keys = list(keys)
    limits = quantiles(panel, keys, value, {"__lo": bounds[0], "__hi": bounds[1]}, group_bound)
    d = panel.join(limits, keys, "left")
    x = F.col(value)
    clamped = F.when(x.isNotNull(), F.greatest("__lo", F.least("__hi", x)))
    return d.withColumn(out, clamped).drop("__lo", "__hi")


def sector_scores(features: DataFrame, as_of=None, latest_only: bool = False, symbols_bound: int | None = None) -> DataFrame:
    """Leadership of each sector per session, best first by ``sector_rank``.

    ``as_of`` drops later sessions; ``latest_only`` keeps the last remaining one.
    """
    d = features.where("sector is not null")
    if as_of is not None:
        d = d.where(F.col(DAY) <= F.lit(as_of))
    if latest_only:
        # a one-row side
        last = d.agg(F.max(DAY).alias(DAY))
        d = d.join(F.broadcast(last), DAY, "left_semi")
    keys = [DAY, "sector"]
    medians = {"rs20": "rs_sector_market_20", "rs126": "rs_sector_market_126", "volume_impulse": "volume_z60"}
    above = F.coalesce(F.col("close") > F.col("ma50"), F.lit(False)).cast("int")
    plain = [
        # symbols are unique within a session
        F.count("symbol").alias("members"),
        (F.avg(above) if "ma50" in d.columns else F.lit(0.0)).alias("breadth"),
    ]
    have = {k: v for k, v in medians.items() if v in d.columns}
    small = fits_one_task(symbols_bound)
    if small:
        plain += [F.median(v).alias(k) for k, v in have.items()]
    out = d.groupBy(*keys).agg(*plain)
    if not small:
        for k, v in have.items():
            out = out.join(quantiles(d, keys, v, {k: 0.5}), keys, "left")
    out = out.withColumns({k: F.lit(0.0) for k in medians if k not in have})
    parts = {f"{k}_rank": average_rank_pct(F.col(k), DAY) / 100 for k in P.SECTOR_WEIGHTS}
    out = out.withColumns(parts)
    score = sum((wt * F.col(f"{k}_rank") for k, wt in P.SECTOR_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("leadership_score", 100 * score)
    # scores that agree to nine decimals tie; the sum of weights is not exact
    best = Window.partitionBy(DAY).orderBy(F.round("leadership_score", 9).desc_nulls_last(), "sector")
    return out.withColumn("sector_rank", F.row_number().over(best))
