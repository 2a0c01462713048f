"""Values made comparable: percentiles in a symbol's own past, in the session's cross-section, and normal scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.normal import normal_quantile
from eqpanel.functions.ordered import join_null_safe, quantiles, with_rank_pcts
from eqpanel.functions.series import rolling_means

#: Rows compared with their windows at once.
CHUNK = 2048


def trailing_rank(x: np.ndarray, size: int, least: int) -> np.ndarray:
    """Percentile of each value among the last ``size`` rows, ties sharing their mean rank.

    NaN stays NaN and is not counted; windows with fewer than ``least`` values give NaN.
    """
    out = np.full(len(x), np.nan)
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(size - 1, np.nan), x], size) if len(x) else np.empty((0, size))
    for at in range(0, len(x), CHUNK):
        w, own = windows[at : at + CHUNK], x[at : at + CHUNK, None]
        known = (~np.isnan(w)).sum(axis=1)
        rank = (w < own).sum(axis=1) + ((w == own).sum(axis=1) + 1) / 2
        ok = ~np.isnan(own[:, 0]) & (known >= least)
        out[at : at + CHUNK][ok] = rank[ok] / known[ok] * 100
    return out


def rolling_percentiles(df: DataFrame, columns: Sequence[str], size: int = 252, least: int = 60, digits: int = 8) -> DataFrame:
    """symbol, trading_date and for each column ``<column>_percentile_<size>``.

    An order statistic in a sliding window has no built-in that does better than
    one list per row, so a symbol's history (bounded by the calendar) is compared
    with its windows in vectorised blocks; only key and columns leave the JVM.
    Values are compared at ``digits`` decimals: an indicator that stands still is
    a tie, whatever its rounding noise.
    """
    names = [f"{c}_percentile_{size}" for c in columns]

    def ranked(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("trading_date", kind="stable")
        ranks = {n: trailing_rank(f[c].to_numpy(np.float64), size, least) for n, c in zip(names, columns, strict=True)}
        return pd.DataFrame({"symbol": f["symbol"], "trading_date": f["trading_date"], **ranks})

    d = df.select("symbol", "trading_date", *[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])
    out = d.groupBy("symbol").applyInPandas(ranked, ", ".join(["symbol string", "trading_date date", *[f"{n} double" for n in names]]))
    return out.select("symbol", "trading_date", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def liquidity_percentile(bars: DataFrame, size: int = 20, symbols_bound: int | None = None) -> DataFrame:
    """Adds adv (mean traded value of ``size`` sessions) and its percentile in the session."""
    d = rolling_means(bars, [("value", size, size, "adv")])
    return with_rank_pcts(d, [(["trading_date"], "adv", "liquidity_percentile")], symbols_bound)


def normal_scores(
    df: DataFrame, keys: Sequence[str], value: str, out: str, tails: tuple[float, float] = P.WINSOR, group_bound: int | None = None
) -> DataFrame:
    """Rank-based inverse normal transform after winsorising at the ``tails`` quantiles of each group.

    Values beyond a tail are tied with it. The score is the normal quantile of
    (rank - 1/2) / n with mean ranks for ties; null stays null. Groups of any size
    unless ``group_bound`` shows that they fit a task; both paths agree.
    """
    keys = list(keys)
    # read by the quantiles, the ranks and the join
    base = checkpointed(df)
    ends = quantiles(base, keys, value, {"__low": tails[0], "__high": tails[1]}, group_bound)
    held = join_null_safe(base, ends, keys, "left") if keys else base.crossJoin(F.broadcast(ends))  # one row
    x = F.col(value).cast("double")
    held = held.withColumn("__x", F.when(x.isNotNull(), F.greatest(F.least(x, F.col("__high")), F.col("__low"))))
    ranked = with_rank_pcts(held, [(keys, "__x", "__pct")], group_bound)
    counts = base.groupBy(*keys).agg(F.count(value).alias("__n"))
    ranked = join_null_safe(ranked, counts, keys, "left") if keys else ranked.crossJoin(F.broadcast(counts))  # one row
    return ranked.withColumn(out, normal_quantile("__pct / 100 - 0.5D / nullif(__n, 0)")).select(*df.columns, out)
