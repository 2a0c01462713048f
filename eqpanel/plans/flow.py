"""The daily flow: from accepted bars to ranked, risk-approved candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.ordered import with_row_number
from eqpanel.functions.series import spread
from eqpanel.operators import features as FE
from eqpanel.operators import market as MK
from eqpanel.operators import relative_strength as RS
from eqpanel.operators import risk as RK
from eqpanel.operators import signals as S
from eqpanel.sources import tables as TB

DAY = "trading_date"


#: What sector scores and candidates read of the feature panel.
TRADED = (
    "symbol", DAY, "sector", "close", "ma50", "volume_z60", "trend_confirmed", "signal_pullback", "signal_reversal", "setup_quality",
    "volume_confirmation", "entry_price", "risk_stop", "adv_shares", "rs_sector_market_20", "rs_sector_market_126", "rs_stock_market_rank_20",
    "rs_stock_market_rank_126",
)


def features(bars: DataFrame, symbols_bound: int | None = None, sessions_bound: int | None = None) -> DataFrame:
    """Features and price plan of every bar, dealt out by symbol; nothing is written."""
    f = FE.add_baseline_features(spread(bars, symbols_bound, "symbol"), sessions_bound)
    return S.price_plan(S.downside_atr(f, sessions=sessions_bound))


def market(panel: DataFrame, index_bars: DataFrame, index_priority: Sequence[str], symbols_bound: int | None = None) -> dict[str, DataFrame]:
    """Breadth, both indices and the regime of every session."""
    dealt = spread(panel, symbols_bound, "symbol")
    breadth = MK.breadth(dealt)
    ew = MK.equal_weight_index(dealt)
    cap = MK.official_index(index_bars, breadth.select(DAY), index_priority)
    return {"breadth": breadth, "equal_weight_index": ew, "official_index": cap, "regimes": MK.regimes(cap, ew, breadth)}


def analyse(
    bars: DataFrame, index_bars: DataFrame, index_priority: Sequence[str], symbols_bound: int | None = None, raw_snapshots: DataFrame | None = None,
    columns: Sequence[str] | None = None, sessions_bound: int | None = None,
) -> dict[str, DataFrame]:
    """Features with ranks, breadth, equal-weight index, regimes and sector scores.

    The feature panel is written once: every later table reads a few of its columns.
    With ``columns`` (``TRADED`` or more) it holds these only, and the tables of
    sessions read ``bars``, which callers store first. With ``raw_snapshots`` only
    index bars that one of them supports are used. ``sessions_bound`` is a proven
    bound on the bars of a symbol.
    """
    if raw_snapshots is not None:
        index_bars = MK.verified_index_bars(index_bars, raw_snapshots)
    f = features(bars, symbols_bound, sessions_bound)
    if columns is None:
        panel = checkpointed(RS.add_cross_sectional_rs(f, symbols_bound=symbols_bound))
    else:
        f = f.select(*[c for c in f.columns if c in columns])
        panel = checkpointed(RS.add_cross_sectional_rs(f, symbols_bound=symbols_bound, carried=True).select(*columns))
    m = market(panel if columns is None else bars, index_bars, index_priority, symbols_bound)
    mode = m["official_index"].select(DAY, "cap_index_mode", "cap_index_warning")
    return {
        "features": panel,
        **m,
        # one row per session, read for the candidates and for the summary
        "sessions": checkpointed(m["regimes"].join(mode, DAY, "left")),
        "sector_scores": RS.sector_scores(panel, symbols_bound=symbols_bound),
    }


def recommend(
    analysed: dict[str, DataFrame], contexts: DataFrame, dq_score: Column, dq_actionable: Column,
    group_bound: int | None = None,
) -> dict[str, DataFrame]:
    """Candidates of all sessions, each account's decisions, and the approved ones.

    ``contexts``: one row per account. Accounts are few; each sees every candidate.
    """
    c = S.detect_candidates(
        analysed["features"], analysed["sessions"], analysed["sector_scores"], dq_score, dq_actionable
    ).where(dq_score >= P.DQ_ACTIONABLE_BLOCK)
    best = [F.col("score").desc(), F.col("symbol")]
    c = checkpointed(with_row_number(c, [DAY], best, "priority", group_bound))
    asked = contexts.select("account").join(c)
    # a bound on the symbols beyond one fold says little of the few that are candidates: their largest group is measured
    fold = group_bound if group_bound is not None and group_bound <= P.MAX_FOLD_GROUP else None
    decisions = RK.approve(asked, contexts, ["account", DAY], ["account"], fold)
    keys = ["account", DAY, "symbol"]
    approved = decisions.where(F.col("status").isin("ACCEPTED", "RESIZED")).select(
        *keys, "decision_id", "status", "quantity", "estimated_loss", "notional", "binding_constraint", "configuration_version"
    )
    return {"candidates": c, "decisions": decisions, "approved": asked.join(approved, keys)}


def market_summary(analysed: dict[str, DataFrame], approved: DataFrame) -> DataFrame:
    """One row per session: regime, official-index mode and approved candidates."""
    n = approved.groupBy(DAY).agg(F.count_distinct("symbol").alias("candidate_count"))
    return analysed["sessions"].join(n, DAY, "left").select(
        DAY, "regime", "reason", "cap_score", "ew_score", "breadth_pct_ma50", "turnover_ratio", "cap_index_mode",
        "cap_index_warning", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.coalesce(F.startswith("cap_index_mode", F.lit("DEGRADED_PROXY")), F.lit(True)).alias("degraded_mode"),
    )


def publish(path: str, verdict: DataFrame, analysed=None, chosen=None) -> None:
    """Write the outputs of a run, or only the blocked verdict over empty outputs."""
    row = verdict.first()
    if not row["acceptable"]:
        TB.write_summary(verdict, f"{path}/market")
        for name, df in (chosen or {}).items():
            TB.write_csv(df.limit(0), f"{path}/{name}")
        return
    TB.write_csv(analysed["sector_scores"], f"{path}/sector_scores")
    for name, df in chosen.items():
        TB.write_csv(df, f"{path}/{name}")
    summary = market_summary(analysed, chosen["approved"])
    last = summary.agg(F.max(DAY).alias(DAY))
    TB.write_summary(summary.join(F.broadcast(last), DAY, "left_semi"), f"{path}/market")
