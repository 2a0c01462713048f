"""Queries for profiles, labels, selection and ingestion checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.series import spread
from eqpanel.operators import market as MK
from eqpanel.operators import outcomes as O
from eqpanel.operators import profiles as PR
from eqpanel.operators import quality as Q
from eqpanel.operators import relative_strength as RS
from eqpanel.operators import signals as S
from eqpanel.plans import market_queries as M
from eqpanel.plans import quality_queries as QQ
from eqpanel.plans import signal_queries as SQ
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D


def _bars(spark, sf) -> DataFrame:
    return D.bars(spark, sf, with_sector=False)


_STATS = "vol_annual:8 beta idio_share:8 adv_value:2 amihud:14 gap_median:8 gap_p90:8 limit_hit_freq:8 variance_ratio_5"


@query("l04_profiles", _STATS)
def l04(spark, sf):
    return PR.profiles(_bars(spark, sf))


@query("l08_archetypes")
def l08(spark, sf):
    return PR.archetypes(PR.profiles(_bars(spark, sf)), 5e6, 9e6).drop("tags")


@query("l10_selection", "composite:8 score win_probability")
def l10(spark, sf):
    """Three best setups a day, at most two of one sector."""
    f = M._features(spark, sf).where("trend_confirmed").select(
        "symbol", "trading_date", "sector", (F.col("setup_quality") * 100).alias("score"), (F.col("volume") % 10 / 10).alias("win_probability")
    )
    return S.select_signals(f)


@query("l11_session_classes")
def l11(spark, sf):
    b = _bars(spark, sf)
    master = b.groupBy("symbol").agg(F.min("trading_date").alias("listed_on"))
    return Q.session_classes(b, D.sessions(b), master)


@query("l12_ingestion_gate")
def l12(spark, sf):
    b = _bars(spark, sf)
    return Q.ingestion_gate(b, b.where("volume % 3 = 0"), 0.03)


@query("l14_reconciliation", "accepted_value:2")
def l14(spark, sf):
    return Q.reconcile(QQ._canonical(spark, sf), ("p2", "p1"), symbols_bound=D.symbol_bound(spark, sf))


@query("l15_fundamentals_as_of", "value:2")
def l15(spark, sf):
    """Yearly supplier totals, published 60 days after the year, as of each bar."""
    b = _bars(spark, sf)
    y = F.year("trading_date")
    end = F.make_date(y, F.lit(12), F.lit(31))
    facts = b.groupBy("symbol", end.alias("period_end")).agg(F.sum("value").cast("double").alias("value")).select(
        "symbol", F.lit("revenue").alias("metric"), "period_end", F.date_add("period_end", 60).alias("published_at"), "value"
    )
    return PR.fundamentals_as_of(b.select("symbol", "trading_date"), facts)


@query("l16_forward_excess", "excess_5:8 excess_10:8 excess_20:8")
def l16(spark, sf):
    b = _bars(spark, sf)
    return PR.forward_excess(b, MK.equal_weight_index(b))


@query("l16_triple_barrier")
def l16t(spark, sf):
    p = SQ._plan(spark, sf).select("symbol", "trading_date", "high", "low", "exit_stop", "target_1")
    return PR.triple_barrier(p)


@query("l17_period_metrics", "cagr:6 volatility:8 sharpe sortino tail_loss:8")
def l17(spark, sf):
    d = PR.with_returns(D.bars(spark, sf)).groupBy("sector", "trading_date").agg(F.avg("r").alias("ret"))
    return PR.period_metrics(d.where("ret IS NOT NULL"), ["sector"])


@query("l21_hit_rates", "win_probability:8")
def l21(spark, sf):
    return PR.hit_rates(O.trades(SQ._taken(spark, sf, "trend_confirmed"), "sector"), ["sector"], 30)


@query("l22_trend_transitions", "p_up:8 p_down:8 p_side:8 expected_duration")
def l22(spark, sf):
    return PR.trend_transitions(_bars(spark, sf), 50)


@query("l23_ewma_volatility", "ewma_vol:8")
def l23(spark, sf):
    return PR.ewma_volatility(_bars(spark, sf))


@query("l25_rank_ic", "rank_ic:8")
def l25(spark, sf):
    b = _bars(spark, sf)
    y = PR.forward_excess(b, MK.equal_weight_index(b), (5,))
    d = b.select("symbol", "trading_date", "volume").join(y, ["symbol", "trading_date"])
    return PR.rank_ic(d, "volume", "excess_5", D.symbol_bound(spark, sf))


@query("l26_gap_action", "overnight_gap:8")
def l26(spark, sf):
    a = O.label_entries(_bars(spark, sf))
    own = PR.profiles(_bars(spark, sf)).select("symbol", "gap_p90")
    d = a.join(own, "symbol").where("overnight_gap IS NOT NULL")
    limit = F.least(F.lit(P.MAXIMUM_GAP), F.col("gap_p90"))
    return d.select(
        "symbol", "trading_date", "overnight_gap",
        S.gap_action(F.col("overnight_gap"), limit, F.col("overnight_gap") >= P.PRICE_BAND).alias("action"),
    )


@query("l10_gate_funnel")
def l10f(spark, sf):
    """Rows stopped at each gate, per session (the daily survival counts)."""
    from eqpanel.plans import flow as FL

    bound = D.symbol_bound(spark, sf)
    bars = D.stored_bars(spark, sf)
    regimes = FL.market(bars, M._index_bars(spark, sf, bars), M.INDEX_PRIORITY, bound)["regimes"]
    kinds = _kinds(bars, bound)
    # of the panel only what the gates ask for is shuffled, once, and nothing of it is written
    f = RS.add_cross_sectional_rs(FL.features(bars, bound, D.session_bound(bars)).join(kinds, "symbol"), symbols_bound=bound, carried=True)
    f = f.join(F.broadcast(regimes.select("trading_date", "regime_level")), "trading_date")  # one row per session
    return S.gate_funnel(f).groupBy("trading_date", "gate").agg(F.count(F.lit(1)).alias("rows"))


def _kinds(bars: DataFrame, bound: int) -> DataFrame:
    """symbol, archetype: one row per symbol, written so that its sorts and those of the panel are not held at once."""
    return checkpointed(PR.archetypes(PR.profiles(spread(bars, bound, "symbol")), 5e6, 9e6).select("symbol", "archetype"))
