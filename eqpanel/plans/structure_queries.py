"""Queries for market structure, the volume profile, normalised values, h-step states and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.operators import market as MK
from eqpanel.operators import normalise as N
from eqpanel.operators import profiles as PR
from eqpanel.operators import structure as ST
from eqpanel.plans import market_queries as M
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D


def _structure(spark, sf) -> DataFrame:
    return ST.market_structure(M._features(spark, sf))


@query("l05_market_structure")
def l05(spark, sf):
    return _structure(spark, sf)


_EDGES = "low_edge:4 high_edge:4 poc_low:4 poc_high:4 value_area_low:4 value_area_high:4 value_area_share:8"


def _profile(spark, sf) -> DataFrame:
    b = D.bars(spark, sf, with_sector=False)
    return ST.volume_profile(b.withColumn("year", F.year("trading_date")), ["symbol", "year"])


@query("l06_volume_profile", _EDGES)
def l06(spark, sf):
    return _profile(spark, sf)


@query("l06_profile_score", "vp_score:8")
def l06s(spark, sf):
    """Each close against the finished profile of the year before, weighted by liquidity."""
    b = N.liquidity_percentile(D.bars(spark, sf, with_sector=False), symbols_bound=D.symbol_bound(spark, sf))
    b = b.select("symbol", "trading_date", "close", "liquidity_percentile", (F.year("trading_date") - 1).alias("year"))
    p = _profile(spark, sf).select("symbol", "year", "value_area_low", "value_area_high")
    return ST.profile_score(b.join(p, ["symbol", "year"])).select("symbol", "trading_date", "vp_score")


@query("l07_rolling_percentiles", "rsi14_percentile_252:8 value_percentile_252:8")
def l07(spark, sf):
    return N.rolling_percentiles(M._features(spark, sf), ["rsi14", "value"])


@query("l07_liquidity_percentile", "adv:4 liquidity_percentile:8")
def l07l(spark, sf):
    d = N.liquidity_percentile(D.bars(spark, sf, with_sector=False), symbols_bound=D.symbol_bound(spark, sf))
    return d.select("symbol", "trading_date", "adv", "liquidity_percentile")


@query("l07_liquidity_percentile_split", "adv:4 liquidity_percentile:8")
def l07b(spark, sf):
    """The same without a bound on the symbols: ranks in ordered blocks."""
    return N.liquidity_percentile(D.bars(spark, sf, with_sector=False)).select("symbol", "trading_date", "adv", "liquidity_percentile")


def _scores(spark, sf, bound) -> DataFrame:
    r = PR.with_returns(D.bars(spark, sf, with_sector=False)).select("symbol", "trading_date", "r")
    return N.normal_scores(r, ["trading_date"], "r", "score", group_bound=bound).select("symbol", "trading_date", "score")


@query("l07_normal_scores", "score:8")
def l07n(spark, sf):
    return _scores(spark, sf, D.symbol_bound(spark, sf))


@query("l07_normal_scores_split", "score:8")
def l07m(spark, sf):
    return _scores(spark, sf, None)


@query("l22_h_step_states", "p_up:8 p_down:8 p_side:8")
def l22h(spark, sf):
    """Five sessions ahead, per nation; histories are long enough for the floor of 200."""
    return PR.h_step_transitions(PR.trend_transitions(D.nation_closes(spark, sf)), 5)


def _ic(spark, sf) -> DataFrame:
    b = D.bars(spark, sf, with_sector=False)
    y = PR.forward_excess(b, MK.equal_weight_index(b), (5,))
    bound = D.symbol_bound(spark, sf)
    d = b.select("symbol", "trading_date", "volume", "value").join(y, ["symbol", "trading_date"])
    parts = [PR.rank_ic(d, f, "excess_5", bound).select(F.lit(f).alias("factor"), "trading_date", "rank_ic") for f in ("volume", "value")]
    return parts[0].unionByName(parts[1])


@query("l25_rolling_ic", "mean_ic:8 ic_low:8 ic_high:8 t_ratio:6")
def l25r(spark, sf):
    return PR.rolling_ic(_ic(spark, sf), ["factor"])


@query("l25_drift", "drift:8")
def l25d(spark, sf):
    """Each year's distribution of returns and traded values against the first year's."""
    r = PR.with_returns(D.bars(spark, sf, with_sector=False)).withColumn("year", F.year("trading_date"))
    parts = [r.select(F.lit(f).alias("factor"), "year", F.col(c).cast("double").alias("x")) for f, c in (("return", "r"), ("value", "value"))]
    return PR.drift(parts[0].unionByName(parts[1]), ["factor"], "x", "year")


def layouts(spark, sf) -> dict[str, DataFrame]:
    """The bars as delivered tables: well named, renamed and shuffled, with swapped names, with a doubled price, with a turnover column."""
    b = checkpointed(D.bars(spark, sf, with_sector=False))  # read by every layout
    text = {c: F.col(c).cast("string") for c in ("symbol", "open", "high", "low", "close", "volume", "value")}
    text["trading_date"] = F.date_format("trading_date", "yyyyMMdd")
    named = {"<Ticker>": "symbol", "Ngày": "trading_date", "Open": "open", "HIGH": "high", "low": "low", "Close": "close", "Vol": "volume"}
    unnamed = {"c1": "volume", "c2": "close", "c3": "trading_date", "c4": "low", "c5": "open", "c6": "symbol", "c7": "high"}
    swapped = {**named, "Open": "volume", "Vol": "open"}
    doubled = {**unnamed, "c2": "open"}
    turnover = {**unnamed, "c8": "value"}
    made = {"named": named, "unnamed": unnamed, "swapped": swapped, "doubled": doubled, "turnover": turnover}
    return {name: b.select(*[text[c].alias(h) for h, c in m.items()]) for name, m in made.items()}


@query("l13_column_identity", "confidence:6")
def l13(spark, sf):
    from eqpanel.sources import columns as CO

    out = None
    for name, t in layouts(spark, sf).items():
        found = CO.detect_columns(t, ticker=r"^S\d{9}$").select(F.lit(name).alias("layout"), "*")
        out = found if out is None else out.unionByName(found)
    return out
