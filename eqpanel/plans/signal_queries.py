"""Queries for outcomes, candidates, sizing and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions import rules as R
from eqpanel.functions.series import rolling_means, series_window
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.ordered import with_row_number
from eqpanel.operators import features as FE
from eqpanel.operators import market as MK
from eqpanel.operators import outcomes as O
from eqpanel.operators import relative_strength as RS
from eqpanel.operators import risk as RK
from eqpanel.operators import signals as S
from eqpanel.plans import market_queries as M
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D

COSTS = R.Costs(commission=0.0015)


@query("g09_g11_price_rules", "limit_price:2 floor_price:2 ceiling_price:2")
def g09(spark, sf):
    c = F.col("close").cast("double")
    return D.bars(spark, sf, with_sector=False).select(
        "symbol", "trading_date", R.tick_size(c).alias("tick"), R.round_down_to_tick(c * (1 + P.ENTRY_PREMIUM)).alias("limit_price"),
        R.floor_price(c).alias("floor_price"), R.ceiling_price(c).alias("ceiling_price"),
    )


@query("g12_g13_costs", "buy_rate:8 sell_rate:8 net_return:8")
def g12(spark, sf):
    """Net return of each order under the cost profile in force on its date."""
    o = D.table(spark, sf, "orders")
    profiles = spark.createDataFrame(
        [("1990-01-01", "1997-06-30", 0.0020, False, 0.0003, 0.001, 20.0), ("1997-07-01", None, 0.0015, True, 0.00027, 0.001, 15.0)],
        "effective_from string, effective_to string, commission_rate double, fee_included boolean, "
        "exchange_fee_rate double, sell_tax_rate double, slippage_bps double",
    ).withColumns({c: F.to_date(c) for c in ("effective_from", "effective_to")})
    buy, sell = R.cost_rates(profiles)
    day = F.to_date("o_orderdate")
    d = o.join(  # a cost schedule has a handful of versions
        F.broadcast(profiles), (day >= F.col("effective_from")) & (F.col("effective_to").isNull() | (day <= F.col("effective_to"))), "left"
    )
    gross = (D.cents(F.col("o_totalprice")) % 2001 - 1000) / 10000
    return d.select("o_orderkey", buy.alias("buy_rate"), sell.alias("sell_rate"), R.net_return(gross, buy, sell).alias("net_return"))


def _attempts(spark, sf, mode: str) -> DataFrame:
    return O.label_entries(D.bars(spark, sf, with_sector=False), mode)


@query("h10_entry_attempts", "entry_price:2 overnight_gap:8")
def h10(spark, sf):
    parts = [
        _attempts(spark, sf, m).select(
            F.lit(m).alias("mode"), "symbol", "trading_date", "attempt_status", "attempt_reason", "entry_date", "entry_price", "overnight_gap"
        )
        for m in O.MODES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("h11_exits", "exit_price:2")
def h11(spark, sf):
    return O.label_exits(D.bars(spark, sf, with_sector=False)).select(
        "symbol", "trading_date", "idx", "bars_left", "pinned", "sellable_date", "policy_exit_date", "exit_idx", "exit_date", "exit_price"
    )


def _taken(spark, sf, signal="signal_pullback", *extra: str) -> DataFrame:
    f = M._features(spark, sf).select("symbol", "trading_date", "open", "high", "low", "close", "sector", signal, *extra)
    return O.without_overlap(O.signal_outcomes(f, COSTS, signal=signal))


@query("h12_trades", "entry_price:2 exit_price:2 net_return:8")
def h12(spark, sf):
    return O.trades(_taken(spark, sf))


@query("h12_attempts", "entry_price:2 overnight_gap:8")
def h12a(spark, sf):
    return O.attempts(_taken(spark, sf))


@query("h12_trades_on_trend", "entry_price:2 exit_price:2 net_return:8")
def h12t(spark, sf):
    """The same selection on a frequent signal, where overlaps are common."""
    return O.trades(_taken(spark, sf, "trend_confirmed"))


_METRICS = "hit_rate mean_net_return:8 median_net_return:8 profit_factor max_trade_loss:8"


@query("d10_trade_metrics", _METRICS)
def d10(spark, sf):
    return O.trade_metrics(O.trades(_taken(spark, sf, "trend_confirmed"), "sector"), ["sector"])


@query("d23_sliced_metrics", _METRICS)
def d23(spark, sf):
    t = O.trades(_taken(spark, sf, "trend_confirmed"), "sector").withColumn("signal_year", F.year("signal_date"))
    return O.slice_metrics(t, ["sector", "signal_year"])


@query("d11_execution_summary", "fill_rate mean_overnight_gap:8")
def d11(spark, sf):
    return O.execution_summary(O.attempts(_taken(spark, sf, "trend_confirmed")))


@query("d11_rejection_counts")
def d11r(spark, sf):
    return O.rejection_counts(O.attempts(_taken(spark, sf, "trend_confirmed")))


@query("b09_result_governance")
def b09(spark, sf):
    """Each sector's result under each mode pair, with warnings and eligibility."""
    t = O.trades(_taken(spark, sf, "trend_confirmed"), "sector").groupBy("sector").agg(F.count(F.lit(1)).alias("trades"))
    modes = F.explode(
        F.array(*[F.struct(F.lit(u).alias("universe_mode"), F.lit(s).alias("sector_mode"))
                  for u in ("STRICT_PIT", "CURRENT_UNIVERSE_PROXY") for s in ("STRICT_PIT", "CURRENT_ICB_PROXY")])
    )
    d = t.select("sector", "trades", modes.alias("m")).select("sector", "trades", "m.*")
    d = d.withColumn("result_label", F.concat(F.lit("PROXY backtest "), F.col("sector")))
    return O.govern_results(d, "idx").withColumn("warnings", F.concat_ws(";", "warnings"))


_PLAN = "entry_price:2 exit_stop:2 risk_stop:2 r_unit:2 target_1:4 target_2:4 risk_reward:6 adv_shares:4 atr14:4 downside_atr14:4"


def _plan(spark, sf) -> DataFrame:
    return S.price_plan(S.downside_atr(M._features(spark, sf)))


@query("l01_l03_price_plan", _PLAN)
def l01(spark, sf):
    return _plan(spark, sf).select("symbol", "trading_date", "plan_valid", *[w.split(":")[0] for w in _PLAN.split()])


def _candidates(spark, sf) -> DataFrame:
    bound = D.symbol_bound(spark, sf)
    f = RS.add_cross_sectional_rs(M._features(spark, sf), symbols_bound=bound)
    # the feature panel is written once; the four tables below read a few columns each
    keep = ["symbol", "trading_date", "sector", "close", "value", *FE.FEATURE_COLUMNS]
    f = checkpointed(f.select(*keep, *[c for c in f.columns if c.startswith("rs_")]))
    regimes = MK.regimes(M._cap(spark, sf), MK.equal_weight_index(f), MK.breadth(f))
    return S.detect_candidates(f, regimes, RS.sector_scores(f, symbols_bound=bound), F.lit(65), F.lit(True))


@query("h07_candidates", "score rs_long_rank rs_short_rank sector_score confidence entry_price risk_stop adv_shares")
def h07(spark, sf):
    return _candidates(spark, sf)


def _ranked(spark, sf) -> DataFrame:
    """Every bar in a confirmed trend, best setup first within its session."""
    d = _plan(spark, sf).where("trend_confirmed")
    best = [F.col("setup_quality").desc_nulls_last(), F.col("symbol")]
    d = with_row_number(d, ["trading_date"], best, "priority", D.symbol_bound(spark, sf))
    return d.select(
        "trading_date", "priority", "symbol", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"),
        F.concat(F.coalesce("sector", F.lit("UNKNOWN")), F.substring("symbol", -1, 1)).alias("correlated_group"),
        "entry_price", "risk_stop", (F.col("adv_shares") * 1000).alias("adv_shares"),
        F.element_at(F.array(*[F.lit(r) for r in P.REGIMES]), 2 + F.dayofmonth("trading_date") % 4).alias("regime"),
    )


def _accounts(spark, sf) -> DataFrame:
    """One account per customer segment, holding one position already."""
    held = F.array(
        F.struct(
            F.lit("S000000001").alias("symbol"), F.lit("ASIA").alias("sector"), F.lit("ASIA1").alias("correlated_group"),
            F.lit(1000).cast("long").alias("quantity"), F.lit(20000.0).alias("market_price"), F.lit(18000.0).alias("risk_stop"),
        )
    )
    equity = F.sum(D.cents(F.col("c_acctbal"))).cast("double") * 10
    return D.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("account")).agg(
        equity.alias("equity"), equity.alias("cash"), (equity * 0.01).alias("max_loss"), F.lit(0.001).alias("buy_rate"),
        F.lit(0.001).alias("sell_rate"), F.lit(10000.0).alias("fixed_cost"), held.alias("positions"),
    )


def _decisions(spark, sf, group_bound):
    accounts = _accounts(spark, sf)
    # every account may take every candidate: the segments are few and fixed
    ranked = _ranked(spark, sf).crossJoin(F.broadcast(accounts.select("account")))
    d = RK.approve(ranked, accounts, ["account", "trading_date"], ["account"], group_bound)
    return d.drop("decision_id", "configuration_version")


_RISK = "entry_price:2 risk_stop:2 adv_shares:2 estimated_loss:2 notional:2"


@query("h03_portfolio_risk", _RISK)
def h03(spark, sf):
    # candidates of one account and session are at most the symbols
    return _decisions(spark, sf, D.symbol_bound(spark, sf))


@query("h03_portfolio_risk_rounds", _RISK)
def h03r(spark, sf):
    """The path for keys of any size: same decisions, no group in one task."""
    return _decisions(spark, sf, P.MAX_FOLD_GROUP + 1)


@query("d22_account_exposure", "notional:2 open_risk:2")
def d22(spark, sf):
    d = h03(spark, sf).where("status <> 'REJECTED'").withColumnRenamed("entry_price", "market_price")
    return RK.exposure(d, ["account", "trading_date", "sector"])


def _requests(spark, sf) -> DataFrame:
    """A request for each bar in a confirmed trend, with the next bar as evidence."""
    w = series_window()
    p = _plan(spark, sf)
    nxt = {c: F.lead(c).over(w) for c in ("trading_date", "open", "high", "low")}
    bar = F.struct(
        nxt["trading_date"].alias("trading_date"), *[nxt[c].cast("double").alias(c) for c in ("open", "high", "low")]
    )
    d = p.withColumn("attempt_bar", F.when(F.col("volume") % 5 != 0, F.when(nxt["trading_date"].isNotNull(), bar)))
    d = d.where("trend_confirmed")
    close = F.col("close").cast("double")
    account = F.broadcast(_accounts(spark, sf).where("account = 'BUILDING'").drop("account"))  # one row
    return d.join(account).select(
        "symbol", F.lit("trend").alias("setup"), F.col("trading_date").alias("signal_date"), close.alias("signal_close"),
        (close * 0.998).alias("zone_low"), (close * 1.004).alias("zone_high"), F.lit("limit").alias("entry_trigger"),
        F.col("exit_stop").alias("technical_stop"), "risk_stop", F.lit("close below stop").alias("invalidation"),
        F.array(F.col("target_1"), F.col("target_2")).alias("targets"),
        (0.2 + (F.col("volume") % 7) / 10).alias("win_probability"), F.lit(80.0).alias("confidence"),
        F.when(F.col("volume") % 11 == 0, "MISSING").otherwise("AVAILABLE").alias("forecast_status"),
        F.when(F.col("volume") % 13 == 0, "WARN").otherwise("PASS").alias("dq_status"), F.lit(True).alias("dq_actionable"),
        F.lit(True).alias("strategy_validated"),
        F.create_map(
            F.lit("provider"), F.col("provider"), F.lit("snapshot_id"), F.col("symbol"), F.lit("canonical_revision"), F.lit("r1"),
            F.lit("ingested_at"), F.when(F.col("volume") % 17 == 0, "").otherwise("2001-01-01"),
        ).alias("source_lineage"),
        "sector", F.col("sector").alias("correlated_group"), (F.col("adv_shares") * 1000).alias("adv_shares"),
        F.lit(P.MAXIMUM_GAP).alias("maximum_gap"), F.lit("RANGE").alias("regime"), "attempt_bar",
        *RK.CONTEXT, "positions",
    )


@query(
    "h09_recommendations",
    "planned_zone_low:2 planned_entry_limit:2 expected_reward_to_risk:6 expected_value:2 nav_fraction:8 fill_price:2",
)
def h09(spark, sf):
    cal = D.sessions(D.bars(spark, sf, with_sector=False)).select("trading_date")
    return S.build_recommendations(_requests(spark, sf), cal)


@query("c14_c15_settlement_dates")
def c14(spark, sf):
    return S.settlement_calendar(D.sessions(D.bars(spark, sf, with_sector=False)).select("trading_date"))
