"""Rules, regimes, candidates, sizing and recommendations on small known cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions import rules as R
from eqpanel.operators import market as MK
from eqpanel.operators import risk as RK
from eqpanel.operators import signals as S
from eqpanel.operators.outcomes import govern_results

DAY = dt.date(2026, 1, 5)


def one(df):
    return df.collect()[0]


def test_tick_rounding(spark):
    d = spark.createDataFrame([(10000 * 1.005,), (9999.0,), (50049.0,), (49999.0,)], "p double")
    assert [r[0] for r in d.select(R.round_down_to_tick(F.col("p"))).collect()] == [10050.0, 9990.0, 50000.0, 49950.0]


def test_costs():
    c = R.Costs(commission=0.0015)
    assert c.buy_rate == pytest.approx(0.003) and c.sell_rate == pytest.approx(0.004)


@pytest.mark.parametrize(
    "cap,ew,breadth,slope,turnover,want",
    [
        ((100, 90, 80), (100, 90, 80), 0.7, 1.0, None, "RANGE"),
        ((100, 90, 80), (100, 90, 80), 0.7, 1.0, 1.2, "STRONG_BULL"),
        ((100, 90, 80), (85, 90, 80), 0.7, 1.0, None, "RANGE"),
        ((None, None, None), (100, 90, 80), 0.3, 1.0, 1.2, "RISK_OFF"),
        ((70, 90, 95), (70, 90, 95), 0.1, -1.0, 1.2, "PANIC_BEAR"),
    ],
)
def test_regime_cases(spark, cap, ew, breadth, slope, turnover, want):
    ix = "trading_date date, close double, ma50 double, ma200 double"
    f = lambda t: tuple(None if x is None else float(x) for x in t)
    c = spark.createDataFrame([(DAY, *f(cap), turnover)], ix + ", turnover_ratio double")
    e = spark.createDataFrame([(DAY, *f(ew))], ix)
    b = spark.createDataFrame([(DAY, breadth, slope)], "trading_date date, pct_ma50 double, ad_slope_10 double")
    assert one(MK.regimes(c, e, b)).regime == want


def candidates(spark, dq, setup=0.8):
    f = spark.createDataFrame(
        [("AAA", DAY, "BANK", 80.0, 20.0, True, False, True, 0.0, setup, 0.7)],
        "symbol string, trading_date date, sector string, rs_stock_market_rank_126 double, rs_stock_market_rank_20 double, "
        "signal_pullback boolean, signal_reversal boolean, trend_confirmed boolean, volume_z60 double, setup_quality double, volume_confirmation double",
    )
    g = spark.createDataFrame([(DAY, "RANGE", 2)], "trading_date date, regime string, regime_level int")
    s = spark.createDataFrame([(DAY, "BANK", 80.0)], "trading_date date, sector string, leadership_score double")
    return S.detect_candidates(f, g, s, F.lit(dq), F.lit(True)).collect()


def test_candidate_family_and_quality_cap(spark):
    [full], [capped], [blocked] = candidates(spark, 100), candidates(spark, 69), candidates(spark, 49)
    assert full.family == "TREND_PULLBACK" and full.actionable
    assert full.score == pytest.approx(0.35 * 80 + 0.15 * 80 + 0.25 * 80 + 15 * 0.8 + 10 * 0.7)
    assert capped.confidence == 69 and capped.actionable
    assert blocked.confidence == 49 and not blocked.actionable


def test_zero_setup_quality_is_not_missing(spark):
    [zero] = candidates(spark, 100, 0.0)
    assert zero.score == pytest.approx(0.35 * 80 + 0.15 * 80 + 0.25 * 80 + 10 * 0.7)


REC = (
    "account string, priority long, symbol string, sector string, correlated_group string, entry_price double, risk_stop double, "
    "adv_shares double, regime string"
)
ACC = f"account string, equity double, cash double, max_loss double, buy_rate double, sell_rate double, fixed_cost double, positions array<{RK.POSITION}>"


def size(spark, rows, positions=(), bound=100, equity=1e9, max_loss=1e7):
    recs = spark.createDataFrame([("A", i + 1, *r) for i, r in enumerate(rows)], REC)
    acc = spark.createDataFrame([("A", equity, equity, max_loss, 0.001, 0.001, 10000.0, list(positions))], ACC)
    return RK.approve(recs, acc, ["account"], group_bound=bound).orderBy("priority").collect()


def test_known_sizes(spark):
    row = lambda stop, adv: ("AAA", "BANK", "BANK", 50000.0, stop, adv, "STRONG_BULL")
    assert [(d.status, d.quantity) for d in size(spark, [row(45000.0, 1e6)])] == [("ACCEPTED", 1900)]
    assert [(d.status, d.quantity) for d in size(spark, [row(45000.0, 50000.0)])] == [("RESIZED", 1500)]
    assert size(spark, [row(45000.0, None)])[0].binding_constraint == "LIQUIDITY_UNAVAILABLE"
    assert size(spark, [row(None, 1e6)])[0].binding_constraint == "RISK_STOP_INVALID"
    assert size(spark, [row(45000.0, 1e6)], equity=0.0)[0].binding_constraint == "RISK_CONTEXT_INVALID"


def brute_force(rows, equity, max_loss, buy, sell, fixed, positions):
    """Row after row with mutable state."""
    held, out = [dict(zip(("symbol", "sector", "group", "q", "price", "stop"), p)) for p in positions], []
    lots = lambda x: math.floor(x / 100) * 100
    for symbol, sector, group, entry, stop, adv, regime in rows:
        limit, mult = P.REGIME_LIMITS[regime]
        why = None
        if entry is None or entry <= 0:
            why = "ENTRY_PRICE_UNAVAILABLE"
        elif stop is None or stop <= 0 or stop >= entry:
            why = "RISK_STOP_INVALID"
        elif (entry - stop) / entry < 0.01:
            why = "MINIMUM_STOP_DISTANCE"
        elif (entry - stop) / entry > 0.20:
            why = "MAXIMUM_STOP_DISTANCE"
        elif adv is None or adv <= 0:
            why = "LIQUIDITY_UNAVAILABLE"
        q = 0
        if why is None:
            per = entry - stop + entry * buy + stop * sell
            budget = min(max_loss, equity * 0.01 * mult)
            same = [h for h in held if h["group"] == group]
            value = lambda hs: sum(h["q"] * h["price"] for h in hs)
            if budget <= fixed:
                why = "MAXIMUM_PERMITTED_LOSS"
            elif lots((budget - fixed) / per) < 100:
                why = "MINIMUM_LOT_RISK"
            elif len(held) >= 10:
                why = "CONCURRENT_POSITION_LIMIT"
            elif len(same) >= 2:
                why = "CORRELATED_POSITION_LIMIT"
            else:
                risk = sum(max(0.0, h["price"] - h["stop"]) * h["q"] for h in held)
                q, name = min(
                    (lots((budget - fixed) / per), "RISK_BUDGET"), (lots(equity / entry), "AVAILABLE_CASH"),
                    (lots(equity * 0.10 / entry), "SECURITY_EXPOSURE"), (lots(max(0, equity * limit - value(held)) / entry), "TOTAL_EXPOSURE"),
                    (lots(max(0, equity * 0.35 - value([h for h in held if h["sector"] == sector])) / entry), "SECTOR_CONCENTRATION"),
                    (lots(max(0, equity * 0.15 - value(same)) / entry), "CORRELATED_EXPOSURE"), (lots(adv * 0.03), "LIQUIDITY_PARTICIPATION"),
                    (lots(max(0, equity * 0.05 - risk - fixed) / per), "TOTAL_OPEN_RISK"),
                )
                if q < 100:
                    why = name
                elif q * entry < P.MIN_NOTIONAL:
                    why = "MINIMUM_NOTIONAL"
        if why is None:
            held.append({"symbol": symbol, "sector": sector, "group": group, "q": q, "price": entry, "stop": stop})
            out.append(("ACCEPTED" if name == "RISK_BUDGET" else "RESIZED", q, name))
        else:
            out.append(("REJECTED", 0, why))
    return out


@pytest.mark.parametrize("bound", [100, P.MAX_FOLD_GROUP + 1])
def test_sizing_equals_row_by_row(spark, bound):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        entry = float(rng.randrange(5000, 90000, 50))
        stop = rng.choice([entry * 0.95, entry * 0.9, entry * 0.995, entry * 0.75, None])
        rows.append((f"S{i}", rng.choice("XYZ"), rng.choice("abcdefgh"), entry, stop, rng.choice([1e6, 5e4, 3e3, None]), "RANGE"))
    held = [("H", "X", "a", 1000, 20000.0, 18000.0)]
    got = [(d.status, d.quantity, d.binding_constraint) for d in size(spark, rows, held, bound, 6e8, 6e6)]
    want = brute_force(rows, 6e8, 6e6, 0.001, 0.001, 10000.0, held)
    assert got == want
    assert len({w[2] for w in want}) > 5 and sum(w[0] != "REJECTED" for w in want) > 3


REQ = (
    "symbol string, setup string, signal_date date, signal_close double, zone_low double, zone_high double, entry_trigger string, technical_stop double, "
    "risk_stop double, invalidation string, targets array<double>, win_probability double, confidence double, forecast_status string, dq_status string, "
    "dq_actionable boolean, strategy_validated boolean, source_lineage map<string,string>, sector string, correlated_group string, adv_shares double, "
    "maximum_gap double, regime string, attempt_bar struct<trading_date:date,open:double,high:double,low:double>, equity double, cash double, "
    f"max_loss double, buy_rate double, sell_rate double, fixed_cost double, positions array<{RK.POSITION}>"
)
LINEAGE = {"provider": "p", "snapshot_id": "s", "canonical_revision": "r", "ingested_at": "t"}


def request(**over):
    base = dict(
        symbol="AAA", setup="pullback", signal_date=DAY, signal_close=50000.0, zone_low=50100.0, zone_high=50555.0, entry_trigger="limit",
        technical_stop=47500.0, risk_stop=47000.0, invalidation="close below", targets=[56000.0, 60000.0], win_probability=0.6, confidence=80.0,
        forecast_status="AVAILABLE", dq_status="PASS", dq_actionable=True, strategy_validated=True, source_lineage=LINEAGE, sector="BANK",
        correlated_group="BANK", adv_shares=1e6, maximum_gap=0.02, regime="STRONG_BULL", attempt_bar=None, equity=1e9, cash=1e9, max_loss=1e7,
        buy_rate=0.001, sell_rate=0.001, fixed_cost=10000.0, positions=[],
    )
    return tuple({**base, **over}.values())


def run_requests(spark, requests, sessions=8):
    days = [DAY + dt.timedelta(days=i) for i in range(14) if (DAY + dt.timedelta(days=i)).weekday() < 5][:sessions]
    cal = spark.createDataFrame([(d,) for d in days], "trading_date date")
    return S.build_recommendations(spark.createDataFrame(requests, REQ), cal).collect()


def test_recommendation_passes_all_gates(spark):
    [r] = run_requests(spark, [request()])
    assert r.status == "ACTIONABLE" and r.planned_entry_limit == 50500.0 and r.planned_zone_low == 50100.0
    assert r.attempt_date == DAY + dt.timedelta(days=1)
    assert r.regulatory_sellable_date == dt.date(2026, 1, 8) and r.policy_earliest_exit_fill_date == dt.date(2026, 1, 9)
    assert r.fill_price is None


@pytest.mark.parametrize(
    "over,reason",
    [
        ({"setup": " "}, "REQUIRED_DATA_MISSING"),
        ({"source_lineage": {**LINEAGE, "ingested_at": ""}}, "SOURCE_LINEAGE_INCOMPLETE"),
        ({"dq_status": "WARN"}, "DQ_GATE_FAILED"),
        ({"strategy_validated": False}, "STRATEGY_GATE_FAILED"),
        ({"win_probability": 1.2}, "FORECAST_GATE_FAILED"),
        ({"signal_date": dt.date(2027, 1, 1)}, "ATTEMPT_DATE_UNAVAILABLE"),
        ({"adv_shares": float("nan")}, "PRICE_OR_LIQUIDITY_INVALID"),
        ({"zone_high": 56000.0}, "PRICE_BAND_GATE_FAILED"),
        ({"risk_stop": 50500.0}, "STOP_GATE_FAILED"),
        ({"targets": [50000.0]}, "TARGET_GATE_FAILED"),
        ({"maximum_gap": -0.1}, "GAP_GATE_INVALID"),
        ({"attempt_bar": (DAY, 50000.0, 51000.0, 49000.0)}, "ATTEMPT_BAR_DATE_MISMATCH"),
        ({"attempt_bar": (dt.date(2026, 1, 6), 50000.0, 49000.0, 49500.0)}, "ATTEMPT_BAR_INVALID"),
        ({"attempt_bar": (dt.date(2026, 1, 6), 52000.0, 53000.0, 51500.0)}, "EXECUTION_GATE_FAILED:gap_gate"),
        ({"regime": "PANIC_BEAR"}, "PORTFOLIO_GATE_FAILED:MAXIMUM_PERMITTED_LOSS"),
        ({"win_probability": 0.05}, "EXPECTED_VALUE_GATE_FAILED"),
        ({"signal_date": dt.date(2026, 1, 13)}, "SETTLEMENT_CALENDAR_INCOMPLETE"),
    ],
)
def test_recommendation_gates(spark, over, reason):
    assert run_requests(spark, [request(**over)])[0].reason == reason


def test_weekend_signal_takes_the_next_session(spark):
    [r] = run_requests(spark, [request(signal_date=dt.date(2026, 1, 10))], sessions=10)
    assert r.attempt_date == dt.date(2026, 1, 12)


def test_label_guard(spark):
    cols = "result_label string, universe_mode string, sector_mode string"
    ok = spark.createDataFrame([("HISTORICAL_IDX run", "STRICT_PIT", "STRICT_PIT")], cols)
    assert one(govern_results(ok, "idx")).capital_qualification_eligible
    bad = spark.createDataFrame([("historical idx", "CURRENT_UNIVERSE_PROXY", "STRICT_PIT")], cols)
    with pytest.raises(Exception, match="STRICT_PIT"):
        govern_results(bad, "idx").collect()


def test_rounds_fold_many_acceptances_at_once(spark, monkeypatch):
    """A key's acceptances take one short fold, not two stored tables each; prefixes of any length agree."""
    rng = random.Random(5)
    rows = [(f"S{i}", f"X{i % 5}", f"g{i}", float(rng.randrange(20000, 60000, 50)), None, 1e6, "STRONG_BULL") for i in range(80)]
    rows = [(s, x, g, e, e * 0.9, *rest) for s, x, g, e, _, *rest in rows]
    want = [(d.status, d.quantity) for d in size(spark, rows, [], 100, 6e8, 6e6)]
    assert sum(w[0] != "REJECTED" for w in want) > 5
    stored, real = [], RK.checkpointed
    monkeypatch.setattr(RK, "checkpointed", lambda d: stored.append(1) or real(d))
    for prefix in (P.FOLD_PREFIX, 3, 1):
        monkeypatch.setattr(P, "FOLD_PREFIX", prefix)
        stored.clear()
        assert [(d.status, d.quantity) for d in size(spark, rows, [], P.MAX_FOLD_GROUP + 1, 6e8, 6e6)] == want
        assert prefix < 10 or len(stored) <= 6
    assert size(spark, [], [], P.MAX_FOLD_GROUP + 1, 6e8, 6e6) == []
