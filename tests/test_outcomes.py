"""Entries, exits and trade selection against a bar-by-bar loop."""

import datetime as dt
import random

import pytest
from decimal import ROUND_FLOOR, Decimal

from eqpanel.functions.rules import Costs
from eqpanel.operators import outcomes as O
from eqpanel.operators import validation as V

COSTS = Costs(commission=0.0015)
BARS = "symbol string, trading_date date, open double, high double, low double, close double, signal_pullback boolean"


def tick_floor(x):
    px = Decimal(str(x)).quantize(Decimal("0.000001"))
    t = Decimal(10 if px < 10000 else 50 if px < 50000 else 100)
    return float((px / t).to_integral_value(rounding=ROUND_FLOOR) * t)


def loop(bars, mode, hold=20):
    """Walk one symbol's bars in order with explicit state."""
    trades, attempts, i, n = [], [], 0, len(bars)
    while i < n - 4:
        _, day, _, _, _, close, signal = bars[i]
        if not signal:
            i += 1
            continue
        _, nday, o, h, low, _, _ = bars[i + 1]
        limit = tick_floor(close * 1.005)
        price = None
        if o / close - 1 <= 0.02:
            if o <= limit:
                price = o
            elif low < limit or (low == limit and mode == "optimistic"):
                price = limit
        attempts.append((day, price))
        if price is None:
            i += 1
            continue
        j = min(max(min(i + 1 + hold, n - 2), i + 3) + 1, n - 1)

        def pinned(k):
            floor = tick_floor(bars[k - 1][5] * (1 - 0.07))
            return mode != "optimistic" and bars[k][2] <= floor and bars[k][3] <= floor

        while pinned(j) and j < n - 1:
            j += 1
        sold = not pinned(j)
        trades.append((day, price, bars[j][1] if sold else None, bars[j][2] if sold else None))
        i = max(i + 1, j)
    return trades, attempts


def random_symbol(name, n, rng):
    price, rows, day = 20000.0, [], dt.date(2020, 1, 1)
    for k in range(n):
        crash = rng.random() < 0.15
        o = price * (0.92 if crash else 1 + rng.uniform(-0.03, 0.04))
        c = o if crash else o * (1 + rng.uniform(-0.02, 0.02))
        o, c = float(round(o / 50) * 50), float(round(c / 50) * 50)
        h = max(o, c) + (0 if crash else 100)
        rows.append((name, day + dt.timedelta(days=k), o, h, min(o, c) - 100, c, rng.random() < 0.3))
        price = max(c, 3000.0)
    return rows


@pytest.mark.parametrize("mode", O.MODES)
@pytest.mark.parametrize("hold", [20, 1])
def test_selection_equals_loop(spark, mode, hold):
    rng = random.Random(3)
    panels = [random_symbol(f"S{i}", n, rng) for i, n in enumerate((120, 90, 30, 6, 4, 200))]
    df = spark.createDataFrame([r for p in panels for r in p], BARS)
    taken = O.without_overlap(O.signal_outcomes(df, COSTS, mode=mode, hold_sessions=hold)).cache()
    t = sorted((r.symbol, r.signal_date, r.entry_price, r.exit_date, r.exit_price) for r in O.trades(taken).collect())
    a = sorted((r.symbol, r.signal_date, r.entry_price) for r in O.attempts(taken).collect() if r.entry_price is not None)
    rejected = O.attempts(taken).where("status = 'REJECTED'").count()
    want = [(p[0][0], loop(p, mode, hold)) for p in panels]
    assert t == sorted((s, *x) for s, (tr, _) in want for x in tr)
    assert a == sorted((s, *x) for s, (_, at) in want for x in at if x[1] is not None)
    assert rejected == sum(1 for _, (_, at) in want for x in at if x[1] is None)
    assert len(t) > 5


def test_gap_is_kept_in_the_audit(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 5, 6, 7, 8, 9, 12)]
    rows = [("AAA", d, 105.0 if i == 1 else 100.0, 106.0, 99.0, 100.0, i == 0) for i, d in enumerate(days)]
    taken = O.without_overlap(O.signal_outcomes(spark.createDataFrame(rows, BARS), COSTS))
    [a] = O.attempts(taken).collect()
    assert (a.status, a.reason) == ("REJECTED", "gap_gate") and a.overnight_gap == pytest.approx(0.05)
    assert O.trades(taken).count() == 0


def test_metrics_by_hand(spark):
    d = spark.createDataFrame([("a", 0.1), ("a", -0.05), ("a", 0.02), ("b", 0.3), ("c", None)], "s string, net_return double")
    m = {r.s: r for r in O.trade_metrics(d, ["s"]).collect()}
    assert m["a"].trades == 3 and m["a"].median_net_return == pytest.approx(0.02)
    assert m["a"].profit_factor == pytest.approx(0.12 / 0.05) and m["a"].max_trade_loss == -0.05
    assert m["b"].profit_factor is None and m["b"].hit_rate == 1.0
    assert m["c"].trades == 1 and m["c"].hit_rate is None and m["c"].median_net_return is None


def test_fold_numbers(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(100)], "trading_date date")
    folds = V.purged_folds(d, 5, 10, 30)
    f = folds.where("fold = 0").collect()[0]
    assert (f.embargo_sessions, f.train_end, f.test_start) == (26, 29, 56)
    roles = {(r.fold, r.role): r["count"] for r in V.fold_dates(d, folds).groupBy("fold", "role").count().collect()}
    assert roles[(0, "train")] == 30 and roles[(0, "embargo")] == 26 and roles[(0, "test")] == 10
    with pytest.raises(ValueError):
        V.purged_folds(d, 0, 10, 30)


def test_drawdown_equals_running_path(spark):
    rng = random.Random(9)
    r = [rng.uniform(-0.1, 0.1) for _ in range(500)]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(r)], "family string, k int, net_return double")
    wealth, peak, worst = 1.0, 0.0, 0.0
    for x in r:
        wealth *= 1 + x
        peak = max(peak, wealth)
        worst = min(worst, wealth / peak - 1)
    got = V.max_drawdown(d, ["family"], ["k"]).collect()[0].max_drawdown
    assert got == pytest.approx(worst, rel=1e-9)


def test_family_report_states(spark):
    rows = [("F", i % 3, "conservative", "FILLED" if i % 5 else "REJECTED", 0.01 if i % 5 else None, 1.0, 2.0, i) for i in range(40)]
    d = spark.createDataFrame(rows, "family string, fold int, execution_mode string, attempt_status string, net_return double, cost double, turnover double, k int")
    ev = spark.createDataFrame([("F", 0.5, True, True, True, None)], "family string, real_sharpe double, stability_passed boolean, multiple_testing_passed boolean, calibration_passed boolean, auc double")
    ledger = spark.createDataFrame([("F", "v1"), ("F", "v2")], "family string, variant string")
    placebo = spark.createDataFrame([("F", 0.1), ("F", 0.3)], "family string, placebo_sharpe double")
    r = V.family_report(d, ev, placebo, ledger, ["k"]).collect()[0]
    assert r.state == "SHADOW_ONLY" and (r.samples, r.filled, r.unfilled_attempts) == (32, 32, 8)
    few = V.family_report(d.where("k < 30"), ev, placebo, ledger, ["k"]).collect()[0]
    assert few.failures == ["INSUFFICIENT_SAMPLE"] and few.state == "SUPPRESSED"
    none = V.family_report(d, ev, placebo, ledger.limit(0), ["k"]).collect()[0]
    assert none.failures == ["MULTIPLE_TESTING"]
    twice = spark.createDataFrame([("F", "v1"), ("F", "v1")], "family string, variant string")
    with pytest.raises(Exception, match="unique"):
        V.family_report(d, ev, placebo, twice, ["k"]).collect()
    done = V.complete_shadow_period(
        spark.createDataFrame([("SHADOW_ONLY", 10, True), ("SHADOW_ONLY", 70, True)], "state string, sessions_observed int, no_capital boolean"), 60
    )
    assert sorted(x.state for x in done.collect()) == ["ELIGIBLE_FOR_ACCEPTANCE_REVIEW", "SHADOW_ONLY"]


def test_null_slice_has_its_median(spark):
    rows = spark.createDataFrame([(None, 0.1), (None, 0.3), ("a", 0.5)], "regime string, net_return double")
    for bound in (10, None):
        got = {r.regime: (r.trades, r.median_net_return) for r in O.trade_metrics(rows, ["regime"], group_bound=bound).collect()}
        assert got == {None: (2, pytest.approx(0.2)), "a": (1, 0.5)}
