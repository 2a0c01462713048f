"""Pivots without look-ahead, the volume profile, normalised values, state powers and drift."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from eqpanel.operators import normalise as N
from eqpanel.operators import profiles as PR
from eqpanel.operators import structure as ST

DAY = dt.date(2020, 1, 1)
BAR = "symbol string, trading_date date, open long, high long, low long, close long, volume long, atr14 double"


def _bars(spark, n=150, symbols=4, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        level = 1000
        for i in range(n):
            o = level + int(rng.integers(-8, 9))
            c = o + int(rng.integers(-12, 13))
            hi, lo = max(o, c) + int(rng.integers(0, 6)), min(o, c) - int(rng.integers(0, 6))
            rows.append((f"S{s}", DAY + dt.timedelta(i), o, hi, lo, c, int(rng.integers(1, 100)), 15.0))
            level = c
    return rows, spark.createDataFrame(rows, BAR)


def test_pivots_by_plain_loop(spark):
    rows, df = _bars(spark)
    got = {(r.symbol, r.trading_date): r for r in ST.confirmed_pivots(df).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    seen = 0
    for bars in by.values():
        last = None
        for i, r in enumerate(bars):
            p = i - 3
            h = None
            if p >= 3 and all(bars[k][3] < bars[p][3] for k in range(p - 3, p)) and all(bars[k][3] <= bars[p][3] for k in range(p + 1, i + 1)):
                h = bars[p][3]
            last = h if h is not None else last
            g = got[r[0], r[1]]
            assert (g.pivot_high, g.swing_high) == (h, last)
            seen += h is not None
    assert seen > 20


def test_structure_does_not_change_when_later_bars_are_cut(spark):
    rows, df = _bars(spark)
    whole = {(r.symbol, r.trading_date): r for r in ST.market_structure(df).collect()}
    flags = ("bos_up", "bos_down", "sweep_low", "sweep_high", "fvg_up", "fvg_down", "spring", "upthrust", "sign_of_strength")
    for end in (30, 71, 112):
        for r in ST.market_structure(df.where(F.col("trading_date") <= DAY + dt.timedelta(end))).collect():
            assert r == whole[r.symbol, r.trading_date]
    counts = {f: sum(r[f] for r in whole.values()) for f in flags}
    assert all(counts[f] for f in flags if f not in ("spring", "upthrust")), counts
    assert sum(r.order_block_low is not None for r in whole.values()) > 0


def test_spring_needs_a_range_and_closes_that_hold(spark):
    """A dip below the swing low that closes back counts two bars later, unless a close falls through."""
    def panel(name, after):
        closes = [100, 104, 100, 96, 100, 104, 100, 96, 100, 104] * 7 + [100, 97, 99]
        rows = [(name, DAY + dt.timedelta(i), c, c + 1, c - 1, c, 10, 8.0) for i, c in enumerate(closes)]
        # quiet bars, then one pierces the low of the range
        rows += [(name, DAY + dt.timedelta(len(rows) + k), 99, 100, 98, 99, 10, 8.0) for k in range(12)]
        t = len(rows)
        rows.append((name, DAY + dt.timedelta(t), 99, 100, 90, 99, 10, 8.0))
        rows += [(name, DAY + dt.timedelta(t + 1 + k), c, c + 1, c - 1, c, 10, 8.0) for k, c in enumerate(after)]
        return rows, t

    good, t = panel("G", [99, 99, 99])
    bad, _ = panel("B", [90, 99, 99])
    got = {(r.symbol, (r.trading_date - DAY).days): r for r in ST.market_structure(spark.createDataFrame(good + bad, BAR)).collect()}
    assert got["G", t].sweep_low and got["G", t].range_state and not got["G", t].spring and got["G", t + 2].spring
    assert got["B", t].sweep_low and not got["B", t + 2].spring


def test_structure_of_empty_and_short_series(spark):
    rows, df = _bars(spark, n=5, symbols=1)
    assert [r.pivot_high for r in ST.market_structure(df).collect()] == [None] * 5
    assert ST.market_structure(df.where("false")).count() == 0


def _plain_profile(points, bins=24, percent=70):
    lo, hi = min(t for t, _ in points), max(t for t, _ in points)
    v = [0] * bins
    for t, n in points:
        v[0 if hi == lo else min(bins - 1, (t - lo) * bins // (hi - lo))] += n
    total, p = sum(v), v.index(max(v))
    a = z = p
    while sum(v[a : z + 1]) * 100 < total * percent:
        if z < bins - 1 and (a == 0 or v[z + 1] >= v[a - 1]):
            z += 1
        else:
            a -= 1
    edge = lambda k: (lo + k * (hi - lo) / bins) / 3
    return len(points), total, edge(p), edge(a), edge(z + 1), sum(v[a : z + 1]) / total


def test_volume_profile_by_plain_loop(spark):
    rows, df = _bars(spark, symbols=6, seed=9)
    flat = [("F", DAY + dt.timedelta(i), 9, 9, 9, 9, 5, 1.0) for i in range(3)] + [("F", DAY, None, None, None, 9, 5, 1.0), (None, DAY, 9, 12, 6, 9, 5, 1.0)]
    nothing = [("Z", DAY, 9, 9, 9, 9, 0, 1.0)]
    df = df.unionByName(spark.createDataFrame(flat + nothing, BAR))
    got = {r.symbol: r for r in ST.volume_profile(df, ["symbol"]).collect()}
    assert "Z" not in got and got[None].rows == 1 and got["F"].rows == 3 and got["F"].poc_low == got["F"].value_area_high == 9.0
    for s in {r[0] for r in rows}:
        want = _plain_profile([(r[3] + r[4] + r[5], r[6]) for r in rows if r[0] == s])
        g = got[s]
        assert (g.rows, g.volume) == want[:2]
        assert (g.poc_low, g.value_area_low, g.value_area_high, g.value_area_share) == pytest.approx(want[2:])
    every = ST.volume_profile(df.where("symbol like 'S%'"), []).first()
    assert every.volume == sum(r[6] for r in rows) and every.label == ST.PROFILE_LABEL


def test_profile_score(spark):
    d = spark.createDataFrame([(5.0, 50.0), (7.0, 50.0), (9.0, 100.0), (None, 50.0), (9.0, None)], "close double, liquidity_percentile double")
    d = d.withColumns({"value_area_low": F.lit(6.0), "value_area_high": F.lit(8.0)})
    assert [r.vp_score for r in ST.profile_score(d).collect()] == [0.0, 0.25, 1.0, None, None]


def test_trailing_rank_with_ties_and_gaps():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 400).astype(float)
    x[rng.random(400) < 0.1] = np.nan
    got = N.trailing_rank(x, 50, 20)
    for i in range(400):
        w = x[max(0, i - 49) : i + 1]
        w = w[~np.isnan(w)]
        if np.isnan(x[i]) or len(w) < 20:
            assert np.isnan(got[i])
        else:
            assert got[i] == pytest.approx(((w < x[i]).sum() + ((w == x[i]).sum() + 1) / 2) / len(w) * 100)
    assert len(N.trailing_rank(np.array([]), 50, 20)) == 0


def test_rolling_percentiles_keep_nulls(spark):
    rows = [("a", DAY + dt.timedelta(i), float(i % 4) if i % 5 else None) for i in range(20)]
    d = spark.createDataFrame(rows, "symbol string, trading_date date, x double")
    got = {r.trading_date: r.x_percentile_8 for r in N.rolling_percentiles(d, ["x"], 8, 3).collect()}
    assert got[DAY] is None and got[DAY + dt.timedelta(10)] is None and len(got) == 20
    assert got[DAY + dt.timedelta(3)] == pytest.approx(100 * 3 / 3)


@pytest.mark.parametrize("bound", [None, 1000])
def test_normal_scores_both_paths(spark, bound):
    rng = np.random.default_rng(4)
    rows = [(k, float(round(v, 1)) if rng.random() > 0.1 else None) for k in ("a", "b", None) for v in rng.standard_t(2, 120)] + [("one", 3.0), ("none", None)]
    d = spark.createDataFrame(rows, "k string, x double")
    got = N.normal_scores(d, ["k"], "x", "z", group_bound=bound).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None, "one", "none"):
        x = np.array([v for g, v in rows if g == k and v is not None])
        if not len(x):
            assert [r.z for r in got if r.k == k] == [None]
            continue
        held = np.clip(x, *np.percentile(x, [1, 99]))
        want = {v: NormalDist().inv_cdf(((held < h).sum() + ((held == h).sum() + 1) / 2 - 0.5) / len(x)) for v, h in zip(x, held)}
        for r in got:
            if r.k == k:
                assert r.z is None if r.x is None else r.z == pytest.approx(want[r.x], abs=1e-12)


def test_h_step_is_five_plain_products(spark):
    one = spark.createDataFrame(
        [("s", "UP", 0.7, 0.1, 0.2), ("s", "DOWN", 0.2, 0.5, 0.3), ("s", "SIDE", 0.25, 0.25, 0.5), ("t", "UP", 0.9, 0.05, 0.05)],
        "symbol string, state string, p_up double, p_down double, p_side double",
    )
    got = {(r.symbol, r.state): (r.p_up, r.p_down, r.p_side) for r in PR.h_step_transitions(one, 5).collect()}
    p = np.array([[0.7, 0.1, 0.2], [0.2, 0.5, 0.3], [0.25, 0.25, 0.5]])
    q = np.array([[0.9, 0.05, 0.05], [1 / 3] * 3, [1 / 3] * 3])
    for s, m in (("s", p), ("t", q)):
        want = m @ m @ m @ m @ m
        for i, state in enumerate(("UP", "DOWN", "SIDE")):
            assert got[s, state] == pytest.approx(tuple(want[i])) and sum(got[s, state]) == pytest.approx(1)
    assert {(r.symbol, r.state): r.p_up for r in PR.h_step_transitions(one, 1).collect()}["s", "UP"] == 0.7


def test_transition_floor_is_kept(spark):
    rows = [("a", DAY + dt.timedelta(i), 1000 + i) for i in range(399)] + [("b", DAY + dt.timedelta(i), 1000 + i) for i in range(400)]
    d = spark.createDataFrame(rows, "symbol string, trading_date date, close long")
    assert {r.symbol for r in PR.trend_transitions(d).collect()} == {"b"}  # 199 and 200 transitions


def test_drift_against_first_period(spark):
    rng = np.random.default_rng(6)
    rows = [("f", p, float(v)) for p, m in ((1, 0.0), (2, 0.0), (3, 1.0)) for v in rng.normal(m, 1, 500)] + [("f", 2, None), ("g", 5, 1.0)]
    got = {(r.f, r.period): r for r in PR.drift(spark.createDataFrame(rows, "f string, p int, x double"), ["f"], "x", "p").collect()}
    x = {p: np.array([v for f, q, v in rows if f == "f" and q == p and v is not None]) for p in (1, 2, 3)}
    cuts = np.percentile(x[1], range(10, 100, 10))
    share = lambda v: (np.bincount(np.searchsorted(cuts, v, "left"), minlength=10) + 0.5) / (len(v) + 5)
    for p in (1, 2, 3):
        want = float(((share(x[p]) - share(x[1])) * np.log(share(x[p]) / share(x[1]))).sum())
        assert got["f", p].drift == pytest.approx(want, abs=1e-12) and got["f", p].rows == len(x[p])
    assert not got["f", 2].drifted and got["f", 3].drifted and got["g", 5].drift == 0


def test_rolling_ic_interval(spark):
    rng = np.random.default_rng(8)
    ic = rng.normal(0.05, 0.1, 40)
    d = spark.createDataFrame([("f", DAY + dt.timedelta(i), float(v)) for i, v in enumerate(ic)], "factor string, trading_date date, rank_ic double")
    got = {r.trading_date: r for r in PR.rolling_ic(d, ["factor"], size=30, least=20).collect()}
    r, w = got[DAY + dt.timedelta(39)], ic[10:40]
    half = 1.959963984540054 * w.std(ddof=1) / math.sqrt(30)
    assert (r.mean_ic, r.ic_low, r.ic_high) == pytest.approx((w.mean(), w.mean() - half, w.mean() + half))
    assert got[DAY + dt.timedelta(18)].mean_ic is None and got[DAY + dt.timedelta(19)].mean_ic is not None
