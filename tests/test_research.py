"""Deflated Sharpe, block bootstrap, the directional model and its gate, drift, h-step transitions."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from eqpanel.functions.normal import normal_cdf, normal_quantile
from eqpanel.operators import research as R
from eqpanel.operators import validation as V

N = NormalDist()
DAY = dt.date(2020, 1, 1)


def test_normal_both_ways(spark):
    xs = [-40.0, -9.0, -7.1, -3.0, -0.2, 0.0, 0.7, 2.5, 6.0, 12.0]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", normal_cdf("x").alias("p")).collect()
    for r in got:
        assert r.p is None if r.x is None else r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-15, rel=1e-7)
    ps = [1e-200, 1e-15, 1e-6, 0.03, 0.074, 0.076, 0.5, 0.9, 0.999999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0, None]], "p double").select("p", normal_quantile("p").alias("x")).collect()
    for r in got:
        assert r.x == pytest.approx(N.inv_cdf(r.p), rel=1e-13, abs=1e-15) if r.p and 0 < r.p < 1 else r.x is None


def test_deflated_sharpe_figures(spark):
    """27.0 % for one declared trial falls to 0.4 % for 24; more trials never help."""
    n, skew, kurt = 61, 0.4, 4.0
    rows = [(n, t, skew, kurt) for t in (0, 1, 24, 500)]
    d = spark.createDataFrame(rows, "n long, trials long, skewness double, kurtosis double").withColumns({"sharpe": F.lit(-0.0806), "v": F.lit(0.0184)})
    got = {r.trials: r for r in R.deflated_sharpe(d, variance="v").collect()}
    assert got[0].deflated_sharpe is None
    assert round(got[1].deflated_sharpe, 3) == 0.27 and round(got[24].deflated_sharpe, 3) == 0.004
    assert got[1].deflated_sharpe > got[24].deflated_sharpe > got[500].deflated_sharpe
    for t in (24, 500):
        top = (1 - R.GAMMA) * N.inv_cdf(1 - 1 / t) + R.GAMMA * N.inv_cdf(1 - 1 / (t * math.e))
        z = (-0.0806 - math.sqrt(0.0184) * top) * math.sqrt(n - 1) / math.sqrt(1 + skew * 0.0806 + (kurt - 1) / 4 * 0.0806**2)
        assert got[t].deflated_sharpe == pytest.approx(N.cdf(z), rel=1e-9)


def test_sharpe_moments_of_thin_groups(spark):
    d = spark.createDataFrame([("a", 0.1), ("a", None), ("b", 0.2), ("b", 0.2), ("c", 0.1), ("c", -0.1), ("c", 0.3), ("c", 0.0)], "g string, ret double")
    got = {r.g: r for r in R.deflated_sharpe(R.sharpe_moments(d, ["g"]).withColumn("trials", F.lit(5).cast("long"))).collect()}
    assert got["a"].sharpe is None and got["b"].sharpe is None and got["a"].deflated_sharpe is None
    x = np.array([0.1, -0.1, 0.3, 0.0])
    assert got["c"].sharpe == pytest.approx(x.mean() / x.std(ddof=1)) and got["c"].skewness == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3)
    assert got["c"].kurtosis == pytest.approx(((x - x.mean()) ** 4).mean() / x.std() ** 4)


def test_block_bootstrap_against_plain_draws(spark):
    rng = np.random.default_rng(3)
    days = [DAY + dt.timedelta(i) for i in range(23)]
    rows = [("g" if rng.random() < 0.7 else None, days[rng.integers(0, 23)], float(r)) for r in rng.normal(0.01, 0.05, 90)] + [("g", days[0], None)]
    trades = spark.createDataFrame(rows, "k string, trading_date date, net_return double")
    cal = spark.createDataFrame([(d,) for d in days], "trading_date date")
    got = {r.k: r for r in R.block_bootstrap(trades, cal, ["k"], size=4, replicates=40).collect()}
    import hashlib

    blocks = 6
    draw = lambda r, k: int(hashlib.sha256(f"blocks:{r}:{k}".encode()).hexdigest()[:8], 16) % blocks
    own = [(d, r) for k, d, r in rows if k == "g" and r is not None]
    means, rates = [], []
    for rep in range(1, 41):
        drawn = [r for k in range(1, blocks + 1) for d, r in own if (d - DAY).days // 4 == draw(rep, k)]
        means.append(np.mean(drawn)), rates.append(np.mean(np.array(drawn) > 0))
    g = got["g"]
    assert g.n == len(own) and g.replicates == 40
    assert (g.expectancy_low, g.expectancy_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    assert (g.hit_rate_low, g.hit_rate_high) == pytest.approx(tuple(np.percentile(rates, [2.5, 97.5])))
    x = np.array([r for _, r in own])
    assert g.effective_sample == pytest.approx(min(len(x), x.var(ddof=1) / np.var(means, ddof=1)))
    assert g.trades_needed == math.ceil((N.inv_cdf(0.975) + N.inv_cdf(0.8)) ** 2 * x.var(ddof=1) / x.mean() ** 2)


def test_bootstrap_widens_with_clustered_days(spark):
    """Ten equal trades of a day carry the information of one."""
    rng = np.random.default_rng(5)
    rows = [(DAY + dt.timedelta(i), float(v)) for i, v in enumerate(rng.normal(0, 0.05, 60)) for _ in range(10)]
    t = spark.createDataFrame(rows, "trading_date date, net_return double")
    r = R.block_bootstrap(t, t.select("trading_date"), [], size=1, replicates=300).first()
    assert r.n == 600 and 35 < r.effective_sample < 100


def test_auc_with_ties_and_gaps(spark):
    rows = [(0.2, 0), (0.2, 1), (0.5, 1), (0.1, 0), (0.5, 0), (0.9, 1), (None, 1), (0.3, None)]
    pairs = [(a, b) for a, y in rows if y == 1 and a is not None for b, z in rows if z == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    d = spark.createDataFrame(rows, "s double, y int")
    r = R.auc(d, [], "s", "y").first()
    assert (r.rows, r.positives) == (6, 3) and r.auc == pytest.approx(want)
    assert R.auc(d.where("y = 1"), [], "s", "y").first().auc is None


def _panel(spark, signal: float):
    """40 symbols, 120 sessions; the label follows ``x`` as strongly as ``signal`` says."""
    rng = np.random.default_rng(11)
    rows = []
    for s in range(40):
        for i in range(120):
            x, z = rng.normal(size=2)
            y = int(rng.random() < 1 / (1 + math.exp(-signal * x)))
            rows.append((f"S{s:02}", DAY + dt.timedelta(i), float(x), None if (s, i) == (0, 60) else float(z), y if i < 118 else None))
    return spark.createDataFrame(rows, "symbol string, trading_date date, x double, z double, label int")


def _folds(spark, panel):
    days = panel.select("trading_date")
    return V.fold_dates(days, V.purged_folds(days, 2, 30, 20, buffer=8))


def test_direction_gate_opens_on_signal_and_shuts_on_noise(spark):
    panel = _panel(spark, 1.5)
    scored = R.directional_scores(panel, _folds(spark, panel), ["x", "z"])
    rows = scored.collect()
    verdict = R.directional_verdict(scored)
    v = verdict.first()
    assert v.state == "SHOWN" and v.auc > 0.7
    assert len(rows) == len({(r.symbol, r.trading_date) for r in rows}) and ("S00", DAY + dt.timedelta(60)) not in {(r.symbol, r.trading_date) for r in rows}
    # against a plain Newton fit of the first fold: standardised inputs, penalty 0.01
    data = [r for r in panel.collect() if r.z is not None]
    first = min(r.fold for r in rows)
    start = min(r.trading_date for r in rows if r.fold == first)
    train = [r for r in data if (start - r.trading_date).days > 10 and r.label is not None]
    x = np.array([[r.x, r.z] for r in train])
    y = np.array([r.label for r in train], float)
    sd = x.std(axis=0, ddof=1)
    a = np.c_[np.ones(len(x)), x / sd]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (p - y) / len(y) + 0.01 * np.r_[0, w[1:]]
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a / len(y) + 0.01 * np.diag([0, 1, 1]), grad)
    at = {(r.symbol, r.trading_date): r for r in data}
    for r in rows[:200]:
        if r.fold == first:
            q = at[r.symbol, r.trading_date]
            assert r.raw == pytest.approx(1 / (1 + math.exp(-(w[0] + w[1] * q.x / sd[0] + w[2] * q.z / sd[1]))), abs=1e-5)
            assert r.probability == r.raw
    pos, neg = [r.probability for r in rows if r.label == 1], [r.probability for r in rows if r.label == 0]
    plain = np.mean([(a > np.array(neg)).mean() + (a == np.array(neg)).mean() / 2 for a in pos])
    assert v.auc == pytest.approx(plain)
    # the sigmoid of later folds keeps frequencies near the probabilities
    late = [r for r in rows if r.fold > first and r.label is not None and r.probability > 0.7]
    assert abs(np.mean([r.label for r in late]) - np.mean([r.probability for r in late])) < 0.06
    assert R.gated_probabilities(scored, verdict).where("probability IS NULL").count() == 0

    noise = _panel(spark, 0.0)
    scored = R.directional_scores(noise, _folds(spark, noise), ["x", "z"])
    verdict = R.directional_verdict(scored)
    assert verdict.first().state == "SUPPRESSED" and verdict.first().auc < 0.52
    assert R.gated_probabilities(scored, verdict).where("probability IS NOT NULL").count() == 0


def test_direction_without_folds_or_outcomes(spark):
    panel = _panel(spark, 1.0)
    none = R.directional_scores(panel, _folds(spark, panel).where("fold < 0"), ["x"])
    assert none.count() == 0 and R.directional_verdict(none).first().state == "SUPPRESSED"
    flat = panel.withColumn("label", F.lit(1))
    assert R.directional_scores(flat, _folds(spark, flat), ["x"]).count() == 0


def test_training_never_meets_the_label_window(spark):
    panel = _panel(spark, 1.0)
    d = {}
    for r in _folds(spark, panel).collect():
        d.setdefault((r.fold, r.role), []).append(r.trading_date)
    for fold, role in list(d):
        if role == "test":
            assert (min(d[fold, "test"]) - max(d[fold, "train"])).days > 10
