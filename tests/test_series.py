"""Window helpers against pandas on the same rows, and their invariants."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eqpanel.functions.ordered import quantiles, value_positions, with_rank_pct
from eqpanel.functions.series import Smoothing, ewm, rolling_means, rolling_zscore, unique_bars
from eqpanel.operators.features import FEATURE_COLUMNS, add_baseline_features


def random_bars(symbols=3, days=300, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        price = 20000.0
        for i, d in enumerate(pd.bdate_range("2020-01-01", periods=days)):
            opened = price * (1 + rng.normal(0, 0.01))
            price = max(1000.0, opened * (1 + rng.normal(0, 0.02)))
            rows.append((f"S{s}", d.date(), round(opened), round(max(opened, price) + 50), round(min(opened, price) - 50), round(price), int(rng.integers(100, 9999))))
    return pd.DataFrame(rows, columns=["symbol", "trading_date", "open", "high", "low", "close", "volume"])


def by_symbol(pdf, fn):
    pdf = pdf.sort_values(["symbol", "trading_date"])
    return pd.concat([fn(g) for _, g in pdf.groupby("symbol")]).to_numpy()


@pytest.fixture(scope="module")
def panel(spark):
    pdf = random_bars()
    return pdf, spark.createDataFrame(pdf)


def ordered(df, *cols):
    return df.orderBy("symbol", "trading_date").select(*cols).toPandas()


def test_rolling_and_zscore(panel):
    pdf, df = panel
    d = rolling_means(df, [("close", 20, 20, "m"), ("volume", 20, 10, "v")]).withColumn("z", rolling_zscore("volume", 60, 20))
    got = ordered(d, "m", "v", "z")
    np.testing.assert_allclose(got.m, by_symbol(pdf, lambda g: g.close.rolling(20).mean()), rtol=1e-12)
    np.testing.assert_allclose(got.v, by_symbol(pdf, lambda g: g.volume.rolling(20, min_periods=10).mean()), rtol=1e-12)

    def z(g):
        r = g.volume.astype(float).rolling(60, min_periods=20)
        return (g.volume - r.mean()) / r.std(ddof=0)

    np.testing.assert_allclose(got.z, by_symbol(pdf, z), rtol=1e-9)


def test_rolling_mean_of_decimals_and_floats_agree(panel):
    pdf, df = panel
    d = df.withColumns({"dec": F.col("close").cast("decimal(18,6)"), "dbl": F.col("close").cast("double")})
    got = ordered(rolling_means(d, [("dec", 20, 20, "a"), ("dbl", 20, 20, "b")]), "a", "b")
    np.testing.assert_allclose(got.a, got.b, rtol=1e-12)


@pytest.mark.parametrize("block", [4096, 64])
def test_ewm_equals_recursion(panel, block):
    pdf, df = panel
    specs = [("close", 2 / 21, 20, "e20"), ("close", 2 / 201, 200, "e200"), ("volume", 1 / 14, 14, "r14")]
    got = ordered(ewm(df, specs, block=block), "e20", "e200", "r14")
    for name, col, a, n in (("e20", "close", 2 / 21, 20), ("e200", "close", 2 / 201, 200), ("r14", "volume", 1 / 14, 14)):
        want = by_symbol(pdf, lambda g: g[col].ewm(alpha=a, adjust=False, min_periods=n).mean())
        np.testing.assert_allclose(got[name], want, rtol=1e-10)


def test_ewm_stays_finite_on_long_series(spark):
    n = 20000
    x = np.random.default_rng(1).uniform(100, 200, n)
    pdf = pd.DataFrame({"symbol": "A", "trading_date": np.arange(n), "x": x})
    got = ordered(ewm(spark.createDataFrame(pdf), [("x", 1 / 14, 14, "y")]), "y").y
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), rtol=1e-10)


def test_features_against_pandas(panel):
    pdf, df = panel
    got = ordered(add_baseline_features(df), "atr14", "rsi14", "trend_confirmed", "setup_quality")

    def want(g):
        c = g.close.astype(float)
        prev = c.shift(1)
        tr = pd.concat([(g.high - g.low).abs(), (g.high - prev).abs(), (g.low - prev).abs()], axis=1).max(axis=1)
        rma = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        up, down = rma(c.diff().clip(lower=0)), rma((-c.diff()).clip(lower=0))
        return pd.DataFrame({"atr": rma(tr), "rsi": 100 - 100 / (1 + up / down)})

    w = pd.concat([want(g) for _, g in pdf.sort_values(["symbol", "trading_date"]).groupby("symbol")])
    np.testing.assert_allclose(got.atr14, w.atr, rtol=1e-9)
    np.testing.assert_allclose(got.rsi14, w.rsi, rtol=1e-9)


def test_no_look_ahead_and_order_and_partitions(spark, panel):
    pdf, df = panel
    cut = sorted(pdf.trading_date.unique())[250]
    cols = ["symbol", "trading_date", *FEATURE_COLUMNS]
    full = ordered(add_baseline_features(df).where(F.col("trading_date") <= F.lit(cut)), *cols)
    past = ordered(add_baseline_features(df.where(F.col("trading_date") <= F.lit(cut))), *cols)
    pd.testing.assert_frame_equal(full, past)
    mixed = spark.createDataFrame(pdf.sample(frac=1, random_state=3)).repartition(5)
    pd.testing.assert_frame_equal(ordered(add_baseline_features(mixed), *cols), ordered(add_baseline_features(df), *cols))


def test_unique_bars_ignores_input_order(spark):
    rows = [("A", "2020-01-01", 2), ("A", "2020-01-01", 1), ("B", "2020-01-01", 3)]
    a = unique_bars(spark.createDataFrame(rows, "symbol string, trading_date string, close int")).orderBy("symbol").collect()
    b = unique_bars(spark.createDataFrame(rows[::-1], "symbol string, trading_date string, close int")).orderBy("symbol").collect()
    assert a == b and [r.close for r in a] == [1, 3]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value a third of them."""
    rng = np.random.default_rng(5)
    g = np.where(rng.random(6000) < 0.8, "hot", rng.choice(["a", "b", "c"], 6000))
    x = np.where(rng.random(6000) < 0.33, 1.0, rng.normal(0, 1, 6000).round(2))
    x[rng.random(6000) < 0.05] = np.nan
    pdf = pd.DataFrame({"id": np.arange(6000), "g": g, "x": x})
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))


@pytest.mark.parametrize("bound", [None, 10_000])
def test_rank_both_paths(skewed, bound):
    pdf, df = skewed
    got = with_rank_pct(df, ["g"], "x", "r", bound).orderBy("id").toPandas()
    want = pdf.groupby("g").x.rank(method="average", pct=True) * 100
    np.testing.assert_allclose(got.r.astype(float), want, rtol=1e-12)


@pytest.mark.parametrize("bound", [None, 10_000])
def test_quantiles_both_paths(skewed, bound):
    pdf, df = skewed
    got = quantiles(df, ["g"], "x", {"lo": 0.01, "mid": 0.5, "hi": 0.99}, bound).orderBy("g").toPandas()
    want = pdf.groupby("g").x.quantile([0.01, 0.5, 0.99]).unstack()
    np.testing.assert_allclose(got[["lo", "mid", "hi"]], want, rtol=1e-12)


def test_value_positions_cover_every_row(skewed):
    pdf, df = skewed
    p = value_positions(df, ["g"], "x").toPandas()
    assert p.n.sum() == pdf.x.notna().sum()
    assert ((p.before + p.n) <= p.total).all()


def test_blocks_keep_null_keys(spark):
    from eqpanel.functions.ordered import with_rank_pct, with_row_number

    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0), ("a", None)], "k string, v double")
    for bound in (10, None):
        ranks = with_rank_pct(rows, ["k"], "v", "pct", bound).collect()
        assert {(r.k, r.v): r.pct for r in ranks} == {(None, 1.0): 50, (None, 2.0): 100, ("a", 3.0): 100, ("a", None): None}
        numbers = with_row_number(rows, ["k"], [F.col("v").desc()], "rn", bound).collect()
        assert sorted((r.k or "", r.rn) for r in numbers) == [("", 1), ("", 2), ("a", 1), ("a", 2)]


def test_one_block_smooths_as_several_do(spark):
    """Where a bound on the rows leaves one block, the values are the same to the last bit, also behind a gap."""
    rng = random.Random(5)
    rows = [(s, d, None if (s, d) in ((0, 0), (1, 40)) else rng.uniform(1, 9), rng.random() < 0.5) for s in range(3) for d in range(90)]
    df = spark.createDataFrame(rows, "symbol int, trading_date int, x double, fell boolean")
    specs = [("x", 1 / 14, 14, "a"), ("x", 2 / 21, 20, "b", 1)]
    want, got = (sorted(map(tuple, ewm(df, specs, rows=n).collect()), key=str) for n in (None, 90))
    assert got == want and any(r[-1] is not None for r in got)
    flagged = lambda d: sorted((r.symbol, r.trading_date, r.a) for r in d.where("fell").collect())
    own = ewm(df, specs[:1], keys=["symbol", "fell"])
    assert flagged(ewm(df, specs[:1], rows=90, among="fell")) == flagged(own)


def test_a_flag_needs_one_block(spark):
    with pytest.raises(ValueError):
        Smoothing([("x", 1 / 14, 14, "a")], rows=5000, among="fell")


def test_short_series_are_sorted_once(spark, sf):
    from eqpanel.plans import flow as FL
    from eqpanel.sources import derived as D

    bars = D.stored_bars(spark, sf)
    columns = [c for c in FL.TRADED if not c.startswith("rs_")]
    want, got = (FL.features(bars, None, n).select(*columns) for n in (None, D.session_bound(bars)))
    sorts = lambda d: d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [")
    assert sorts(got) == 1 < sorts(want)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
