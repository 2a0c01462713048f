"""Columns of delivered tables found by header, shape and logic."""

import datetime as dt

import numpy as np
import pytest

from eqpanel.sources import columns as CO

NAMES = ("trading_date", "symbol", "open", "high", "low", "close", "volume")


def _rows(seed=1, symbols=("AAA", "BBB1", "ccc"), n=80):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        level = 20000
        for i in range(n):
            o = level + int(rng.integers(-20, 21))
            c = o + int(rng.integers(-400, 401))
            out.append((f"{dt.date(2020, 1, 1) + dt.timedelta(i):%Y%m%d}", s, o, max(o, c) + int(rng.integers(0, 90)), min(o, c) - int(rng.integers(0, 90)), c, int(rng.integers(10**5, 10**7))))
            level = c
    rng.shuffle(out)
    return [tuple(map(str, r)) for r in out]


def table(spark, rows, names, order=NAMES):
    pick = [NAMES.index(c) for c in order]
    return spark.createDataFrame([tuple(r[i] for i in pick) for r in rows], ", ".join(f"`{n}` string" for n in names))


def found(df):
    rows = df.collect()
    assert len({(r.method, r.accepted, r.problem) for r in rows}) == 1 and len(rows) == 7
    return {r.role: r.column for r in rows}, rows[0].method, rows[0].accepted, rows[0].problem


def test_headers_with_accents_and_case(spark):
    assert CO.plain_header("Đóng cửa") == "dongcua" and CO.plain_header("<Ticker>") == "ticker"
    t = table(spark, _rows(), ["DTYYYYMMDD", "Mã", "Mở cửa", "Cao nhất", "THẤP NHẤT", "Đóng cửa", "Volume"])
    m, method, ok, problem = found(CO.detect_columns(t))
    assert ok and method == "HEADER" and problem is None and m["close"] == "Đóng cửa"
    bars = CO.mapped_bars(t, CO.detect_columns(t))
    r = bars.where("symbol = 'CCC'").orderBy("trading_date").first()
    want = min((x for x in _rows() if x[1] == "ccc"), key=lambda x: x[0])
    assert (r.trading_date, r.open, r.high, r.volume) == (dt.date(2020, 1, 1), float(want[2]), float(want[3]), int(want[6]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shuffled_and_nameless(spark, seed):
    order = list(NAMES)
    np.random.default_rng(seed).shuffle(order)
    names = [f"x.{i}" for i in range(7)]
    m, method, ok, _ = found(CO.detect_columns(table(spark, _rows(seed), names, order)))
    assert ok and method == "SHAPE" and m == {c: names[order.index(c)] for c in NAMES}


def test_swapped_headers_are_not_believed(spark):
    names = ["date", "symbol", "close", "low", "high", "open", "volume"]
    m, method, ok, _ = found(CO.detect_columns(table(spark, _rows(), names)))
    assert ok and method == "SHAPE" and m == dict(zip(NAMES, names))


def test_ambiguous_tables_are_refused(spark):
    rows = _rows()
    doubled = [(*r[:5], r[2], r[6]) for r in rows]
    *_, ok, problem = found(CO.detect_columns(table(spark, doubled, [f"c{i}" for i in range(7)])))
    assert not ok and "close, open" in problem
    two_dates = spark.createDataFrame([(*r, r[0]) for r in rows], ", ".join(f"c{i} string" for i in range(8)))
    assert found(CO.detect_columns(two_dates))[2:] == (False, "2 columns look like trading_date")
    noise = spark.createDataFrame([tuple(map(str, v)) for v in np.random.default_rng(3).normal(size=(50, 7))], ", ".join(f"c{i} string" for i in range(7)))
    df = CO.detect_columns(noise)
    assert found(df)[2:] == (False, "0 columns look like trading_date")
    with pytest.raises(ValueError, match="columns not identified"):
        CO.mapped_bars(noise, df)


def test_broken_bars_and_empty_tables(spark):
    rows = [(*r[:3], r[4], r[3], *r[5:]) if i % 5 == 0 else r for i, r in enumerate(_rows())]
    *_, ok, problem = found(CO.detect_columns(table(spark, rows, NAMES)))
    assert not ok and "high" in problem and "low" in problem
    assert found(CO.detect_columns(table(spark, _rows(), NAMES).limit(0)))[2:] == (False, "0 columns look like trading_date")
    blank = spark.createDataFrame([("", None, " ", "x", "y", "z", None)], ", ".join(f"`{n}` string" for n in NAMES))
    assert not found(CO.detect_columns(blank))[2]


def test_extra_text_columns_and_a_few_gaps_do_no_harm(spark):
    rows = [(*r[:6], None if i % 50 == 0 else r[6], f"note {i}") for i, r in enumerate(_rows())]
    t = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(8)))
    m, _, ok, _ = found(CO.detect_columns(t))
    assert ok and m["volume"] == "c6"


def test_rows_are_sorted_once_for_a_mapping(spark, sf, monkeypatch):
    """Neither for names that other checks refute, nor again for the mapping that the order itself gave."""
    from eqpanel.plans.structure_queries import layouts
    from eqpanel.sources import columns as CO

    passes, real = [], CO._continuity
    monkeypatch.setattr(CO, "_continuity", lambda *a: passes.append(1) or real(*a))
    for name, t in layouts(spark, sf).items():
        passes.clear()
        found = CO.detect_columns(t, ticker=r"^S\d{9}$").collect()
        assert found and len(passes) <= 1, name
