"""Point-in-time joins, quality codes, payloads, tables and streams on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eqpanel.functions.ordered import with_row_number
from eqpanel.operators import ingest as I
from eqpanel.operators import pit as PT
from eqpanel.operators import quality as Q
from eqpanel.plans.flow import publish
from eqpanel.sources import payloads as PL
from eqpanel.sources import tables as TB
from eqpanel.streaming.bars import bars_from_ticks

D1, D2, D3 = dt.date(2026, 9, 14), dt.date(2026, 9, 15), dt.date(2026, 9, 16)
FIELDS = {"symbol": "ticker", "trading_date": "date", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
BAR = (
    "symbol string, trading_date date, open double, high double, low double, close double, volume long, turnover double, adj_close double, provider string, "
    "raw_snapshot_id string, payload_sha256 string, source_reference string, raw_price_unit string, price_semantics string"
)


def bar(spark, *changes):
    base = dict(
        symbol="AAA", trading_date=D1, open=100.0, high=101.0, low=99.0, close=100.0, volume=10, turnover=1000.0, adj_close=100.0, provider="p1",
        raw_snapshot_id="s", payload_sha256="h", source_reference="f", raw_price_unit="unit", price_semantics="raw",
    )
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in (changes or ({},))], BAR)


def codes(findings):
    return sorted(r.code for r in findings.collect())


def test_clean_bar_has_no_findings(spark):
    assert codes(Q.evaluate(bar(spark))) == []
    s = Q.score(Q.evaluate(bar(spark)), ["symbol"], bar(spark)).collect()[0]
    assert (s.dq_score, s.dq_status, s.actionable) == (100, "PASS", True)


def test_every_canonical_code_fires(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    day = "symbol string, trading_date date"
    one = lambda df, **kw: codes(Q.evaluate(df, **kw))
    assert one(bar(spark, {}, {})) == ["DUPLICATE_BAR"]
    assert one(bar(spark), admitted=t([("p2",)], "provider string")) == ["PROVIDER_NOT_ADMITTED"]
    assert one(bar(spark, {"payload_sha256": "unknown"})) == ["LINEAGE_MISSING"]
    assert one(bar(spark, {"raw_price_unit": None})) == ["UNIT_UNKNOWN"]
    assert one(bar(spark, {"price_semantics": "mixed"})) == ["RAW_ADJUSTED_AMBIGUOUS"]
    assert one(bar(spark), unresolved_actions=t([("AAA", D1)], day)) == ["UNRESOLVED_CORPORATE_ACTION"]
    assert one(bar(spark), trading_status=t([("AAA", D1, "halted")], day + ", trading_status string")) == ["TRADING_STATUS_BLOCKED"]
    bands, ref = t([("AAA", 0.07)], "symbol string, band double"), t([("AAA", D1, 100.0)], day + ", reference_price double")
    assert one(bar(spark, {"high": 108.0}), bands=bands, reference_prices=ref) == ["PRICE_BAND_BREACH"]
    assert one(bar(spark), bands=bands, reference_prices=ref) == []
    assert one(bar(spark, {}, {"provider": "p2", "close": 101.0})) == ["PROVIDER_DISAGREEMENT"]
    assert one(bar(spark, {}, {"provider": "p2", "turnover": None})) == ["PROVIDER_DISAGREEMENT"]
    cal = PT.numbered_sessions(t([(D1,), (D2,), (D3,)], "trading_date date"))
    assert one(bar(spark, {}, {"trading_date": D3}), calendar=cal) == ["MISSING_SESSION"]
    assert one(bar(spark), expected_latest=D2) == ["STALE_DATA"]


def test_frame_issues(spark):
    rows = [("A", "not-a-date", 10.0, 9.0, 8.0, 9.0, 1, "p", 0), ("A", "2026-01-02", 1.0, 2.0, 0.0, 1.0, -1, "p", 1), ("A", "2026-01-01", 1.0, 2.0, 1.0, 1.0, 1, "p", 2)]
    d = spark.createDataFrame(rows, "symbol string, trading_date string, open double, high double, low double, close double, volume long, provider string, k long")
    got = {(r.code, r.field): r.occurrences for r in Q.validate_bars(d, ordinal="k").collect()}
    assert got == {("INVALID_DATE", None): 1, ("OHLC_LOGIC", None): 1, ("NEGATIVE_VOLUME", None): 1, ("NONPOSITIVE_PRICE", "low"): 1, ("UNSORTED", None): 1}
    assert codes(Q.validate_bars(d.limit(0))) == ["EMPTY"]
    with pytest.raises(ValueError, match="SCHEMA_MISSING"):
        Q.validate_bars(d.drop("close"))


def test_later_file_row_wins_and_unknown(spark):
    i = spark.createDataFrame(
        [("aaa", "B", "Banks", "T", dt.date(2020, 1, 1), None, "s1", 0), ("AAA", "T", "Tech", "T", dt.date(2026, 9, 15), None, "s2", 1)],
        "symbol string, sector_code string, sector_name string, taxonomy_version string, effective_from date, effective_to date, source_snapshot_id string, file_ordinal long",
    )
    p = spark.createDataFrame([("AAA", D1), ("AAA", D2), ("BBB", D1)], "symbol string, trading_date date")
    got = {(r.symbol, r.trading_date): r.sector for r in PT.sectors_as_of(p, i).collect()}
    assert got == {("AAA", D1): "Banks", ("AAA", D2): "Tech", ("BBB", D1): "UNKNOWN"}
    assert PT.interval_conflicts(i.withColumn("symbol", F.upper("symbol"))).collect()[0].problem == "open-ended interval overlaps a later one"
    asked = p.withColumnRenamed("trading_date", "as_of")
    got = {(r.symbol, r.as_of): r.matches for r in PT.exactly_one(asked, i).collect()}
    assert got == {("AAA", D1): 1, ("AAA", D2): 2, ("BBB", D1): 0}


def test_universe_never_invents_history(spark):
    i = spark.createDataFrame([("IDX", "AAA", D2, None, "r", "s")], "index_code string, symbol string, effective_from date, effective_to date, source string, source_snapshot_id string")
    dates = spark.createDataFrame([(D1,), (D2,)], "as_of date")
    assert [r.as_of for r in PT.universe_as_of(dates, i, "IDX").collect()] == [D2]
    assert [r.as_of for r in PT.uncovered_dates(dates, i, "IDX").collect()] == [D1]
    proxy = PT.universe_as_of(dates, i, "IDX", spark.createDataFrame([("zzz",)], "symbol string")).orderBy("as_of").collect()
    assert [(r.symbol, r.mode) for r in proxy] == [("ZZZ", "CURRENT_UNIVERSE_PROXY"), ("AAA", "STRICT_PIT")]


def payload(spark, *texts):
    return spark.createDataFrame([("p", f"p-{i}", t) for i, t in enumerate(texts)], "provider string, snapshot_id string, payload string")


def test_json_envelopes_and_refusals(spark):
    rec = {"ticker": "aaa", "date": "2026-09-14", "o": 10, "h": 11, "l": 9, "c": 10.5, "v": 100}
    unix = {**rec, "date": 1789344000}
    lacking = {k: v for k, v in rec.items() if k != "c"}
    p = payload(spark, json.dumps([rec]), json.dumps({"items": [unix]}), json.dumps({"data": [rec, lacking]}), json.dumps({"x": 1}), json.dumps([{**rec, "o": "n/a"}]))
    got = PL.json_bars(p, FIELDS, 1000.0).collect()
    assert {(r.symbol, r.trading_date, r.close) for r in got} == {("AAA", D1, 10500.0)} and len(got) == 2
    assert {r.snapshot_id: r.problem for r in PL.refused(p, FIELDS).collect()} == {
        "p-2": "a mapped field is missing", "p-3": "no record list", "p-4": "a number cannot be read"
    }
    with pytest.raises(ValueError):
        PL.json_bars(p, {"symbol": "ticker"})


def test_html_table(spark):
    head = "<tr><th>Ngày</th><th>Mở cửa</th><th>Cao nhất</th><th>Thấp nhất</th><th>Đóng cửa</th><th>KL khớp lệnh</th></tr>"
    row = "<tr><td>14/09/2026</td><td>10</td><td>11</td><td>9</td><td><b>10.5</b></td><td>100</td></tr>"
    good, short = f"<table><thead>{head}</thead><tbody>{row}</tbody></table>", f"<table>{head}<tr><td>1</td></tr></table>"
    d = spark.createDataFrame(
        [("aaa", "ref", good, D1, D3), ("bbb", "ref", short, D1, D3), ("ccc", "ref", "<p>none</p>", D1, D3), ("ddd", "ref", good, D2, D3)],
        "symbol string, provider string, html string, start date, end date",
    )
    [r] = PL.html_bars(d).collect()
    assert (r.symbol, r.trading_date, r.open, r.close, r.volume) == ("AAA", D1, 10000.0, 10500.0, 100)
    assert {r.symbol: r.problem for r in PL.html_problems(d).collect()} == {"bbb": "inconsistent columns", "ccc": "no populated table"}


def test_unpublished_revision_is_invisible(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([("A", 1)], "symbol string, x int")
    TB.stage_revision(d, path, "r1")
    TB.stage_revision(d.withColumn("x", F.lit(2)), path, "r2")
    TB.publish(spark, path, "r1", dt.datetime(2026, 1, 1))
    assert [r.x for r in TB.read_published(spark, path).collect()] == [1]
    TB.publish(spark, path, "r2", dt.datetime(2026, 1, 2))
    assert sorted(r.x for r in TB.read_published(spark, path).collect()) == [1, 2]
    assert [r.x for r in TB.read_published(spark, path, latest_only=True).collect()] == [2]


def test_reingest_adds_nothing(spark):
    b = bar(spark, {}, {"trading_date": D2})
    assert I.new_observations(b, b).count() == 0 and I.duplicate_observations(b, b).count() == 2


def test_blocked_gate_publishes_empty_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    verdict = spark.createDataFrame([("r", False, "SYNC_REPORT_NOT_ACCEPTABLE")], "run_id string, acceptable boolean, block_reason string")
    publish(path, verdict, chosen={"candidates": spark.createDataFrame([("A",)], "symbol string")})
    assert spark.read.json(f"{path}/market").collect()[0].block_reason == "SYNC_REPORT_NOT_ACCEPTABLE"
    assert spark.read.schema("symbol string").option("header", True).csv(f"{path}/candidates").count() == 0


def test_row_number_both_paths(spark):
    d = spark.range(3000).select((F.col("id") % 7 == 0).alias("g"), (F.col("id") * 37 % 3000).alias("x"))
    a = with_row_number(d, ["g"], [F.col("x").desc()], "n").orderBy("x").collect()
    b = with_row_number(d, ["g"], [F.col("x").desc()], "n", 10_000).orderBy("x").collect()
    assert a == b


def test_ticks_to_bars_ties(spark):
    t = dt.datetime(2026, 9, 14, 9)
    d = spark.createDataFrame([("A", t, 2, 20, 1), ("A", t, 1, 10, 1), ("A", t + dt.timedelta(hours=1), 3, 15, 2)], "key string, ts timestamp, seq int, price int, size int")
    r = bars_from_ticks(d).collect()[0]
    assert (r.open, r.high, r.low, r.close, r.volume) == (10, 20, 10, 15, 4)
