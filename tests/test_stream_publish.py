"""Streams that publish whole batches, and inputs that are refused one by one."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eqpanel.functions.asof import as_of, as_of_calendar
from eqpanel.operators import ingest as I
from eqpanel.sources import payloads as PL
from eqpanel.sources import tables as TB
from eqpanel.streaming import bars as SB
from eqpanel.streaming import ingest as SI

FIELDS = {"symbol": "t", "trading_date": "d", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "value": "x"}
T0 = dt.datetime(2026, 9, 10)


def record(symbol, day, **over):
    return {"t": symbol, "d": f"2026-09-{day:02}", "o": 10, "h": 12, "l": 9, "c": 11, "v": 100, "x": 5} | over


def landed(spark, *rows):
    """(id, records or text, days after T0)"""
    data = [("p", i, r if isinstance(r, str) else json.dumps(r), T0 + dt.timedelta(d)) for i, r, d in rows]
    return spark.createDataFrame(data, SI.PAYLOAD_SCHEMA)


def bars_of(spark, root):
    return sorted((r.symbol, r.trading_date.day) for r in SI.read_stream_table(spark, root, "bars").collect())


def fates(spark, root):
    return sorted((r.snapshot_id, r.fate) for r in SI.read_stream_table(spark, root, "snapshots").collect())


def test_every_row_is_accounted_for(spark, tmp_path):
    root = str(tmp_path / "r")
    SI.publish_batch(landed(spark, ("a", [record("AAA", 1), record("AAA", 2)], 5), ("a", [record("AAA", 1)], 6), ("b", "not json", 5), ("c", [record("BBB", 1, h=1)], 5)), 0, FIELDS, root)
    SI.publish_batch(landed(spark, ("a", [record("AAA", 9)], 7), ("d", [record("AAA", 2), record("CCC", 3)], 7), ("e", [record("AAA", 4)], -9), ("f", [record("AAA", 5, x="?")], 7)), 1, FIELDS, root)
    assert bars_of(spark, root) == [("AAA", 1), ("AAA", 2), ("CCC", 3)]
    assert fates(spark, root) == [("a", "ACCEPTED"), ("a", "REPEATED"), ("a", "REPEATED"), ("b", "REFUSED"), ("c", "ACCEPTED"), ("d", "ACCEPTED"), ("e", "LATE"), ("f", "REFUSED")]
    held = SI.read_stream_table(spark, root, "held").collect()
    assert [(r.symbol, r.reason) for r in held] == [("BBB", "OHLC_LOGIC")]
    late = SI.read_stream_table(spark, root, "snapshots").where("fate = 'LATE'").first()
    assert json.loads(late.payload)[0]["t"] == "AAA"
    for m in SI.manifest(spark, root).collect():
        assert m.snapshots == m.accepted + m.repeated + m.late + m.refused
        assert m.decoded == m.written + m.held + m.stored
    one = SI.manifest(spark, root).where("batch_id = 1").first()
    assert (one.decoded, one.written, one.stored) == (2, 1, 1)


def test_replay_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    first, second = landed(spark, ("a", [record("AAA", 1)], 0)), landed(spark, ("b", [record("AAA", 2)], 1))
    SI.publish_batch(first, 0, FIELDS, root)
    SI.publish_batch(second, 1, FIELDS, root)
    before = bars_of(spark, root), fates(spark, root), SI.manifest(spark, root).orderBy("batch_id").collect()
    SI.publish_batch(second, 1, FIELDS, root)
    assert (bars_of(spark, root), fates(spark, root), SI.manifest(spark, root).orderBy("batch_id").collect()) == before


def test_failing_batch_leaves_readers_unchanged(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    SI.publish_batch(landed(spark, ("a", [record("AAA", 1)], 0)), 0, FIELDS, root)
    second = landed(spark, ("b", [record("AAA", 2)], 1))
    with monkeypatch.context() as m:
        m.setattr(SI, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            SI.publish_batch(second, 1, FIELDS, root)
    assert bars_of(spark, root) == [("AAA", 1)] and fates(spark, root) == [("a", "ACCEPTED")]
    SI.publish_batch(second, 1, FIELDS, root)
    assert bars_of(spark, root) == [("AAA", 1), ("AAA", 2)]


def test_whole_batch_is_held(spark, tmp_path):
    root = str(tmp_path / "r")
    SI.publish_batch(landed(spark, ("a", [record("AAA", 1)], 0), ("b", [record("BBB", 1, h=1)], 0)), 0, FIELDS, root, hold="batch")
    assert bars_of(spark, root) == [] and SI.read_stream_table(spark, root, "held").count() == 2
    assert not SI.manifest(spark, root).first().published
    SI.publish_batch(landed(spark, ("c", [record("AAA", 1)], 0)), 1, FIELDS, root, hold="batch")
    assert bars_of(spark, root) == [("AAA", 1)]
    with pytest.raises(ValueError):
        SI.publish_batch(landed(spark, ("c", [], 0)), 2, FIELDS, root, hold="half")


def test_empty_batch_and_null_symbol(spark, tmp_path):
    root = str(tmp_path / "r")
    SI.publish_batch(landed(spark).limit(0), 0, FIELDS, root)
    assert bars_of(spark, root) == [] and SI.manifest(spark, root).first().published
    SI.publish_batch(landed(spark, ("a", [record(None, 1, h=1), record("AAA", 1)], 0)), 1, FIELDS, root)
    m = SI.manifest(spark, root).where("batch_id = 1").first()
    assert m.decoded == m.written + m.held + m.stored + 0 and m.held == 1


def test_stream_runs_through(spark, tmp_path):
    base = str(tmp_path)
    landed(spark, ("a", [record("AAA", 1)], 0)).write.parquet(f"{base}/in/1")
    run = lambda: SI.ingest_stream(SI.payload_stream(spark, f"{base}/in/*"), FIELDS, f"{base}/r", f"{base}/state").awaitTermination()
    run()
    landed(spark, ("a", [record("AAA", 1)], 0), ("b", [record("AAA", 2)], 0)).write.parquet(f"{base}/in/2")
    run()
    run()
    assert bars_of(spark, f"{base}/r") == [("AAA", 1), ("AAA", 2)] and SI.manifest(spark, f"{base}/r").count() == 2


def test_tick_stream_keeps_the_last_window(spark, tmp_path):
    base = str(tmp_path)
    rows = [("A", dt.datetime(2026, 9, d, h), d * 100 + h, p, 1) for d, h, p in ((14, 9, 5), (14, 10, 7), (15, 9, 6), (16, 9, 8))]
    d = spark.createDataFrame(rows, "key string, ts timestamp, seq int, price int, size int")
    d.where("seq < 1509").write.parquet(f"{base}/in/1")
    ticks = lambda: spark.readStream.schema(d.schema).parquet(f"{base}/in/*")
    SB.bars_stream(ticks(), f"{base}/out", f"{base}/state", "1 hour").awaitTermination()
    assert [r.high for r in SB.read_bar_stream(spark, f"{base}/out").collect()] == [7]
    d.where("seq >= 1509").write.parquet(f"{base}/in/2")
    SB.bars_stream(ticks(), f"{base}/out", f"{base}/state", "1 hour").awaitTermination()
    key = lambda r: (r.symbol, r.trading_date)
    assert sorted(SB.read_bar_stream(spark, f"{base}/out").collect(), key=key) == sorted(SB.bars_from_ticks(d).collect(), key=key)


def test_long_holiday_run_is_bridged(spark):
    day = dt.date(2026, 1, 1)
    shut = [(day + dt.timedelta(i),) for i in range(120)]
    asked = spark.createDataFrame([(day + dt.timedelta(100),), (day + dt.timedelta(100),), (dt.date(2025, 12, 28),), (dt.date(2026, 5, 4),), (None,)], "as_of date")
    got = {r.as_of: r.expected_session for r in I.expected_session(asked, spark.createDataFrame(shut, "day date")).collect()}
    assert got == {day + dt.timedelta(100): dt.date(2025, 12, 31), dt.date(2025, 12, 28): dt.date(2025, 12, 26), dt.date(2026, 5, 4): dt.date(2026, 5, 4), None: None}
    none = I.expected_session(asked, spark.createDataFrame([], "day date")).where("as_of = date'2025-12-28'").first()
    assert none.expected_session == dt.date(2025, 12, 26)


def test_accepted_data_stays_accepted_at_any_age(spark):
    d = dt.date
    rows = [
        ("ok", d(2026, 9, 14), d(2026, 9, 14), None), ("old", d(2026, 9, 14), d(2026, 1, 2), "outage"), ("gone", d(2026, 9, 14), d(2026, 9, 11), "NO_ADMITTED_PROVIDER"),
        ("none", d(2026, 9, 14), None, "NO_ADMITTED_PROVIDER: nobody"), ("dq", d(2026, 9, 14), None, "DQ failed for AAA"), ("net", d(2026, 9, 14), None, "timed out"),
    ]
    r = spark.createDataFrame(rows, "run_id string, expected_session date, last_accepted_session date, failure_reason string")
    r = r.withColumns({"provider": F.lit("p"), "last_sync_at": F.lit("x"), "dq_status": F.lit("PASS")})
    got = {x.run_id: x for x in I.degraded_state(r).collect()}
    view = {x.run_id: x.state for x in I.status_view(I.degraded_state(r)).collect()}
    assert {k: (x.mode, x.status, x.cache_accepted, x.actionable, x.dq_status, view[k]) for k, x in got.items()} == {
        "ok": ("LIVE", "READY", True, True, "PASS", "FRESH"),
        "old": ("DEGRADED_CACHED_DATA", "CACHE_STALE", True, False, "PASS", "DEGRADED_CACHED_DATA"),
        "gone": ("STALE", "CACHE_STALE", True, False, "PASS", "STALE"),
        "none": ("FAILED", "NO_ADMITTED_PROVIDER", False, False, "NOT_RUN", "NO_ADMITTED_PROVIDER"),
        "dq": ("FAILED", "SYNC_FAILED", False, False, "FAIL", "FAILED"),
        "net": ("FAILED", "SYNC_FAILED", False, False, "NOT_RUN", "FAILED"),
    }
    assert got["gone"].data_age_days == 3 and got["gone"].degraded_mode and got["none"].provider is None


def test_bad_values_refuse_only_their_own(spark, tmp_path):
    p = spark.createDataFrame([("p", "1", json.dumps([record("AAA", 1, x="n/a")])), ("p", "2", json.dumps([record("AAA", 2, x=None)])), ("p", "3", json.dumps([record("AAA", 3, v="1e30")]))], "provider string, snapshot_id string, payload string")
    got = {r.trading_date.day: (r.value, r.volume) for r in PL.json_bars(p, FIELDS).collect()}
    assert got == {2: (None, 100), 3: (5.0, None)}
    assert {r.snapshot_id: r.problem for r in PL.refused(p, FIELDS).collect()} == {"1": "a number cannot be read"}
    head = "<tr><th>Ngày</th><th>Mở cửa</th><th>Cao nhất</th><th>Thấp nhất</th><th>Đóng cửa</th><th>KL khớp lệnh</th></tr>"
    page = lambda *c: f"<table>{head}<tr>{''.join(f'<td>{x}</td>' for x in c)}</tr></table>"
    d = dt.date(2026, 9, 14)
    pages = spark.createDataFrame([("a", "r", page("14/09/2026", 1, 2, 1, "-", 5), d, d), ("b", "r", page("14.9.", 1, 2, 1, 2, 5), d, d), ("c", "r", page("14/09/2026", 1, 2, 1, 2, 5), d, d)], "symbol string, provider string, html string, start date, end date")
    assert [r.symbol for r in PL.html_bars(pages).collect()] == ["C"]
    assert {r.symbol: r.problem for r in PL.html_problems(pages).collect()} == {"a": "a number cannot be read", "b": "a trading date cannot be read"}
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("symbol,Trading_Date,open,high,low,close,volume\nA,2026-09-14,1,2,1,x,5\nB,2026-09-14,1,2,1,2,5\nC,2026-09-14,,2,1,2,5\nD,nope,1,2,1,2,5\n")
    assert sorted(r.symbol for r in TB.csv_bars(spark, path, "p", d, d).collect()) == ["B", "C"]
    assert [(r.symbol, r.column) for r in TB.csv_problems(spark, path, "p", d, d).collect()] == [("A", "close")]


def test_later_row_of_a_split_file_wins(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    with open(path, "w") as f:
        f.write("symbol,sector_code,sector_name,taxonomy_version,effective_from,effective_to,source,source_snapshot_id\n")
        f.writelines(f"A,C{i:05},S{i:05},T,2020-01-01,,s,x\n" for i in range(2000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        d = TB.csv_intervals(spark, path, "sector")
        assert d.rdd.getNumPartitions() > 5
        assert d.agg(F.max_by("sector_code", "file_ordinal")).first()[0] == "C01999"
        assert [r.sector_code for r in d.orderBy("file_ordinal").collect()] == [f"C{i:05}" for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_as_of_ties_nulls_and_repeats(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 5, 2), ("a", None, 3), ("b", 9, 4), (None, 7, 5), ("a", 0, 6)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x", 1), ("a", 5, "y", 2), ("a", 3, "w", 9), (None, 6, "n", 1), ("a", None, "never", 1)], "k string, u int, v string, o int")
    got = sorted((r.id, r.v) for r in as_of(left, right, ["k"], "t", "u", ["v"], ["o"]).collect())
    assert got == [(1, "y"), (2, "y"), (2, "y"), (3, None), (4, None), (5, "n"), (6, None)]
    got = sorted((r.id, r.v) for r in as_of(left, right, ["k"], "t", "u", ["v"], ["o"], strict=True).collect())
    assert got == [(1, "w"), (2, "w"), (2, "w"), (3, None), (4, None), (5, "n"), (6, None)]
    days = right.where("k = 'a' and v <> 'y'").select("u", "v")
    assert sorted((r.id, r.v) for r in as_of_calendar(left, "t", days, "u", ["v"]).collect()) == [(1, "x"), (2, "x"), (2, "x"), (3, None), (4, "x"), (5, "x"), (6, None)]
