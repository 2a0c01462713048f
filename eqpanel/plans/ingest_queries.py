"""Queries for payload decoding, incremental ingest, streams and the daily flow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpoint_dir, checkpointed
from eqpanel.operators import ingest as I
from eqpanel.operators import quality as Q
from eqpanel.plans import flow as FL
from eqpanel.plans import market_queries as M
from eqpanel.plans import signal_queries as SQ
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D
from eqpanel.sources import payloads as PL
from eqpanel.sources import tables as TB
from eqpanel.streaming.bars import bars_from_ticks, bars_stream, read_bar_stream
from eqpanel.streaming import ingest as SI

FIELDS = {"symbol": "ticker", "trading_date": "date", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "value": "val"}


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _bars(spark, sf) -> DataFrame:
    return D.bars(spark, sf, with_sector=False)


def _payloads(spark, sf) -> DataFrame:
    """One JSON payload per symbol and year, in one of the four envelopes.

    A payload holds at most a year of weekly bars. Every third year's dates are unix
    seconds, and a year ending in 9 lacks the close field.
    """
    y = F.year("trading_date")
    day = F.when(y % 3 == 0, F.unix_timestamp(F.col("trading_date").cast("timestamp")).cast("string")).otherwise(F.col("trading_date").cast("string"))
    b = _bars(spark, sf).select(
        "symbol", y.alias("year"),
        F.struct(
            F.col("symbol").alias("ticker"), day.alias("date"), F.col("open").alias("o"), F.col("high").alias("h"),
            F.col("low").alias("l"), F.when(y % 10 != 9, F.col("close")).alias("c"), F.col("volume").alias("v"), F.col("value").alias("val"),
        ).alias("r"),
    )
    g = b.groupBy("symbol", "year").agg(F.collect_list("r").alias("rs"))
    text = (
        F.when(F.col("year") % 4 == 0, F.to_json("rs"))
        .when(F.col("year") % 4 == 1, F.to_json(F.struct(F.col("rs").alias("data"))))
        .when(F.col("year") % 4 == 2, F.to_json(F.struct(F.col("rs").alias("items"))))
        .otherwise(F.to_json(F.struct(F.col("rs").alias("records"))))
    )
    return g.select(
        F.lit("p1").alias("provider"), F.concat_ws("-", F.lit("p1"), "symbol", F.col("year").cast("string")).alias("snapshot_id"),
        text.alias("payload"), "year",
    )


@query("a07_json_bars", "open:2 high:2 low:2 close:2 value:2")
def a07(spark, sf):
    return PL.json_bars(_payloads(spark, sf), FIELDS)


@query("a07_refused_payloads")
def a07r(spark, sf):
    return PL.refused(_payloads(spark, sf), FIELDS)


@query("a08_json_members")
def a08(spark, sf):
    return PL.json_members(_payloads(spark, sf), "ticker")


@query("a09_json_index_bars", "open:2 high:2 low:2 close:2 turnover:2")
def a09(spark, sf):
    d = _payloads(spark, sf)
    # in payloads of even years the value of every 10th session is null
    broken = F.when(F.col("year") % 2 == 0, F.regexp_replace("payload", r'"val":\d*0\b', '"val":null')).otherwise(F.col("payload"))
    return PL.json_index_bars(d.withColumn("payload", broken), FIELDS)


@query("a10_html_bars", "open:2 high:2 low:2 close:2 value:2")
def a10(spark, sf):
    th = F.lit("<tr><th>Ngày</th><th>Mở cửa</th><th>Cao nhất</th><th>Thấp nhất</th><th>Đóng cửa</th><th>KL khớp lệnh</th></tr>")
    td = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    k = lambda c: (F.col(c) / 1000).cast("decimal(18,3)").cast("string")
    row = F.concat(
        F.lit("\n<tr class='r'>"), td(F.date_format("trading_date", "dd/MM/yyyy")), td(k("open")), td(k("high")), td(k("low")), td(k("close")),
        td(F.col("volume").cast("string")), F.lit("</tr>"),
    )
    b = _bars(spark, sf)
    pages = b.groupBy("symbol", F.year("trading_date").alias("y")).agg(F.collect_list(row).alias("rs"))  # a year of weeks
    html = F.concat(F.lit("<html><body><TABLE id='p'><thead>"), th, F.lit("</thead><tbody>"), F.array_join("rs", ""),
                    F.lit("</tbody></TABLE><table><tr><td>other</td></tr></table></body></html>"))
    pages = pages.select(
        "symbol", F.lit("ref").alias("provider"), html.alias("html"), F.make_date("y", F.lit(2), F.lit(1)).alias("start"),
        F.make_date("y", F.lit(11), F.lit(30)).alias("end"),
    )
    return PL.html_bars(pages)


@query("a10_page_problems")
def a10p(spark, sf):
    """The given web pages hold no price table: each is refused with a reason."""
    p = D.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("symbol"), "html")
    return PL.html_problems(p)


@query("a04_csv_bars", "open:2 high:2 low:2 close:2 value:2")
def a04(spark, sf):
    path = scratch(spark, "csv")
    b = _bars(spark, sf)
    TB.write_csv(b.select(*[F.col(c).alias(f" {c.upper()} ") for c in ("symbol", "trading_date", "open", "high", "low", "close", "volume")]), path)
    return TB.csv_bars(spark, path, "csv", "1996-01-01", "1998-12-31")


@query("a05_csv_members")
def a05(spark, sf):
    path = scratch(spark, "members")
    b = _bars(spark, sf)
    TB.write_csv(b.select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol")), path)
    return TB.csv_members(spark, path)


@query("a06_csv_intervals")
def a06(spark, sf):
    path = scratch(spark, "intervals")
    i = D.sector_intervals(spark, sf).withColumn("effective_to", F.coalesce(F.col("effective_to").cast("string"), F.lit("open")))
    TB.write_csv(i.drop("file_ordinal"), path)
    return TB.csv_intervals(spark, path, "sector").drop("file_ordinal")


@query("a11_raw_files")
def a11(spark, sf):
    """Raw evidence of landed files: count per hash check (paths differ by run)."""
    path = scratch(spark, "landed")
    p = _payloads(spark, sf).select("payload", F.col("year").cast("string").alias("y"))
    p.write.partitionBy("y").text(path)
    raw = PL.raw_files(spark, f"{path}/*/*.txt", "p1")
    lines = F.size(F.filter(F.split(F.col("payload").cast("string"), "\n"), lambda x: F.length(x) > 0))
    return raw.agg(
        F.sum(lines).alias("payloads"), F.bool_and(F.sha2("payload", 256) == F.col("payload_sha256")).alias("hashes_match"),
        F.bool_and(F.startswith("snapshot_id", F.lit("p1-"))).alias("ids_match"),
    )


@query("a12_i09_published_revisions")
def a12(spark, sf):
    """Two revisions staged, one published: readers see only that one."""
    path = scratch(spark, "revisions")
    b = _bars(spark, sf).select("symbol", "trading_date", "close")
    half = F.col("trading_date") < "1997-01-01"
    TB.stage_revision(b.where(half), path, "r1")
    TB.stage_revision(b.where(~half), path, "r2")
    stamp = spark.sql("select timestamp'2001-01-01' as t").first()["t"]
    TB.publish(spark, path, "r1", stamp)
    return TB.read_published(spark, path, "symbol string, trading_date date, close bigint, revision string")


@query("a13_a02_append_and_merge")
def a13(spark, sf):
    """Two appends, the second with one more column, read by column name."""
    path = scratch(spark, "append")
    b = _bars(spark, sf).select("symbol", "trading_date", "close", "volume")
    TB.append(b.where("volume % 2 = 0").select("symbol", "trading_date", "close"), path)
    TB.append(b.where("volume % 2 <> 0"), path)
    return TB.read_table(spark, path)


@query("a16_known_evidence")
def a16(spark, sf):
    members = D.universe_intervals(spark, sf).withColumn("source", F.lit("p1")).withColumn(
        "source_snapshot_id", F.concat_ws("-", F.lit("p1"), "symbol", F.lit("1995"))
    )
    good, bad = TB.with_known_evidence(members, _payloads(spark, sf))
    return good.select("symbol", F.lit(True).alias("known")).unionByName(bad.select("symbol", F.lit(False).alias("known")))


@query("a03_sql_over_views")
def a03(spark, sf):
    TB.register_views(spark, {"panel_bars": _bars(spark, sf), "panel_sessions": D.sessions(_bars(spark, sf))})
    return spark.sql(
        "SELECT session_no, count(*) AS bars, sum(volume) AS volume FROM panel_bars JOIN panel_sessions USING (trading_date) GROUP BY session_no"
    )


def _split(spark, sf):
    """Stored bars, and a later delivery that repeats some and brings others."""
    b = _bars(spark, sf)
    return b.where("trading_date < DATE'1998-01-01'"), b.where("trading_date >= DATE'1997-06-01'")


@query("c09_duplicate_observations")
def c09(spark, sf):
    stored, incoming = _split(spark, sf)
    return I.duplicate_observations(incoming, stored).select("symbol", "trading_date", "close")


@query("c10_new_observations")
def c10(spark, sf):
    stored, incoming = _split(spark, sf)
    return I.new_observations(incoming, stored).select("symbol", "trading_date", "close")


@query("i05_new_counts")
def i05(spark, sf):
    stored, incoming = _split(spark, sf)
    return I.new_counts(incoming, stored, ["symbol"])


def _reports(spark, sf) -> DataFrame:
    """One sync report per symbol and year: its last session, accepted or not."""
    b = _bars(spark, sf).groupBy("symbol", F.year("trading_date").alias("y")).agg(F.max("trading_date").alias("session"))
    return b.select(
        F.lit("p1").alias("provider"), F.col("symbol").alias("capability"), "session", ((F.substring("symbol", -2, 2).cast("int") + F.col("y")) % 4 != 0).alias("accepted"),
        F.concat_ws("-", "symbol", F.col("y").cast("string")).alias("run_id"),
    )


@query("i01_watermarks")
def i01(spark, sf):
    return I.latest_watermarks(_reports(spark, sf))


@query("i02_i03_request_ranges")
def i02(spark, sf):
    caps = D.securities(spark, sf).select(
        F.lit("p1").alias("provider"), F.col("symbol").alias("capability"), (F.col("suppkey") % 4).cast("int").alias("recheck_sessions")
    )
    return I.request_ranges(caps, I.latest_watermarks(_reports(spark, sf)), F.lit("2001-10-29").cast("date"))


@query("g06_expected_session")
def g06(spark, sf):
    """With a closed stretch of three months."""
    o = D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    holidays = o.where((F.dayofmonth("as_of") <= 2) & F.month("as_of").isin(1, 9)).select(F.col("as_of").alias("day"))
    shut = spark.range(1).select(F.explode(F.sequence(F.lit("1996-03-04").cast("date"), F.lit("1996-05-31").cast("date"))).alias("day"))
    return I.expected_session(o, holidays.unionByName(shut))


@query("i06_batch_verdict")
def i06(spark, sf):
    from eqpanel.plans.quality_queries import _canonical

    b = _canonical(spark, sf)
    return I.batch_verdict(Q.score(Q.evaluate(b), ["symbol"], population=b))


@query("i10_g17_sync_status")
def i10(spark, sf):
    """Degraded-mode columns and display text for one report per symbol: success, no provider, outage, with and without accepted data."""
    b = _bars(spark, sf)
    newest = b.groupBy("symbol").agg(F.max("trading_date").alias("last"), F.sum("volume").alias("v"))
    expected = newest.agg(F.max("last").alias("expected_session"))
    v = F.col("v")
    r = newest.join(F.broadcast(expected)).select(
        F.col("symbol").alias("run_id"), F.lit("p1").alias("provider"), "expected_session",
        F.when((v % 4 > 1) | (v % 3 != 0), F.col("last")).alias("last_accepted_session"), F.col("last").alias("last_sync_at"), F.lit("PASS").alias("dq_status"),
        F.when(v % 4 == 0, "NO_ADMITTED_PROVIDER").when(v % 4 == 1, "provider timed out").alias("failure_reason"),
    )
    return I.status_view(I.degraded_state(r))


@query("i11_coverage")
def i11(spark, sf):
    return I.coverage(_bars(spark, sf))


def _raw(spark, sf) -> DataFrame:
    """Raw snapshots of the payloads; some hashes, ids and copies are wrong."""
    p = _payloads(spark, sf).withColumn("payload_sha256", F.sha2("payload", 256)).withColumn("source_reference", F.lit("file"))
    y = F.col("year")
    bad = p.withColumns(
        {
            "payload_sha256": F.when(y == 1995, F.lit("0")).otherwise(F.col("payload_sha256")),
            "snapshot_id": F.when(y == 1996, F.concat(F.lit("x"), "snapshot_id")).otherwise(F.col("snapshot_id")),
        }
    )
    copies = F.when(y == 1997, 2).otherwise(1)
    return bad.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


@query("k02_snapshot_integrity")
def k02(spark, sf):
    return I.snapshot_integrity(_raw(spark, sf))


@query("c13_lineage_problems")
def c13(spark, sf):
    raw = _raw(spark, sf)
    b = _bars(spark, sf).select(
        "provider", F.concat_ws("-", F.lit("p1"), "symbol", F.year("trading_date").cast("string")).alias("raw_snapshot_id"),
        F.when(F.year("trading_date") == 1998, "elsewhere").when(F.year("trading_date") == 1999, "unknown").otherwise("file").alias("source_reference"),
    )
    return I.lineage_problems(b, raw, ("source_reference",))


@query("k01_c16_provider_admission")
def k01(spark, sf):
    """Admission evidence, one provider per supplier, with gaps by key."""
    k = F.col("s_suppkey")
    check = F.struct(
        F.lit("daily").alias("check"), (k % 4 != 0).alias("passed"), F.when(k % 5 == 0, " ").otherwise("ref").alias("evidence_reference")
    )
    e = D.table(spark, sf, "supplier").select(
        D.symbol_of(k).alias("provider"), F.when(k % 6 == 0, "QUARANTINED").otherwise("ADMITTED").alias("state"), (k % 7 != 0).alias("enabled"),
        F.array(F.lit("daily_ohlcv"), F.lit("members")).alias("capabilities"),
        F.when(k % 8 == 0, F.create_map(F.lit("members"), F.lit("d"))).otherwise(
            F.create_map(F.lit("members"), F.lit("d"), F.lit("daily_ohlcv"), F.lit("d"))
        ).alias("capability_definitions"),
        F.array(check).alias("validation_results"), F.lit("2000-01-01").cast("date").alias("reviewed_at"),
        F.date_add(F.lit("2000-01-01").cast("date"), (k % 9).cast("int")).alias("next_review_at"),
        F.when(k % 10 == 0, "").otherwise("licence").alias("licence_reference"), F.lit("team").alias("owner"),
    )
    return Q.admitted_providers(e, "daily").withColumn("missing", F.concat_ws(";", "missing"))


@query("h17_review_import")
def h17(spark, sf):
    s = D.securities(spark, sf)
    rows = s.select(F.lower("symbol").alias("symbol"), F.when(F.col("suppkey") % 2 == 0, "idx").otherwise("other").alias("index_code"))
    twice = rows.unionByName(rows)
    return I.import_review(twice, "IDX", "1998-01-01", "review", F.lit("p1-review"))


@query("h18_acceptance_gate")
def h18(spark, sf):
    """The gate over this panel's own lineage, findings and anomalies."""
    b = _bars(spark, sf)
    year = F.year("trading_date").cast("string")
    bars = b.select(
        "symbol", "trading_date", "provider", F.concat(F.lit("p1-"), year).alias("raw_snapshot_id"), F.sha2(year, 256).alias("payload_sha256"),
        F.lit("file").alias("source_reference"), F.lit("r1").alias("canonical_revision"),
    )
    raw = b.select(year.alias("y")).distinct().select(
        F.lit("p1").alias("provider"), F.concat(F.lit("p1-"), "y").alias("snapshot_id"), F.sha2("y", 256).alias("payload_sha256"),
        F.lit("file").alias("source_reference"),
    )
    admitted = b.select("provider").distinct().withColumn("admitted", F.lit(True))
    report = b.agg(
        F.max("trading_date").alias("last_accepted_session"), F.lit("run-1").alias("run_id"), F.lit("p1").alias("provider_id"),
        F.lit(0).alias("data_age_days"), F.lit("r1").alias("canonical_revision"),
        F.array(F.lit("daily_ohlcv"), F.lit("current_index_members")).alias("required_capabilities"), F.lit("PASS").alias("dq_status"),
        F.lit("STRICT_PIT").alias("universe_status"), F.lit(True).alias("actionable"), F.lit(True).alias("cache_accepted"),
        F.lit(100).alias("dq_score"),
    )
    expected = F.lit(b.agg(F.max("trading_date")).first()[0])  # one value
    anomalies = b.where("close < 0").select("symbol", F.lit("UNRESOLVED").alias("resolution_status"))
    from eqpanel.plans.quality_queries import _canonical

    return I.acceptance_gate(report, bars, raw, admitted, Q.provider_disagreements(_canonical(spark, sf)), anomalies, expected)


def _flow(spark, sf):
    bound = D.symbol_bound(spark, sf)
    bars = D.stored_bars(spark, sf)
    a = FL.analyse(bars, M._index_bars(spark, sf, bars), M.INDEX_PRIORITY, bound, columns=FL.TRADED, sessions_bound=D.session_bound(bars))
    scaled = a["features"].withColumn("adv_shares", F.col("adv_shares") * 1000)  # fixture volumes are small
    a["features"] = scaled
    return a, FL.recommend(a, SQ._accounts(spark, sf), F.lit(65), F.lit(True), bound)


@query("h19_daily_flow", "breadth_pct_ma50 turnover_ratio:8")
def h19(spark, sf):
    a, r = _flow(spark, sf)
    return FL.market_summary(a, r["approved"])


@query("c07_h19_approved_candidates", "score confidence entry_price:2 risk_stop:2 estimated_loss:2 notional:2")
def c07(spark, sf):
    _, r = _flow(spark, sf)
    return r["approved"].select(
        "account", "trading_date", "priority", "symbol", "family", "score", "confidence", "entry_price", "risk_stop", "status", "quantity",
        "estimated_loss", "notional", "binding_constraint",
    )


def _ticks(spark, sf) -> DataFrame:
    return D.table(spark, sf, "events").select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        D.cents(F.col("value")).alias("price"), F.lit(1).cast("long").alias("size"),
    )


@query("i13_bars_from_ticks")
def i13(spark, sf):
    return bars_from_ticks(_ticks(spark, sf))


@query("i13_bars_from_tick_stream")
def i13s(spark, sf):
    """The same bars from a stream, the last window included."""
    events = D.table(spark, sf, "events").schema
    s = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(sf)
    ticks = s.select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        D.cents(F.col("value")).alias("price"), F.lit(1).cast("long").alias("size"),
    )
    out = scratch(spark, "stream")
    bars_stream(ticks, f"{out}/bars", f"{out}/state", "1 hour").awaitTermination()
    return read_bar_stream(spark, f"{out}/bars")


def _streamed(spark, sf) -> str:
    """Payload files through the ingest stream, the second delivery partly repeated; returns the root of its tables.

    Of the first delivery every fifth symbol's 1995 has a low above its high; the
    second repeats 1996 and 1997 under the same ids, and under new ones, and
    brings 1998 of every seventh symbol a month too late.
    """
    base = scratch(spark, "ingest")
    p = _payloads(spark, sf)
    number = F.substring("symbol", 2, 9).cast("long")
    broken = F.when((F.col("year") == 1995) & (number % 5 == 0), F.regexp_replace("payload", '"l":[0-9]+', '"l":9999999')).otherwise(F.col("payload"))
    p = p.withColumns({"symbol": F.split("snapshot_id", "-")[1]}).withColumn("payload", broken)
    p = p.withColumn("ingested_at", F.when((F.col("year") == 1998) & (number % 7 == 0), F.lit("2001-10-01")).otherwise(F.lit("2001-11-01")).cast("timestamp"))
    cols = ["provider", "snapshot_id", "payload", "ingested_at"]
    p = checkpointed(p)
    p.where("year < 1998").select(*cols).write.parquet(f"{base}/landed/a")
    run = lambda: SI.ingest_stream(SI.payload_stream(spark, f"{base}/landed/*"), FIELDS, f"{base}/tables", f"{base}/state").awaitTermination()
    run()
    late = p.where("year >= 1996").select(*cols)
    again = p.where("year IN (1996, 1997)").withColumn("snapshot_id", F.concat("snapshot_id", F.lit("-again"))).select(*cols)
    late.unionByName(again).write.parquet(f"{base}/landed/b")
    run()
    return f"{base}/tables"


@query("i12_streamed_ingest", "open:2 high:2 low:2 close:2 value:2")
def i12(spark, sf):
    return SI.read_stream_table(spark, _streamed(spark, sf), "bars")


@query("i12_held_rows", "open:2 high:2 low:2 close:2 value:2")
def i12h(spark, sf):
    """Bars a blocking finding of their symbol keeps back."""
    return SI.read_stream_table(spark, _streamed(spark, sf), "held")


@query("i12_snapshot_fates")
def i12f(spark, sf):
    """What became of each landed snapshot, with the payload's presence where it is kept."""
    d = SI.read_stream_table(spark, _streamed(spark, sf), "snapshots")
    return d.select("snapshot_id", "fate", "problem", F.col("payload").isNotNull().alias("kept"))


@query("i07_published_batches")
def i07(spark, sf):
    """The manifest: every landed row and every decoded bar is accounted for."""
    return SI.manifest(spark, _streamed(spark, sf)).drop("newest")
