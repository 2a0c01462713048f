"""Queries for point-in-time joins and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.operators import pit as PT
from eqpanel.operators import quality as Q
from eqpanel.plans.registry import query
from eqpanel.sources import derived as D


def _bars(spark, sf) -> DataFrame:
    return D.bars(spark, sf, with_sector=False)


def _dates(spark, sf) -> DataFrame:
    return D.sessions(_bars(spark, sf)).select(F.col("trading_date").alias("as_of"))


@query("c03_sector_from_master")
def c03(spark, sf):
    s = D.securities(spark, sf)
    master = s.select("symbol", "sector", F.lit(1).alias("file_ordinal")).unionByName(
        s.where(F.col("suppkey") > 20).select("symbol", F.col("later_sector").alias("sector"), F.lit(2).alias("file_ordinal"))
    )
    return PT.sectors_from_master(_bars(spark, sf), master).select("symbol", "trading_date", "sector")


@query("c04_sector_as_of")
def c04(spark, sf):
    return PT.sectors_as_of(_bars(spark, sf), D.sector_intervals(spark, sf)).select(
        "symbol", "trading_date", *PT.SECTOR_FIELDS
    )


@query("c05_universe_as_of")
def c05(spark, sf):
    current = D.securities(spark, sf).select("symbol")
    return PT.universe_as_of(_dates(spark, sf), D.universe_intervals(spark, sf), "IDX", current, D.symbol_bound(spark, sf))


@query("c05_universe_summary")
def c05s(spark, sf):
    return PT.universe_summary(c05(spark, sf))


@query("c05_uncovered_dates")
def c05u(spark, sf):
    return PT.uncovered_dates(_dates(spark, sf), D.universe_intervals(spark, sf), "IDX")


@query("c06_exactly_one_class")
def c06(spark, sf):
    asked = _bars(spark, sf).select("symbol", F.col("trading_date").alias("as_of"))
    return PT.exactly_one(asked, D.sector_intervals(spark, sf))


@query("c11_missing_sessions")
def c11(spark, sf):
    b = _bars(spark, sf)
    return PT.missing_sessions(b, D.sessions(b))


@query("c14_add_sessions")
def c14(spark, sf):
    b = _bars(spark, sf)
    cal = D.sessions(b)
    d = PT.add_sessions(b.select("symbol", "trading_date"), "trading_date", cal, 2, "sellable_date")
    return PT.add_sessions(d, "trading_date", cal, 3, "policy_exit_date")


@query("e17_interval_conflicts")
def e17(spark, sf):
    i = D.sector_intervals(spark, sf)
    early = F.when(F.col("file_ordinal") == 2, F.date_sub("effective_from", F.col("symbol").substr(-1, 1).cast("int")))
    return PT.interval_conflicts(i.withColumn("effective_from", F.coalesce(early, F.col("effective_from"))))


def _canonical(spark, sf) -> DataFrame:
    """Bars of two providers with lineage columns; some rows lack parts of them."""
    b = _bars(spark, sf)
    cal = D.sessions(b)
    both = b.unionByName(D.second_provider(b, cal))
    d = both.join(F.broadcast(cal), "trading_date")  # bounded by the calendar
    n = F.col("session_no")
    return d.select(
        "symbol", "trading_date", "open", "high", "low", "close", "volume", F.col("value").alias("turnover"),
        F.col("close").alias("adj_close"), "provider", "session_no",
        F.concat(F.col("provider"), F.lit("-"), F.year("trading_date").cast("string")).alias("raw_snapshot_id"),
        F.when(n % 97 == 0, "unknown").otherwise(F.sha2(F.concat("provider", F.year("trading_date").cast("string")), 256)).alias("payload_sha256"),
        F.lit("file").alias("source_reference"),
        F.when(n % 89 == 0, "UNKNOWN").otherwise("unit").alias("raw_price_unit"),
        F.when(n % 83 == 0, "mixed").otherwise("raw").alias("price_semantics"),
    )


def _doubled(d: DataFrame) -> DataFrame:
    """Every row of each 101st session occurs twice."""
    copies = F.when(F.col("session_no") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("copy", F.explode(copies))


@query("h16_quality_findings")
def h16(spark, sf):
    return Q.evaluate(*_inputs(spark, sf)[0], **_inputs(spark, sf)[1])


def _inputs(spark, sf):
    b = _bars(spark, sf)
    cal = D.sessions(b)
    bars = _doubled(_canonical(spark, sf))
    s = D.securities(spark, sf)
    prev = b.select("symbol", "trading_date", F.col("open").alias("reference_price"))
    last = cal.agg(F.max("trading_date").alias("d"))
    status = b.select(
        "symbol", "trading_date", F.when(F.col("volume") % 41 == 0, "suspended").otherwise("Normal").alias("trading_status")
    )
    return (bars,), dict(
        calendar=cal,
        expected_latest=F.lit(last.first()["d"]),  # one value
        admitted=bars.select("provider").where("provider = 'p1'").distinct(),
        bands=s.select("symbol", F.when(F.col("sector") == "ASIA", 0.07).otherwise(0.10).alias("band")),
        reference_prices=prev, trading_status=status,
        unresolved_actions=b.where(F.col("volume") % 53 == 0).select("symbol", "trading_date"),
    )


@query("d12_quality_score_by_symbol")
def d12(spark, sf):
    args, kw = _inputs(spark, sf)
    return Q.score(Q.evaluate(*args, **kw), ["symbol"], population=args[0])


@query("d12_clean_scores")
def d12c(spark, sf):
    """Scores of one year's single-provider bars: most are clean or only warned."""
    b = _canonical(spark, sf)
    return Q.score(Q.evaluate(b), ["symbol", "trading_date"], population=b)


@query("d18_provider_disagreement")
def d18(spark, sf):
    return Q.provider_disagreements(_canonical(spark, sf))


@query("d19_latest_bar")
def d19(spark, sf):
    return _bars(spark, sf).groupBy("symbol").agg(F.max("trading_date").alias("latest"))


@query("e16_duplicate_keys")
def e16(spark, sf):
    return Q.duplicate_bars(_doubled(_canonical(spark, sf)))


@query("d20_frame_issues")
def d20(spark, sf):
    b = _bars(spark, sf)
    d = _doubled(b.join(F.broadcast(D.sessions(b)), "trading_date"))
    n = F.col("session_no")
    bad = d.select(
        "symbol", F.when(n % 109 == 0, "not-a-date").otherwise(F.col("trading_date").cast("string")).alias("trading_date"),
        "open", F.when(n % 103 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(n % 127 == 0, 0).otherwise(F.col("low")).alias("low"), "close",
        F.when(n % 107 == 0, -1).otherwise(F.col("volume")).alias("volume"), "provider",
        (n * 2 + F.col("copy") + F.when(n % 113 == 0, 5).otherwise(0)).alias("ordinal"),
    )
    return Q.validate_bars(bad, ["symbol"], "ordinal")


@query("h08_dq_policy", "confidence:4")
def h08(spark, sf):
    """Confidence capped by each symbol's own score."""
    from eqpanel.operators.signals import apply_dq_policy

    s = Q.score(Q.evaluate(_canonical(spark, sf)), ["symbol", "trading_date"]).select("symbol", "trading_date", "dq_score")
    d = _bars(spark, sf).join(s, ["symbol", "trading_date"], "left").withColumn("dq_score", F.coalesce("dq_score", F.lit(100)))
    confidence, ok = apply_dq_policy((F.col("volume") % 100).cast("double"), F.col("dq_score"))
    return d.select("symbol", "trading_date", "dq_score", confidence.alias("confidence"), ok.alias("actionable"))
