"""Queries for entry gates, exit order, publication, evidence of findings and gaps in membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.functions import rules as RU
from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.series import rolling_means, series_window
from eqpanel.operators import market as MK
from eqpanel.operators import outcomes as O
from eqpanel.operators import pit as PT
from eqpanel.operators import policy as PO
from eqpanel.operators import profiles as PR
from eqpanel.operators import quality as Q
from eqpanel.operators import relative_strength as RS
from eqpanel.operators import research as R
from eqpanel.plans import market_queries as M
from eqpanel.plans import profile_queries as PQ
from eqpanel.plans import quality_queries as QQ
from eqpanel.plans import signal_queries as SQ
from eqpanel.plans.registry import query
from eqpanel.plans.research_queries import _trades
from eqpanel.sources import derived as D
from eqpanel.sources import payloads as PL


def _family():
    return F.when(F.col("signal_pullback"), "PULLBACK").when(F.col("signal_reversal"), "REVERSAL").when(F.col("trend_confirmed"), "MOMENTUM")


@query("l09_volume_score", "volume_score:8")
def l09(spark, sf):
    f = M._features(spark, sf).withColumn("family", _family())
    return f.select("symbol", "trading_date", "family", PO.volume_score(F.col("family"), F.col("volume_z60")).alias("volume_score"))


def _gate_rows(spark, sf) -> DataFrame:
    """Every bar with what the gates say that need no rank, and its ranks."""
    from eqpanel.plans import flow as FL

    bound = D.symbol_bound(spark, sf)
    bars = D.stored_bars(spark, sf)
    regimes = FL.market(bars, M._index_bars(spark, sf, bars), M.INDEX_PRIORITY, bound)["regimes"]
    kinds = PQ._kinds(bars, bound)
    f = FL.features(bars, bound, D.session_bound(bars))
    f = rolling_means(f.withColumn("sessions", F.row_number().over(series_window())), [("value", 20, 20, "adv20")])
    f = f.join(kinds, "symbol").join(F.broadcast(regimes.select("trading_date", "regime_level")), "trading_date")  # one row per session
    v = F.col("volume")
    f = f.select(
        "symbol", "trading_date", "sector", "close", "regime_level", F.lit(True).alias("member"), "sessions", "adv20", (v % 47 == 0).alias("flagged"), "archetype",
        (v % 100).cast("double").alias("risk_proxy"), F.lit(100).alias("dq_score"), F.when(v % 53 != 0, v % 29 != 0).alias("exogenous_ok"),
        _family().alias("family"), "volume_z60",
        (F.col("setup_quality") * 100).alias("score"), F.lit(0.5).alias("win_probability"), (v % 40).alias("sample"), "r_unit", "atr14", "risk_reward",
        "risk_stop", "exit_stop", "entry_price", (F.col("close") * 1.07).alias("ceiling"),
    )
    # of the panel only what the gates say and the returns are shuffled, once, and nothing of it is written
    f = PO.known_gates(f, adv_floor=2e6, least_sessions=130).select("symbol", "trading_date", "sector", "close", "archetype", *PO.KNOWN)
    f = RS.add_cross_sectional_rs(f, symbols_bound=bound, carried=True)
    return f.withColumns({"long_rank": F.col("rs_stock_market_rank_126"), "short_rank": F.col("rs_stock_market_rank_20")})


@query("l10_gate_chain")
def l10g(spark, sf):
    """The full chain: rows stopped at each gate, per archetype."""
    d = PO.ranked_gate(_gate_rows(spark, sf))
    return d.groupBy("archetype", "gate").agg(F.count(F.lit(1)).alias("rows"))


@query("l17_extended_metrics", "cagr:8 max_drawdown:8 calmar:8 information_ratio:6")
def l17x(spark, sf):
    r = PR.with_returns(D.bars(spark, sf))
    d = r.groupBy("sector", "trading_date").agg(F.avg("r").alias("ret"))
    return R.extended_metrics(d, r.select("trading_date", F.col("m").alias("bench")).distinct(), ["sector"])


@query("l17_score_deciles", "hit_rate:8 mean_outcome:8")
def l17d(spark, sf):
    return R.score_deciles(_trades(spark, sf, "setup_quality"), "setup_quality")


@query("l27_exit_reasons")
def l27(spark, sf):
    """Every bar as a position entered 20 sessions ago under its price plan."""
    w = series_window()
    p = SQ._plan(spark, sf).select("symbol", "trading_date", "close", "volume", "entry_price", "exit_stop", "target_1", "r_unit")
    at = lambda c: F.lag(c, 20).over(w)
    d = p.withColumns({f"_{c}": at(c) for c in ("entry_price", "exit_stop", "target_1", "r_unit", "volume")})
    v = F.col("volume")
    row = {
        "risk_proxy": (v % 80), "risk_at_entry": F.col("_volume") % 80, "close": F.col("close"), "exit_stop": F.col("_exit_stop"),
        "regime": F.when(v % 31 == 0, "PANIC_BEAR").otherwise("RANGE"), "target_1": F.col("_target_1"), "sold_before": v % 3 == 0,
        "trailing_stop": F.col("_entry_price") * 0.99, "held": F.lit(20), "hold_max": F.lit(20), "profit_r": (F.col("close") - F.col("_entry_price")) / F.col("_r_unit"),
        "thesis_broken": v % 2 == 0,
    }
    d = d.withColumn("x", PO.exit_decision(row)).where("_exit_stop IS NOT NULL")
    return d.select("symbol", "trading_date", F.col("x.reason").alias("reason"), F.col("x.action").alias("action"), F.col("x.urgent").alias("urgent"))


@query("l28_published_fractions", "notional_nav:8 estimated_loss_nav:8")
def l28(spark, sf):
    """Decisions of every account without amounts."""
    return _published(spark, sf, SQ.h03(spark, sf))


def _published(spark, sf, decisions: DataFrame) -> DataFrame:
    d = decisions.join(F.broadcast(SQ._accounts(spark, sf).select("account", "equity")), "account")  # a handful of segments
    return PO.nav_fractions(d, "equity", ["notional", "estimated_loss"], ["account", "trading_date", "symbol", "status"])


@query("l28_privacy_scan")
def l28s(spark, sf):
    """The same before and after: what a scan of both finds."""
    decisions = SQ.h03(spark, sf).select("account", "trading_date", "symbol", "status", "quantity", "notional", "estimated_loss")
    decisions = checkpointed(decisions)  # scanned before and after
    d, after = decisions.drop("trading_date"), _published(spark, sf, decisions)
    parts = [PO.privacy_problems(x).select(F.lit(n).alias("table"), "column", "problem") for n, x in (("before", d), ("after", after))]
    return parts[0].unionByName(parts[1])


@query("h05_verified_index", "close:4")
def h05v(spark, sf):
    """Index bars whose hash one stored snapshot of their year supports; some snapshots are doubled, some differ."""
    b = D.official_index(D.bars(spark, sf, with_sector=False), "IDXA").select("index_code", "trading_date", "close", F.year("trading_date").alias("y"))
    sha = F.sha2(F.col("y").cast("string"), 256)
    b = b.withColumns({"provider": F.lit("p"), "raw_snapshot_id": F.concat(F.lit("p-"), "y"), "payload_sha256": sha, "source_reference": F.lit("file")})
    years = b.select("provider", F.col("raw_snapshot_id").alias("snapshot_id"), "y", "payload_sha256", "source_reference").distinct()
    raw = years.withColumn("payload_sha256", F.when(F.col("y") % 4 == 0, "other").otherwise(F.col("payload_sha256"))).unionByName(years.where("y % 4 = 1")).drop("y")
    return MK.verified_index_bars(b, raw).select("index_code", "trading_date", "close")


@query("h16_finding_evidence")
def h16e(spark, sf):
    bars = QQ._canonical(spark, sf).withColumn("canonical_revision", F.concat(F.lit("r"), F.year("trading_date").cast("string")))
    return Q.with_evidence(Q.evaluate(bars), bars).drop("message").withColumn("snapshot_ids", F.concat_ws(",", "snapshot_ids"))


def _late_members(spark, sf) -> DataFrame:
    return D.universe_intervals(spark, sf).where("effective_to IS NOT NULL")


@query("c05_universe_with_gaps")
def c05g(spark, sf):
    """Only members that left again: dates before and after are answered by proxy."""
    return PT.universe_as_of(QQ._dates(spark, sf), _late_members(spark, sf), "IDX", D.securities(spark, sf).select("symbol"), D.symbol_bound(spark, sf))


@query("c05_uncovered_with_gaps")
def c05h(spark, sf):
    return PT.uncovered_dates(QQ._dates(spark, sf), _late_members(spark, sf), "IDX")


@query("l11_session_classes_by_master")
def l11m(spark, sf):
    """Securities with and without bars, some without a listing date, some halted."""
    b = D.bars(spark, sf, with_sector=False)
    n = F.substring("symbol", 2, 9).cast("long")
    known = b.groupBy("symbol").agg(F.min("trading_date").alias("d")).select("symbol", F.when(n % 6 != 0, F.col("d")).alias("listed_on"))
    new = D.table(spark, sf, "nation").select(
        F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("symbol"), F.when(F.col("n_nationkey") % 3 != 0, F.lit("1998-01-05")).cast("date").alias("listed_on")
    )
    halted = b.where("volume % 19 = 0").select("symbol", F.date_add("trading_date", 7).alias("trading_date")).distinct()
    return Q.session_classes(b, D.sessions(b), known.unionByName(new), halted)


@query("l16_triple_barrier_filled")
def l16f(spark, sf):
    """Only entries that were filled are labelled by a barrier."""
    keys = ["symbol", "trading_date"]
    p = SQ._plan(spark, sf).select(*keys, "high", "low", "exit_stop", "target_1")
    a = O.label_entries(D.bars(spark, sf, with_sector=False)).select(*keys, (F.col("attempt_status") == "FILLED").alias("filled"))
    return PR.triple_barrier(p.join(a, keys))


@query("l08_archetypes_with_overrides")
def l08o(spark, sf):
    """Every seventh security belongs to a group that a sector explains."""
    stats = PR.profiles(D.bars(spark, sf, with_sector=False))
    n = F.substring("symbol", 2, 9).cast("long")
    groups = stats.select("symbol").where(n % 7 == 0).select("symbol", F.lit("BANK").alias("override"), F.lit("banking sector").alias("override_reason"))
    return PR.archetypes(stats, 5e6, 9e6, groups).withColumn("tags", F.concat_ws(",", "tags"))


@query("l08_archetype_stability", "stability:8")
def l08s(spark, sf):
    """Year on year, as the panel is weekly."""
    b = D.bars(spark, sf, with_sector=False).withColumn("year", F.year("trading_date"))
    by = ["symbol", "year"]
    return PR.archetype_stability(PR.archetypes(PR.profiles(b, by=by), 2e6, 4e6, by=by), "year")


@query("g11_venue_bands", "floor_price:2 ceiling_price:2")
def g11(spark, sf):
    """Floor and ceiling under the band of each security's venue; an unknown venue has none."""
    n, c = F.substring("symbol", 2, 9).cast("long") % 4, F.col("close").cast("double")
    venue = F.element_at(F.array(F.lit("HOSE"), F.lit(" hnx"), F.lit("UPCOM"), F.lit("OTC")), (n + 1).cast("int"))
    d = D.bars(spark, sf, with_sector=False).withColumn("band", RU.venue_band(venue))
    return d.select("symbol", "trading_date", RU.floor_price(c, F.col("band")).alias("floor_price"), RU.ceiling_price(c, F.col("band")).alias("ceiling_price"))


@query("g04_g14_snapshot_ids")
def g04(spark, sf):
    """Ids of snapshots by payload and request; the order of the request's fields does not matter."""
    d = D.bars(spark, sf, with_sector=False).select("symbol", F.year("trading_date").cast("string").alias("year")).distinct()
    payload, year, symbol = F.concat("symbol", F.lit(":"), "year"), (F.lit("year"), F.col("year")), (F.lit("symbol"), F.col("symbol"))
    ids = [PL.snapshot_id(F.lit("p1"), payload, F.create_map(*a, *b)) for a, b in ((year, symbol), (symbol, year))]
    return d.select("symbol", "year", ids[0].alias("snapshot_id"), (ids[0] == ids[1]).alias("order_free"))


@query("f05_largest_moves", "r:8")
def f05(spark, sf):
    """A report of ten rows: the largest moves of the panel."""
    d = PR.with_returns(D.bars(spark, sf, with_sector=False)).where("r IS NOT NULL")
    return d.orderBy(F.abs("r").desc(), "symbol", "trading_date").limit(10).select("symbol", "trading_date", "r")
