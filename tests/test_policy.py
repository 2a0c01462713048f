"""Gates, exits, publication, and the findings on nulls, bands and gaps that were mended."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.series import ewm
from eqpanel.operators import policy as PO
from eqpanel.operators import profiles as PR
from eqpanel.operators import quality as Q
from eqpanel.operators import research as R
from eqpanel.operators import risk as RK
from eqpanel.operators import validation as V

DAY = dt.date(2026, 9, 14)


def test_volume_score_flips_with_the_setup(spark):
    d = spark.createDataFrame([("PULLBACK", 0.5), ("PULLBACK", 2.5), ("MOMENTUM", 0.5), ("MOMENTUM", 2.5), ("REVERSAL", 1.5), (None, 1.0), ("PULLBACK", None)], "f string, z double")
    got = [r.s for r in d.select(PO.volume_score(F.col("f"), F.col("z")).alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, 0.5, None, None]


GOOD = dict(
    regime_level=4, member=True, sessions=300, adv20=10.0, flagged=False, archetype="LARGE_CAP", risk_proxy=10.0, dq_score=100, exogenous_ok=True, long_rank=80.0, short_rank=30.0,
    family="PULLBACK", volume_z60=0.0, score=70.0, win_probability=0.6, sample=50, r_unit=10.0, atr14=10.0, risk_reward=2.0, risk_stop=80.0, exit_stop=85.0, entry_price=100.0, ceiling=107.0,
)


def gates(spark, *changes):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in GOOD.items())
    d = spark.createDataFrame([(i, *(GOOD | c).values()) for i, c in enumerate(changes)], f"i int, {schema}")
    return [r.gate for r in PO.gate_chain(d, adv_floor=5.0).orderBy("i").collect()]


def test_first_failing_gate_is_named_and_unknown_fails(spark):
    assert gates(spark, {}) == ["PASSED"]
    failing = [
        ({"regime_level": 0, "adv20": 1.0}, "GATE0_REGIME"), ({"adv20": 1.0, "risk_proxy": 90.0}, "GATE1_ELIGIBILITY"), ({"archetype": "EXCLUDED"}, "GATE1_ELIGIBILITY"),
        ({"flagged": None}, "GATE1_ELIGIBILITY"), ({"risk_proxy": None}, "GATE2_RISK"), ({"dq_score": 49}, "GATE2_RISK"), ({"archetype": "SPECULATIVE", "regime_level": 3}, "GATE3_ARCHETYPE_REGIME"),
        ({"archetype": "UNHEARD"}, "GATE3_ARCHETYPE_REGIME"), ({"exogenous_ok": None}, "GATE3_ARCHETYPE_REGIME"), ({"short_rank": 70.0}, "GATE4A_DUAL_CONDITION"),
        ({"family": None}, "GATE4B_SETUP"), ({"volume_z60": 2.5}, "GATE4B_SETUP"), ({"win_probability": 0.5}, "GATE5_GEOMETRY"), ({"risk_reward": None}, "GATE5_GEOMETRY"),
        ({"exit_stop": 79.0}, "GATE5_GEOMETRY"), ({"ceiling": 100.2}, "GATE5_GEOMETRY"),
    ]
    assert gates(spark, *[c for c, _ in failing]) == [g for _, g in failing]
    # momentum wants a high short rank and loud volume; few trades leave the probability out
    assert gates(spark, {"family": "MOMENTUM", "short_rank": 70.0, "volume_z60": 2.0}, {"family": "MOMENTUM"}, {"sample": 10, "win_probability": None}) == ["PASSED", "GATE4A_DUAL_CONDITION", "PASSED"]


def test_exit_rules_in_order(spark):
    base = dict(risk_proxy=10, risk_at_entry=10, close=100.0, exit_stop=90.0, regime="RANGE", target_1=120.0, sold_before=False, trailing_stop=95.0, held=5, hold_max=20, profit_r=1.0, thesis_broken=False)
    cases = [
        ({}, None), ({"risk_proxy": 75, "close": 80.0}, "P1_ANOMALY"), ({"risk_proxy": 35}, "P1_ANOMALY"), ({"close": 90.0}, "P2_EXIT_STOP"), ({"regime": "PANIC_BEAR", "close": 130.0}, "P3_REGIME"),
        ({"close": 120.0, "thesis_broken": True}, "P4_TARGET"), ({"close": 120.0, "sold_before": True}, None), ({"close": 94.0}, None), ({"close": 94.0, "sold_before": True}, "P5_TRAILING"),
        ({"held": 20, "profit_r": 0.4}, "P6_TIME"), ({"held": 20, "profit_r": 0.5, "thesis_broken": True}, "P7_THESIS"), ({"risk_proxy": None, "close": 90.0}, "P2_EXIT_STOP"),
    ]
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    d = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items()))
    got = [r.x for r in d.select("i", PO.exit_decision({k: F.col(k) for k in base}).alias("x")).orderBy("i").collect()]
    assert [x and x.reason for x in got] == [w for _, w in cases]
    assert got[5].action == "SELL_HALF" and not got[5].urgent and got[3].urgent


def test_published_tables_hold_no_amounts(spark):
    d = spark.createDataFrame([("a", 1e6, 250000, 40.0), ("b", 0.0, 10, 1.0), ("c", None, 10, 1.0)], "symbol string, equity double, notional long, loss double")
    out = PO.nav_fractions(d, "equity", ["notional", "loss"], ["symbol"])
    assert [tuple(r) for r in out.orderBy("symbol").collect()] == [("a", 0.25, 4e-05), ("b", None, None), ("c", None, None)]
    assert PO.privacy_problems(out).count() == 0
    found = {(r.column, r.problem) for r in PO.privacy_problems(d).collect()}
    assert found == {("equity", "names capital"), ("notional", "names capital"), ("equity", "holds amounts"), ("notional", "holds amounts")}
    assert PO.privacy_problems(d.select("symbol")).count() == 0


def test_null_key_parts_keep_their_reservations(spark):
    """Rows of a session without a date reserve capital like any other, on both paths."""
    n = 30
    c = spark.createDataFrame(
        [("acc", d, i + 1, f"S{i}", "X", f"G{i}", 20000.0, 19000.0, 1e6, "STRONG_BULL") for d in (None, DAY) for i in range(n)],
        "account string, trading_date date, priority long, symbol string, sector string, correlated_group string, entry_price double, risk_stop double, adv_shares double, regime string",
    )
    ctx = spark.createDataFrame([("acc", 1e9, 1e9, 1e9, 0.001, 0.001, 0.0)], "account string, equity double, cash double, max_loss double, buy_rate double, sell_rate double, fixed_cost double")
    ctx = ctx.withColumn("positions", F.array().cast(f"array<{RK.POSITION}>"))
    out = {}
    for bound in (100, P.MAX_FOLD_GROUP + 1):
        rows = RK.approve(c, ctx, ["account", "trading_date"], ["account"], bound).collect()
        out[bound] = sorted((str(r.trading_date), r.priority, r.status, r.quantity) for r in rows)
        per = {d: [x[1:] for x in out[bound] if x[0] == d] for d in ("None", str(DAY))}
        assert per["None"] == per[str(DAY)] and 0 < sum(x[1] != "REJECTED" for x in per["None"]) <= P.MAX_POSITIONS
    assert out[100] == out[P.MAX_FOLD_GROUP + 1]


def _canonical(spark, rows):
    d = spark.createDataFrame(rows, "symbol string, trading_date date, open double, high double, low double, close double, volume long, provider string, raw_snapshot_id string")
    return d.withColumns({c: F.lit(v) for c, v in {"payload_sha256": "x", "source_reference": "f", "raw_price_unit": "u", "price_semantics": "raw"}.items()})


def test_bar_on_its_ceiling_is_no_breach(spark):
    """20,000 plus 15 % is 23,000 exactly; in doubles the limit would be a hair lower."""
    rows = [("A", DAY, 20.0, 0.23, 0.2, 0.21, 1, "p", "s"), ("B", DAY, 20.0, 0.230001, 0.2, 0.21, 1, "p", "s"), ("C", DAY, 20.0, 0.2, 0.17, 0.2, 1, "p", "s")]
    ref = spark.createDataFrame([(s, DAY, 0.2) for s in "ABC"], "symbol string, trading_date date, reference_price double")
    bands = spark.createDataFrame([(s, 0.15) for s in "ABC"], "symbol string, band double")
    found = Q.evaluate(_canonical(spark, rows), bands=bands, reference_prices=ref).where("code = 'PRICE_BAND_BREACH'")
    assert [r.symbol for r in found.collect()] == ["B"]
    exact = ref.withColumn("reference_price", F.lit(Decimal("0.2")))
    assert Q.evaluate(_canonical(spark, rows), bands=bands, reference_prices=exact).where("code = 'PRICE_BAND_BREACH'").count() == 1


def test_findings_carry_their_snapshots(spark):
    bars = _canonical(spark, [("A", DAY, 1.0, 2.0, 1.0, 1.0, 1, p, f"{p}-1") for p in ("p", "q")] + [("B", DAY, 1.0, 2.0, 1.0, 1.0, 1, "p", None)])
    bars = bars.withColumn("close", F.when(F.col("provider") == "q", 1.5).otherwise(F.col("close"))).withColumn("canonical_revision", F.lit("r1"))
    got = {r.code: r for r in Q.with_evidence(Q.evaluate(bars), bars).collect()}
    assert got["PROVIDER_DISAGREEMENT"].snapshot_ids == ["p-1", "q-1"] and got["LINEAGE_MISSING"].snapshot_ids == []
    assert {r.canonical_revision for r in got.values()} == {"r1"}
    again = {r.code: r.result_id for r in Q.with_evidence(Q.evaluate(bars), bars).collect()}
    assert again == {k: r.result_id for k, r in got.items()}


def test_no_smoothed_value_after_a_gap(spark):
    rows = [("a", i, float(i)) for i in range(8)] + [("b", i, None if i == 4 else float(i)) for i in range(8)] + [("c", i, None if i < 2 else float(i)) for i in range(8)]
    d = spark.createDataFrame(rows, "symbol string, trading_date int, x double")
    got = {}
    for r in ewm(d, [("x", 0.5, 1, "y")]).collect():
        got.setdefault(r.symbol, {})[r.trading_date] = r.y
    assert all(got["a"][i] is not None for i in range(8)) and [i for i in range(8) if got["b"][i] is not None] == [0, 1, 2, 3]
    assert got["b"][3] == got["a"][3] and all(v is None for v in got["c"].values())
    led = {(r.symbol, r.trading_date): r.y for r in ewm(d.where("symbol = 'c'"), [("x", 0.5, 1, "y", 2)]).collect()}
    assert led["c", 2] == 2.0 and led["c", 3] == pytest.approx(2.5)


def test_deciles_and_ratios(spark):
    rows = [(float(i // 2), 0.01 * (i - 5)) for i in range(40)] + [(None, 1.0), (3.0, None)]
    got = {r.decile: r for r in R.score_deciles(spark.createDataFrame(rows, "score double, net_return double"), "score").collect()}
    assert sorted(got) == list(range(1, 11)) and all(r.trades == 4 for r in got.values()) and got[1].hit_rate == 0.0 and got[10].hit_rate == 1.0
    d = spark.createDataFrame([("g", DAY + dt.timedelta(i), v) for i, v in enumerate((0.1, -0.5, 0.2))] + [("up", DAY, 0.1), ("up", DAY + dt.timedelta(1), 0.2)], "g string, trading_date date, ret double")
    bench = spark.createDataFrame([(DAY + dt.timedelta(i), 0.0) for i in range(3)], "trading_date date, bench double")
    r = {x.g: x for x in R.extended_metrics(d, bench, ["g"]).collect()}
    assert r["g"].max_drawdown == pytest.approx(-0.5) and r["g"].calmar == pytest.approx(r["g"].cagr / 0.5)
    assert r["up"].calmar is None and r["up"].information_ratio == pytest.approx(0.15 / 0.0707106781 * 250**0.5)
    assert V.max_drawdown(d, ["g"], ["trading_date"], "ret").count() == 2


def test_silent_and_unknown_securities(spark):
    days = [DAY + dt.timedelta(i) for i in range(3)]
    bars = spark.createDataFrame([("A", days[1], 5), ("U", days[0], 0)], "symbol string, trading_date date, volume long")
    cal = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "trading_date date, session_no int")
    master = spark.createDataFrame([("A", days[1]), ("S", days[2]), ("N", None)], "symbol string, listed_on date")
    halted = spark.createDataFrame([("S", days[2])], "symbol string, trading_date date")
    got = {(r.symbol, (r.trading_date - DAY).days): r.session_status for r in Q.session_classes(bars, cal, master, halted).collect()}
    want = {("A", 0): "NOT_LISTED", ("A", 1): "TRADED", ("A", 2): "PROVIDER_MISSING", ("U", 0): "NO_TRADE", ("U", 1): "UNKNOWN", ("U", 2): "UNKNOWN"}
    assert got == want | {("S", 0): "NOT_LISTED", ("S", 1): "NOT_LISTED", ("S", 2): "SUSPENDED"} | {("N", i): "UNKNOWN" for i in range(3)}


def test_overrides_tags_and_stability(spark):
    cols = "symbol string, adv_value double, vol_annual double, beta double, variance_ratio_5 double, limit_hit_freq double, max_floor_streak long, gap_p90 double"
    rows = [("calm", 50.0, 0.2, 0.5, 1.0, 0.0, 0, 0.01), ("bank", 50.0, 0.2, 0.5, 1.0, 0.0, 0, 0.01), ("thin", 1.0, 0.2, 0.5, 1.0, 0.0, 0, 0.01), ("none", 11.0, 0.36, 1.0, 1.0, 0.03, 0, 0.01), ("odd", None, None, None, None, None, None, None)]
    o = spark.createDataFrame([("bank", "BANK", "banking sector"), ("thin", "BANK", "banking sector")], "symbol string, override string, override_reason string")
    got = {r.symbol: r for r in PR.archetypes(spark.createDataFrame(rows, cols), 10.0, 20.0, o).collect()}
    assert {k: r.archetype for k, r in got.items()} == {"calm": "DEFENSIVE", "bank": "BANK", "thin": "EXCLUDED", "none": "SPECULATIVE", "odd": "SPECULATIVE"}
    assert got["bank"].tags == ["BANK", "DEFENSIVE", "LARGE_CAP"] and got["thin"].tags == ["BANK", "DEFENSIVE", "EXCLUDED"] and got["none"].tags == ["SPECULATIVE"]
    assert all(len(r.archetype_reason) > 10 for r in got.values())
    a = spark.createDataFrame([("x", 1, "A"), ("x", 2, "A"), ("x", 4, "A"), ("y", 1, "A"), ("y", 2, "B"), ("z", 2, "A")], "symbol string, q int, archetype string")
    assert [tuple(r) for r in PR.archetype_stability(a, "q").collect()] == [(2, 2, 0.5, True)]


def test_barriers_of_filled_entries_only(spark):
    rows = [("A", DAY + dt.timedelta(i), 10.0 if i != 5 else 30.0, 9.0, 5.0, 20.0, [True, False, None][i] if i < 3 else None) for i in range(40)]
    d = spark.createDataFrame(rows, "symbol string, trading_date date, high double, low double, exit_stop double, target_1 double, filled boolean")
    got = [tuple(r)[2:] for r in PR.triple_barrier(d).orderBy("trading_date").limit(3).collect()]
    assert got == [("TARGET", 5), ("NOT_FILLED", None), (None, None)]


def test_privacy_scan_sizes_once(spark, sf, monkeypatch):
    from eqpanel.plans.catalog import QUERIES

    calls, real = [], RK.approve
    monkeypatch.setattr(RK, "approve", lambda *a: calls.append(1) or real(*a))
    assert QUERIES["l28_privacy_scan"].run(spark, sf).count() > 0
    assert len(calls) == 1
