"""Panels of many symbols: a task's share is fixed, the results are those of the SQL."""

import re

import pytest

from compare import compare, connect
from eqpanel import params as P
from eqpanel.plans import ingest_queries, policy_queries, research_queries
from eqpanel.plans.catalog import ORACLES, QUERIES
from eqpanel.sources import derived as D


@pytest.fixture
def many_symbols(spark, sf, monkeypatch):
    """Every panel counts as one of many symbols."""
    monkeypatch.setattr(P, "SYMBOLS_PER_TASK", 1)
    symbols = D.symbol_bound(spark, sf)
    assert symbols > spark.sparkContext.defaultParallelism
    return symbols


def _same(spark, sf, name):
    d = QUERIES[name].run(spark, sf)
    assert compare(d, ORACLES[name], connect(sf)) is None
    return d


def test_series_are_dealt_out_by_the_number_of_symbols(spark, sf, many_symbols):
    assert _same(spark, sf, "panel_bars").rdd.getNumPartitions() == many_symbols


def test_ranks_sort_narrow_rows(spark, sf, many_symbols):
    assert _same(spark, sf, "h02_relative_strength").rdd.getNumPartitions() >= many_symbols


def test_fields_are_settled_before_they_become_rows(spark, sf, many_symbols):
    assert _same(spark, sf, "l14_reconciliation").rdd.getNumPartitions() == many_symbols


def test_intervals_are_dealt_out_before_they_are_spread(spark, sf, many_symbols):
    assert _same(spark, sf, "c05_universe_as_of").rdd.getNumPartitions() >= many_symbols


def test_ranks_meet_the_panel_in_as_many_parts_as_it_was_dealt_into(spark, sf, many_symbols):
    """Not in the session's number of shuffle partitions, which does not grow with the panel."""
    plan = _same(spark, sf, "h02_relative_strength")._jdf.queryExecution().executedPlan().toString()
    parts = re.findall(r"hashpartitioning\(__key#\d+, (\d+)\)", plan)
    assert set(parts) == {str(many_symbols)} and "coalesce(symbol" not in plan


def test_daily_flow_deals_its_panel_out(spark, sf, many_symbols):
    _same(spark, sf, "h19_daily_flow")
    plan = ingest_queries._flow(spark, sf)[0]["regimes"]._jdf.queryExecution().executedPlan().toString()
    panel = [x for x in plan.splitlines() if re.search(r"hashpartitioning\(symbol#\d+, ", x)]
    assert panel and all(f", {many_symbols})" in x for x in panel)


def test_gates_run_on_the_dealt_out_panel(spark, sf, many_symbols):
    _same(spark, sf, "l10_gate_chain")
    plan = policy_queries._gate_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(symbol#\d+, (\d+)\)", plan)) == {str(many_symbols)}


def test_score_deciles_read_the_panel_once(spark, sf, many_symbols):
    _same(spark, sf, "l17_score_deciles")
    plan = research_queries._trades(spark, sf, "setup_quality")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/lineitem.parquet") <= 1 and "trading_date" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_sectors_join_the_bars_as_they_are_dealt_out(spark, sf, monkeypatch):
    from eqpanel.functions import series as S
    from eqpanel.sources import derived as D

    want = sorted(map(str, D.bars(spark, sf).collect()))
    monkeypatch.setattr(S.P, "SYMBOLS_PER_TASK", 1)
    monkeypatch.setattr(S, "many", lambda df, symbols: True)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # a supplier table too large to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        dealt = D.bars(spark, sf)
        rows = sorted(map(str, dealt.collect()))
        plan = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows == want
    # sorted for the series and the suppliers' side only
    assert "SortMergeJoin" in plan and plan.count(") Sort ") == 2


def _written(spark, tmp_path, monkeypatch, run) -> dict[int, int]:
    """Columns of each table that ``run`` writes on the way, with its rows."""
    from eqpanel.functions import checkpoints

    monkeypatch.setattr(checkpoints, "checkpoint_dir", lambda _: str(tmp_path))
    run().collect()
    tables = [spark.read.parquet(str(p)) for p in tmp_path.glob("table-*")]
    return {len(t.columns): t.count() for t in tables}


@pytest.mark.parametrize("name", ["l10_gate_chain", "l10_gate_funnel"])
def test_gates_write_no_panel(spark, sf, many_symbols, tmp_path, monkeypatch, name):
    """The bars and one row per symbol, and no feature of a bar."""
    bars = len(D.bars(spark, sf).columns)
    written = _written(spark, tmp_path, monkeypatch, lambda: QUERIES[name].run(spark, sf))
    assert set(written) == {bars, 2} and written[2] <= many_symbols


@pytest.mark.parametrize("name", ["l10_gate_chain", "l10_gate_funnel"])
def test_gates_scan_the_order_lines_once(spark, sf, many_symbols, name):
    """That is for the bars; index, archetypes and features are read from these."""
    d = QUERIES[name].run(spark, sf)
    assert "/lineitem.parquet" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_carried_ranks_are_the_joined_ones(spark, sf, many_symbols):
    from eqpanel.operators import relative_strength as RS

    bars = D.stored_bars(spark, sf)
    want, got = (RS.add_cross_sectional_rs(bars, symbols_bound=many_symbols, carried=c) for c in (False, True))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_candidates_are_few_and_folded_at_once(spark, sf, monkeypatch):
    """However many symbols there are: the largest group of candidates counts, not the bound on it."""
    from eqpanel.operators import risk as RK

    monkeypatch.setattr(P, "MAX_FOLD_GROUP", 5)
    assert D.symbol_bound(spark, sf) > P.MAX_FOLD_GROUP
    monkeypatch.setattr(RK, "_accepted_by_rounds", lambda *a: pytest.fail("rounds"))
    _same(spark, sf, "c07_h19_approved_candidates")


def test_gates_are_judged_before_the_ranks(spark, sf, many_symbols):
    """So that no number behind a gate is shuffled with the returns."""
    d = policy_queries._gate_rows(spark, sf)
    assert not {"r_unit", "atr14", "entry_price", "adv20", "volume_z60", "score"} & set(d.columns)
