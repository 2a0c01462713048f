"""SQL answers for ingest, streams and the daily flow."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, BREADTH, CAP, EW, FEAT, REGIME, RS, SECTORS, chain
from eqpanel.plans.quality_oracles import CANON, DOUBLED, SESSIONS, SIMPLE, scored
from eqpanel.plans.registry import oracle
from eqpanel.plans.signal_oracles import ACCOUNTS, FIRST_HELD, LIMIT_OF, PLAN, STATIC, VERDICT, _sizing

ROWS = "symbol, trading_date, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume"

FLOW = f"""
{PLAN.strip()},
{ACCOUNTS.strip()},
cand AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY score DESC, symbol) AS priority FROM (
    SELECT *, least(100, 0.35 * l + 0.15 * CASE WHEN family = 'MOMENTUM_CONTINUATION' THEN s ELSE 100 - s END
        + 0.25 * sector_score + 100 * 0.15 * coalesce(setup_quality, 0.5) + 100 * 0.10 * coalesce(volume_confirmation, 0.5)) AS score
    FROM (SELECT f.symbol, f.trading_date, f.sector, f.sector AS correlated_group, f.entry_price, f.risk_stop, f.adv_shares * 1000 AS adv_shares,
            f.setup_quality, f.volume_confirmation, g.regime, a.rs_stock_market_rank_126 AS l, b.rs_stock_market_rank_20 AS s,
            coalesce(x.leadership_score, 50) AS sector_score,
            CASE WHEN signal_pullback AND rs_stock_market_rank_126 >= 60 AND rs_stock_market_rank_20 <= 40 THEN 'TREND_PULLBACK'
                 WHEN regime_level = 4 AND rs_stock_market_rank_126 >= 60 AND rs_stock_market_rank_20 >= 65 AND trend_confirmed
                      AND coalesce(volume_z60, 0) >= 0.5 THEN 'MOMENTUM_CONTINUATION'
                 WHEN signal_reversal AND rs_stock_market_rank_20 <= 25 AND regime_level >= 2 THEN 'STRUCTURAL_REVERSAL' END AS family
          FROM plan f JOIN rs126 a USING (symbol, trading_date) JOIN rs20 b USING (symbol, trading_date)
          JOIN regime g USING (trading_date) LEFT JOIN sectors x USING (trading_date, sector) WHERE regime_level > 0)
    WHERE family IS NOT NULL AND l IS NOT NULL AND s IS NOT NULL AND sector_score >= 45)),
cnd AS MATERIALIZED (
  SELECT account, equity, equity * 0.01 AS max_loss, c.*, {LIMIT_OF.format(r='regime')} AS lim,
         entry_price - risk_stop + entry_price * 0.001 + risk_stop * 0.001 AS per_share FROM cand c CROSS JOIN acc),
go AS (
  SELECT account, trading_date, 0::BIGINT AS priority, {FIRST_HELD} AS held, NULL::VARCHAR AS status, 0.0::DOUBLE AS quantity,
         NULL::VARCHAR AS binding, 0.0::DOUBLE AS loss FROM (SELECT DISTINCT account, trading_date FROM cnd)
  UNION ALL
  SELECT account, trading_date, priority,
    CASE WHEN why IS NULL THEN list_append(held, {{'sector': sector, 'grp': correlated_group, 'notional': best.q * entry_price,
                                  'risk': greatest(0, entry_price - risk_stop) * best.q}}) ELSE held END,
    CASE WHEN why IS NOT NULL THEN 'REJECTED' WHEN best.n = 'RISK_BUDGET' THEN 'ACCEPTED' ELSE 'RESIZED' END,
    CASE WHEN why IS NULL THEN best.q ELSE 0 END, coalesce(why, best.n), CASE WHEN why IS NULL THEN best.q * per_share + 10000 ELSE 0 END
  FROM (SELECT *, {STATIC} AS why FROM (SELECT *, {VERDICT} AS best FROM (
      SELECT c.*, g.held, {_sizing('g.held')}
      FROM go g JOIN cnd c ON c.account = g.account AND c.trading_date = g.trading_date AND c.priority = g.priority + 1)))),
approved AS MATERIALIZED (
  SELECT c.account, c.trading_date, c.priority, symbol, family, score, least(score, 65) AS confidence, entry_price, risk_stop, g.status,
         g.quantity::BIGINT AS quantity, g.loss AS estimated_loss, g.quantity * entry_price AS notional, g.binding AS binding_constraint
  FROM go g JOIN cnd c ON c.account = g.account AND c.trading_date = g.trading_date AND c.priority = g.priority WHERE g.status <> 'REJECTED')"""

RAW = """
raws AS (
  SELECT symbol, year(trading_date) AS y, CASE WHEN year(trading_date) = 1996 THEN 'x' ELSE '' END || 'p1-' || symbol || '-' || year(trading_date) AS id
  FROM bars GROUP BY 1, 2)"""

REPORTS = """
rep AS MATERIALIZED (
  SELECT symbol, year(trading_date) AS y, max(trading_date) AS session, (CAST(right(symbol, 2) AS INT) + year(trading_date)) % 4 <> 0 AS ok
  FROM bars GROUP BY 1, 2, 4),
wm AS MATERIALIZED (
  SELECT symbol, max(session) AS s, symbol || '-' || max(y) AS run FROM rep WHERE ok GROUP BY 1)"""

FATES = """
hold AS MATERIALIZED (SELECT DISTINCT symbol FROM bars WHERE year(trading_date) = 1995 AND CAST(substr(symbol, 2) AS INT) % 5 = 0),
pays AS MATERIALIZED (
  SELECT symbol, year(trading_date) AS y, 'p1-' || symbol || '-' || year(trading_date) AS id, count(*) AS n, CAST(substr(symbol, 2) AS INT) AS k,
    symbol IN (SELECT symbol FROM hold) AS bad FROM bars GROUP BY 1, 2),
fte AS MATERIALIZED (
  SELECT 0 AS b, id, n, 'ACCEPTED' AS fate, CASE WHEN bad THEN 'held' ELSE 'new' END AS what FROM pays WHERE y < 1998
  UNION ALL
  SELECT 1, id, n, CASE WHEN y < 1998 THEN 'REPEATED' WHEN y = 1998 AND k % 7 = 0 THEN 'LATE' WHEN y % 10 = 9 THEN 'REFUSED' ELSE 'ACCEPTED' END, 'new' FROM pays WHERE y >= 1996
  UNION ALL
  SELECT 1, id || '-again', n, 'ACCEPTED', CASE WHEN bad THEN 'new' ELSE 'stored' END FROM pays WHERE y IN (1996, 1997))"""

TICKS = """SELECT event_type AS symbol, ts::DATE AS trading_date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
  count(*) AS volume FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS p, row(ts, event_id) AS k FROM events) GROUP BY 1, 2"""


def register() -> None:
    oracle("a07_json_bars", BARS, f"SELECT {ROWS}, value::DOUBLE AS value, provider FROM bars WHERE year(trading_date) % 10 <> 9")
    oracle("a07_refused_payloads", BARS, """
SELECT DISTINCT 'p1' AS provider, 'p1-' || symbol || '-' || year(trading_date) AS snapshot_id, 'a mapped field is missing' AS problem
FROM bars WHERE year(trading_date) % 10 = 9""")
    oracle("a09_json_index_bars", BARS, """
SELECT symbol AS index_code, trading_date, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close,
  CASE WHEN NOT (year(trading_date) % 2 = 0 AND bool_or(value % 10 = 0) OVER (PARTITION BY symbol, year(trading_date))) THEN value END AS turnover,
  provider, 'p1-' || symbol || '-' || year(trading_date) AS snapshot_id FROM bars WHERE year(trading_date) % 10 <> 9""")
    reports = chain(BARS, REPORTS)
    oracle("i01_watermarks", reports, "SELECT 'p1' AS provider, symbol AS capability, s AS last_accepted_session, run AS run_id FROM wm")
    oracle("i02_i03_request_ranges", reports, """
SELECT 'p1' AS provider, c.symbol AS capability, s AS last_accepted_session,
  coalesce(s - CAST(greatest(0, suppkey % 4 - 1) AS INT), DATE '2001-10-29') AS request_from, DATE '2001-10-29' AS request_to,
  coalesce(s >= DATE '2001-10-29', false) AS fresh,
  sha256('p1|' || c.symbol || '|2001-10-29|' || coalesce(CAST(s AS VARCHAR), 'none')) AS freshness_key
FROM sec c LEFT JOIN wm ON wm.symbol = c.symbol""")
    oracle("a08_json_members", BARS, "SELECT DISTINCT 'p1-' || symbol || '-' || year(trading_date) AS snapshot_id, symbol FROM bars")
    oracle("a10_html_bars", BARS, f"""
SELECT {ROWS}, NULL::DOUBLE AS value, 'ref' AS provider FROM bars WHERE strftime(trading_date, '%m-%d') BETWEEN '02-01' AND '11-30'""")
    oracle("a10_page_problems", "", "SELECT CAST(page_id AS VARCHAR) AS symbol, 'no populated table' AS problem FROM pages")
    oracle("a04_csv_bars", BARS, f"""
SELECT {ROWS}, NULL::DOUBLE AS value, 'csv' AS provider FROM bars WHERE trading_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
    oracle("a05_csv_members", BARS, "SELECT DISTINCT symbol FROM bars")
    oracle("a06_csv_intervals", BARS, """
SELECT symbol, 'C' || length(s) || substr(s, 1, 3) AS sector_code, s AS sector_name, 'T1' AS taxonomy_version, f AS effective_from, t AS effective_to,
  'review' AS source, 'snap-' || ord AS source_snapshot_id
FROM (SELECT symbol, 1 AS ord, sector AS s, DATE '1990-01-01' AS f, DATE '1998-06-30' AS t FROM sec WHERE suppkey % 10 <> 0
      UNION ALL SELECT symbol, 2, later_sector, DATE '1998-07-01', NULL FROM sec)""")
    oracle("a11_raw_files", BARS, """
SELECT count(*) AS payloads, true AS hashes_match, true AS ids_match FROM (SELECT DISTINCT symbol, year(trading_date) FROM bars)""")
    oracle("a12_i09_published_revisions", BARS, "SELECT 'r1' AS revision, symbol, trading_date, close FROM bars WHERE trading_date < DATE '1997-01-01'")
    oracle("a13_a02_append_and_merge", BARS, "SELECT symbol, trading_date, close, CASE WHEN volume % 2 <> 0 THEN volume END AS volume FROM bars")
    oracle("a16_known_evidence", BARS, """
SELECT s.symbol, EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND year(b.trading_date) = 1995) AS known FROM sec s""")
    oracle("a03_sql_over_views", chain(BARS, SESSIONS), """
SELECT no AS session_no, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume FROM bars JOIN sess USING (trading_date) GROUP BY 1""")
    oracle("c09_duplicate_observations", BARS, """
SELECT symbol, trading_date, close FROM bars WHERE trading_date >= DATE '1997-06-01' AND trading_date < DATE '1998-01-01'""")
    oracle("c10_new_observations", BARS, "SELECT symbol, trading_date, close FROM bars WHERE trading_date >= DATE '1998-01-01'")
    oracle("i05_new_counts", BARS, "SELECT symbol, count(*) AS new_rows FROM bars WHERE trading_date >= DATE '1998-01-01' GROUP BY 1")
    oracle("g06_expected_session", "", """
SELECT as_of, (SELECT max(d) FROM (SELECT as_of - CAST(i AS INT) AS d FROM range(400) r(i)) WHERE isodow(d) < 6
  AND NOT (day(d) <= 2 AND month(d) IN (1, 9) AND d IN (SELECT o_orderdate::DATE FROM orders)) AND NOT d BETWEEN DATE '1996-03-04' AND DATE '1996-05-31') AS expected_session
FROM (SELECT DISTINCT o_orderdate::DATE AS as_of FROM orders)""")
    once = chain(BARS, SESSIONS, CANON, SIMPLE.format(src="canon"))
    oracle("i06_batch_verdict", once, f"""
SELECT min(dq_score) AS dq_score, count(*) FILTER (dq_status = 'FAIL') AS failed, count(*) FILTER (dq_status = 'WARN') AS warned,
  CASE WHEN bool_or(dq_status = 'FAIL') THEN 'FAIL' WHEN bool_or(dq_status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS dq_status,
  bool_and(actionable) AS actionable, NOT bool_or(dq_status = 'FAIL') AS publish
FROM ({scored('simple', 'symbol', 'SELECT DISTINCT symbol FROM bars')})""")
    oracle("i10_g17_sync_status", BARS, """
SELECT symbol AS run_id, state, CASE WHEN state = 'FRESH' THEN 'success' WHEN cache THEN 'warning' ELSE 'error' END AS severity,
  state || ' — ' || CASE state WHEN 'FRESH' THEN 'the run finished and its data was accepted.' WHEN 'STALE' THEN 'stored data ends before the expected session.'
    WHEN 'NO_ADMITTED_PROVIDER' THEN 'no admitted provider can be asked.' WHEN 'FAILED' THEN 'provider timed out'
    ELSE 'the last run failed; earlier accepted data stays in use.' END AS primary_message,
  'provider: ' || CASE WHEN cache THEN 'p1' ELSE 'none' END || '; data as of: ' || coalesce(CAST(CASE WHEN cache THEN d END AS VARCHAR), 'unavailable') || '; last sync: ' || coalesce(CAST(CASE WHEN cache THEN d END AS VARCHAR), 'never')
    || '; DQ: ' || CASE WHEN cache THEN 'PASS' ELSE 'NOT_RUN' END || '; cache accepted: ' || CASE WHEN cache THEN 'yes' ELSE 'no' END
    || '; actionable recommendations: ' || CASE WHEN state = 'FRESH' THEN 'allowed' ELSE 'blocked' END AS details
FROM (SELECT *, CASE WHEN v % 4 > 1 THEN CASE WHEN cache THEN 'FRESH' ELSE 'FAILED' END WHEN v % 4 = 0 THEN CASE WHEN cache THEN 'STALE' ELSE 'NO_ADMITTED_PROVIDER' END
    ELSE CASE WHEN cache THEN 'DEGRADED_CACHED_DATA' ELSE 'FAILED' END END AS state
  FROM (SELECT symbol, max(trading_date) AS d, sum(volume) AS v, sum(volume) % 4 > 1 OR sum(volume) % 3 <> 0 AS cache FROM bars GROUP BY 1))""")
    oracle("i11_coverage", BARS, """
SELECT provider, symbol, count(*) AS rows, min(trading_date) AS first_session, max(trading_date) AS last_session FROM bars GROUP BY 1, 2""")
    raw = chain(BARS, RAW)
    oracle("k02_snapshot_integrity", raw, """
SELECT 'p1' AS provider, id AS snapshot_id, CASE WHEN y = 1997 THEN 2 ELSE 1 END AS copies,
  CASE y WHEN 1995 THEN 'payload hash mismatch' WHEN 1996 THEN 'id does not name its provider' ELSE 'ambiguous snapshot id' END AS problem
FROM raws WHERE y IN (1995, 1996, 1997)""")
    oracle("c13_lineage_problems", raw, """
SELECT 'p1' AS provider, 'p1-' || symbol || '-' || y AS raw_snapshot_id, CASE WHEN y = 1998 THEN 'elsewhere' ELSE 'file' END AS source_reference,
  CASE y WHEN 1996 THEN 'unknown raw snapshot' WHEN 1997 THEN 'ambiguous raw snapshot' ELSE 'source_reference differs' END AS problem
FROM raws WHERE y IN (1996, 1997, 1998)""")
    oracle("k01_c16_provider_admission", "", """
SELECT 'S' || lpad(CAST(k AS VARCHAR), 9, '0') AS provider, missing,
  k % 6 <> 0 AND k % 7 <> 0 AND missing = '' AND k % 4 <> 0 AND k % 5 <> 0 AS admitted
FROM (SELECT s_suppkey AS k, concat_ws(';', CASE WHEN s_suppkey % 10 = 0 THEN 'licence_reference' END,
        CASE WHEN s_suppkey % 8 = 0 THEN 'capability_definitions[daily_ohlcv]' END,
        CASE WHEN s_suppkey % 9 = 0 THEN 'next_review_at_after_reviewed_at' END) AS missing FROM supplier)""")
    oracle("h17_review_import", BARS, """
SELECT 'IDX' AS index_code, symbol, DATE '1998-01-01' AS effective_from, NULL::DATE AS effective_to, 'review' AS source, 'p1-review' AS source_snapshot_id
FROM sec WHERE suppkey % 2 = 0""")
    oracle("h18_acceptance_gate", once, """
SELECT 'run-1' AS run_id, true AS acceptable, NULL::VARCHAR AS block_reason, 'ADMITTED' AS provider_status, 'COMPLETE' AS expected_session_status,
  'COMPLETE' AS lineage_status, 'ACCEPTED' AS canonical_revision_status, 'CLEAR' AS corporate_action_status,
  CASE WHEN EXISTS (SELECT 1 FROM disagree) THEN 'DISAGREEMENT' ELSE 'CLEAR' END AS reconciliation_status, 100::BIGINT AS dq_score""")
    flow = chain(FEAT, RS, SECTORS, EW, BREADTH, CAP, REGIME, FLOW)
    oracle("c07_h19_approved_candidates", flow, "SELECT * FROM approved")
    oracle("h19_daily_flow", flow, """
SELECT trading_date, regime, reason, cap_score, ew_score, breadth_pct_ma50, turnover_ratio, cap_index_mode, cap_index_warning,
  coalesce(n, 0) AS candidate_count, false AS degraded_mode
FROM regime JOIN (SELECT trading_date, cap_index_mode, cap_index_warning FROM capx) USING (trading_date)
LEFT JOIN (SELECT trading_date, count(DISTINCT symbol) AS n FROM approved GROUP BY 1) USING (trading_date)""")
    oracle("i13_bars_from_ticks", "", TICKS)
    oracle("i13_bars_from_tick_stream", "", TICKS)
    fates = chain(BARS, FATES)
    oracle("i12_streamed_ingest", fates, f"""
SELECT {ROWS}, value::DOUBLE AS value, provider FROM bars b LEFT JOIN hold h USING (symbol), LATERAL (SELECT year(trading_date) AS y)
WHERE CASE WHEN y < 1996 THEN h.symbol IS NULL WHEN y = 1998 THEN CAST(substr(b.symbol, 2) AS INT) % 7 <> 0 ELSE y <> 1999 END""")
    oracle("i12_held_rows", fates, """
SELECT symbol, trading_date, open::DOUBLE AS open, high::DOUBLE AS high, CASE WHEN year(trading_date) = 1995 THEN 9999999 ELSE low END::DOUBLE AS low,
  close::DOUBLE AS close, volume, value::DOUBLE AS value, provider, 'OHLC_LOGIC' AS reason
FROM bars JOIN hold USING (symbol) WHERE year(trading_date) < 1998""")
    oracle("i12_snapshot_fates", fates, "SELECT id AS snapshot_id, fate, CASE WHEN fate = 'REFUSED' THEN 'a mapped field is missing' END AS problem, fate IN ('LATE', 'REFUSED') AS kept FROM fte")
    oracle("i07_published_batches", fates, """
SELECT b AS batch_id, count(*) AS snapshots, count(*) FILTER (fate = 'ACCEPTED') AS accepted, count(*) FILTER (fate = 'REPEATED') AS repeated,
  count(*) FILTER (fate = 'LATE') AS late, count(*) FILTER (fate = 'REFUSED') AS refused,
  coalesce(sum(n) FILTER (fate = 'ACCEPTED'), 0)::BIGINT AS decoded, coalesce(sum(n) FILTER (fate = 'ACCEPTED' AND what = 'new'), 0)::BIGINT AS written,
  coalesce(sum(n) FILTER (fate = 'ACCEPTED' AND what = 'held'), 0)::BIGINT AS held, coalesce(sum(n) FILTER (fate = 'ACCEPTED' AND what = 'stored'), 0)::BIGINT AS stored,
  true AS published
FROM fte GROUP BY 1""")
