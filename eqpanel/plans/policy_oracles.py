"""SQL answers for entry gates, exit order, publication, evidence of findings and gaps in membership."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, BREADTH, CAP, EW, FEAT, REGIME, RS, SECTORS, chain, mean
from eqpanel.plans.profile_oracles import RET, STATS
from eqpanel.plans.quality_oracles import CANON, INTERVALS, SESSIONS, SIMPLE
from eqpanel.plans.registry import ORACLES, oracle
from eqpanel.plans.research_oracles import TRADES
from eqpanel.plans.signal_oracles import NEXT, PLAN, _taken, down

FAMILY = "CASE WHEN signal_pullback THEN 'PULLBACK' WHEN signal_reversal THEN 'REVERSAL' WHEN trend_confirmed THEN 'MOMENTUM' END"

ASKED = f"""
ask AS MATERIALIZED (
  SELECT p.*, {FAMILY} AS family, {mean('value', 20)} AS adv20, archetype, regime_level, a.rs_stock_market_rank_126 AS lr, b.rs_stock_market_rank_20 AS sr
  FROM plan p JOIN rs126 a USING (symbol, trading_date) JOIN rs20 b USING (symbol, trading_date) JOIN regime USING (trading_date) JOIN arch USING (symbol))"""

PATHS = """
pth AS MATERIALIZED (SELECT sector, trading_date, avg(r) AS x, any_value(m) AS m FROM ret GROUP BY 1, 2 HAVING avg(r) IS NOT NULL),
wth AS (SELECT *, product(1 + x) OVER (PARTITION BY sector ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS w FROM pth),
dd AS (SELECT sector, min(w / pk - 1) AS fall FROM (SELECT *, max(w) OVER (PARTITION BY sector ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS pk FROM wth) GROUP BY 1)"""


def register() -> None:
    oracle("l09_volume_score", FEAT, f"""
SELECT symbol, trading_date, family, CASE WHEN volume_z60 IS NULL THEN NULL WHEN family IN ('PULLBACK', 'REVERSAL') THEN greatest(0, least(1, 2 - volume_z60))
  WHEN family = 'MOMENTUM' THEN greatest(0, least(1, (volume_z60 - 1) / 1.5)) END AS volume_score FROM (SELECT *, {FAMILY} AS family FROM feat)""")
    oracle("l10_gate_chain", chain(FEAT, RS, SECTORS, EW, BREADTH, CAP, REGIME, PLAN, RET, STATS, ASKED), """
SELECT archetype, gate, count(*) AS rows FROM (SELECT archetype, CASE
  WHEN NOT regime_level > 0 THEN 'GATE0_REGIME'
  WHEN NOT coalesce(rn >= 130 AND adv20 >= 2e6 AND volume % 47 <> 0 AND archetype <> 'EXCLUDED', false) THEN 'GATE1_ELIGIBILITY'
  WHEN NOT volume % 100 < 75 THEN 'GATE2_RISK'
  WHEN NOT coalesce(regime_level >= CASE archetype WHEN 'DEFENSIVE' THEN 1 WHEN 'LARGE_CAP' THEN 2 WHEN 'HIGH_BETA' THEN 3 ELSE 4 END AND volume % 53 <> 0 AND volume % 29 <> 0, false)
    THEN 'GATE3_ARCHETYPE_REGIME'
  WHEN NOT coalesce(lr >= 60 AND CASE WHEN coalesce(family = 'MOMENTUM', false) THEN sr >= 65 ELSE sr <= 40 END, false) THEN 'GATE4A_DUAL_CONDITION'
  WHEN NOT coalesce(family IS NOT NULL AND CASE WHEN family = 'MOMENTUM' THEN volume_z60 > 1 ELSE volume_z60 < 2 END, false) THEN 'GATE4B_SETUP'
  WHEN NOT coalesce(setup_quality * 100 >= 60 AND volume % 40 < 30 AND r_unit / atr14 >= 0.8 AND risk_reward >= 1.7 AND risk_stop < exit_stop AND exit_stop < entry_price
    AND entry_price < close * 1.07 * 0.995, false) THEN 'GATE5_GEOMETRY' ELSE 'PASSED' END AS gate FROM ask) GROUP BY 1, 2""")
    oracle("l17_extended_metrics", chain(BARS, RET, PATHS), """
SELECT sector, sessions, cagr, fall AS max_drawdown, cagr / nullif(-fall, 0) AS calmar, ir AS information_ratio FROM (
  SELECT sector, count(*) AS sessions, exp(sum(ln(1 + x)) * 250 / count(*)) - 1 AS cagr, avg(x - m) / stddev_samp(x - m) * sqrt(250) AS ir FROM pth GROUP BY 1) JOIN dd USING (sector)""")
    oracle("l17_score_deciles", chain(FEAT, NEXT, _taken("trend_confirmed")), """
SELECT d AS decile, count(*) AS trades, avg((net_return > 0)::INT) AS hit_rate, avg(net_return) AS mean_outcome FROM (
  SELECT net_return, least(10, floor((rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 - 0.5) / count(*) OVER () * 10) + 1)::BIGINT AS d
  FROM (SELECT t.net_return, f.setup_quality AS q FROM taken t JOIN feat f USING (symbol, trading_date) WHERE t.filled AND t.net_return IS NOT NULL AND f.setup_quality IS NOT NULL)) GROUP BY 1""")
    oracle("l27_exit_reasons", chain(FEAT, PLAN), """
SELECT symbol, trading_date, reason, CASE WHEN reason = 'P4_TARGET' THEN 'SELL_HALF' WHEN reason IS NOT NULL THEN 'EXIT' END AS action,
  CASE WHEN reason IS NOT NULL THEN reason IN ('P1_ANOMALY', 'P2_EXIT_STOP', 'P3_REGIME', 'P5_TRAILING') END AS urgent
FROM (SELECT symbol, trading_date, CASE WHEN volume % 80 >= 75 OR volume % 80 - v0 % 80 >= 25 THEN 'P1_ANOMALY' WHEN close <= s0 THEN 'P2_EXIT_STOP' WHEN volume % 31 = 0 THEN 'P3_REGIME'
    WHEN volume % 3 <> 0 AND close >= t0 THEN 'P4_TARGET' WHEN volume % 3 = 0 AND close <= e0 * 0.99 THEN 'P5_TRAILING' WHEN (close - e0) / u0 < 0.5 THEN 'P6_TIME'
    WHEN volume % 2 = 0 THEN 'P7_THESIS' END AS reason
  FROM (SELECT *, lag(volume, 20) OVER w AS v0, lag(exit_stop, 20) OVER w AS s0, lag(target_1, 20) OVER w AS t0, lag(entry_price, 20) OVER w AS e0, lag(r_unit, 20) OVER w AS u0
        FROM plan WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)) WHERE s0 IS NOT NULL)""")
    # the decisions' own SQL, with the account's equity beside it
    head, tail = ORACLES["h03_portfolio_risk"].rsplit("SELECT * REPLACE", 1)
    digits = "".join(f", round_even({c}_nav::DOUBLE * 1e8, 0) / 1e8 + 0.0 AS {c}_nav" for c in ("notional", "estimated_loss"))
    ORACLES["l28_published_fractions"] = f"""{head}SELECT account, trading_date, symbol, status{digits} FROM (
  SELECT a.*, notional / e AS notional_nav, estimated_loss / e AS estimated_loss_nav FROM answer a
  JOIN (SELECT c_mktsegment AS account, sum(CAST(round(c_acctbal * 100) AS BIGINT))::DOUBLE * 10 AS e FROM customer GROUP BY 1) USING (account))"""
    ORACLES["l28_privacy_scan"] = f"""{head}SELECT 'before' AS "table", x AS "column", CASE WHEN k = 0 THEN 'names capital' ELSE 'holds amounts' END AS problem FROM (
  SELECT unnest(['quantity', 'notional', 'notional', 'quantity', 'estimated_loss']) AS x, unnest([0, 0, 1, 2, 3]) AS k),
  (SELECT max((notional >= 1e5 AND notional = round(notional))::INT) AS n1, max((quantity >= 1e5)::INT) AS n2, max((estimated_loss >= 1e5 AND estimated_loss = round(estimated_loss))::INT) AS n3 FROM answer)
WHERE k = 0 OR k = 1 AND n1 = 1 OR k = 2 AND n2 = 1 OR k = 3 AND n3 = 1"""
    oracle("h05_verified_index", BARS, """
SELECT 'IDXA' AS index_code, trading_date, sum(close * volume)::DOUBLE / sum(volume) AS close FROM bars WHERE year(trading_date) % 4 > 1 GROUP BY 2""")
    simple = chain(BARS, SESSIONS, CANON, SIMPLE.format(src="canon"))
    oracle("h16_finding_evidence", simple, """
SELECT sha256('{"code":"' || code || '","symbol":"' || symbol || '","trading_date":"' || trading_date || '","provider":"' || provider || '","canonical_revision":"r' || year(trading_date) || '"}') AS result_id,
  code, status, symbol, trading_date, provider, occurrences, 'r' || year(trading_date) AS canonical_revision,
  CASE WHEN code = 'PROVIDER_DISAGREEMENT' THEN 'p1-' || year(trading_date) || ',p2-' || year(trading_date) ELSE provider || '-' || year(trading_date) END AS snapshot_ids FROM simple""")
    gaps = chain(BARS, SESSIONS, INTERVALS)
    bare = "SELECT trading_date AS as_of FROM sess WHERE NOT EXISTS (SELECT 1 FROM uni u WHERE u.t IS NOT NULL AND trading_date BETWEEN u.f AND u.t)"
    oracle("c05_uncovered_with_gaps", gaps, bare)
    oracle("c05_universe_with_gaps", gaps, f"""
SELECT trading_date AS as_of, symbol, 'STRICT_PIT' AS mode, source, snap AS source_snapshot_id FROM sess JOIN uni u ON u.t IS NOT NULL AND trading_date BETWEEN u.f AND u.t
UNION ALL SELECT as_of, symbol, 'CURRENT_UNIVERSE_PROXY', 'current-provider-membership', NULL FROM ({bare}), sec""")
    oracle("l11_session_classes_by_master", chain(BARS, SESSIONS), """
SELECT m.symbol, d.trading_date, CASE WHEN b.volume > 0 THEN 'TRADED' WHEN b.volume IS NOT NULL THEN 'NO_TRADE'
    WHEN EXISTS (SELECT 1 FROM bars h WHERE h.symbol = m.symbol AND h.volume % 19 = 0 AND h.trading_date + 7 = d.trading_date) THEN 'SUSPENDED'
    WHEN m.f IS NULL THEN 'UNKNOWN' WHEN d.trading_date < m.f THEN 'NOT_LISTED' ELSE 'PROVIDER_MISSING' END AS session_status
FROM (SELECT symbol, CASE WHEN CAST(substr(symbol, 2) AS INT) % 6 <> 0 THEN min(trading_date) END AS f FROM bars GROUP BY 1
      UNION ALL SELECT 'X' || n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN DATE '1998-01-05' END FROM nation) m CROSS JOIN sess d
LEFT JOIN bars b ON b.symbol = m.symbol AND b.trading_date = d.trading_date""")
    oracle("l16_triple_barrier_filled", chain(FEAT, PLAN, NEXT), """
SELECT symbol, trading_date, CASE WHEN f THEN CASE WHEN k IS NOT NULL THEN CASE WHEN lo <= exit_stop THEN 'STOP' ELSE 'TARGET' END WHEN has THEN 'TIME' END WHEN NOT f THEN 'NOT_FILLED' END AS barrier,
  CASE WHEN f THEN k END AS sessions
FROM (SELECT p.symbol, p.trading_date, any_value(p.exit_stop) AS exit_stop, any_value(p.n - p.rn >= 21) AS has, any_value(e.why IN ('open_better_than_limit', 'traded_through_limit')) AS f,
        min(q.rn - p.rn) FILTER (q.low <= p.exit_stop OR q.high >= p.target_1) AS k, arg_min(q.low, q.rn) FILTER (q.low <= p.exit_stop OR q.high >= p.target_1) AS lo
      FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM plan) p JOIN ent e USING (symbol, trading_date)
      LEFT JOIN bars q ON q.symbol = p.symbol AND q.rn BETWEEN p.rn + 4 AND p.rn + 21 GROUP BY 1, 2)""")
    oracle("l08_archetypes_with_overrides", chain(BARS, RET, STATS), """
SELECT symbol, CASE WHEN NOT ex AND bank THEN 'BANK' ELSE archetype END AS archetype, CASE WHEN NOT ex AND bank THEN 'banking sector' ELSE archetype_reason END AS archetype_reason,
  CASE WHEN len(t) > 0 THEN array_to_string(list_sort(list_distinct(t)), ',') ELSE archetype END AS tags
FROM (SELECT *, list_filter([CASE WHEN ex THEN 'EXCLUDED' END, CASE WHEN bank THEN 'BANK' END, CASE WHEN vol_annual < 0.28 AND beta < 0.85 AND limit_hit_freq < 0.02 THEN 'DEFENSIVE' END,
      CASE WHEN beta > 1.25 AND vol_annual > 0.38 THEN 'HIGH_BETA' END, CASE WHEN vol_annual > 0.45 OR limit_hit_freq > 0.05 OR max_floor_streak >= 3 THEN 'SPECULATIVE' END,
      CASE WHEN adv_value > 18e6 AND vol_annual < 0.35 THEN 'LARGE_CAP' END, CASE WHEN variance_ratio_5 > 1.15 AND adv_value >= 9e6 AND vol_annual < 0.38 THEN 'LARGE_CAP' END,
      CASE WHEN variance_ratio_5 < 0.85 AND vol_annual < 0.33 THEN 'DEFENSIVE' END], lambda x: x IS NOT NULL) AS t
  FROM (SELECT *, adv_value < 5e6 OR max_floor_streak >= 5 OR gap_p90 > 0.045 AS ex, CAST(substr(symbol, 2) AS INT) % 7 = 0 AS bank FROM stats JOIN arch USING (symbol)))""")
    yearly = STATS.replace("SELECT symbol, count(*) AS k FROM (", "SELECT symbol, year, count(*) AS k FROM (").replace("GROUP BY symbol, i),", "GROUP BY symbol, year, i),")
    yearly = yearly.replace("  SELECT symbol, coalesce(r <= -0.069, false) AS dn", "  SELECT symbol, year, coalesce(r <= -0.069, false) AS dn")
    yearly = yearly.replace("SELECT symbol, var_samp(x) AS v5", "SELECT symbol, year, var_samp(x) AS v5").replace("SELECT symbol, (rn - 2) // 5 AS b", "SELECT symbol, year, (rn - 2) // 5 AS b")
    yearly = yearly.replace("GROUP BY 1, 2 HAVING count(*) = 5) GROUP BY 1)", "GROUP BY 1, 2, 3 HAVING count(*) = 5) GROUP BY 1, 2)")
    yearly = yearly.replace("SELECT symbol, stddev_samp(r)", "SELECT symbol, year, stddev_samp(r)").replace("i.symbol = ret.symbol)", "i.symbol = ret.symbol AND i.year = ret.year)")
    yearly = yearly.replace("f.symbol = ret.symbol)", "f.symbol = ret.symbol AND f.year = ret.year)").replace("FROM ret GROUP BY symbol)", "FROM ret GROUP BY symbol, year)")
    yearly = yearly.replace("SELECT symbol, CASE WHEN adv_value < 5e6", "SELECT symbol, year, CASE WHEN adv_value < 2e6").replace("18e6", "8e6").replace("9e6", "4e6")
    oracle("l08_archetype_stability", chain(BARS, RET.replace("SELECT *, avg(r)", "SELECT *, year(trading_date) AS year, avg(r)"), yearly), """
SELECT a.year, count(*) AS securities, avg((a.archetype = b.archetype)::INT) AS stability, avg((a.archetype = b.archetype)::INT) < 0.60 AS unstable
FROM arch a JOIN arch b ON b.symbol = a.symbol AND b.year = a.year - 1 GROUP BY 1""")
    by_venue = "CASE CAST(substr(symbol, 2) AS INT) % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} END"
    oracle("g11_venue_bands", BARS, f"""
SELECT symbol, trading_date, {by_venue.format(*[down(f'close * {1 - b}') for b in (0.07, 0.10, 0.15)])} AS floor_price,
  {by_venue.format(*[down(f'close * {1 + b}') for b in (0.07, 0.10, 0.15)])} AS ceiling_price FROM bars""")
    oracle("g04_g14_snapshot_ids", BARS, """
SELECT symbol, year, 'p1-' || substr(sha256(sha256(symbol || ':' || year) || '|{"symbol":"' || symbol || '","year":"' || year || '"}'), 1, 24) AS snapshot_id, true AS order_free
FROM (SELECT DISTINCT symbol, CAST(year(trading_date) AS VARCHAR) AS year FROM bars)""")
    oracle("f05_largest_moves", chain(BARS, RET), "SELECT symbol, trading_date, r FROM ret WHERE r IS NOT NULL ORDER BY abs(r) DESC, symbol, trading_date LIMIT 10")
