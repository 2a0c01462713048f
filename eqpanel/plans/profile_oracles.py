"""SQL answers for profiles, labels, selection and ingestion checks."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, BREADTH, CAP, EW, FEAT, REGIME, RS, SECTORS, W, chain, mean
from eqpanel.plans.quality_oracles import CANON, SESSIONS
from eqpanel.plans.registry import oracle
from eqpanel.plans.signal_oracles import NEXT, PLAN, _taken

RET = f"""
ret0 AS (SELECT *, close::DOUBLE / lag(close) {W} - 1 AS r, open::DOUBLE / lag(close) {W} - 1 AS gap FROM bars),
ret AS MATERIALIZED (SELECT *, avg(r) OVER (PARTITION BY trading_date) AS m FROM ret0)"""

STATS = """
isle AS (SELECT symbol, count(*) AS k FROM (
  SELECT symbol, coalesce(r <= -0.069, false) AS dn, count(*) FILTER (NOT coalesce(r <= -0.069, false)) OVER (PARTITION BY symbol ORDER BY trading_date) AS i
  FROM ret) WHERE dn GROUP BY symbol, i),
five AS (SELECT symbol, var_samp(x) AS v5 FROM (
  SELECT symbol, (rn - 2) // 5 AS b, sum(ln(1 + r)) AS x FROM ret WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 5) GROUP BY 1),
stats AS MATERIALIZED (
  SELECT symbol, stddev_samp(r) * sqrt(250) AS vol_annual, covar_samp(r, m) / var_samp(CASE WHEN r IS NOT NULL THEN m END) AS beta,
    1 - corr(r, m) ** 2 AS idio_share, avg(value) AS adv_value, avg(abs(r) / value) AS amihud, quantile_cont(abs(gap), 0.5) AS gap_median,
    quantile_cont(abs(gap), 0.9) AS gap_p90, avg((abs(r) >= 0.069)::INT) AS limit_hit_freq,
    coalesce((SELECT max(k) FROM isle i WHERE i.symbol = ret.symbol), 0) AS max_floor_streak,
    (SELECT v5 FROM five f WHERE f.symbol = ret.symbol) / (5 * var_samp(ln(1 + r))) AS variance_ratio_5
  FROM ret GROUP BY symbol),
arch AS MATERIALIZED (
  SELECT symbol, CASE WHEN adv_value < 5e6 OR max_floor_streak >= 5 OR gap_p90 > 0.045 THEN 'EXCLUDED'
      WHEN vol_annual < 0.28 AND beta < 0.85 AND limit_hit_freq < 0.02 THEN 'DEFENSIVE' WHEN beta > 1.25 AND vol_annual > 0.38 THEN 'HIGH_BETA'
      WHEN vol_annual > 0.45 OR limit_hit_freq > 0.05 OR max_floor_streak >= 3 THEN 'SPECULATIVE'
      WHEN adv_value > 18e6 AND vol_annual < 0.35 THEN 'LARGE_CAP' WHEN variance_ratio_5 > 1.15 AND adv_value >= 9e6 AND vol_annual < 0.38 THEN 'LARGE_CAP'
      WHEN variance_ratio_5 < 0.85 AND vol_annual < 0.33 THEN 'DEFENSIVE' ELSE 'SPECULATIVE' END AS archetype,
    CASE WHEN adv_value < 5e6 THEN 'cannot size a position' WHEN max_floor_streak >= 5 THEN 'tail risk when locked' WHEN gap_p90 > 0.045 THEN 'unusable for EOD entry'
      WHEN vol_annual < 0.28 AND beta < 0.85 AND limit_hit_freq < 0.02 THEN 'low volatility, beta and limit hits'
      WHEN beta > 1.25 AND vol_annual > 0.38 THEN 'high beta and volatility'
      WHEN vol_annual > 0.45 OR limit_hit_freq > 0.05 OR max_floor_streak >= 3 THEN 'volatile or often at its limit'
      WHEN adv_value > 18e6 AND vol_annual < 0.35 THEN 'liquid and calm'
      WHEN variance_ratio_5 > 1.15 AND adv_value >= 9e6 AND vol_annual < 0.38 THEN 'trending and liquid'
      WHEN variance_ratio_5 < 0.85 AND vol_annual < 0.33 THEN 'mean-reverting and calm' ELSE 'no clear signature; assigned conservatively' END AS archetype_reason
  FROM stats)"""


def _excess(h: int) -> str:
    return f"lead(close, {h}) {W}::DOUBLE / close - (SELECT e.close FROM ew e WHERE e.trading_date = lead(b.trading_date, {h}) {W}) / i.close"


def _fwd(hs) -> str:
    cols = ", ".join(f"lead(b.trading_date, {h}) {W} AS d{h}, lead(b.close, {h}) {W}::DOUBLE / b.close AS g{h}" for h in hs)
    joins = " ".join(f"LEFT JOIN ew e{h} ON e{h}.trading_date = d{h}" for h in hs)
    out = ", ".join(f"g{h} - e{h}.close / i.close AS excess_{h}" for h in hs)
    return f"SELECT x.symbol, x.trading_date, x.volume, {out} FROM (SELECT symbol, b.trading_date, volume, {cols} FROM bars b) x JOIN ew i ON i.trading_date = x.trading_date {joins}"


def register() -> None:
    st = chain(BARS, RET, STATS)
    oracle("l04_profiles", st, "SELECT * FROM stats")
    oracle("l08_archetypes", st, "SELECT * FROM arch")
    oracle("l10_selection", FEAT, """
SELECT symbol, trading_date, sector, score, p AS win_probability, c AS composite, k AS selection_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY c DESC, symbol) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY trading_date, sector ORDER BY c DESC, symbol) AS s FROM (
      SELECT *, 0.6 * score / 100 + 0.4 * p AS c FROM (SELECT *, setup_quality * 100 AS score, volume % 10 / 10 AS p FROM feat WHERE trend_confirmed)))
  WHERE s <= 2) WHERE k <= 3""")
    ss = chain(BARS, SESSIONS)
    oracle("l11_session_classes", ss, """
SELECT s.symbol, d.trading_date, CASE WHEN b.volume > 0 THEN 'TRADED' WHEN b.volume IS NOT NULL THEN 'NO_TRADE' WHEN d.trading_date < s.f THEN 'NOT_LISTED'
  ELSE 'PROVIDER_MISSING' END AS session_status
FROM (SELECT symbol, min(trading_date) AS f FROM bars GROUP BY 1) s CROSS JOIN sess d
LEFT JOIN bars b ON b.symbol = s.symbol AND b.trading_date = d.trading_date""")
    oracle("l12_ingestion_gate", chain(BARS, RET), """
SELECT *, (p IS NULL OR rows >= p * 0.90) AND unexplained_moves = 0 AND broken_ohlc = 0 AND negative_volume = 0 AS passed, p AS previous_rows
FROM (SELECT *, lag(rows) OVER (ORDER BY trading_date) AS p FROM (
  SELECT trading_date, count(*) AS rows, count(*) FILTER (abs(r) > 0.03 * 1.05 AND volume % 3 <> 0) AS unexplained_moves,
    count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS broken_ohlc, count(*) FILTER (volume < 0) AS negative_volume
  FROM ret GROUP BY 1))""".replace("SELECT *, (p", "SELECT trading_date, rows, unexplained_moves, broken_ohlc, negative_volume, (p"))
    oracle("l14_reconciliation", chain(BARS, SESSIONS, CANON), """
SELECT symbol, trading_date, field, arg_max(v, provider)::DOUBLE AS accepted_value, max(provider) AS accepted_provider,
  CASE WHEN min(v) = max(v) THEN 'AGREED' ELSE 'DISPUTED' END AS reconciliation_status
FROM (SELECT symbol, trading_date, provider, unnest(['open', 'high', 'low', 'close', 'volume']) AS field, unnest([open, high, low, close, volume]) AS v FROM canon)
GROUP BY 1, 2, 3""")
    oracle("l15_fundamentals_as_of", BARS, """
SELECT b.symbol, 'revenue' AS metric, b.trading_date, f.pub AS published_at, f.pe AS period_end, f.v AS value FROM bars b ASOF LEFT JOIN (
  SELECT symbol, make_date(year(trading_date), 12, 31) AS pe, make_date(year(trading_date), 12, 31) + 60 AS pub, sum(value)::DOUBLE AS v FROM bars GROUP BY 1, 2, 3) f
ON f.symbol = b.symbol AND f.pub <= b.trading_date""")
    ewx = chain(BARS, EW)
    oracle("l16_forward_excess", ewx, f"SELECT * EXCLUDE (volume) FROM ({_fwd((5, 10, 20))})")
    oracle("l16_triple_barrier", chain(FEAT, PLAN), f"""
SELECT symbol, trading_date, CASE WHEN k IS NOT NULL THEN CASE WHEN lo <= exit_stop THEN 'STOP' ELSE 'TARGET' END WHEN has THEN 'TIME' END AS barrier, k AS sessions
FROM (SELECT p.symbol, p.trading_date, any_value(p.exit_stop) AS exit_stop, any_value(p.n - p.rn >= 21) AS has,
        min(q.rn - p.rn) FILTER (q.low <= p.exit_stop OR q.high >= p.target_1) AS k,
        arg_min(q.low, q.rn) FILTER (q.low <= p.exit_stop OR q.high >= p.target_1) AS lo
      FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM plan) p
      LEFT JOIN bars q ON q.symbol = p.symbol AND q.rn BETWEEN p.rn + 4 AND p.rn + 21 GROUP BY 1, 2)""")
    oracle("l17_period_metrics", chain(BARS, RET), """
SELECT sector, count(*) AS sessions, exp(sum(ln(1 + x)) * 250 / count(*)) - 1 AS cagr, stddev_samp(x) * sqrt(250) AS volatility,
  avg(x) / stddev_samp(x) * sqrt(250) AS sharpe, avg(x) / sqrt(avg(least(x, 0) ** 2)) * sqrt(250) AS sortino, min(x) AS tail_loss
FROM (SELECT sector, trading_date, avg(r) AS x FROM ret GROUP BY 1, 2) WHERE x IS NOT NULL GROUP BY 1""")
    oracle("l21_hit_rates", chain(FEAT, NEXT, _taken("trend_confirmed")), """
SELECT sector, count(net_return) AS n, avg((net_return > 0)::INT) AS win_probability FROM taken WHERE filled AND net_return IS NOT NULL
GROUP BY 1 HAVING count(net_return) >= 30""")
    oracle("l22_trend_transitions", BARS, f"""
SELECT symbol, state, n, p_up, p_down, p_side, 1 / (1 - CASE state WHEN 'UP' THEN p_up WHEN 'DOWN' THEN p_down ELSE p_side END) AS expected_duration
FROM (SELECT symbol, state, count(*) AS n, (count(*) FILTER (nx = 'UP') + 1) / (count(*) + 3) AS p_up, (count(*) FILTER (nx = 'DOWN') + 1) / (count(*) + 3) AS p_down,
        (count(*) FILTER (nx = 'SIDE') + 1) / (count(*) + 3) AS p_side, sum(count(*)) OVER (PARTITION BY symbol) AS t
      FROM (SELECT *, lead(state) {W} AS nx FROM (
        SELECT symbol, trading_date, CASE WHEN close > ma50 AND ma50 > ma200 THEN 'UP' WHEN close < ma50 AND ma50 < ma200 THEN 'DOWN' ELSE 'SIDE' END AS state
        FROM (SELECT symbol, trading_date, close, {mean('close', 50)} AS ma50, {mean('close', 200)} AS ma200 FROM bars) WHERE ma200 IS NOT NULL))
      WHERE nx IS NOT NULL GROUP BY 1, 2) WHERE t >= 50""")
    oracle("l23_ewma_volatility", chain(BARS, RET, """
ev AS (SELECT symbol, rn, r * r AS y FROM ret WHERE rn = 2
  UNION ALL SELECT t.symbol, t.rn, 0.94 * e.y + (1 - 0.94) * t.r * t.r FROM ev e JOIN ret t ON t.symbol = e.symbol AND t.rn = e.rn + 1)"""), """
SELECT b.symbol, b.trading_date, sqrt(y * 250) AS ewma_vol FROM bars b LEFT JOIN ev USING (symbol, rn)""")
    oracle("l25_rank_ic", ewx, f"""
SELECT trading_date, count(*) AS symbols, corr(x, y) AS rank_ic FROM (
  SELECT trading_date, rank() OVER (PARTITION BY trading_date ORDER BY volume) + (count(*) OVER (PARTITION BY trading_date, volume) - 1) / 2 AS x,
    rank() OVER (PARTITION BY trading_date ORDER BY excess_5) + (count(*) OVER (PARTITION BY trading_date, excess_5) - 1) / 2 AS y
  FROM ({_fwd((5,))}) WHERE excess_5 IS NOT NULL) GROUP BY 1""")
    oracle("l26_gap_action", chain(BARS, NEXT, RET, STATS), """
SELECT symbol, trading_date, g AS overnight_gap, CASE WHEN g >= 0.07 THEN 'CANCEL' WHEN g < -0.02 THEN 'REVIEW' WHEN g <= t * 0.5 THEN 'PROCEED'
  WHEN g <= t THEN 'REDUCE' ELSE 'CANCEL' END AS action
FROM (SELECT symbol, trading_date, gap AS g, least(0.02, gap_p90) AS t FROM ent JOIN (SELECT symbol, gap_p90 FROM stats) USING (symbol) WHERE gap IS NOT NULL)""")
    oracle("l10_gate_funnel", chain(FEAT, RS, SECTORS, EW, BREADTH, CAP, REGIME, PLAN, RET, STATS), """
SELECT trading_date, CASE WHEN NOT regime_level > 0 THEN 'GATE0_REGIME' WHEN archetype = 'EXCLUDED' THEN 'GATE1_ELIGIBILITY'
  WHEN NOT coalesce(a.rs_stock_market_rank_126 >= 60 AND b.rs_stock_market_rank_20 <= 40, false) THEN 'GATE4A_DUAL_CONDITION'
  WHEN NOT (signal_pullback OR signal_reversal) THEN 'GATE4B_SETUP' WHEN NOT coalesce(plan_valid AND r_unit / atr14 >= 0.8, false) THEN 'GATE5_GEOMETRY'
  ELSE 'PASSED' END AS gate, count(*) AS rows
FROM plan JOIN rs126 a USING (symbol, trading_date) JOIN rs20 b USING (symbol, trading_date) JOIN regime USING (trading_date) JOIN arch USING (symbol)
GROUP BY 1, 2""")
