"""SQL answers for market structure, the volume profile, normalised values, h-step states and drift."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, EW, FEAT, W, chain, mean
from eqpanel.plans.profile_oracles import RET, _fwd
from eqpanel.plans.registry import oracle

# a swing is looked for at its own bar and then handed to the bar that confirms it
SWINGS = """
cand AS MATERIALIZED (
  SELECT b.symbol, b.rn, b.high, b.low,
    NOT EXISTS (SELECT 1 FROM bars o WHERE o.symbol = b.symbol AND (o.rn BETWEEN b.rn - 3 AND b.rn - 1 AND o.high >= b.high OR o.rn BETWEEN b.rn + 1 AND b.rn + 3 AND o.high > b.high)) AS is_high,
    NOT EXISTS (SELECT 1 FROM bars o WHERE o.symbol = b.symbol AND (o.rn BETWEEN b.rn - 3 AND b.rn - 1 AND o.low <= b.low OR o.rn BETWEEN b.rn + 1 AND b.rn + 3 AND o.low < b.low)) AS is_low
  FROM bars b WHERE b.rn > 3),
swg AS MATERIALIZED (
  SELECT *, last_value(pivot_high IGNORE NULLS) OVER u AS swing_high, last_value(pivot_low IGNORE NULLS) OVER u AS swing_low FROM (
    SELECT f.symbol, f.trading_date, f.rn, f.open, f.high, f.low, f.close, f.volume, f.atr14,
      CASE WHEN c.is_high THEN c.high END AS pivot_high, CASE WHEN c.is_low THEN c.low END AS pivot_low
    FROM feat f LEFT JOIN cand c ON c.symbol = f.symbol AND c.rn = f.rn - 3)
  WINDOW u AS (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)),
mov AS MATERIALIZED (
  SELECT *, lag(close) OVER w AS pc, abs(close - lag(close) OVER w) AS move, lag(close, 20) OVER w AS from20, lag(high, 2) OVER w AS up2, lag(low, 2) OVER w AS dn2
  FROM swg WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
rng AS MATERIALIZED (
  SELECT *, coalesce(abs(close - from20) <= 0.35::DOUBLE * sum(move) OVER s AND avg(move) OVER s <= CASE WHEN count(move) OVER l >= 40 THEN avg(move) OVER l END, false) AS range_state,
    coalesce(close > swing_high AND volume > avg(volume) OVER s AND high - low > avg(high - low) OVER s, false) AS strong,
    coalesce(close > swing_high AND (pc IS NULL OR pc <= swing_high), false) AS bos_up, coalesce(close < swing_low AND (pc IS NULL OR pc >= swing_low), false) AS bos_down,
    coalesce(low < swing_low AND close > swing_low, false) AS sweep_low, coalesce(high > swing_high AND close < swing_high, false) AS sweep_high
  FROM mov WINDOW s AS (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING), l AS (PARTITION BY symbol ORDER BY rn ROWS 59 PRECEDING))"""

PROFILE = """
pts AS MATERIALIZED (SELECT symbol, year(trading_date) AS year, high + low + close AS t, volume AS v FROM bars WHERE volume > 0),
spn AS (SELECT symbol, year, min(t) AS lo, max(t) AS hi, sum(v)::BIGINT AS total, count(*) AS rows FROM pts GROUP BY 1, 2),
bns AS MATERIALIZED (
  SELECT symbol, year, CASE WHEN hi = lo THEN 0 ELSE least(23, (t - lo) * 24 // (hi - lo)) END AS b, sum(v)::BIGINT AS v FROM pts JOIN spn USING (symbol, year) GROUP BY 1, 2, 3),
poc AS (SELECT symbol, year, min(b) AS p, max(v) AS v FROM (SELECT *, max(v) OVER (PARTITION BY symbol, year) AS m FROM bns) WHERE v = m GROUP BY 1, 2),
grw AS (
  SELECT symbol, year, p, p AS a, p AS z, poc.v AS v, total, 0 AS k FROM poc JOIN spn USING (symbol, year)
  UNION ALL
  SELECT symbol, year, p, CASE WHEN up THEN a ELSE a - 1 END, CASE WHEN up THEN z + 1 ELSE z END, v + CASE WHEN up THEN coalesce(vu, 0) ELSE coalesce(vd, 0) END, total, k + 1
  FROM (SELECT g.*, u.v AS vu, d.v AS vd, z < 23 AND (a = 0 OR coalesce(u.v, 0) >= coalesce(d.v, 0)) AS up
    FROM grw g LEFT JOIN bns u ON u.symbol = g.symbol AND u.year = g.year AND u.b = g.z + 1 LEFT JOIN bns d ON d.symbol = g.symbol AND d.year = g.year AND d.b = g.a - 1
    WHERE g.v * 100 < g.total * 70)),
prf AS MATERIALIZED (
  SELECT symbol, year, rows, spn.total AS volume, lo / 3 AS low_edge, hi / 3 AS high_edge, (lo + p * (hi - lo) / 24) / 3 AS poc_low, (lo + (p + 1) * (hi - lo) / 24) / 3 AS poc_high,
    (lo + a * (hi - lo) / 24) / 3 AS value_area_low, (lo + (z + 1) * (hi - lo) / 24) / 3 AS value_area_high, v / spn.total AS value_area_share, 'EOD Volume Profile proxy' AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY k DESC) AS n FROM grw) JOIN spn USING (symbol, year) WHERE n = 1)"""

LIQUID = f"""
liq AS MATERIALIZED (
  SELECT symbol, trading_date, close, adv, CASE WHEN adv IS NOT NULL THEN (rank() OVER (PARTITION BY trading_date ORDER BY adv NULLS LAST)
      + (count(*) OVER (PARTITION BY trading_date, adv) - 1) / 2) / count(adv) OVER (PARTITION BY trading_date) * 100 END AS liquidity_percentile
  FROM (SELECT symbol, trading_date, close, {mean('value', 20)} AS adv FROM bars))"""


def _percentile(column: str) -> str:
    return f"""SELECT f.symbol, f.trading_date, CASE WHEN f.{column} IS NOT NULL AND count(o.{column}) >= 60 THEN
    (count(*) FILTER (o.{column} < f.{column}) + (count(*) FILTER (o.{column} = f.{column}) + 1) / 2) / count(o.{column}) * 100 END AS p
  FROM (SELECT * REPLACE (round({column}, 8) AS {column}) FROM feat) f JOIN (SELECT * REPLACE (round({column}, 8) AS {column}) FROM feat) o ON o.symbol = f.symbol AND o.rn BETWEEN f.rn - 251 AND f.rn GROUP BY f.symbol, f.trading_date, f.{column}"""


# bisection on the power series of the normal distribution, once per distinct share
SCORE = """
held AS MATERIALIZED (
  SELECT symbol, trading_date, r, greatest(least(r, quantile_cont(r, 0.99) OVER d), quantile_cont(r, 0.01) OVER d) AS x, count(r) OVER d AS n
  FROM ret WINDOW d AS (PARTITION BY trading_date)),
rnk AS MATERIALIZED (
  SELECT symbol, trading_date, CASE WHEN r IS NOT NULL THEN rank() OVER (PARTITION BY trading_date ORDER BY CASE WHEN r IS NOT NULL THEN x END NULLS LAST)
    + (count(*) OVER (PARTITION BY trading_date, CASE WHEN r IS NOT NULL THEN x END) - 1) / 2 - 0.5 END AS k, n FROM held),
shr AS MATERIALIZED (SELECT DISTINCT k, n, k / n AS p FROM rnk WHERE k IS NOT NULL),
bsc AS (
  SELECT k, n, p, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS i FROM shr
  UNION ALL
  SELECT k, n, p, CASE WHEN c < p THEN x ELSE lo END, CASE WHEN c < p THEN hi ELSE x END, i + 1
  FROM (SELECT *, 0.5 + sign(x) * exp(-x * x / 2) / sqrt(2 * pi()) * list_sum([exp((2 * j + 1) * ln(abs(x) + 1e-300) - (lgamma(j + 1.5) + (j + 1) * ln(2) - 0.5 * ln(pi()))) FOR j IN range(0, 100)]) AS c
        FROM (SELECT *, (lo + hi) / 2 AS x FROM bsc)) WHERE i < 45)"""

NATIONS = f"""
nbar AS MATERIALIZED (
  SELECT symbol, trading_date, CAST(greatest(20000 + 100 * sum(dm) OVER (PARTITION BY symbol ORDER BY trading_date ROWS UNBOUNDED PRECEDING), 1000) AS BIGINT) AS close
  FROM (SELECT 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS symbol, CAST(l_shipdate AS DATE) AS trading_date, CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS BIGINT) AS dm
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)),
nst AS (
  SELECT *, lead(state) {W} AS nx FROM (
    SELECT symbol, trading_date, CASE WHEN close > ma50 AND ma50 > ma200 THEN 'UP' WHEN close < ma50 AND ma50 < ma200 THEN 'DOWN' ELSE 'SIDE' END AS state
    FROM (SELECT symbol, trading_date, close, {mean('close', 50)} AS ma50, {mean('close', 200)} AS ma200 FROM nbar) WHERE ma200 IS NOT NULL)),
big AS (SELECT symbol FROM nst WHERE nx IS NOT NULL GROUP BY 1 HAVING count(*) >= 200),
stp AS MATERIALIZED (
  SELECT s.symbol, a.x AS i, b.x AS j, (count(n.nx) FILTER (n.nx = b.x) + 1) / (count(n.nx) + 3) AS p
  FROM big s, (SELECT unnest(['UP', 'DOWN', 'SIDE']) AS x) a, (SELECT unnest(['UP', 'DOWN', 'SIDE']) AS x) b, LATERAL (SELECT 1) z
  LEFT JOIN nst n ON n.symbol = s.symbol AND n.state = a.x GROUP BY 1, 2, 3),
p2 AS MATERIALIZED (SELECT a.symbol, a.i, b.j, sum(a.p * b.p) AS p FROM stp a JOIN stp b ON a.symbol = b.symbol AND a.j = b.i GROUP BY 1, 2, 3),
p3 AS MATERIALIZED (SELECT a.symbol, a.i, b.j, sum(a.p * b.p) AS p FROM p2 a JOIN stp b ON a.symbol = b.symbol AND a.j = b.i GROUP BY 1, 2, 3),
p5 AS (SELECT a.symbol, a.i, b.j, sum(a.p * b.p) AS p FROM p2 a JOIN p3 b ON a.symbol = b.symbol AND a.j = b.i GROUP BY 1, 2, 3)"""


DRIFT = f"""
dxs AS MATERIALIZED (
  SELECT 'return' AS factor, year(trading_date) AS y, r AS x FROM ret WHERE r IS NOT NULL UNION ALL SELECT 'value', year(trading_date), value::DOUBLE FROM ret),
dcut AS MATERIALIZED (
  SELECT factor, [{", ".join(f"quantile_cont(x, {i / 10})" for i in range(1, 10))}] AS q
  FROM (SELECT *, min(y) OVER (PARTITION BY factor) AS f FROM dxs) WHERE y = f GROUP BY 1)"""


# the sign test's normal probability by the power series
COLUMNS = f"""
lgc AS (
  SELECT h, l, CASE WHEN abs(z) > 12 THEN (z > 0)::INT ELSE
    0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([exp((2 * j + 1) * ln(abs(z) + 1e-300) - (lgamma(j + 1.5) + (j + 1) * ln(2) - 0.5 * ln(pi()))) FOR j IN range(0, 300)]) END AS sure
  FROM (SELECT avg((high >= greatest(open, close, low))::INT) AS h, avg((low <= least(open, close, high))::INT) AS l,
          (count(*) FILTER (x < 0) - count(*) FILTER (x > 0)) / sqrt(count(*) FILTER (x <> 0)) AS z
        FROM (SELECT *, abs(open - lag(close) {W}) - abs(close - lag(open) {W}) AS x FROM bars)))"""


def _ic(factor: str) -> str:
    return f"""SELECT '{factor}' AS factor, trading_date, corr(x, y) AS ic FROM (
    SELECT f.trading_date, rank() OVER (PARTITION BY f.trading_date ORDER BY b.{factor}) + (count(*) OVER (PARTITION BY f.trading_date, b.{factor}) - 1) / 2 AS x,
      rank() OVER (PARTITION BY f.trading_date ORDER BY excess_5) + (count(*) OVER (PARTITION BY f.trading_date, excess_5) - 1) / 2 AS y
    FROM ({_fwd((5,))}) f JOIN bars b USING (symbol, trading_date) WHERE excess_5 IS NOT NULL) GROUP BY 2"""


def register() -> None:
    oracle("l05_market_structure", chain(FEAT, SWINGS), """
SELECT symbol, trading_date, pivot_high, pivot_low, swing_high, swing_low, range_state, bos_up, bos_down, sweep_low, sweep_high,
  coalesce(low > up2, false) AS fvg_up, coalesce(high < dn2, false) AS fvg_down,
  coalesce(lag(sweep_low AND range_state, 2) OVER w AND least(close, lag(close) OVER w) >= lag(swing_low, 2) OVER w, false) AS spring,
  coalesce(lag(sweep_high AND range_state, 2) OVER w AND greatest(close, lag(close) OVER w) <= lag(swing_high, 2) OVER w, false) AS upthrust,
  coalesce(lag(strong) OVER w AND close > lag(swing_high) OVER w, false) AS sign_of_strength,
  CASE WHEN bos_up AND move >= atr14 THEN bear.l WHEN bos_down AND move >= atr14 THEN bull.l END AS order_block_low,
  CASE WHEN bos_up AND move >= atr14 THEN bear.h WHEN bos_down AND move >= atr14 THEN bull.h END AS order_block_high
FROM (SELECT *, last_value(CASE WHEN close < open THEN struct_pack(l := low, h := high) END IGNORE NULLS) OVER p AS bear,
        last_value(CASE WHEN close > open THEN struct_pack(l := low, h := high) END IGNORE NULLS) OVER p AS bull
      FROM rng WINDOW p AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WINDOW w AS (PARTITION BY symbol ORDER BY rn)""")
    oracle("l06_volume_profile", chain(BARS, PROFILE), "SELECT * FROM prf")
    oracle("l06_profile_score", chain(BARS, PROFILE, LIQUID), """
SELECT symbol, trading_date, CASE WHEN close > value_area_high THEN 1 WHEN close >= value_area_low THEN 0.5 ELSE 0 END * liquidity_percentile / 100 AS vp_score
FROM liq JOIN prf USING (symbol) WHERE prf.year = year(trading_date) - 1""")
    oracle("l07_rolling_percentiles", FEAT, f"""
SELECT symbol, trading_date, a.p AS rsi14_percentile_252, b.p AS value_percentile_252 FROM ({_percentile('rsi14')}) a JOIN ({_percentile('value')}) b USING (symbol, trading_date)""")
    for name in ("l07_liquidity_percentile", "l07_liquidity_percentile_split"):
        oracle(name, chain(BARS, LIQUID), "SELECT symbol, trading_date, adv, liquidity_percentile FROM liq")
    for name in ("l07_normal_scores", "l07_normal_scores_split"):
        oracle(name, chain(BARS, RET, SCORE), "SELECT symbol, trading_date, (lo + hi) / 2 AS score FROM rnk LEFT JOIN (SELECT * FROM bsc WHERE i = 45) USING (k, n)")
    oracle("l22_h_step_states", NATIONS, """
SELECT symbol, i AS state, 5 AS steps, max(p) FILTER (j = 'UP') AS p_up, max(p) FILTER (j = 'DOWN') AS p_down, max(p) FILTER (j = 'SIDE') AS p_side FROM p5 GROUP BY 1, 2""")
    f = "OVER (PARTITION BY factor ORDER BY trading_date ROWS 59 PRECEDING)"
    oracle("l25_rolling_ic", chain(BARS, EW), f"""
SELECT factor, trading_date, n AS sessions, CASE WHEN n >= 20 THEN m END AS mean_ic, CASE WHEN n >= 20 THEN m - 1.959963984540054 * s / sqrt(n) END AS ic_low,
  CASE WHEN n >= 20 THEN m + 1.959963984540054 * s / sqrt(n) END AS ic_high, CASE WHEN n >= 20 THEN m / nullif(s / sqrt(n), 0) END AS t_ratio
FROM (SELECT factor, trading_date, count(ic) {f} AS n, avg(ic) {f} AS m, stddev_samp(ic) {f} AS s FROM ({_ic('volume')} UNION ALL {_ic('value')}))""")
    oracle("l25_drift", chain(BARS, RET, DRIFT), """
SELECT factor, y AS period, sum(k)::BIGINT AS rows, sum((p - p0) * ln(p / p0)) AS drift, sum((p - p0) * ln(p / p0)) >= 0.2 AS drifted
FROM (SELECT *, first_value(p) OVER (PARTITION BY factor, b ORDER BY y) AS p0 FROM (
  SELECT factor, y, b, k, (k + 0.5) / (sum(k) OVER (PARTITION BY factor, y) + 5) AS p FROM (
    SELECT g.factor, g.y, g.b, count(c.b) AS k FROM (SELECT * FROM (SELECT DISTINCT factor, y FROM dxs), (SELECT unnest(range(0, 10)) AS b)) g
    LEFT JOIN (SELECT factor, y, len([c FOR c IN q IF c < x]) AS b FROM dxs JOIN dcut USING (factor)) c USING (factor, y, b) GROUP BY 1, 2, 3)))
GROUP BY 1, 2""")
    oracle("l13_column_identity", chain(BARS, COLUMNS), """
SELECT layout, role, col AS "column", method,
  CASE WHEN role IN ('open', 'close') THEN CASE WHEN layout = 'doubled' THEN 0.5 ELSE sure END WHEN role = 'high' THEN h WHEN role = 'low' THEN l ELSE 1 END AS confidence,
  layout <> 'doubled' AS accepted, CASE WHEN layout = 'doubled' THEN 'below 0.95: close, open' END AS problem
FROM (SELECT layout, role, col, method FROM (SELECT unnest([
    ('named', 'HEADER', ['Ngày', '<Ticker>', 'Open', 'HIGH', 'low', 'Close', 'Vol']), ('unnamed', 'SHAPE', ['c3', 'c6', 'c5', 'c7', 'c4', 'c2', 'c1']),
    ('swapped', 'SHAPE', ['Ngày', '<Ticker>', 'Vol', 'HIGH', 'low', 'Close', 'Open']), ('doubled', 'SHAPE', ['c3', 'c6', 'c2', 'c7', 'c4', 'c5', 'c1'])]) AS x),
  LATERAL (SELECT x[1] AS layout, x[2] AS method, unnest(['trading_date', 'symbol', 'open', 'high', 'low', 'close', 'volume']) AS role, unnest(x[3]) AS col)), lgc
UNION ALL
SELECT 'turnover', role, CASE role WHEN 'trading_date' THEN 'c3' WHEN 'symbol' THEN 'c6' END, 'SHAPE', NULL, false, '2 columns look like volume'
FROM (SELECT unnest(['trading_date', 'symbol', 'open', 'high', 'low', 'close', 'volume']) AS role)""")
