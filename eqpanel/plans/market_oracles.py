"""Plain SQL answers for the panel queries."""

from __future__ import annotations

from eqpanel.plans.registry import oracle

BARS = """
weekly AS MATERIALIZED (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS symbol, l_suppkey AS suppkey,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS trading_date,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS BIGINT) AS dm,
         max(CAST(round(l_tax * 100) AS BIGINT)) AS tx,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS volume,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value
  FROM lineitem GROUP BY 1, 2, 3),
closes AS (
  SELECT *, CAST(greatest(20000 + 100 * sum(dm) OVER (PARTITION BY symbol ORDER BY trading_date
                 ROWS UNBOUNDED PRECEDING), 1000) AS BIGINT) AS close FROM weekly),
opens AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trading_date), close)
            + 50 * (volume % 21 - 10) AS open FROM closes),
places AS (SELECT n_nationkey, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey),
sec AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS symbol, s_suppkey AS suppkey,
         p.sector, q.sector AS later_sector
  FROM supplier JOIN places p ON s_nationkey = p.n_nationkey
  JOIN places q ON q.n_nationkey = (s_nationkey + 7) % 25),
bars AS MATERIALIZED (
  SELECT o.symbol, o.trading_date, open, greatest(open, close) + 10 * tx AS high,
         greatest(least(open, close) - 10 * tx, 10) AS low, close, volume, value,
         'p1' AS provider, s.sector,
         row_number() OVER (PARTITION BY o.symbol ORDER BY o.trading_date) AS rn
  FROM opens o LEFT JOIN sec s ON s.symbol = o.symbol)"""

W = "OVER (PARTITION BY symbol ORDER BY trading_date)"


def frame(n: int, part: str = "PARTITION BY symbol") -> str:
    return f"OVER ({part} ORDER BY trading_date ROWS {n - 1} PRECEDING)"


def mean(x: str, n: int, least: int | None = None, part: str = "PARTITION BY symbol") -> str:
    f = frame(n, part)
    return f"CASE WHEN count({x}) {f} >= {least or n} THEN avg({x}) {f} END"


def zscore(x: str) -> str:
    f = frame(60)
    return f"CASE WHEN count({x}) {f} >= 20 THEN ({x} - avg({x}) {f}) / nullif(stddev_pop({x}) {f}, 0) END"


SMOOTH = """
moves AS MATERIALIZED (
  SELECT *, lag(close) OVER w AS prev, close - lag(close) OVER w AS change FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)),
inputs AS MATERIALIZED (
  SELECT symbol, rn, close::DOUBLE AS c, volume::DOUBLE AS v,
         greatest(abs(high - low), abs(high - coalesce(prev, high)), abs(low - coalesce(prev, low)))::DOUBLE AS tr,
         greatest(change, 0)::DOUBLE AS up, greatest(-change, 0)::DOUBLE AS dn FROM moves),
smooth AS (
  SELECT symbol, rn, c AS e20, c AS e50, c AS e200, v AS rv, tr AS atr,
         NULL::DOUBLE AS au, NULL::DOUBLE AS ad FROM inputs WHERE rn = 1
  UNION ALL
  SELECT i.symbol, i.rn, (1 - 2.0/21) * s.e20 + 2.0/21 * c, (1 - 2.0/51) * s.e50 + 2.0/51 * c,
         (1 - 2.0/201) * s.e200 + 2.0/201 * c, 13.0/14 * s.rv + v / 14, 13.0/14 * s.atr + tr / 14,
         CASE WHEN i.rn = 2 THEN up ELSE 13.0/14 * s.au + up / 14 END,
         CASE WHEN i.rn = 2 THEN dn ELSE 13.0/14 * s.ad + dn / 14 END
  FROM smooth s JOIN inputs i ON i.symbol = s.symbol AND i.rn = s.rn + 1),
smoothed AS MATERIALIZED (SELECT * FROM smooth)"""

FEATURES = f"""
raw AS MATERIALIZED (
  SELECT b.*, s.atr, s.au, s.ad,
         lag(close) {W} AS prev,
         close::DOUBLE / lag(close, 1) {W} - 1 AS ret_1,
         close::DOUBLE / lag(close, 20) {W} - 1 AS ret_20,
         close::DOUBLE / lag(close, 126) {W} - 1 AS ret_126,
         {mean('close', 20)} AS ma20, {mean('close', 50)} AS ma50, {mean('close', 200)} AS ma200,
         CASE WHEN rn >= 20 THEN e20 END AS ema20, CASE WHEN rn >= 50 THEN e50 END AS ema50,
         CASE WHEN rn >= 200 THEN e200 END AS ema200,
         {mean('volume', 5)} AS v5, {mean('volume', 20)} AS v20,
         CASE WHEN rn >= 14 THEN s.atr END AS atr14,
         CASE WHEN rn >= 15 THEN CASE WHEN s.ad = 0 THEN 100 ELSE 100 - 100 / (1 + s.au / s.ad) END END AS rsi14,
         {zscore('volume')} AS volume_z60, {zscore('value')} AS turnover_z60
  FROM bars b JOIN smoothed s USING (symbol, rn)),
flags AS MATERIALIZED (
  SELECT *, atr14 / close AS atr_pct, abs(close - prev) / nullif(atr14, 0) AS displacement_atr,
         coalesce(ma20 > ma50 AND ma50 > ma200 AND close > ma200, false) AS trend_confirmed,
         close / ma20 - 1 AS dist, coalesce(close > open AND close > prev, false) AS reclaim
  FROM raw),
feat AS MATERIALIZED (
  SELECT *,
    coalesce(trend_confirmed AND close > ma200 * 1.02 AND dist BETWEEN -0.04 AND 0.02
             AND v5 < v20 * 1.10 AND reclaim, false) AS signal_pullback,
    coalesce(rsi14 < 32 AND close > prev AND close > ma200
             AND (close - low)::DOUBLE / nullif(high - low, 0) > 0.60, false) AS signal_reversal,
    CASE WHEN dist IS NOT NULL AND atr_pct IS NOT NULL THEN greatest(0, least(1,
      0.35 * trend_confirmed::INT + 0.25 * (1 - greatest(0, least(1, abs(dist) / 0.06)))
      + 0.20 * reclaim::INT + 0.20 * (1 - greatest(0, least(1, atr_pct / 0.08))))) END AS setup_quality,
    greatest(0, least(1, 0.5 + 0.2 * coalesce(volume_z60, 0))) AS volume_confirmation
  FROM flags)"""


def _rs_cte(h: int) -> str:
    def rank(x: str, part: str) -> str:
        return (
            f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST)"
            f" + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"
            f" / count({x}) OVER (PARTITION BY {part}) * 100 END"
        )

    return f"""
ret{h} AS (SELECT symbol, trading_date, sector, close::DOUBLE / lag(close, {h}) {W} - 1 AS r FROM bars),
grp{h} AS MATERIALIZED (
  SELECT *, avg(r) OVER (PARTITION BY trading_date) AS m, avg(r) OVER (PARTITION BY trading_date, sector) AS s
  FROM ret{h}),
exc{h} AS (SELECT *, r - m AS a, r - s AS b, s - m AS c FROM grp{h}),
rs{h} AS MATERIALIZED (
  SELECT symbol, trading_date, m AS market_return_{h}, s AS sector_return_{h}, a AS rs_stock_market_{h},
         b AS rs_stock_sector_{h}, c AS rs_sector_market_{h},
         {rank('a', 'trading_date')} AS rs_stock_market_rank_{h},
         {rank('b', 'trading_date, sector')} AS rs_stock_sector_rank_{h},
         {rank('c', 'trading_date')} AS rs_sector_market_rank_{h}
  FROM exc{h})"""


RS = _rs_cte(20) + "," + _rs_cte(126)

EW = f"""
ewr AS (
  SELECT trading_date, coalesce(avg(r), 0) AS r FROM (
    SELECT trading_date, close::DOUBLE / lag(close) {W} - 1 AS r FROM bars) GROUP BY 1),
ewc AS MATERIALIZED (
  SELECT trading_date, 1000 * product(1 + r) OVER (ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS close FROM ewr),
ew AS MATERIALIZED (
  SELECT trading_date, close, {mean('close', 20, part='')} AS ma20, {mean('close', 50, part='')} AS ma50,
         {mean('close', 200, part='')} AS ma200 FROM ewc)"""

BREADTH = f"""
bm AS (
  SELECT *, {mean('close', 20)} AS ma20, {mean('close', 50)} AS ma50, {mean('close', 200)} AS ma200,
         close - lag(close) {W} AS diff FROM bars),
bd AS (
  SELECT trading_date, avg(coalesce(close > ma20, false)::INT) AS pct_ma20,
         avg(coalesce(close > ma50, false)::INT) AS pct_ma50,
         avg(coalesce(close > ma200, false)::INT) AS pct_ma200,
         count(*) FILTER (diff > 0) AS advances, count(*) FILTER (diff < 0) AS decreases,
         CAST(sum(value) AS BIGINT) AS turnover FROM bm GROUP BY 1),
bl AS (
  SELECT *, advances - decreases AS ad_net,
         CAST(sum(advances - decreases) OVER (ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ad_line
  FROM bd),
breadth AS MATERIALIZED (
  SELECT *, ad_line - lag(ad_line, 10) OVER (ORDER BY trading_date) AS ad_slope_10,
         {mean('turnover', 20, 10, part='')} AS turnover_ma20,
         turnover / nullif({mean('turnover', 20, 10, part='')}, 0) AS turnover_ratio FROM bl)"""

CAP = f"""
lastday AS (SELECT max(trading_date) AS d FROM bars),
level AS MATERIALIZED (
  SELECT trading_date, sum(close * volume)::DOUBLE / sum(volume) AS close, sum(value)::DOUBLE AS turnover
  FROM bars GROUP BY 1),
ixb AS MATERIALIZED (
  SELECT 'IDXA' AS index_code, l.* FROM level l, lastday WHERE trading_date < d
  UNION ALL SELECT 'IDXB', l.* FROM level l),
ixm AS (
  SELECT *, {mean('close', 20, part='PARTITION BY index_code')} AS ma20,
         {mean('close', 50, part='PARTITION BY index_code')} AS ma50,
         {mean('close', 200, part='PARTITION BY index_code')} AS ma200,
         {mean('turnover', 20, 10, part='PARTITION BY index_code')} AS turnover_ma20 FROM ixb),
ixi AS MATERIALIZED (SELECT *, turnover / nullif(turnover_ma20, 0) AS turnover_ratio FROM ixm),
cap AS MATERIALIZED (
  SELECT trading_date, 'OFFICIAL_' || arg_min(index_code, index_code) AS cap_index_mode,
         NULL::VARCHAR AS cap_index_warning, arg_min(close, index_code) AS close,
         min_by(row(ma20, ma50, ma200, turnover_ratio), index_code) AS x
  FROM ixi GROUP BY 1),
capx AS MATERIALIZED (
  SELECT trading_date, cap_index_mode, cap_index_warning, close, x[1] AS ma20, x[2] AS ma50, x[3] AS ma200,
         x[4] AS turnover_ratio FROM cap)"""

SCORE = "CASE WHEN {t}.ma50 IS NULL OR {t}.ma200 IS NULL THEN 0 ELSE ({t}.close > {t}.ma50)::INT + ({t}.close > {t}.ma200)::INT + ({t}.ma50 > {t}.ma200)::INT END"
REGIME = f"""
rgi AS (
  SELECT b.trading_date, {SCORE.format(t='c')} AS cap_score, {SCORE.format(t='e')} AS ew_score,
         b.pct_ma50 AS b50, coalesce(b.ad_slope_10 > 0, false) AS up, c.turnover_ratio AS tr
  FROM breadth b LEFT JOIN ew e USING (trading_date) LEFT JOIN capx c USING (trading_date)),
rgl AS (
  SELECT *, CASE
    WHEN least(cap_score, ew_score) = 3 AND b50 >= 0.60 AND up AND tr >= 1.00 THEN 4
    WHEN least(cap_score, ew_score) >= 2 AND b50 >= 0.45 AND tr >= 0.85 THEN 3
    WHEN least(cap_score, ew_score) >= 1 AND b50 >= 0.35 THEN 2
    WHEN least(cap_score, ew_score) >= 1 OR b50 >= 0.25 THEN 1 ELSE 0 END AS lv FROM rgi),
regime AS MATERIALIZED (
  SELECT trading_date,
    ['PANIC_BEAR', 'RISK_OFF', 'RANGE', 'CONCENTRATED_BULL', 'STRONG_BULL'][lv + 1] AS regime,
    lv::BIGINT AS regime_level, cap_score::BIGINT AS cap_score, ew_score::BIGINT AS ew_score,
    b50 AS breadth_pct_ma50, tr AS turnover_ratio,
    CASE WHEN lv = 4 THEN 'both indices trend, breadth and turnover agree'
         WHEN lv = 3 THEN 'upward trend, breadth or turnover only in part'
         WHEN lv = 2 AND tr IS NULL THEN 'sideways; without turnover no bull state'
         WHEN lv = 2 THEN 'trend and breadth disagree' WHEN lv = 1 THEN 'trend or breadth is poor'
         ELSE 'trend and breadth are poor' END AS reason
  FROM rgl)"""


def _pct_rank(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trading_date ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY trading_date, {x}) - 1) / 2.0)"
        f" / count({x}) OVER (PARTITION BY trading_date) END"
    )


SECTORS = f"""
scr AS (
  SELECT trading_date, sector, count(DISTINCT symbol) AS members, median(rs_sector_market_20) AS rs20,
         median(rs_sector_market_126) AS rs126, avg(coalesce(close > ma50, false)::INT) AS breadth,
         median(volume_z60) AS volume_impulse
  FROM feat JOIN rs20 USING (symbol, trading_date) JOIN rs126 USING (symbol, trading_date)
  WHERE sector IS NOT NULL GROUP BY 1, 2),
sck AS (
  SELECT *, {_pct_rank('rs20')} AS rs20_rank, {_pct_rank('rs126')} AS rs126_rank,
         {_pct_rank('breadth')} AS breadth_rank, {_pct_rank('volume_impulse')} AS volume_impulse_rank FROM scr),
scl AS (
  SELECT *, 100 * (0.30 * rs20_rank + 0.30 * rs126_rank + 0.25 * breadth_rank + 0.15 * volume_impulse_rank)
         AS leadership_score FROM sck),
sectors AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY round(leadership_score, 9) DESC NULLS LAST, sector)
         AS sector_rank FROM scl)"""


def chain(*parts: str) -> str:
    return ",".join(p.strip() if i else p for i, p in enumerate(parts))


FEAT = chain(BARS, SMOOTH, FEATURES)


def register() -> None:
    b = BARS
    oracle("panel_bars", b, "SELECT symbol, trading_date, open, high, low, close, volume, value, provider, sector FROM bars")
    oracle("e01_returns", b, "SELECT symbol, trading_date, " + ", ".join(
        f"close::DOUBLE / lag(close, {k}) {W} - 1 AS ret_{k}" for k in (1, 20, 126)) + " FROM bars")
    oracle("e02_difference", b, f"SELECT symbol, trading_date, lag(close) {W} AS previous_close, close - lag(close) {W} AS diff FROM bars")
    oracle("e03_rolling_mean", b, "SELECT symbol, trading_date, " + ", ".join(
        f"{mean(x, n)} AS {a}" for x, n, a in
        [("close", 20, "ma20"), ("close", 50, "ma50"), ("close", 200, "ma200"), ("volume", 5, "vol5"), ("volume", 20, "vol20")]
    ) + " FROM bars")
    oracle("e04_rolling_mean_min_obs", b, f"SELECT symbol, trading_date, {mean('value', 20, 10)} AS value_ma20 FROM bars")
    oracle("e05_rolling_zscore", b, f"SELECT symbol, trading_date, {zscore('volume')} AS volume_z60 FROM bars")
    sm = chain(BARS, SMOOTH)
    oracle("e06_ema", sm, """
SELECT b.symbol, b.trading_date, CASE WHEN rn >= 20 THEN e20 END AS ema20, CASE WHEN rn >= 50 THEN e50 END AS ema50,
       CASE WHEN rn >= 200 THEN e200 END AS ema200 FROM bars b JOIN smoothed s USING (symbol, rn)""")
    oracle("e07_wilder_average", sm, """
SELECT b.symbol, b.trading_date, CASE WHEN rn >= 14 THEN rv END AS rma14 FROM bars b JOIN smoothed s USING (symbol, rn)""")
    for name, cols in (("e08_atr", "atr14, atr_pct"), ("e09_rsi", "rsi14"), ("e10_displacement", "displacement_atr"),
                       ("h01_baseline_features", ", ".join(FEATURE_NAMES))):
        oracle(name, FEAT, f"SELECT symbol, trading_date, {cols} FROM feat")
    rank = """
SELECT symbol, trading_date, (rank() OVER (PARTITION BY trading_date ORDER BY volume)
  + (count(*) OVER (PARTITION BY trading_date, volume) - 1) / 2.0)
  / count(*) OVER (PARTITION BY trading_date) * 100 AS volume_rank FROM bars"""
    oracle("e11_percentile_rank", b, rank)
    oracle("e11_percentile_rank_split", b, rank)
    oracle("e13_winsorize", b, f"""
SELECT symbol, trading_date, CASE WHEN r IS NOT NULL THEN greatest(lo, least(hi, r)) END AS ret_1_clipped FROM (
  SELECT *, quantile_cont(r, 0.01) OVER (PARTITION BY trading_date) AS lo,
         quantile_cont(r, 0.99) OVER (PARTITION BY trading_date) AS hi
  FROM (SELECT symbol, trading_date, close::DOUBLE / lag(close) {W} - 1 AS r FROM bars))""")
    oracle("e14_running_product", b, f"""
SELECT symbol, trading_date, wealth, max(wealth) OVER (PARTITION BY symbol ORDER BY trading_date) AS peak FROM (
  SELECT symbol, trading_date, product(1 + r) {W} AS wealth FROM (
    SELECT symbol, trading_date, coalesce(close::DOUBLE / lag(close) {W} - 1, 0) AS r FROM bars))""")
    oracle("e15_factor_jumps", b, f"""
SELECT symbol, trading_date, pf AS previous_factor, f AS factor, f / pf - 1 AS factor_change,
       'UNKNOWN' AS action_type, 'UNRESOLVED' AS resolution_status
FROM (SELECT *, lag(f) {W} AS pf FROM (
  SELECT symbol, trading_date, CASE WHEN right(symbol, 1) IN ('0', '4', '8') AND no < half THEN close * 0.9
         ELSE close END::DOUBLE / close AS f
  FROM bars JOIN (SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS no,
                         count(*) OVER () // 2 AS half FROM (SELECT DISTINCT trading_date FROM bars)) USING (trading_date)))
WHERE abs(f / pf - 1) >= 0.005""")
    oracle("e19_next_session_bar", b, "SELECT symbol, trading_date, " + ", ".join(
        f"lead({c}) {W} AS next_{c}" for c in ("trading_date", "open", "high", "low")) + " FROM bars")
    rs = chain(BARS, RS)
    oracle("h02_relative_strength", rs, "SELECT * FROM rs20 JOIN rs126 USING (symbol, trading_date)")
    oracle("h02_relative_strength_split", rs, "SELECT * FROM rs20 JOIN rs126 USING (symbol, trading_date)")
    oracle("d01_d02_group_returns", rs, "SELECT DISTINCT trading_date, b.sector, market_return_20, sector_return_20 FROM rs20 JOIN bars b USING (symbol, trading_date)")
    oracle("d03_equal_weight_index", chain(BARS, EW), "SELECT * FROM ew")
    oracle("d04_d08_breadth", chain(BARS, BREADTH), "SELECT * FROM breadth")
    sc = chain(FEAT, RS, SECTORS)
    oracle("d09_h06_sector_scores", sc, "SELECT * FROM sectors")
    oracle("d09_h06_sector_scores_split", sc, "SELECT * FROM sectors")
    oracle("h06_sector_scores_latest", sc, "SELECT * FROM sectors WHERE trading_date = (SELECT max(trading_date) FROM bars)")
    oracle("e18_index_indicators", chain(BARS, CAP), "SELECT * FROM ixi")
    oracle("h05_official_index", chain(BARS, CAP), "SELECT * FROM capx")
    oracle("h04_regime", chain(BARS, EW, BREADTH, CAP, REGIME), "SELECT * FROM regime")


FEATURE_NAMES = (
    "ret_1", "ret_20", "ret_126", "ma20", "ma50", "ma200", "ema20", "ema50", "ema200", "atr14", "atr_pct", "rsi14",
    "volume_z60", "turnover_z60", "displacement_atr", "trend_confirmed", "signal_pullback", "signal_reversal",
    "setup_quality", "volume_confirmation",
)
