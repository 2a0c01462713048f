"""SQL answers for evidence about strategies."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, FEAT, chain
from eqpanel.plans.profile_oracles import RET
from eqpanel.plans.quality_oracles import SESSIONS
from eqpanel.plans.registry import oracle
from eqpanel.plans.signal_oracles import NEXT, _taken

TRADES = """
trd AS MATERIALIZED (SELECT sector, trading_date, net_return AS r FROM taken WHERE filled AND net_return IS NOT NULL)"""

BOOT = """
blk AS MATERIALIZED (SELECT trading_date, (no - 1) // 5 AS b FROM sess),
drw AS MATERIALIZED (
  SELECT rep, ('0x' || substr(sha256('blocks:' || rep || ':' || k), 1, 8))::BIGINT % (SELECT max(b) + 1 FROM blk) AS b
  FROM (SELECT unnest(range(1, 1001)) AS rep), (SELECT unnest(range(1, (SELECT max(b) + 2 FROM blk))) AS k)),
bst AS MATERIALIZED (SELECT sector, b, count(*) AS n, count(*) FILTER (r > 0) AS w, sum(r) AS t FROM trd JOIN blk USING (trading_date) GROUP BY 1, 2),
rps AS MATERIALIZED (SELECT sector, rep, sum(w) / sum(n) AS h, sum(t) / sum(n) AS e FROM bst JOIN drw USING (b) GROUP BY 1, 2)"""

# the normal distribution by its power series, its inverse by bisection
NORMAL = """
ask AS MATERIALIZED (
  SELECT t, unnest([1 - 1.0 / t, 1 - 1.0 / (t * exp(1))]) AS p, unnest(['a', 'b']) AS side FROM (SELECT unnest([24, 500]) AS t)),
bis AS (
  SELECT t, side, p, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS k FROM ask
  UNION ALL
  SELECT t, side, p, CASE WHEN c < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < p THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT *, 0.5 + sign(x) * exp(-x * x / 2) / sqrt(2 * pi()) * list_sum([exp((2 * i + 1) * ln(abs(x) + 1e-300) - (lgamma(i + 1.5) + (i + 1) * ln(2) - 0.5 * ln(pi()))) FOR i IN range(0, 160)]) AS c
        FROM (SELECT *, (lo + hi) / 2 AS x FROM bis)) WHERE k < 60),
qnt AS MATERIALIZED (SELECT t, max(lo) FILTER (side = 'a') AS a, max(lo) FILTER (side = 'b') AS b FROM bis WHERE k = 60 GROUP BY 1)"""

DIRECTION = """
dir AS MATERIALIZED (
  SELECT f.symbol, f.trading_date, setup_quality, rsi14 IS NOT NULL AND volume_z60 IS NOT NULL AND atr_pct IS NOT NULL AND ret_20 IS NOT NULL
      AND displacement_atr IS NOT NULL AND setup_quality IS NOT NULL AS complete,
    (lead(close, 5) OVER (PARTITION BY f.symbol ORDER BY f.trading_date) > close)::INT AS label FROM feat f),
dfold AS MATERIALIZED (
  SELECT i AS fold, 119 + 60 * i AS train_end, 146 + 60 * i AS test_start, 205 + 60 * i AS test_end
  FROM (SELECT unnest(range((SELECT count(*) FROM sess))) AS i) WHERE 146 + 60 * i + 60 <= (SELECT count(*) FROM sess)),
ddate AS MATERIALIZED (
  SELECT fold, CASE WHEN no - 1 <= train_end THEN 'train' WHEN no - 1 < test_start THEN 'embargo' ELSE 'test' END AS role, trading_date
  FROM sess JOIN dfold ON no - 1 <= test_end)"""


def register() -> None:
    oracle("l18_deflated_sharpe", chain(BARS, RET, NORMAL), """
SELECT sector, n, sharpe, skewness, kurtosis, trials, sharpe_threshold,
  0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([exp((2 * i + 1) * ln(abs(z) + 1e-300) - (lgamma(i + 1.5) + (i + 1) * ln(2) - 0.5 * ln(pi()))) FOR i IN range(0, 160)]) AS deflated_sharpe
FROM (SELECT *, (sharpe - sharpe_threshold) * sqrt(n - 1) / sqrt(1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS z
  FROM (SELECT *, CASE WHEN trials = 1 THEN 0 ELSE sqrt(1.0 / (n - 1)) * ((1 - 0.5772156649015329) * a + 0.5772156649015329 * b) END AS sharpe_threshold
    FROM (SELECT sector, count(*) AS n, avg(x) / stddev_samp(x) AS sharpe, avg((x - mu) ** 3) / avg((x - mu) ** 2) ** 1.5 AS skewness,
            avg((x - mu) ** 4) / avg((x - mu) ** 2) ** 2 AS kurtosis
          FROM (SELECT *, avg(x) OVER (PARTITION BY sector) AS mu FROM (SELECT sector, trading_date, avg(r) AS x FROM ret GROUP BY 1, 2) WHERE x IS NOT NULL) GROUP BY 1),
         (SELECT unnest([1, 24, 500]) AS trials) LEFT JOIN qnt ON qnt.t = trials))""")
    trend = chain(FEAT, SESSIONS, NEXT, _taken("trend_confirmed"), TRADES)
    oracle("l19_block_bootstrap", chain(trend, BOOT), """
SELECT g.*, least(n, s2 / v) AS effective_sample, ceil((1.959963984540054 + 0.8416212335729143) ** 2 * s2 / (expectancy * expectancy))::BIGINT AS trades_needed
FROM (SELECT sector, n, blocks, replicates, hit_rate, hit_rate_low, hit_rate_high, expectancy, expectancy_low, expectancy_high FROM
    (SELECT sector, count(*) AS n, count(DISTINCT b) AS blocks, avg((r > 0)::INT) AS hit_rate, avg(r) AS expectancy FROM trd JOIN blk USING (trading_date) GROUP BY 1)
    JOIN (SELECT sector, count(*) AS replicates, quantile_cont(h, 0.025) AS hit_rate_low, quantile_cont(h, 0.975) AS hit_rate_high,
            quantile_cont(e, 0.025) AS expectancy_low, quantile_cont(e, 0.975) AS expectancy_high FROM rps GROUP BY 1) USING (sector)) g
JOIN (SELECT sector, var_samp(r) AS s2 FROM trd GROUP BY 1) USING (sector) JOIN (SELECT sector, var_samp(e) AS v FROM rps GROUP BY 1) USING (sector)""".replace(
        "SELECT g.*,", "SELECT g.sector, n, blocks, replicates, hit_rate, hit_rate_low, hit_rate_high, expectancy, expectancy_low, expectancy_high,"))
    oracle("l19_concentration", trend, """
SELECT sector, sum(k)::BIGINT AS n, max(k) / sum(k) AS largest_share, sum(k * k) / (sum(k) * sum(k)) AS concentration
FROM (SELECT sector, year(trading_date) AS y, count(*) AS k FROM trd GROUP BY 1, 2) GROUP BY 1""")
    direction = chain(FEAT, SESSIONS, DIRECTION)
    oracle("l24_direction_folds", direction, """
SELECT fold, role, count(*) AS rows, count(label) AS labelled, sum(label)::BIGINT AS positives, min(trading_date) AS first_date, max(trading_date) AS last_date
FROM dir JOIN ddate USING (trading_date) WHERE complete GROUP BY 1, 2""")
    oracle("l24_single_factor_auc", direction, """
SELECT y AS year, count(*) AS rows, sum(label)::BIGINT AS positives,
  (sum(k) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY y ORDER BY setup_quality) + (count(*) OVER (PARTITION BY y, setup_quality) - 1) / 2 AS k
  FROM (SELECT *, year(trading_date) AS y FROM dir WHERE setup_quality IS NOT NULL AND label IS NOT NULL)) GROUP BY 1""")
