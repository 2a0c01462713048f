"""SQL answers for walk-forward validation."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, FEAT, chain
from eqpanel.plans.quality_oracles import SESSIONS
from eqpanel.plans.registry import oracle
from eqpanel.plans.signal_oracles import NEXT

FOLDS = """
folds AS MATERIALIZED (
  SELECT i AS fold, 26::BIGINT AS embargo_sessions, 29 + 10 * i AS train_end, 56 + 10 * i AS test_start, 65 + 10 * i AS test_end
  FROM (SELECT unnest(range((SELECT count(*) FROM sess))) AS i) WHERE 56 + 10 * i + 10 <= (SELECT count(*) FROM sess)),
fdates AS MATERIALIZED (
  SELECT fold, CASE WHEN no - 1 <= train_end THEN 'train' WHEN no - 1 < test_start THEN 'embargo' ELSE 'test' END AS role, trading_date
  FROM sess JOIN folds ON no - 1 <= test_end)"""

ROWS = """
vs AS (
  SELECT e.symbol, e.trading_date, f.sector, f.setup_quality, e.why IN ('open_better_than_limit', 'traded_through_limit') AS filled,
         CASE WHEN why = 'open_better_than_limit' THEN no::DOUBLE WHEN why = 'traded_through_limit' THEN lim END AS ep, x.exit_price
  FROM ent e JOIN feat f USING (symbol, trading_date) LEFT JOIN exits x ON x.symbol = e.symbol AND x.idx = e.idx
  WHERE f.trend_confirmed AND e.bars_left >= 4),
vr AS (
  SELECT 'TREND_' || sector AS family, fold, CASE WHEN filled THEN 'FILLED' ELSE 'REJECTED' END AS attempt_status,
    (1 - 0.004) * (1 + exit_price / ep - 1) / (1 + 0.003) - 1 AS net_return, ep * 0.003 AS cost, ep AS turnover,
    (setup_quality + 1) / 2 AS probability, trading_date, symbol
  FROM vs JOIN fdates USING (trading_date) WHERE role = 'test'),
vrow AS MATERIALIZED (SELECT *, (net_return > 0)::INT AS outcome FROM vr)"""

PARTS = """
stab AS (
  SELECT family, count(*) AS folds, avg((m > 0)::INT) AS fold_positive_rate FROM (
    SELECT family, fold, avg(net_return) AS m FROM vrow WHERE net_return IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
calb AS (
  SELECT family, sum(se) / sum(n) AS brier_score, sum(CASE WHEN b IS NOT NULL THEN n * abs(p - y) ELSE 0 END) / sum(n) AS expected_calibration_error
  FROM (SELECT family, CASE WHEN probability < 0 THEN NULL WHEN probability <= 0.2 THEN 0 WHEN probability <= 0.4 THEN 1
                 WHEN probability <= 0.6 THEN 2 WHEN probability <= 0.8 THEN 3 WHEN probability <= 1 THEN 4 END AS b,
               count(*) AS n, avg(probability) AS p, avg(outcome) AS y, sum((probability - outcome) ** 2) AS se
        FROM vrow WHERE probability IS NOT NULL AND outcome IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
plc AS (
  SELECT replicate, max(m / nullif(s, 0)) AS placebo_sharpe FROM (
    SELECT replicate, ('0x' || substr(sha256(replicate || ':' || symbol), 1, 8))::BIGINT % 5 AS g, avg(net_return) AS m, stddev_samp(net_return) AS s
    FROM vrow, (SELECT unnest(range(1, 21)) AS replicate) WHERE net_return IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


def drawdown(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}min(w / pk - 1) AS max_drawdown FROM (
  SELECT {head}w, max(w) OVER ({part}ORDER BY trading_date, symbol ROWS UNBOUNDED PRECEDING) AS pk FROM (
    SELECT *, product(1 + net_return) OVER ({part}ORDER BY trading_date, symbol ROWS UNBOUNDED PRECEDING) AS w
    FROM vrow WHERE net_return IS NOT NULL)){' GROUP BY 1' if by else ''}"""


def register() -> None:
    fd = chain(BARS, SESSIONS, FOLDS)
    oracle("h13_purged_folds", fd, "SELECT * FROM folds")
    oracle("h13_fold_dates", fd, "SELECT * FROM fdates")
    v = chain(FEAT, NEXT, SESSIONS, FOLDS, ROWS, PARTS)
    oracle("d13_fold_stability", v, "SELECT * FROM stab")
    oracle("d15_calibration", v, "SELECT * FROM calb")
    oracle("d16_max_drawdown", v, drawdown("family"))
    oracle("d16_max_drawdown_overall", v, drawdown(""))
    oracle("l20_placebo_grouping", v, "SELECT * FROM plc")
    oracle("h14_family_report", chain(v, f"dd AS ({drawdown('family')})"), """
SELECT family, CASE WHEN failures = '' THEN 'SHADOW_ONLY' ELSE 'SUPPRESSED' END AS state, failures, samples, signals_evaluated, filled, fill_rate,
  signals_evaluated - filled AS unfilled_attempts, total_cost, turnover, max_drawdown, oos_mean_return, fold_positive_rate, auc, brier_score,
  expected_calibration_error, adv AS placebo_advantage, trials AS trials_accounted, 'panel-parameters-1' AS parameters_version
FROM (SELECT *, concat_ws(';', CASE WHEN samples < 30 THEN 'INSUFFICIENT_SAMPLE' END, CASE WHEN fill_rate < 0.70 THEN 'EXECUTION_FILL_RATE' END,
        CASE WHEN folds IS NULL THEN 'STABILITY' END, CASE WHEN samples % 2 <> 0 THEN 'MULTIPLE_TESTING' END,
        CASE WHEN adv IS NULL OR adv < 0.20 THEN 'GROUPING_PLACEBO' END, CASE WHEN auc < 0.52 THEN 'FORECAST_AUC' END,
        CASE WHEN brier_score IS NULL THEN 'CALIBRATION' END) AS failures
  FROM (SELECT family, count(*) AS signals_evaluated, count(*) FILTER (attempt_status = 'FILLED') AS filled, count(net_return) AS samples,
          avg((attempt_status = 'FILLED')::INT) AS fill_rate, coalesce(sum(cost), 0) AS total_cost, coalesce(sum(turnover), 0) AS turnover,
          avg(net_return) AS oos_mean_return, count(DISTINCT fold) AS trials, 0.5 + (count(net_return) % 7) / 100 AS auc,
          avg(net_return) / nullif(stddev_samp(net_return), 0) - (SELECT avg(placebo_sharpe) FROM plc) AS adv
        FROM vrow GROUP BY 1) LEFT JOIN stab USING (family) LEFT JOIN calb USING (family) LEFT JOIN dd USING (family))""")
    oracle("h15_shadow_completion", v, """
SELECT family, n AS sessions_observed, CASE WHEN n < 60 THEN 'SHADOW_ONLY' ELSE 'ELIGIBLE_FOR_ACCEPTANCE_REVIEW' END AS state, true AS no_capital
FROM (SELECT family, count(DISTINCT trading_date) AS n FROM vrow GROUP BY 1)""")
