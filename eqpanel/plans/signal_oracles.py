"""SQL answers for outcomes, candidates, sizing and recommendations."""

from __future__ import annotations

from eqpanel.plans.market_oracles import (
    BARS, BREADTH, CAP, EW, FEAT, REGIME, RS, SECTORS, W, chain, mean,
)
from eqpanel.plans.registry import oracle


def tick(x: str) -> str:
    d = f"CAST(({x}) AS DECIMAL(20, 6))"
    return f"CASE WHEN {d} < 10000 THEN 10 WHEN {d} < 50000 THEN 50 ELSE 100 END"


def down(x: str) -> str:
    """Largest tick price not above x."""
    units = f"CAST(CAST(({x}) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)"
    return f"CAST(floor({units} / (1000000.0 * ({tick(x)}))) * ({tick(x)}) AS DOUBLE)"


def _fill(mode: str) -> str:
    touch = "nl = lim" if mode == "optimistic" else "false"
    return f"""CASE WHEN no IS NULL THEN NULL WHEN no::DOUBLE / close - 1 > 0.02 THEN 'gap_gate'
      WHEN no <= lim THEN 'open_better_than_limit' WHEN nl < lim THEN 'traded_through_limit'
      WHEN {touch} THEN 'touch_fill_optimistic' ELSE 'limit_not_provably_filled' END"""


NEXT = f"""
nxt AS MATERIALIZED (
  SELECT symbol, trading_date, open, high, low, close, lead(trading_date) {W} AS nd, lead(open) {W} AS no,
         lead(low) {W} AS nl, {down('close * (1 + 0.005)')} AS lim,
         rn - 1 AS idx, count(*) OVER (PARTITION BY symbol) - rn AS bars_left,
         coalesce(open <= flo AND high <= flo, false) AS pinned,
         lead(trading_date, 3) {W} AS sellable_date, lead(trading_date, 4) {W} AS policy_exit_date
  FROM (SELECT *, {down('pc * 0.93')} AS flo FROM (SELECT *, lag(close) {W} AS pc FROM bars))),
ent AS MATERIALIZED (
  SELECT *, {_fill('conservative')} AS why, no::DOUBLE / close - 1 AS gap FROM nxt),
planned AS (
  SELECT symbol, idx, CASE WHEN bars_left >= 22 THEN idx + 22 ELSE idx + bars_left END AS j FROM ent),
found AS (
  SELECT p.symbol, p.idx, min(s.idx) AS exit_idx FROM planned p
  JOIN nxt s ON s.symbol = p.symbol AND s.idx >= p.j AND NOT s.pinned GROUP BY 1, 2),
exits AS MATERIALIZED (
  SELECT f.symbol, f.idx, f.exit_idx, n.trading_date AS exit_date, n.open::DOUBLE AS exit_price
  FROM found f JOIN nxt n ON n.symbol = f.symbol AND n.idx = f.exit_idx)"""


def _taken(signal: str) -> str:
    return f"""
sig AS MATERIALIZED (
  SELECT e.*, e.why IN ('open_better_than_limit', 'traded_through_limit') AS filled, x.exit_idx, x.exit_date, x.exit_price,
         f.sector
  FROM ent e JOIN feat f USING (symbol, trading_date) LEFT JOIN exits x ON x.symbol = e.symbol AND x.idx = e.idx
  WHERE f.{signal} AND e.bars_left >= 4),
sgf AS MATERIALIZED (
  SELECT *, CASE WHEN filled THEN greatest(idx + 1, coalesce(exit_idx, idx + bars_left)) ELSE idx + 1 END AS free_at,
         CASE WHEN why = 'open_better_than_limit' THEN no::DOUBLE WHEN filled THEN lim END AS entry_price FROM sig),
hops AS MATERIALIZED (
  SELECT s.symbol, s.idx, min(t.idx) AS nxt_idx FROM sgf s LEFT JOIN sgf t ON t.symbol = s.symbol AND t.idx >= s.free_at
  GROUP BY 1, 2),
walk AS (
  SELECT symbol, min(idx) AS idx FROM sgf GROUP BY 1
  UNION ALL
  SELECT w.symbol, h.nxt_idx FROM walk w JOIN hops h ON h.symbol = w.symbol AND h.idx = w.idx WHERE h.nxt_idx IS NOT NULL),
taken AS MATERIALIZED (
  SELECT s.*, (1 - 0.004) * (1 + exit_price / entry_price - 1) / (1 + 0.003) - 1 AS net_return
  FROM sgf s JOIN walk w ON w.symbol = s.symbol AND w.idx = s.idx)"""


TRADES = """SELECT symbol, trading_date AS signal_date, nd AS entry_date, entry_price, sellable_date AS regulatory_sellable_date,
  policy_exit_date AS policy_earliest_exit_date, exit_date, exit_price, net_return,
  CASE WHEN exit_date IS NOT NULL THEN 'time_stop' END AS exit_reason{extra} FROM taken WHERE filled"""

ATTEMPTS = """SELECT symbol, trading_date AS signal_date, CASE WHEN filled THEN 'FILLED' ELSE 'REJECTED' END AS status,
  why AS reason, CASE WHEN filled THEN nd END AS entry_date, entry_price, gap AS overnight_gap FROM taken"""

METRICS = """count(net_return) AS trades, avg((net_return > 0)::INT) FILTER (net_return IS NOT NULL) AS hit_rate,
  avg(net_return) AS mean_net_return, median(net_return) AS median_net_return,
  CASE WHEN -sum(net_return) FILTER (net_return < 0) > 0
       THEN coalesce(sum(net_return) FILTER (net_return > 0), 0) / -sum(net_return) FILTER (net_return < 0) END AS profit_factor,
  min(net_return) AS max_trade_loss"""

PLAN = f"""
dwn AS MATERIALIZED (
  SELECT b.symbol, b.rn, i.tr, row_number() OVER (PARTITION BY b.symbol ORDER BY b.rn) AS k
  FROM moves b JOIN inputs i USING (symbol, rn) WHERE change < 0),
dws AS (
  SELECT symbol, rn, k, tr AS y FROM dwn WHERE k = 1
  UNION ALL SELECT d.symbol, d.rn, d.k, 13.0/14 * s.y + d.tr / 14 FROM dws s JOIN dwn d ON d.symbol = s.symbol AND d.k = s.k + 1),
dwa AS (
  SELECT f.*, last_value(CASE WHEN k >= 14 THEN y END IGNORE NULLS) OVER
           (PARTITION BY f.symbol ORDER BY f.trading_date ROWS UNBOUNDED PRECEDING) AS downside_atr14
  FROM feat f LEFT JOIN (SELECT symbol, rn, k, y FROM dws) s USING (symbol, rn)),
pl1 AS (
  SELECT *, {down('close * (1 + 0.005)')} AS entry_price, {mean('volume', 20)} AS adv_shares,
         min(low) OVER (PARTITION BY symbol ORDER BY trading_date ROWS 9 PRECEDING)::DOUBLE AS lo,
         max(high) OVER (PARTITION BY symbol ORDER BY trading_date ROWS 251 PRECEDING)::DOUBLE AS hi FROM dwa),
pl2 AS (
  SELECT *, CASE WHEN atr14 IS NOT NULL THEN {down('least(lo - 0.5 * atr14, entry_price * (1 - 0.08))')} END AS exit_stop,
         CASE WHEN atr14 IS NOT NULL THEN
           {down('least(entry_price - 2.5 * greatest(atr14, coalesce(1.3 * downside_atr14, atr14)), entry_price * (1 - 0.08 * 1.25))')}
         END AS risk_stop FROM pl1),
pl3 AS (SELECT *, entry_price - exit_stop AS r_unit FROM pl2),
pl4 AS (
  SELECT *, CASE WHEN NOT trend_confirmed AND entry_price < hi AND hi < entry_price + 2 * r_unit THEN hi * 0.99
            ELSE entry_price + 2 * r_unit END AS target_1, entry_price + 3.5 * r_unit AS target_2 FROM pl3),
plan AS MATERIALIZED (
  SELECT *, (target_1 - entry_price) / nullif(r_unit, 0) AS risk_reward,
    coalesce(risk_stop > 0 AND risk_stop < exit_stop AND exit_stop < entry_price
      AND NOT (NOT trend_confirmed AND hi < entry_price * 1.03)
      AND (target_1 - entry_price) / nullif(r_unit, 0) >= 1.7, false) AS plan_valid FROM pl4)"""

ACCOUNTS = """
acc AS MATERIALIZED (
  SELECT c_mktsegment AS account, sum(CAST(round(c_acctbal * 100) AS BIGINT))::DOUBLE * 10 AS equity FROM customer GROUP BY 1)"""

LIMIT_OF = "CASE {r} WHEN 'STRONG_BULL' THEN 1.0 WHEN 'CONCENTRATED_BULL' THEN 0.8 WHEN 'RANGE' THEN 0.6 WHEN 'RISK_OFF' THEN 0.4 ELSE 0.0 END"


def _sizing(held: str) -> str:
    """Sizing of row c against a list of held positions (sector, grp, notional, risk)."""

    def used(field: str, keep: str = "true") -> str:
        return f"coalesce(list_sum([h.{field} for h in {held} if {keep}]), 0)"

    return f"""
      greatest(0, equity * lim - {used('notional')}) AS total_room,
      greatest(0, equity * 0.35 - {used('notional', 'h.sector = c.sector')}) AS sector_room,
      greatest(0, equity * 0.15 - {used('notional', 'h.grp = c.correlated_group')}) AS group_room,
      greatest(0, equity * 0.05 - {used('risk')} - 10000) AS risk_room,
      len({held}) AS n_held, len([1 for h in {held} if h.grp = c.correlated_group]) AS n_group"""


VERDICT = """
      list_sort([
        {'q': floor((least(max_loss, equity * 0.01 * lim) - 10000) / per_share / 100) * 100, 'n': 'RISK_BUDGET'},
        {'q': floor(equity / entry_price / 100) * 100, 'n': 'AVAILABLE_CASH'},
        {'q': floor(equity * 0.10 / entry_price / 100) * 100, 'n': 'SECURITY_EXPOSURE'},
        {'q': floor(total_room / entry_price / 100) * 100, 'n': 'TOTAL_EXPOSURE'},
        {'q': floor(sector_room / entry_price / 100) * 100, 'n': 'SECTOR_CONCENTRATION'},
        {'q': floor(group_room / entry_price / 100) * 100, 'n': 'CORRELATED_EXPOSURE'},
        {'q': floor(adv_shares * 0.03 / 100) * 100, 'n': 'LIQUIDITY_PARTICIPATION'},
        {'q': floor(risk_room / per_share / 100) * 100, 'n': 'TOTAL_OPEN_RISK'}])[1]"""

STATIC = """CASE WHEN entry_price IS NULL OR entry_price <= 0 THEN 'ENTRY_PRICE_UNAVAILABLE'
        WHEN risk_stop IS NULL OR risk_stop <= 0 OR risk_stop >= entry_price THEN 'RISK_STOP_INVALID'
        WHEN (entry_price - risk_stop) / entry_price < 0.01 THEN 'MINIMUM_STOP_DISTANCE'
        WHEN (entry_price - risk_stop) / entry_price > 0.20 THEN 'MAXIMUM_STOP_DISTANCE'
        WHEN adv_shares IS NULL OR adv_shares <= 0 THEN 'LIQUIDITY_UNAVAILABLE'
        WHEN equity <= 0 THEN 'RISK_CONTEXT_INVALID'
        WHEN least(max_loss, equity * 0.01 * lim) <= 10000 OR per_share <= 0 THEN 'MAXIMUM_PERMITTED_LOSS'
        WHEN floor((least(max_loss, equity * 0.01 * lim) - 10000) / per_share / 100) * 100 < 100 THEN 'MINIMUM_LOT_RISK'
        WHEN n_held >= 10 THEN 'CONCURRENT_POSITION_LIMIT' WHEN n_group >= 2 THEN 'CORRELATED_POSITION_LIMIT'
        WHEN best.q < 100 THEN best.n
        WHEN best.q * per_share + 10000 > max_loss + 1e-9 THEN 'MAXIMUM_PERMITTED_LOSS'
        WHEN best.q * entry_price < 10000000 THEN 'MINIMUM_NOTIONAL' END"""

FIRST_HELD = "[{'sector': 'ASIA', 'grp': 'ASIA1', 'notional': 20000000.0, 'risk': 2000000.0}]"

RISK = f"""
{PLAN.strip()},
{ACCOUNTS.strip()},
rkd AS (
  SELECT trading_date, row_number() OVER (PARTITION BY trading_date ORDER BY setup_quality DESC NULLS LAST, symbol) AS priority,
         symbol, coalesce(sector, 'UNKNOWN') AS sector, coalesce(sector, 'UNKNOWN') || right(symbol, 1) AS correlated_group,
         entry_price, risk_stop, adv_shares * 1000 AS adv_shares,
         ['PANIC_BEAR', 'RISK_OFF', 'RANGE', 'CONCENTRATED_BULL', 'STRONG_BULL'][2 + day(trading_date) % 4] AS regime
  FROM plan WHERE trend_confirmed),
cnd AS MATERIALIZED (
  SELECT account, equity, equity * 0.01 AS max_loss, r.*, {LIMIT_OF.format(r='regime')} AS lim,
         entry_price - risk_stop + entry_price * 0.001 + risk_stop * 0.001 AS per_share
  FROM rkd r CROSS JOIN acc),
go AS (
  SELECT account, trading_date, 0::BIGINT AS priority, {FIRST_HELD} AS held, NULL::VARCHAR AS status, 0.0::DOUBLE AS quantity,
         NULL::VARCHAR AS binding, 0.0::DOUBLE AS loss
  FROM (SELECT DISTINCT account, trading_date FROM cnd)
  UNION ALL
  SELECT account, trading_date, priority,
    CASE WHEN why IS NULL THEN list_append(held, {{'sector': sector, 'grp': correlated_group, 'notional': best.q * entry_price,
                                  'risk': greatest(0, entry_price - risk_stop) * best.q}}) ELSE held END,
    CASE WHEN why IS NOT NULL THEN 'REJECTED' WHEN best.n = 'RISK_BUDGET' THEN 'ACCEPTED' ELSE 'RESIZED' END,
    CASE WHEN why IS NULL THEN best.q ELSE 0 END, coalesce(why, best.n),
    CASE WHEN why IS NULL THEN best.q * per_share + 10000 ELSE 0 END
  FROM (SELECT *, {STATIC} AS why FROM (
    SELECT *, {VERDICT} AS best FROM (
      SELECT c.*, g.held, {_sizing('g.held')}
      FROM go g JOIN cnd c ON c.account = g.account AND c.trading_date = g.trading_date AND c.priority = g.priority + 1)))),
risk AS MATERIALIZED (
  SELECT c.account, c.trading_date, c.priority, symbol, sector, correlated_group, entry_price, risk_stop, adv_shares, regime,
         g.status, g.quantity::BIGINT AS quantity, g.loss AS estimated_loss, g.quantity * coalesce(entry_price, 0) AS notional,
         g.binding AS binding_constraint
  FROM go g JOIN cnd c ON c.account = g.account AND c.trading_date = g.trading_date AND c.priority = g.priority)"""

CAL = """
cal AS MATERIALIZED (
  SELECT trading_date, lead(trading_date, 1) OVER w AS attempt_date, lead(trading_date, 3) OVER w AS sellable_date,
         lead(trading_date, 4) OVER w AS policy_exit_date FROM (SELECT DISTINCT trading_date FROM bars)
  WINDOW w AS (ORDER BY trading_date))"""

RECO = f"""
{PLAN.strip()},
{ACCOUNTS.strip()},
{CAL.strip()},
req AS (
  SELECT *, close * 0.998 AS zl, close * 1.004 AS zh, 0.2 + (volume % 7) / 10 AS p, adv_shares * 1000 AS adv,
         CASE WHEN volume % 5 <> 0 THEN lead(trading_date) {W} END AS bd, lead(open) {W}::DOUBLE AS bo,
         lead(high) {W}::DOUBLE AS bh, lead(low) {W}::DOUBLE AS bl FROM plan),
rq1 AS (
  SELECT r.*, c.attempt_date, c.sellable_date, c.policy_exit_date, a.equity, a.equity * 0.01 AS max_loss, 0.6 AS lim,
         {down('zl')} AS plo, {down('zh')} AS ent
  FROM req r JOIN cal c USING (trading_date), acc a WHERE trend_confirmed AND account = 'BUILDING'),
rq2 AS (
  SELECT *, ent AS entry_price, ent - risk_stop + ent * 0.001 + risk_stop * 0.001 AS per_share,
         {down('close * (1 + (ent / close - 1))')} AS lim_px FROM (SELECT * EXCLUDE (entry_price, adv_shares), adv AS adv_shares FROM rq1)),
rq3 AS (
  SELECT c.*, {_sizing(FIRST_HELD)} FROM (SELECT *, sector AS correlated_group FROM rq2) c),
rq4 AS (SELECT *, {VERDICT} AS best FROM rq3),
rq5 AS (SELECT *, {STATIC} AS why FROM rq4),
rq6 AS (
  SELECT *, CASE WHEN why IS NULL THEN best.q * per_share + 10000 ELSE 0 END AS loss, CASE WHEN why IS NULL THEN best.q ELSE 0 END AS qty FROM rq5),
rq7 AS (
  SELECT *, qty * (target_1 - ent - ent * 0.001 - target_1 * 0.001) - 10000 AS rw1,
         qty * (target_2 - ent - ent * 0.001 - target_2 * 0.001) - 10000 AS rw2 FROM rq6),
reco AS MATERIALIZED (
  SELECT *, p * rw1 - (1 - p) * loss AS ev, CASE
    WHEN volume % 17 = 0 THEN 'SOURCE_LINEAGE_INCOMPLETE'
    WHEN volume % 13 = 0 THEN 'DQ_GATE_FAILED'
    WHEN volume % 11 = 0 THEN 'FORECAST_GATE_FAILED'
    WHEN attempt_date IS NULL THEN 'ATTEMPT_DATE_UNAVAILABLE'
    WHEN exit_stop IS NULL OR exit_stop <= 0 OR risk_stop IS NULL OR risk_stop <= 0 OR adv_shares IS NULL OR adv_shares <= 0
      THEN 'PRICE_OR_LIQUIDITY_INVALID'
    WHEN plo > ent THEN 'ENTRY_PLAN_INVALID'
    WHEN NOT ({down('close * 0.93')} <= plo AND ent <= {down('close * 1.07')}) THEN 'PRICE_BAND_GATE_FAILED'
    WHEN exit_stop >= ent OR risk_stop >= ent THEN 'STOP_GATE_FAILED'
    WHEN NOT (target_1 > ent AND target_2 > ent) THEN 'TARGET_GATE_FAILED'
    WHEN bd IS NOT NULL AND bd <> attempt_date THEN 'ATTEMPT_BAR_DATE_MISMATCH'
    WHEN bd IS NOT NULL AND NOT (bl > 0 AND bl <= bo AND bo <= bh) THEN 'ATTEMPT_BAR_INVALID'
    WHEN bd IS NOT NULL AND bo / close - 1 > 0.02 THEN 'EXECUTION_GATE_FAILED:gap_gate'
    WHEN bd IS NOT NULL AND NOT (bo <= lim_px OR bl < lim_px) THEN 'EXECUTION_GATE_FAILED:limit_not_provably_filled'
    WHEN why IS NOT NULL THEN 'PORTFOLIO_GATE_FAILED:' || why
    WHEN NOT (loss > 0 AND rw1 > 0 AND rw2 > 0) THEN 'COST_ADJUSTED_PAYOFF_INVALID'
    WHEN NOT (p * rw1 - (1 - p) * loss > 0) THEN 'EXPECTED_VALUE_GATE_FAILED'
    WHEN sellable_date IS NULL OR policy_exit_date IS NULL THEN 'SETTLEMENT_CALENDAR_INCOMPLETE'
    ELSE 'ALL_GATES_PASSED' END AS reason FROM rq7)"""


def register() -> None:
    oracle("g09_g11_price_rules", BARS, f"""
SELECT symbol, trading_date, CAST({tick('close')} AS BIGINT) AS tick, {down('close * (1 + 0.005)')} AS limit_price,
       {down('close * 0.93')} AS floor_price, {down('close * 1.07')} AS ceiling_price FROM bars""")
    oracle("g12_g13_costs", "", """
SELECT o_orderkey, b AS buy_rate, s AS sell_rate,
  (1 - s) * (1 + (CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 1000) / 10000) / (1 + b) - 1 AS net_return
FROM (SELECT *, CASE WHEN o_orderdate::DATE <= DATE '1997-06-30' THEN 0.0020 + 0.0003 + 0.0020 ELSE 0.0015 + 0.0015 END AS b,
             CASE WHEN o_orderdate::DATE <= DATE '1997-06-30' THEN 0.0020 + 0.0003 + 0.0020 + 0.001 ELSE 0.0015 + 0.0015 + 0.001 END AS s
      FROM orders)""")
    modes = " UNION ALL ".join(
        f"SELECT '{m}' AS mode, *, {_fill(m)} AS why FROM nxt" for m in ("optimistic", "base", "conservative")
    )
    nx = chain(BARS, NEXT)
    oracle("h10_entry_attempts", nx, f"""
SELECT mode, symbol, trading_date,
  CASE WHEN why IN ('open_better_than_limit', 'traded_through_limit', 'touch_fill_optimistic') THEN 'FILLED'
       WHEN why IS NOT NULL THEN 'REJECTED' END AS attempt_status, why AS attempt_reason,
  CASE WHEN why IN ('open_better_than_limit', 'traded_through_limit', 'touch_fill_optimistic') THEN nd END AS entry_date,
  CASE WHEN why = 'open_better_than_limit' THEN no::DOUBLE WHEN why IN ('traded_through_limit', 'touch_fill_optimistic') THEN lim END AS entry_price,
  no::DOUBLE / close - 1 AS overnight_gap FROM ({modes})""")
    oracle("h11_exits", nx, """
SELECT n.symbol, n.trading_date, n.idx, n.bars_left, n.pinned, n.sellable_date, n.policy_exit_date, x.exit_idx, x.exit_date, x.exit_price
FROM nxt n LEFT JOIN exits x ON x.symbol = n.symbol AND x.idx = n.idx""")
    pull = chain(FEAT, NEXT, _taken("signal_pullback"))
    trend = chain(FEAT, NEXT, _taken("trend_confirmed"))
    oracle("h12_trades", pull, TRADES.format(extra=""))
    oracle("h12_attempts", pull, ATTEMPTS)
    oracle("h12_trades_on_trend", trend, TRADES.format(extra=""))
    oracle("d10_trade_metrics", trend, f"SELECT sector, {METRICS} FROM taken WHERE filled GROUP BY 1")
    oracle("d23_sliced_metrics", trend, f"""
SELECT CASE WHEN grouping(sector) = 1 THEN 'ALL' ELSE sector END AS sector,
       CASE WHEN grouping(y) = 1 THEN 'ALL' ELSE CAST(y AS VARCHAR) END AS signal_year, {METRICS}
FROM (SELECT *, year(trading_date) AS y FROM taken WHERE filled) GROUP BY CUBE (sector, y)""")
    oracle("d11_execution_summary", trend, """
SELECT count(*) AS signals, avg(filled::INT) AS fill_rate, avg(gap) AS mean_overnight_gap FROM taken""")
    oracle("d11_rejection_counts", trend, "SELECT why AS reason, count(*) AS rejections FROM taken WHERE NOT filled GROUP BY 1")
    oracle("b09_result_governance", trend, """
SELECT sector, count(*) AS trades, u AS universe_mode, s AS sector_mode, 'PROXY backtest ' || sector AS result_label,
  concat_ws(';', CASE WHEN u <> 'STRICT_PIT' THEN 'NOT_TRUE_HISTORICAL_IDX: CURRENT_UNIVERSE_PROXY' END,
    CASE WHEN s <> 'STRICT_PIT' THEN 'NOT_TRUE_HISTORICAL_SECTOR_CLASSIFICATION: current-sector proxy' END,
    CASE WHEN u <> 'STRICT_PIT' OR s <> 'STRICT_PIT' THEN 'NOT_ELIGIBLE_FOR_REAL_CAPITAL_STRATEGY_QUALIFICATION' END) AS warnings,
  u = 'STRICT_PIT' AND s = 'STRICT_PIT' AS capital_qualification_eligible
FROM taken, (VALUES ('STRICT_PIT'), ('CURRENT_UNIVERSE_PROXY')) x(u), (VALUES ('STRICT_PIT'), ('CURRENT_ICB_PROXY')) y(s)
WHERE filled GROUP BY sector, u, s""")
    plan = chain(FEAT, PLAN)
    oracle("l01_l03_price_plan", plan, """
SELECT symbol, trading_date, plan_valid, entry_price, exit_stop, risk_stop, r_unit, target_1, target_2, risk_reward, adv_shares,
       atr14, downside_atr14 FROM plan""")
    oracle("h07_candidates", chain(FEAT, RS, SECTORS, EW, BREADTH, CAP, REGIME), """
SELECT symbol, trading_date, family, score, l AS rs_long_rank, s AS rs_short_rank, sector_score,
  CASE family WHEN 'TREND_PULLBACK' THEN 'long-term leader in short-term pullback'
              WHEN 'MOMENTUM_CONTINUATION' THEN 'long+short RS strong in Strong Bull' ELSE 'oversold reversal with market gate' END AS reason,
  least(score, 65) AS confidence, true AS actionable, sector, sector AS correlated_group,
  NULL::DOUBLE AS entry_price, NULL::DOUBLE AS risk_stop, NULL::DOUBLE AS adv_shares, regime
FROM (SELECT *, least(100, 0.35 * l + 0.15 * CASE WHEN family = 'MOMENTUM_CONTINUATION' THEN s ELSE 100 - s END
        + 0.25 * sector_score + 100 * 0.15 * coalesce(setup_quality, 0.5) + 100 * 0.10 * coalesce(volume_confirmation, 0.5)) AS score
  FROM (SELECT f.*, g.regime, a.rs_stock_market_rank_126 AS l, b.rs_stock_market_rank_20 AS s,
          coalesce(x.leadership_score, 50) AS sector_score,
          CASE WHEN signal_pullback AND rs_stock_market_rank_126 >= 60 AND rs_stock_market_rank_20 <= 40 THEN 'TREND_PULLBACK'
               WHEN regime_level = 4 AND rs_stock_market_rank_126 >= 60 AND rs_stock_market_rank_20 >= 65 AND trend_confirmed
                    AND coalesce(volume_z60, 0) >= 0.5 THEN 'MOMENTUM_CONTINUATION'
               WHEN signal_reversal AND rs_stock_market_rank_20 <= 25 AND regime_level >= 2 THEN 'STRUCTURAL_REVERSAL' END AS family
        FROM feat f JOIN rs126 a USING (symbol, trading_date) JOIN rs20 b USING (symbol, trading_date)
        JOIN regime g USING (trading_date) LEFT JOIN sectors x USING (trading_date, sector) WHERE regime_level > 0)
  WHERE family IS NOT NULL AND l IS NOT NULL AND s IS NOT NULL AND sector_score >= 45) WHERE score IS NOT NULL""")
    rk = chain(FEAT, RISK)
    oracle("h03_portfolio_risk", rk, "SELECT * FROM risk")
    oracle("h03_portfolio_risk_rounds", rk, "SELECT * FROM risk")
    oracle("d22_account_exposure", rk, """
SELECT account, trading_date, sector, count(*) AS positions, sum(notional) AS notional,
       sum(greatest(0, entry_price - risk_stop) * quantity) AS open_risk FROM risk WHERE status <> 'REJECTED' GROUP BY 1, 2, 3""")
    oracle("h09_recommendations", chain(FEAT, RECO), """
SELECT symbol, trading_date AS signal_date, CASE WHEN ok THEN 'ACTIONABLE' ELSE 'NO_ACTIONABLE_RECOMMENDATION' END AS status, reason,
  CASE WHEN ok THEN attempt_date END AS attempt_date, CASE WHEN ok THEN plo END AS planned_zone_low,
  CASE WHEN ok THEN ent END AS planned_entry_limit, CASE WHEN ok THEN rw1 / loss END AS expected_reward_to_risk,
  CASE WHEN ok THEN ev END AS expected_value, CASE WHEN ok THEN qty * ent / equity END AS nav_fraction,
  CASE WHEN ok THEN CASE WHEN bd IS NOT NULL THEN 'ATTEMPT_FEASIBLE_NOT_A_FILL' ELSE 'ELIGIBLE_FOR_FUTURE_ATTEMPT' END END AS execution_feasibility,
  CASE WHEN ok THEN sellable_date END AS regulatory_sellable_date, CASE WHEN ok THEN policy_exit_date END AS policy_earliest_exit_fill_date,
  NULL::DOUBLE AS fill_price FROM (SELECT *, reason = 'ALL_GATES_PASSED' AS ok FROM reco)""")
    oracle("c14_c15_settlement_dates", chain(BARS, CAL), "SELECT * FROM cal")
