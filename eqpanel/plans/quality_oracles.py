"""SQL answers for point-in-time joins and data quality."""

from __future__ import annotations

from eqpanel.plans.market_oracles import BARS, W, chain
from eqpanel.plans.registry import oracle

SESSIONS = """
sess AS MATERIALIZED (
  SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS no FROM (SELECT DISTINCT trading_date FROM bars))"""

INTERVALS = """
ivl AS MATERIALIZED (
  SELECT symbol, 1 AS ord, sector AS sector_name, DATE '1990-01-01' AS f, DATE '1998-06-30' AS t FROM sec WHERE suppkey % 10 <> 0
  UNION ALL SELECT symbol, 2, later_sector, DATE '1998-07-01', NULL FROM sec),
uni AS MATERIALIZED (
  SELECT symbol, CASE WHEN suppkey % 3 = 0 THEN DATE '1997-01-06' ELSE DATE '1995-01-01' END AS f,
         CASE WHEN suppkey % 3 = 0 THEN DATE '1999-12-26' END AS t,
         CASE WHEN suppkey % 3 = 0 THEN 'review-b' ELSE 'review-a' END AS source,
         CASE WHEN suppkey % 3 = 0 THEN 'snap-b' ELSE 'snap-a' END AS snap FROM sec)"""

MEMBERS = """
covered AS (SELECT s.trading_date AS as_of, u.* FROM sess s JOIN uni u ON u.f <= s.trading_date AND (u.t IS NULL OR u.t >= s.trading_date)),
bare AS (SELECT trading_date AS as_of FROM sess WHERE trading_date NOT IN (SELECT as_of FROM covered)),
members AS MATERIALIZED (
  SELECT as_of, symbol, 'STRICT_PIT' AS mode, source, snap AS source_snapshot_id FROM covered
  UNION ALL SELECT as_of, symbol, 'CURRENT_UNIVERSE_PROXY', 'current-provider-membership', NULL FROM bare, sec)"""

CANON = """
canon AS MATERIALIZED (
  SELECT symbol, trading_date, open, high + d AS high, low, close + d AS close, volume, value AS turnover, close + d AS adj_close,
         p AS provider, no,
         CASE WHEN no % 97 = 0 THEN 'unknown' ELSE sha256(p || year(trading_date)) END AS sha,
         CASE WHEN no % 89 = 0 THEN 'UNKNOWN' ELSE 'unit' END AS unit, CASE WHEN no % 83 = 0 THEN 'mixed' ELSE 'raw' END AS sem
  FROM (SELECT b.*, no, p, CASE WHEN p = 'p2' AND no % 13 = 0 THEN 100 ELSE 0 END AS d
        FROM bars b JOIN sess USING (trading_date), (VALUES ('p1'), ('p2')) x(p))),
disagree AS MATERIALIZED (
  SELECT symbol, trading_date FROM canon GROUP BY 1, 2
  HAVING count(DISTINCT provider) >= 2 AND count(DISTINCT row(open, high, low, close, volume, turnover, adj_close)) > 1)"""

LINEAGE_MSG = "snapshot id, content hash or origin is blank"
SEM_MSG = "prices are marked neither raw nor adjusted"
ROWFAIL = "'FAIL' AS status, symbol, trading_date, provider, 1::BIGINT AS occurrences"
SIMPLE = f"""
simple AS MATERIALIZED (
  SELECT 'LINEAGE_MISSING' AS code, {ROWFAIL}, '{LINEAGE_MSG}' AS message FROM {{src}} WHERE sha = 'unknown'
  UNION ALL SELECT 'UNIT_UNKNOWN', {ROWFAIL}, 'the price unit was not stated' FROM {{src}} WHERE lower(unit) = 'unknown'
  UNION ALL SELECT 'RAW_ADJUSTED_AMBIGUOUS', {ROWFAIL}, '{SEM_MSG}' FROM {{src}} WHERE sem = 'mixed'
  UNION ALL SELECT 'PROVIDER_DISAGREEMENT', 'WARN', symbol, trading_date, 'p1', 1,
    'providers report different values; all are kept' FROM disagree)"""

DOUBLED = "twice AS MATERIALIZED (SELECT c.* FROM canon c UNION ALL SELECT * FROM canon WHERE no % 101 = 0)"

FINDINGS = f"""
info AS (
  SELECT t.*, b.open AS ref, b.volume AS vol, CASE WHEN s.sector = 'ASIA' THEN 0.07 ELSE 0.10 END::DOUBLE AS band
  FROM twice t JOIN bars b USING (symbol, trading_date) LEFT JOIN sec s USING (symbol)),
latest AS (SELECT symbol, max(trading_date) AS trading_date FROM bars GROUP BY 1),
findings AS MATERIALIZED (
  SELECT * FROM simple
  UNION ALL SELECT 'PROVIDER_NOT_ADMITTED', {ROWFAIL}, 'no admission for this provider' FROM info WHERE provider <> 'p1'
  UNION ALL SELECT 'UNRESOLVED_CORPORATE_ACTION', {ROWFAIL}, 'an open corporate action touches this bar' FROM info WHERE vol % 53 = 0
  UNION ALL SELECT 'TRADING_STATUS_BLOCKED', {ROWFAIL}, 'security is not trading normally: SUSPENDED' FROM info WHERE vol % 41 = 0
  UNION ALL SELECT 'PRICE_BAND_BREACH', {ROWFAIL}, 'low or high lies outside the allowed band' FROM info
    WHERE low < ref::DOUBLE * (1 - band) OR high > ref::DOUBLE * (1 + band)
  UNION ALL SELECT 'DUPLICATE_BAR', 'FAIL', symbol, trading_date, provider, count(*) - 1, 'key stored more than once'
    FROM twice GROUP BY symbol, trading_date, provider HAVING count(*) > 1
  UNION ALL SELECT 'MISSING_SESSION', 'FAIL', s.symbol, d.trading_date, NULL, 1, 'no bar for a session of the calendar'
    FROM latest s CROSS JOIN sess d LEFT JOIN bars b ON b.symbol = s.symbol AND b.trading_date = d.trading_date WHERE b.symbol IS NULL
  UNION ALL SELECT 'STALE_DATA', 'FAIL', symbol, l.trading_date, 'p1', 1,
    'newest bar ' || l.trading_date || ' is older than session ' || e FROM latest l, (SELECT max(trading_date) AS e FROM sess)
    WHERE l.trading_date < e)"""

HARD = """code IN ('INVALID_DATE', 'MISSING_SESSION', 'STALE_DATA', 'PRICE_BAND_BREACH', 'TRADING_STATUS_BLOCKED', 'UNIT_UNKNOWN',
  'RAW_ADJUSTED_AMBIGUOUS', 'LINEAGE_MISSING', 'PROVIDER_NOT_ADMITTED', 'UNRESOLVED_CORPORATE_ACTION', 'DUPLICATE_BAR', 'OHLC_LOGIC',
  'NEGATIVE_VOLUME', 'NONPOSITIVE_PRICE')"""


def scored(src: str, by: str, population: str) -> str:
    return f"""
SELECT {by}, s AS dq_score, n AS findings, h AS hard_block,
  CASE WHEN h OR s < 50 THEN 'FAIL' WHEN n > 0 THEN 'WARN' ELSE 'PASS' END AS dq_status, s < 70 AS confidence_capped,
  s >= 50 AND NOT h AS actionable
FROM (SELECT p.*, coalesce(n, 0)::BIGINT AS n, coalesce(h, false) AS h, greatest(0, 100 - coalesce(lost, 0))::BIGINT AS s
  FROM ({population}) p LEFT JOIN (
    SELECT {by}, sum(CASE status WHEN 'FAIL' THEN 35 ELSE 10 END * occurrences) AS lost, sum(occurrences) AS n, bool_or({HARD}) AS h
    FROM {src} GROUP BY ALL) USING ({by}))"""


def register() -> None:
    oracle("c03_sector_from_master", BARS, """
SELECT b.symbol, trading_date, coalesce(CASE WHEN s.suppkey > 20 THEN s.later_sector ELSE s.sector END, 'UNKNOWN') AS sector
FROM bars b LEFT JOIN sec s USING (symbol)""")
    iv = chain(BARS, SESSIONS, INTERVALS)
    oracle("c04_sector_as_of", iv, """
SELECT b.symbol, trading_date, coalesce(i.sector_name, 'UNKNOWN') AS sector,
  coalesce('C' || length(i.sector_name) || substr(i.sector_name, 1, 3), 'UNKNOWN') AS sector_code,
  CASE WHEN ord IS NULL THEN 'UNKNOWN' ELSE 'T1' END AS sector_taxonomy_version, coalesce('snap-' || ord, 'UNKNOWN') AS sector_source_snapshot_id
FROM bars b LEFT JOIN ivl i ON i.symbol = b.symbol AND f <= trading_date AND (t IS NULL OR t >= trading_date)""")
    mem = chain(BARS, SESSIONS, INTERVALS, MEMBERS)
    oracle("c05_universe_as_of", mem, "SELECT * FROM members")
    oracle("c05_universe_summary", mem, """
SELECT as_of, mode, count(*) AS members, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM members GROUP BY 1, 2""")
    oracle("c05_uncovered_dates", mem, "SELECT * FROM bare")
    oracle("c06_exactly_one_class", iv, """
SELECT b.symbol, trading_date AS as_of, count(i.symbol) AS matches,
  CASE WHEN count(i.symbol) = 1 THEN max(sector_name) END AS sector_name,
  CASE WHEN count(i.symbol) <> 1 THEN 'not exactly one classification' END AS error
FROM bars b LEFT JOIN ivl i ON i.symbol = b.symbol AND f <= trading_date AND (t IS NULL OR t >= trading_date) GROUP BY 1, 2""")
    ss = chain(BARS, SESSIONS)
    oracle("c11_missing_sessions", ss, """
SELECT s.symbol, d.trading_date FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN sess d
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.trading_date = d.trading_date)""")
    oracle("c14_add_sessions", ss, """
SELECT symbol, b.trading_date, p.trading_date AS sellable_date, q.trading_date AS policy_exit_date FROM bars b JOIN sess s USING (trading_date)
LEFT JOIN sess p ON p.no = s.no + 2 LEFT JOIN sess q ON q.no = s.no + 3""")
    oracle("e17_interval_conflicts", iv, """
SELECT symbol, 'T1' AS taxonomy_version, g AS effective_from, p AS previous_to, 'overlapping intervals' AS problem FROM (
  SELECT symbol, g, lag(t) OVER (PARTITION BY symbol ORDER BY g) AS p, row_number() OVER (PARTITION BY symbol ORDER BY g) AS n
  FROM (SELECT *, CASE WHEN ord = 2 THEN f - CAST(right(symbol, 1) AS INT) ELSE f END AS g FROM ivl)) WHERE n > 1 AND g <= p""")
    base = chain(BARS, SESSIONS, CANON)
    full = chain(base, DOUBLED, SIMPLE.format(src="twice"), FINDINGS)
    once = chain(base, SIMPLE.format(src="canon"))
    oracle("h16_quality_findings", full, "SELECT * FROM findings")
    oracle("d12_quality_score_by_symbol", full, scored("findings", "symbol", "SELECT DISTINCT symbol FROM bars"))
    oracle("d12_clean_scores", once, scored("simple", "symbol, trading_date", "SELECT DISTINCT symbol, trading_date FROM bars"))
    oracle("d18_provider_disagreement", once, "SELECT * FROM simple WHERE code = 'PROVIDER_DISAGREEMENT'")
    oracle("d19_latest_bar", BARS, "SELECT symbol, max(trading_date) AS latest FROM bars GROUP BY 1")
    oracle("e16_duplicate_keys", full, "SELECT * FROM findings WHERE code = 'DUPLICATE_BAR'")
    oracle("d20_frame_issues", ss, """
SELECT symbol, severity, code, field, n::BIGINT AS occurrences FROM (
  SELECT symbol, count(*) FILTER (no % 109 = 0) AS a, count(*) FILTER (h < greatest(open, close) OR l > least(open, close) OR l > h) AS b,
         count(*) FILTER (no % 107 = 0) AS c, count(*) FILTER (l <= 0) AS d, count(*) FILTER (h <= 0) AS e,
         count(*) - count(DISTINCT CASE WHEN no % 109 = 0 THEN 'not-a-date' ELSE CAST(trading_date AS VARCHAR) END) AS f,
         count(*) FILTER (step) AS g
  FROM (SELECT *, CASE WHEN no % 103 = 0 THEN low - 1 ELSE high END AS h, CASE WHEN no % 127 = 0 THEN 0 ELSE low END AS l, k.step
        FROM (SELECT b.*, no, 0 AS copy FROM bars b JOIN sess USING (trading_date)
              UNION ALL SELECT b.*, no, 1 FROM bars b JOIN sess USING (trading_date) WHERE no % 101 = 0) x
        LEFT JOIN (SELECT symbol AS ks, kno, kc, kd < lag(kd) OVER (PARTITION BY symbol ORDER BY kno * 2 + kc + CASE WHEN kno % 113 = 0 THEN 5 ELSE 0 END) AS step
                   FROM (SELECT b.symbol, no AS kno, 0 AS kc, b.trading_date AS kd FROM bars b JOIN sess USING (trading_date) WHERE no % 109 <> 0
                         UNION ALL SELECT b.symbol, no, 1, b.trading_date FROM bars b JOIN sess USING (trading_date) WHERE no % 101 = 0 AND no % 109 <> 0)) k
        ON k.ks = x.symbol AND k.kno = x.no AND k.kc = x.copy)
  GROUP BY 1) q,
  LATERAL (VALUES ('ERROR', 'INVALID_DATE', NULL, a), ('ERROR', 'OHLC_LOGIC', NULL, b), ('ERROR', 'NEGATIVE_VOLUME', NULL, c),
    ('ERROR', 'NONPOSITIVE_PRICE', 'low', d), ('ERROR', 'NONPOSITIVE_PRICE', 'high', e), ('ERROR', 'DUPLICATE', NULL, f),
    ('WARN', 'UNSORTED', NULL, g)) v(severity, code, field, n) WHERE n > 0""")
    oracle("h08_dq_policy", once, """
SELECT b.symbol, b.trading_date, s AS dq_score, CASE WHEN s < 70 THEN least(volume % 100, s) ELSE volume % 100 END AS confidence, s >= 50 AS actionable
FROM (SELECT b.*, greatest(0, 100 - coalesce(lost, 0))::BIGINT AS s FROM bars b LEFT JOIN (
  SELECT symbol, trading_date, sum(CASE status WHEN 'FAIL' THEN 35 ELSE 10 END * occurrences) AS lost FROM simple GROUP BY 1, 2)
  USING (symbol, trading_date)) b""")
