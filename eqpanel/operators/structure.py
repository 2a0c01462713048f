"""Market structure from confirmed pivots, and the end-of-day volume profile.

Every column of a row is known at that row's close: a swing counts only once its
right side is complete, and patterns that need later bars are reported on the bar
that settles them. Cutting off later bars therefore changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqpanel.functions.ordered import join_null_safe
from eqpanel.functions.series import RUNNING, over

KEY = ("symbol", "trading_date")
PROFILE_LABEL = "EOD Volume Profile proxy"


def _rows(first: int, last: int) -> str:
    """OVER clause from ``first`` to ``last`` rows before the current one."""
    return over(*KEY, f"ROWS BETWEEN {first} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'}")


def confirmed_pivots(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Adds pivot_high, pivot_low (price of the swing this bar confirms, else null) and the swings in force.

    A swing lies ``right`` bars back, is above (below) the ``left`` bars before it
    and not exceeded by the bars since; of equal bars the first is the swing.
    """
    w = over(*KEY)
    cols = {"__n": f"row_number() {w}"}
    for side, pick, beats, holds in (("high", "max", ">", ">="), ("low", "min", "<", "<=")):
        at = f"lag({side}, {right}) {w}"
        cols[f"pivot_{side}"] = (
            f"CASE WHEN row_number() {w} > {left + right} AND {at} {beats} {pick}({side}) {_rows(left + right, right + 1)}"
            f" AND {at} {holds} {pick}({side}) {_rows(right - 1, 0)} THEN {at} END"
        )
    d = bars.withColumns({k: F.expr(v) for k, v in cols.items()})
    run = over(*KEY, RUNNING)
    return d.withColumns({f"swing_{side}": F.expr(f"last(pivot_{side}, true) {run}") for side in ("high", "low")}).drop("__n")


def market_structure(
    bars: DataFrame, left: int = 3, right: int = 3, displacement: float = 1.0, window: int = 20, efficiency: float = 0.35, settle: int = 2
) -> DataFrame:
    """Breaks, sweeps, gaps, order blocks and range tests per bar.

    ``bars`` needs open, high, low, close, volume and atr14. Flags are false where
    their inputs are missing. A break of structure is the first close beyond the
    swing in force; an order block is the last opposite candle before a break whose
    move is at least ``displacement`` average ranges. Springs and upthrusts leave
    a quiet range (directional efficiency and average move low) and count once
    ``settle`` more closes have stayed inside; strength counts on the bar that
    follows through.
    """
    w = over(*KEY)
    d = confirmed_pivots(bars, left, right).withColumns(
        {
            "__pc": F.expr(f"lag(close) {w}"), "__move": F.expr(f"abs(close - lag(close) {w})"), "__from": F.expr(f"lag(close, {window}) {w}"),
            "__up2": F.expr(f"lag(high, 2) {w}"), "__dn2": F.expr(f"lag(low, 2) {w}"), "__vol": F.expr(f"avg(volume) {_rows(window - 1, 0)}"),
            "__spread": F.expr(f"avg(high - low) {_rows(window - 1, 0)}"),
            "__bear": F.expr(f"last(CASE WHEN close < open THEN struct(low, high) END, true) {over(*KEY, 'ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}"),
            "__bull": F.expr(f"last(CASE WHEN close > open THEN struct(low, high) END, true) {over(*KEY, 'ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}"),
        }
    )
    d = d.withColumns(
        {
            "__path": F.expr(f"sum(__move) {_rows(window - 1, 0)}"), "__short": F.expr(f"avg(__move) {_rows(window - 1, 0)}"),
            "__long": F.expr(f"CASE WHEN count(__move) {_rows(3 * window - 1, 0)} >= {2 * window} THEN avg(__move) {_rows(3 * window - 1, 0)} END"),
        }
    )
    d = d.withColumn("range_state", F.expr(f"coalesce(abs(close - __from) <= {efficiency} * __path AND __short <= __long, false)"))
    flags = {
        "bos_up": "close > swing_high AND (__pc IS NULL OR __pc <= swing_high)", "bos_down": "close < swing_low AND (__pc IS NULL OR __pc >= swing_low)",
        "sweep_low": "low < swing_low AND close > swing_low", "sweep_high": "high > swing_high AND close < swing_high",
        "fvg_up": "low > __up2", "fvg_down": "high < __dn2",
        "__strong": f"close > swing_high AND volume > __vol AND high - low > __spread",
    }
    d = d.withColumns({k: F.expr(f"coalesce({v}, false)") for k, v in flags.items()})
    back = lambda c, k: f"lag({c}, {k}) {w}"
    later = {
        "spring": f"{back('sweep_low AND range_state', settle)} AND min(close) {_rows(settle - 1, 0)} >= {back('swing_low', settle)}",
        "upthrust": f"{back('sweep_high AND range_state', settle)} AND max(close) {_rows(settle - 1, 0)} <= {back('swing_high', settle)}",
        "sign_of_strength": f"{back('__strong', 1)} AND close > {back('swing_high', 1)}",
    }
    far = f"__move >= {displacement} * atr14"
    blocks = {
        "order_block_low": f"CASE WHEN bos_up AND {far} THEN __bear.low WHEN bos_down AND {far} THEN __bull.low END",
        "order_block_high": f"CASE WHEN bos_up AND {far} THEN __bear.high WHEN bos_down AND {far} THEN __bull.high END",
    }
    d = d.withColumns({k: F.expr(f"coalesce({v}, false)") for k, v in later.items()} | {k: F.expr(v) for k, v in blocks.items()})
    shown = [k for k in flags if not k.startswith("__")]
    return d.select(*KEY, "pivot_high", "pivot_low", "swing_high", "swing_low", "range_state", *shown, *later, *blocks)


def volume_profile(bars: DataFrame, by: Sequence[str], bins: int = 24, percent: int = 70) -> DataFrame:
    """Volume by typical price per group: point of control and value area. A proxy, labelled as one.

    Typical price is (high + low + close) / 3; the group's span is cut into
    ``bins`` equal bins (one if it has no width). The point of control is the
    fullest bin, the lowest of equals. The value area grows from it to the fuller
    neighbour, upwards on ties, until it holds ``percent`` of the volume. Rows
    without price or volume do not count; a group without volume is left out.
    Bins are summed before a group is put together, so a group's size does not
    matter.
    """
    by = list(by)
    d = bars.where("high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume > 0").select(
        *by, F.expr("high + low + close").alias("__t"), F.col("volume").alias("__v")
    )
    points = d.groupBy(*by, "__t").agg(F.sum("__v").alias("__v"), F.count(F.lit(1)).alias("__k"))
    span = points.groupBy(*by).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    binned = join_null_safe(points, span, by) if by else points.crossJoin(F.broadcast(span))  # one row
    at = F.expr(f"if(__hi = __lo, 0, int(least({bins - 1}, floor((__t - __lo) * {bins} / (__hi - __lo)))))")
    binned = binned.groupBy(*by, "__lo", "__hi", at.alias("__b")).agg(F.sum("__v").alias("__v"), F.sum("__k").alias("__k"))
    # at most ``bins`` entries a group
    d = binned.groupBy(*by, "__lo", "__hi").agg(
        F.map_from_entries(F.collect_list(F.struct("__b", "__v"))).alias("__m"), F.sum("__v").alias("volume"), F.sum("__k").alias("rows")
    )
    d = d.withColumn("__a", F.expr(f"transform(sequence(0, {bins - 1}), i -> coalesce(try_element_at(__m, i), 0))"))
    d = d.withColumn("__p", F.expr("int(array_position(__a, array_max(__a))) - 1"))
    grow = f"""aggregate(sequence(1, {bins}), named_struct('lo', __p, 'hi', __p, 'v', __a[__p]), (s, i) ->
        CASE WHEN s.v * 100 >= volume * {percent} THEN s
             WHEN s.hi < {bins - 1} AND (s.lo = 0 OR __a[s.hi + 1] >= __a[s.lo - 1])
               THEN named_struct('lo', s.lo, 'hi', s.hi + 1, 'v', s.v + __a[s.hi + 1])
             WHEN s.lo > 0 THEN named_struct('lo', s.lo - 1, 'hi', s.hi, 'v', s.v + __a[s.lo - 1])
             ELSE s END)"""
    d = d.withColumn("__g", F.expr(grow))
    edge = lambda k: F.expr(f"(__lo + ({k}) * double(__hi - __lo) / {bins}) / 3")
    return d.select(
        *by, "rows", "volume", edge("0").alias("low_edge"), edge(str(bins)).alias("high_edge"), edge("__p").alias("poc_low"), edge("__p + 1").alias("poc_high"),
        edge("__g.lo").alias("value_area_low"), edge("__g.hi + 1").alias("value_area_high"), F.expr("__g.v / volume").alias("value_area_share"),
        F.lit(PROFILE_LABEL).alias("label"),
    )


def profile_score(rows: DataFrame, price: str = "close", confidence: str = "liquidity_percentile") -> DataFrame:
    """Adds vp_score: 1 above the value area, 0.5 inside, 0 below, times the liquidity confidence (a percentile)."""
    place = f"CASE WHEN {price} > value_area_high THEN 1D WHEN {price} >= value_area_low THEN 0.5D WHEN {price} < value_area_low THEN 0D END"
    return rows.withColumn("vp_score", F.expr(f"({place}) * {confidence} / 100"))
