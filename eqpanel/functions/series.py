"""Per-symbol window helpers.

A series window groups by symbol. Bars are unique on (symbol, trading_date), so
one group never holds more rows than the calendar has sessions (about 250 a
year); more data adds symbols, not rows per symbol. Feed these helpers through
``unique_bars`` when the key is not guaranteed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eqpanel import params as P


def series_window(keys: str | Sequence[str] = "symbol", order: str = "trading_date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(order)


def many(df: DataFrame, symbols: int | None) -> bool:
    """Whether the series of a panel are more than one round of tasks should sort."""
    return -(-(symbols or 0) // P.SYMBOLS_PER_TASK) > df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, symbols: int | None, *keys: str) -> DataFrame:
    """Deal a panel of ``symbols`` series out by ``keys``, so that a task's share does not grow with the panel.

    The windows behind it widen rows by far more than the shuffled bytes show, by
    which Spark would merge partitions. A small panel is left to Spark.
    """
    return df.repartition(-(-symbols // P.SYMBOLS_PER_TASK), *keys) if many(df, symbols) else df


def ratio_return(price: Column, previous: Column) -> Column:
    return F.try_divide(price, previous) - 1


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp, with null kept null (``greatest``/``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def _as_units(schema: T.StructType, name: str) -> tuple[str, float | None]:
    """Column as whole units, and the unit size; None when it is a float."""
    kind = schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"bigint({name})", 1.0
    if isinstance(kind, T.DecimalType) and kind.scale <= 6:
        return f"bigint({name} * {10**kind.scale})", float(10**kind.scale)
    return f"double({name})", None


def over(keys: str | Sequence[str], order: str, frame: str = "") -> str:
    """OVER clause text. Long expressions are written as SQL text in this module:
    one call to the JVM each, instead of one per operator."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"OVER ({part}ORDER BY {order}{' ' + frame if frame else ''})"


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


class RollingMeans:
    """Rolling means in two steps that callers may merge with other window columns.

    A spec is (input, window rows, least observations, output). Whole-number and
    decimal inputs use running totals and their lag: exact, and the work per row
    does not depend on the window length. Floats use a sliding frame, because
    differences of running float totals lose digits.
    """

    def __init__(self, df: DataFrame, specs, keys="symbol", order="trading_date"):
        self.specs, self.keys, self.order = specs, keys, order
        schema = df.schema
        self.inputs = {s[0]: _as_units(schema, s[0]) for s in specs}

    def totals(self) -> dict[str, Column]:
        w = over(self.keys, self.order, RUNNING)
        out = {}
        for name, (units, scale) in self.inputs.items():
            if scale is not None:
                out[f"__sum_{name}"] = F.expr(f"coalesce(sum({units}) {w}, 0L)")
                out[f"__cnt_{name}"] = F.expr(f"count({units}) {w}")
        return out

    def means(self) -> dict[str, Column]:
        w = over(self.keys, self.order)
        out = {}
        for name, size, least, alias in self.specs:
            units, scale = self.inputs[name]
            if scale is None:
                f = over(self.keys, self.order, f"ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW")
                n, mean = f"count({units}) {f}", f"avg({units}) {f}"
            else:
                n, total = (f"({c} - lag({c}, {size}, 0L) {w})" for c in (f"__cnt_{name}", f"__sum_{name}"))
                mean = f"try_divide(double({total}), {n} * {scale}D)"
            out[alias] = F.expr(f"CASE WHEN {n} >= {least} THEN {mean} END")
        return out


def rolling_means(
    df: DataFrame,
    specs: Sequence[tuple[str, int, int, str]],
    keys: str | Sequence[str] = "symbol",
    order: str = "trading_date",
) -> DataFrame:
    r = RollingMeans(df, specs, keys, order)
    totals = r.totals()
    out = df.withColumns(totals) if totals else df
    return out.withColumns(r.means()).drop(*totals)


def rolling_zscore(
    value: str, size: int, least: int, keys: str | Sequence[str] = "symbol", order: str = "trading_date"
) -> Column:
    """Deviation of an SQL value from its rolling mean in population standard deviations."""
    f = over(keys, order, f"ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW")
    x = f"double({value})"
    return F.expr(
        f"CASE WHEN count({x}) {f} >= {least} THEN ({x} - avg({x}) {f}) / nullif(stddev_pop({x}) {f}, 0D) END"
    )


class Smoothing:
    """Recursive smoothing y_t = (1-a) y_{t-1} + a x_t seeded with the first value.

    A spec is (input, a, least observations, output) or the same with the number of
    leading rows whose input is null. From any other null on a series has no
    value: what the gap did to the average is not known. Written without
    recursion: with b = 1-a, ``y_t = b^j * sum(c_i x_i b^-i) + b^(j+1) * y(end of the
    block before)``. The exponent restarts every ``block`` rows so that b^-i stays
    finite; blocks further back than ``depth`` weigh less than a double can hold.
    With ``rows``, a proven bound on the rows of a series, that fits one block there
    is only one, and the series are not sorted again for theirs. ``among`` names a
    flag: rows without it neither count nor weigh; it needs such a bound.
    """

    def __init__(self, specs, keys="symbol", order="trading_date", block: int = 4096, rows: int | None = None, among: str | None = None):
        self.specs = [(*s, 0)[:5] for s in specs]
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = order
        self.block = min([block] + [int(600 / -math.log1p(-s[1])) for s in self.specs])
        self.single = rows is not None and rows <= self.block
        if among and not self.single:
            raise ValueError("a flag needs series of one block")
        self.among = among
        self.counted = {name: i for i, name in enumerate(dict.fromkeys(s[0] for s in self.specs))}
        self.helpers = ["__pos", "__blk", "__j"] + [f"__y{i}" for i in range(len(self.specs))] + [f"__k{i}" for i in self.counted.values()]

    def position(self) -> dict[str, Column]:
        if self.among:
            return {"__pos": F.expr(f"count_if({self.among}) {over(self.keys, self.order, RUNNING)} - 1")}
        return {"__pos": F.expr(f"row_number() {over(self.keys, self.order)} - 1")}

    def _counting(self, value: str) -> str:
        return f"CASE WHEN {self.among} THEN {value} END" if self.among else value

    def blocks(self) -> dict[str, Column]:
        if self.single:
            return {"__j": F.expr("double(__pos)")}
        return {"__blk": F.expr(f"__pos div {self.block}"), "__j": F.expr(f"double(__pos % {self.block})")}

    def local(self) -> dict[str, Column]:
        inside = over(self.keys if self.single else [*self.keys, "__blk"], self.order, RUNNING)
        out = {}
        for i, (name, a, _, _, skip) in enumerate(self.specs):
            term = f"{name} * if(__pos = {skip}, 1D, {a!r}D) * pow({1 - a}D, -__j)"
            out[f"__y{i}"] = F.expr(f"pow({1 - a}D, __j) * sum({self._counting(term)}) {inside}")
        for name, i in self.counted.items():
            out[f"__k{i}"] = F.expr(f"count({self._counting(name)}) {over(self.keys, self.order, RUNNING)}")
        return out

    def smoothed(self) -> dict[str, Column]:
        out = {}
        for i, (name, a, least, alias, skip) in enumerate(self.specs):
            b = 1 - a
            depth = max(1, math.ceil(40.0 / (-math.log(b) * self.block)))
            y = f"__y{i}"
            for back in range(1, 1 if self.single else depth + 1):
                w = over(self.keys, "__blk", f"RANGE BETWEEN {back} PRECEDING AND {back} PRECEDING")
                end = f"max(CASE WHEN __j = {self.block - 1} THEN __y{i} END) {w}"
                y += f" + coalesce(pow({b!r}D, __j + {1 + (back - 1) * self.block}) * {end}, 0D)"
            whole = f"__k{self.counted[name]} = __pos - {skip - 1}"
            out[alias] = F.expr(f"CASE WHEN __pos >= {least - 1 + skip} AND {whole} THEN {y} END")
        return out


def ewm(
    df: DataFrame,
    specs: Sequence[tuple],
    keys: str | Sequence[str] = "symbol",
    order: str = "trading_date",
    block: int = 4096,
    rows: int | None = None,
    among: str | None = None,
) -> DataFrame:
    s = Smoothing(specs, keys, order, block, rows, among)
    d = df.withColumns(s.position()).withColumns(s.blocks())
    return d.withColumns(s.local()).withColumns(s.smoothed()).drop(*s.helpers)


def rolling_extreme(
    df: DataFrame, value: str, size: int, out: str, largest: bool = True, keys: str = "symbol", order: str = "trading_date"
) -> DataFrame:
    """Maximum (or minimum) of the last ``size`` rows, fewer at the start.

    Any such window spans at most two blocks of ``size`` rows: it is the end of one
    and the start of the next. Both come from running extremes, so the work per row
    does not depend on the window length.
    """
    f, pick = ("max", "greatest") if largest else ("min", "least")
    d = df.withColumn("__b", F.expr(f"(row_number() {over(keys, order)} - 1) div {size}"))
    d = d.withColumns(
        {
            "__tail": F.expr(f"{f}({value}) {over([keys, '__b'], order + ' DESC', RUNNING)}"),
            "__head": F.expr(f"{f}({value}) {over([keys, '__b'], order, RUNNING)}"),
        }
    )
    reach = f"lag(__tail, {size - 1}) {over(keys, order)}"
    return d.withColumn(out, F.expr(f"{pick}(__head, {reach})")).drop("__b", "__tail", "__head")


def unique_bars(bars: DataFrame, keys: Sequence[str] = ("symbol", "trading_date")) -> DataFrame:
    """One row per key, the same one whatever the input order.

    Aggregates (with map-side combine) instead of ranking inside the group, so a
    key that holds a large share of all rows shrinks before it is shuffled.
    """
    rest = [c for c in bars.columns if c not in keys]
    return (
        bars.groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("__row"))
        .select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in bars.columns])
    )
