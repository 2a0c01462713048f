"""Which column of a delivered table is what: by header, by value shape, by the logic of a bar.

All values are read as text. What the shapes say is summed per column over the
unpivoted table, what the logic says in one aggregate over the rows; only as many
rows as the table has columns come to the driver, which then settles the roles.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.normal import normal_cdf

ROLES = ("trading_date", "symbol", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")
#: Least confidence a mapping is accepted with.
ACCEPT = 0.95
TICKER = r"^[A-Za-z]{3}[A-Za-z0-9]?$"
SCHEMA = "role string, column string, method string, confidence double, accepted boolean, problem string"

# fixed values: header words, compared without case, accents and punctuation
HEADERS = {
    "trading_date": ("date", "tradingdate", "dtyyyymmdd", "ngay"),
    "symbol": ("symbol", "ticker", "code", "ma", "mack"),
    "open": ("open", "openfixed", "mocua"),
    "high": ("high", "highfixed", "caonhat"),
    "low": ("low", "lowfixed", "thapnhat"),
    "close": ("close", "closefixed", "dongcua"),
    "volume": ("volume", "vol", "klkhoplenh", "klgd"),
}


def plain_header(name: str) -> str:
    """Letters and digits only, lower case, without accents."""
    text = unicodedata.normalize("NFD", name.lower().replace("đ", "d"))
    return "".join(c for c in text if c.isascii() and c.isalnum())


def header_roles(columns: Sequence[str], headers: Mapping[str, Sequence[str]] = HEADERS) -> dict[str, list[str]]:
    """Columns by the role their header names."""
    return {role: [c for c in columns if plain_header(c) in words] for role, words in headers.items()}


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _is_date(c: Column) -> Column:
    t = F.trim(c)
    return t.rlike(r"^(19|20)\d{6}$") | t.rlike(r"^\d{4}-\d{2}-\d{2}") & t.try_cast("date").isNotNull() | t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")


def _as_date(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(F.when(t.rlike(r"^(19|20)\d{6}$"), F.try_to_date(t, "yyyyMMdd")), F.when(t.rlike("/"), F.try_to_date(t, "d/M/yyyy")), t.try_cast("date"))


def column_shapes(table: DataFrame, ticker: str = TICKER) -> DataFrame:
    """(column, rows, dates, tickers, numbers, counts): per column the filled values and the shares that look like each.

    A count is a whole number that is not negative. Blank values are not counted.
    """
    names = table.columns
    text = table.select(*[F.col(f"`{c}`").cast("string").alias(f"__{i}") for i, c in enumerate(names)])
    long = text.unpivot([], [f"__{i}" for i in range(len(names))], "__c", "v").where(F.trim("v") != "")
    v = F.col("v")
    share = lambda ok: F.avg(F.coalesce(ok, F.lit(False)).cast("int"))
    shapes = long.groupBy("__c").agg(
        F.count(F.lit(1)).alias("rows"), share(_is_date(v)).alias("dates"), share(F.trim(v).rlike(ticker)).alias("tickers"),
        share(_number(v).isNotNull() & ~F.isnan(_number(v))).alias("numbers"), share(F.trim(v).rlike(r"^\d+(\.0*)?$")).alias("counts"),
    )
    label = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(f"__{i}"), F.lit(c)) for i, c in enumerate(names))), F.col("__c"))
    return shapes.select(label.alias("column"), "rows", "dates", "tickers", "numbers", "counts")


@dataclass
class Finding:
    """A mapping tried: its method, the column and confidence of each role, and what speaks against it."""

    method: str
    columns: dict[str, str] = field(default_factory=dict)
    confidence: dict[str, float] = field(default_factory=dict)
    problem: str | None = None

    @property
    def accepted(self) -> bool:
        return self.problem is None

    def rows(self) -> list[tuple]:
        return [(r, self.columns.get(r), self.method, self.confidence.get(r), self.accepted, self.problem) for r in ROLES]


def _judged(table: DataFrame, method: str, columns: dict[str, str], shapes: Mapping, continuity: tuple[int, int] | None = None) -> Finding | None:
    """Confidence of each role of a complete mapping.

    ``continuity`` is that of the open and the close where it is known. Otherwise it
    is looked for, by a sort of all rows, only if every other role holds; else None.
    """
    f = Finding(method, columns)
    f.confidence = {
        "trading_date": shapes[columns["trading_date"]].dates, "symbol": shapes[columns["symbol"]].tickers, "volume": shapes[columns["volume"]].counts,
    }
    x = {r: _number(F.col(f"`{columns[r]}`").cast("string")) for r in PRICES}
    logic = table.agg(
        F.avg((x["high"] >= F.greatest(x["open"], x["close"], x["low"])).cast("int")).alias("high"),
        F.avg((x["low"] <= F.least(x["open"], x["close"], x["high"])).cast("int")).alias("low"),
    ).first()
    f.confidence |= {"high": logic.high or 0.0, "low": logic.low or 0.0}
    if continuity is None:
        if any(sure < ACCEPT for sure in f.confidence.values()):
            return None
        continuity = _continuity(table, columns, x["open"], x["close"])
    f.confidence["open"] = f.confidence["close"] = _sure(table, *continuity)
    weak = sorted(r for r in ROLES if f.confidence[r] < ACCEPT)
    f.problem = f"below {ACCEPT}: {', '.join(weak)}" if weak else None
    return f


def _continuity(table: DataFrame, columns: Mapping[str, str], a: Column, b: Column) -> tuple[int, int]:
    """Rows where ``a`` lies closer to the previous ``b`` than ``b`` to the previous ``a``, and the reverse."""
    day, key = _as_date(F.col(f"`{columns['trading_date']}`").cast("string")), F.col(f"`{columns['symbol']}`").cast("string")
    d = table.select(key.alias("__k"), day.alias("__d"), a.alias("a"), b.alias("b")).where("__d IS NOT NULL")
    w = Window.partitionBy("__k").orderBy("__d")
    d = d.select((F.abs(F.col("a") - F.lag("b").over(w)) - F.abs(F.col("b") - F.lag("a").over(w))).alias("x"))
    r = d.agg(F.count_if(F.col("x") < 0).alias("forward"), F.count_if(F.col("x") > 0).alias("back")).first()
    return r.forward, r.back


def _sure(table: DataFrame, yes: int, no: int) -> float:
    """Chance that ``yes`` outweighs ``no`` for a reason (sign test); one half without evidence."""
    if not yes + no:
        return 0.5
    z = (yes - no) / (yes + no) ** 0.5
    return table.sparkSession.range(1).select(normal_cdf(f"{z!r}D")).first()[0]


def _by_shape(table: DataFrame, shapes: Mapping) -> Finding:
    """A mapping from values alone, or what keeps it open."""
    f = Finding("SHAPE")
    dates = [c for c, s in shapes.items() if s.dates >= ACCEPT]
    tickers = [c for c, s in shapes.items() if s.tickers >= ACCEPT and c not in dates]
    numbers = [c for c, s in shapes.items() if s.numbers >= ACCEPT and c not in dates]
    for role, found in (("trading_date", dates), ("symbol", tickers)):
        if len(found) != 1:
            f.problem = f"{len(found)} columns look like {role}"
            return f
        f.columns[role] = found[0]
    if len(numbers) < 5:
        f.problem = f"{len(numbers)} numeric columns"
        return f
    # prices of a bar lie near one another, so most columns near the row's median are prices
    x = {c: _number(F.col(f"`{c}`").cast("string")) for c in numbers}
    middle = F.array_sort(F.array(*x.values()))[(len(numbers) - 1) // 2]
    near = table.agg(*[F.avg(((v > middle / 2) & (v < middle * 2)).cast("int")).alias(f"__{i}") for i, v in enumerate(x.values())]).first()
    prices = [c for c, share in zip(x, near, strict=True) if (share or 0) >= ACCEPT]
    counts = [c for c in numbers if c not in prices and shapes[c].counts >= ACCEPT]
    for role, found, want in (("price", prices, 4), ("volume", counts, 1)):
        if len(found) != want:
            f.problem = f"{len(found)} columns look like {role}"
            return f
    f.columns["volume"] = counts[0]
    p = {c: x[c] for c in prices}
    tops = [F.avg((v >= F.greatest(*p.values())).cast("int")).alias(f"t{i}") for i, v in enumerate(p.values())]
    lows = [F.avg((v <= F.least(*p.values())).cast("int")).alias(f"b{i}") for i, v in enumerate(p.values())]
    r = table.agg(*tops, *lows).first()
    high = max(range(4), key=lambda i: r[f"t{i}"])
    low = max((i for i in range(4) if i != high), key=lambda i: r[f"b{i}"])
    f.columns |= {"high": prices[high], "low": prices[low]}
    a, b = (prices[i] for i in range(4) if i not in (high, low))
    forward, back = _continuity(table, f.columns, p[a], p[b])
    # exchanged columns exchange the two counts
    f.columns |= {"open": a, "close": b} if forward >= back else {"open": b, "close": a}
    return _judged(table, "SHAPE", f.columns, shapes, (max(forward, back), min(forward, back)))


def detect_columns(table: DataFrame, ticker: str = TICKER, headers: Mapping[str, Sequence[str]] = HEADERS) -> DataFrame:
    """role, column, method, confidence, accepted, problem: one row per role.

    Headers are believed only when they name every role once and the values bear
    them out; otherwise the values decide. Below ``ACCEPT`` in any role nothing is
    accepted and ``problem`` says why, with the roles found so far. An empty table
    is refused. Extra columns are left alone as long as they cannot be taken for
    one of the roles.
    """
    spark = table.sparkSession
    # read by each check
    table = checkpointed(table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns]))
    shapes = {r.column: r for r in column_shapes(table, ticker).collect()}  # one row per column
    named = header_roles(table.columns, headers)
    if all(len(named[r]) == 1 and named[r][0] in shapes for r in ROLES):
        f = _judged(table, "HEADER", {r: named[r][0] for r in ROLES}, shapes)
        if f is not None and f.accepted:
            return spark.createDataFrame(f.rows(), SCHEMA)
    return spark.createDataFrame(_by_shape(table, shapes).rows(), SCHEMA)


def mapped_bars(table: DataFrame, found: DataFrame) -> DataFrame:
    """The table's bars under an accepted mapping; a refused one raises with its reason."""
    rows = {r.role: r for r in found.collect()}  # one row per role
    if not all(r.accepted for r in rows.values()):
        raise ValueError(f"columns not identified: {next(iter(rows.values())).problem}; found {({k: r.column for k, r in rows.items() if r.column})}")
    text = {r: F.col(f"`{rows[r].column}`").cast("string") for r in ROLES}
    return table.select(
        F.upper(F.trim(text["symbol"])).alias("symbol"), _as_date(text["trading_date"]).alias("trading_date"),
        *[_number(text[c]).alias(c) for c in PRICES], _number(text["volume"]).cast("long").alias("volume"),
    )
