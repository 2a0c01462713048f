"""Decoding landed provider payloads into bars, set at a time.

A payload that cannot be mapped without guessing is refused as a whole: its rows are
kept out and the snapshot is reported by ``refused``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "trading_date", "open", "high", "low", "close", "volume", "value", "provider")
NEEDED = ("trading_date", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")

# fixed values: header words of the public price tables
TABLE_ALIASES = {
    "trading_date": ("Ngày", "Ngay"),
    "open": ("Mở cửa", "Mo cua"),
    "high": ("Cao nhất", "Cao nhat"),
    "low": ("Thấp nhất", "Thap nhat"),
    "close": ("Đóng cửa", "Dong cua"),
    "volume": ("KL khớp lệnh", "KL giao dịch", "KLGD"),
}


def raw_files(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Landed files as raw snapshots: bytes, hash, and where they came from."""
    d = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    return d.select(
        F.lit(provider).alias("provider"), F.concat(F.lit(f"{provider}-"), F.substring(sha, 1, 24)).alias("snapshot_id"),
        F.col("modificationTime").alias("ingested_at"), F.col("content").alias("payload"), sha.alias("payload_sha256"),
        F.col("path").alias("source_reference"),
    )


def snapshot_id(provider: Column, payload: Column, request: Column) -> Column:
    """Provider and the first 24 hex digits of a hash over payload and sorted request."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(request))))
    return F.concat(provider, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.sha2(payload, 256), ordered), 256), 1, 24))


def json_records(payload: Column) -> Column:
    """The record list of a JSON payload: bare, or under data, items or records."""
    text = payload.cast("string")
    record = "array<map<string,string>>"
    wrapped = F.from_json(text, f"struct<data:{record},items:{record},records:{record}>")
    bare = F.when(F.substring(F.ltrim(text), 1, 1) == "[", F.from_json(text, record))
    return F.coalesce(bare, wrapped["data"], wrapped["items"], wrapped["records"])


def _day(text: Column) -> Column:
    """ISO date or timestamp text, or unix seconds."""
    seconds = F.when(text.rlike(r"^\d{8,}$"), F.to_date(F.timestamp_seconds(text.try_cast("bigint"))))
    return F.coalesce(seconds, text.try_cast("date"))


def json_bars(
    snapshots: DataFrame, field_map: Mapping[str, str], price_multiplier: float = 1.0, keep: Sequence[str] = ()
) -> DataFrame:
    """Bars from JSON snapshots. ``field_map`` maps our names to the provider's."""
    lacking = sorted(set(NEEDED) - set(field_map))
    if lacking:
        raise ValueError(f"field mapping is incomplete: {lacking}")
    d = _usable(snapshots, field_map).where("__problem IS NULL")
    d = d.select("provider", *keep, F.explode("__records").alias("r"))

    def get(name: str) -> Column:
        return F.col("r")[field_map[name]] if name in field_map else F.lit(None).cast("string")

    return d.select(
        F.upper(F.trim(get("symbol"))).alias("symbol"), _day(get("trading_date")).alias("trading_date"),
        *[(get(c).try_cast("double") * price_multiplier).alias(c) for c in PRICES],
        get("volume").try_cast("double").try_cast("long").alias("volume"), get("value").try_cast("double").alias("value"), "provider", *keep,
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that later expressions read it instead of repeating it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _usable(snapshots: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    """Records of each snapshot, and why it is refused if it is."""
    d = _once(snapshots, "__records", json_records(F.col("payload")))

    def no_key(field: str) -> Column:
        return F.exists("__records", lambda r: ~F.map_contains_key(r, field))

    def no_number(field: str) -> Column:
        return F.exists("__records", lambda r: r[field].try_cast("double").isNull())

    def bad_number(field: str) -> Column:
        """Optional field: blank is no value, other text is refused."""
        return F.exists("__records", lambda r: (F.trim(r[field]) != "") & r[field].try_cast("double").isNull())

    def any_of(conditions: list[Column]) -> Column:
        return F.coalesce(*[F.when(c, True) for c in conditions], F.lit(False))

    problem = (
        F.when(F.col("__records").isNull(), "no record list")
        .when(any_of([no_key(f) for f in field_map.values()]), "a mapped field is missing")
        .when(F.lit("symbol" not in field_map), "no mapped symbol field")
        .when(any_of([no_number(field_map[c]) for c in NEEDED[1:]] + [bad_number(field_map[c]) for c in ("value",) if c in field_map]), "a number cannot be read")
        .when(F.exists("__records", lambda r: _day(r[field_map["trading_date"]]).isNull()), "a trading date cannot be read")
    )
    return d.withColumn("__problem", problem)


def refused(snapshots: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    return _usable(snapshots, field_map).where("__problem IS NOT NULL").select(
        "provider", "snapshot_id", F.col("__problem").alias("problem")
    )


def json_members(snapshots: DataFrame, field: str = "symbol") -> DataFrame:
    """Distinct upper-case index members; a snapshot with a blank symbol is refused."""
    symbols = F.transform(
        json_records(F.col("payload")), lambda r: F.upper(F.trim(F.coalesce(r[field], F.lit(""))))
    )
    d = _once(snapshots, "__s", symbols).where((F.size("__s") > 0) & ~F.array_contains("__s", ""))
    return d.select("snapshot_id", F.explode(F.array_distinct("__s")).alias("symbol"))


def json_index_bars(snapshots: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    """Index bars; turnover only where every record of the snapshot has a value."""
    d = snapshots.withColumn(
        "__all", F.forall(json_records(F.col("payload")), lambda r: r[field_map.get("value", "value")].isNotNull())
    )
    b = json_bars(d, field_map, keep=("snapshot_id", "__all"))
    return b.select(
        F.col("symbol").alias("index_code"), "trading_date", *PRICES, F.when(F.col("__all"), F.col("value")).alias("turnover"),
        "provider", "snapshot_id",
    )


def html_bars(
    pages: DataFrame, aliases: Mapping[str, Sequence[str]] = TABLE_ALIASES, price_multiplier: float = 1000.0
) -> DataFrame:
    """Bars from the first table of HTML pages (columns symbol, provider, html, start, end).

    Prices are in thousands, dates day-first. Pages whose rows do not match the
    header, that lack a column or hold a number or date that cannot be read, give an error row in ``html_problems`` instead.
    """
    d = _tables(pages, aliases).where("__problem IS NULL")
    d = d.select("symbol", "provider", "start", "end", "__at", F.explode("__body").alias("r"))

    def cell(name: str) -> Column:
        return F.get("r", F.col("__at")[name] - 1)

    out = d.select(
        F.upper("symbol").alias("symbol"), F.try_to_date(cell("trading_date"), "d/M/yyyy").alias("trading_date"),
        *[(cell(c).try_cast("double") * price_multiplier).alias(c) for c in PRICES],
        cell("volume").try_cast("double").try_cast("long").alias("volume"), F.lit(None).cast("double").alias("value"), "provider", "start", "end",
    )
    return out.where(F.col("trading_date").between(F.col("start"), F.col("end"))).select(*BAR_COLUMNS)


def html_problems(pages: DataFrame, aliases: Mapping[str, Sequence[str]] = TABLE_ALIASES) -> DataFrame:
    return _tables(pages, aliases).where("__problem IS NOT NULL").select("symbol", F.col("__problem").alias("problem"))


def _tables(pages: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    def parts(text: Column, pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    table = F.regexp_extract("html", r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    cells = F.transform(
        parts(table, r"(?is)<tr\b[^>]*>(.*?)</tr>"),
        lambda r: F.transform(parts(r, r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))),
    )
    d = _once(pages, "__rows", F.filter(cells, lambda r: F.size(r) > 0))
    head = F.get("__rows", F.lit(0))

    def position(names: Sequence[str]) -> Column:
        hit = F.transform(head, lambda h: F.coalesce(*[F.when(h.contains(n), True) for n in names], F.lit(False)))
        return F.array_position(hit, F.lit(True)).cast("int")

    d = _once(d, "__at", F.struct(*[position(names).alias(c) for c, names in aliases.items()]))
    d = d.withColumns(
        {
            "__body": F.when(F.size("__rows") > 1, F.slice("__rows", 2, F.greatest(F.size("__rows") - 1, F.lit(1)))),
        }
    )
    lacks = [F.when(F.coalesce(F.col("__at")[c], F.lit(0)) == 0, F.lit(f"layout lacks {c}")) for c in aliases]
    at = F.col("__at")

    def no_number(c: str) -> Column:
        return F.exists("__body", lambda r: F.get(r, at[c] - 1).try_cast("double").isNull())

    unread = [F.when(no_number(c), F.lit("a number cannot be read")) for c in (*PRICES, "volume") if c in aliases]
    unread.append(F.when(F.exists("__body", lambda r: F.try_to_date(F.get(r, at["trading_date"] - 1), "d/M/yyyy").isNull()), F.lit("a trading date cannot be read")))
    problem = F.coalesce(
        F.when(F.size("__rows") < 2, F.lit("no populated table")),
        F.when(F.exists("__body", lambda r: F.size(r) != F.size(head)), F.lit("inconsistent columns")),
        *lacks,
        *unread,
    )
    return d.withColumn("__problem", problem)
