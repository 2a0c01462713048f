"""A bar panel, and its companion tables, derived from the order-line tables.

Line items of one supplier in one week make one bar. Prices are whole numbers, so
sums and means are exact. Everything is derived by Spark from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.series import series_window, spread


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a given table; its schema is read from the footer once per process."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def symbol_of(suppkey: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(suppkey.cast("string"), 9, "0"))


def cents(value: Column) -> Column:
    return F.rint(value * 100).cast("long")


def symbol_bound(spark: SparkSession, sf_dir: str) -> int:
    """No session has more bars than there are suppliers (parquet footer count)."""
    return table(spark, sf_dir, "supplier").count()


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppkey and the sector, which is the region of the supplier's nation."""
    return table(spark, sf_dir, "supplier").join(
        F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_suppkey").alias("suppkey"), "s_nationkey", "sector")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 25 nations and 5 regions, at every scale
    return table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("sector"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, and the sector of the later classification."""
    later = _places(spark, sf_dir).select(F.col("n_nationkey").alias("later_key"), F.col("sector").alias("later_sector"))
    return (
        sectors(spark, sf_dir)
        .join(F.broadcast(later), F.col("later_key") == (F.col("s_nationkey") + 7) % 25)
        .select(symbol_of(F.col("suppkey")).alias("symbol"), "suppkey", "sector", "later_sector")
    )


def bars(spark: SparkSession, sf_dir: str, with_sector: bool = True) -> DataFrame:
    """One bar per supplier and week.

    The order lines shrink in a map-side combined aggregate before the shuffle, so
    a supplier with a large share of all lines is no hot spot; what is left is at
    most one row per supplier and week.
    """
    weekly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("suppkey"),
            F.trunc(F.to_date("l_shipdate"), "week").alias("trading_date"),
        )
        .agg(
            F.sum(cents(F.col("l_discount")) - 5).alias("dm"),
            F.max(cents(F.col("l_tax"))).alias("tx"),
            F.sum(F.rint("l_quantity").cast("long")).alias("volume"),
            F.sum(cents(F.col("l_extendedprice"))).alias("value"),
        )
    )
    w = series_window()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.greatest(20000 + 100 * F.sum("dm").over(run), F.lit(1000).cast("long"))
    weekly = spread(weekly.withColumn("symbol", symbol_of(F.col("suppkey"))), symbol_bound(spark, sf_dir), "symbol")
    closes = weekly.withColumn("close", level)
    start = F.coalesce(F.lag("close").over(w), F.col("close")) + 50 * (F.col("volume") % 21 - 10)
    opened = closes.withColumn("open", start)
    if with_sector:
        # by the symbol, as the series are dealt out and sorted: a join by suppkey would sort all bars in Spark's own number of partitions
        own = sectors(spark, sf_dir).select(symbol_of(F.col("suppkey")).alias("own"), F.col("suppkey").alias("key"), "sector")
        opened = opened.join(own, (F.col("symbol") == F.col("own")) & F.col("suppkey").between(F.col("key"), F.col("key")), "left")
    return opened.select(
        "symbol",
        "trading_date",
        "open",
        (F.greatest("open", "close") + 10 * F.col("tx")).alias("high"),
        F.greatest(F.least("open", "close") - 10 * F.col("tx"), F.lit(10).cast("long")).alias("low"),
        "close",
        "volume",
        "value",
        F.lit("p1").alias("provider"),
        *(["sector"] if with_sector else []),
    )


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars``, written once for queries that read them several times."""
    return checkpointed(bars(spark, sf_dir))


def session_bound(panel: DataFrame) -> int:
    """No symbol has more bars than there are sessions (one number comes back)."""
    return panel.agg(F.count_distinct("trading_date")).first()[0]


def nation_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily close per supplier nation: a panel of few symbols with long histories."""
    daily = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("symbol"), F.to_date("l_shipdate").alias("trading_date")
        )
        .agg((F.sum(cents(F.col("l_discount")) - 5)).alias("dm"))
    )
    run = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select("symbol", "trading_date", F.greatest(20000 + 100 * F.sum("dm").over(run), F.lit(1000).cast("long")).alias("close"))


def sessions(panel: DataFrame) -> DataFrame:
    """Session calendar of a panel with consecutive numbers from 1."""
    days = panel.select("trading_date").distinct()
    return days.withColumn("session_no", F.row_number().over(Window.orderBy("trading_date")))


def sector_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated sectors: two intervals, or only the later one."""
    s = securities(spark, sf_dir)
    first = s.where(F.col("suppkey") % 10 != 0).select(
        "symbol", F.lit(1).alias("file_ordinal"), F.col("sector").alias("sector_name"),
        F.lit("1990-01-01").cast("date").alias("effective_from"),
        F.lit("1998-06-30").cast("date").alias("effective_to"),
    )
    second = s.select(
        "symbol", F.lit(2).alias("file_ordinal"), F.col("later_sector").alias("sector_name"),
        F.lit("1998-07-01").cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
    )
    return first.unionByName(second).select(
        "symbol",
        F.concat(F.lit("C"), F.length("sector_name").cast("string"), F.substring("sector_name", 1, 3)).alias(
            "sector_code"
        ),
        "sector_name",
        F.lit("T1").alias("taxonomy_version"),
        "effective_from",
        "effective_to",
        F.lit("review").alias("source"),
        F.concat(F.lit("snap-"), F.col("file_ordinal").cast("string")).alias("source_snapshot_id"),
        "file_ordinal",
    )


def universe_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index membership intervals: a third of the suppliers left again."""
    s = securities(spark, sf_dir)
    leaver = F.col("suppkey") % 3 == 0
    return s.select(
        F.lit("IDX").alias("index_code"),
        "symbol",
        F.when(leaver, F.lit("1997-01-06")).otherwise(F.lit("1995-01-01")).cast("date").alias("effective_from"),
        F.when(leaver, F.lit("1999-12-26")).cast("date").alias("effective_to"),
        F.when(leaver, F.lit("review-b")).otherwise(F.lit("review-a")).alias("source"),
        F.when(leaver, F.lit("snap-b")).otherwise(F.lit("snap-a")).alias("source_snapshot_id"),
    )


def second_provider(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """The same bars from provider p2; every 13th session disagrees on close."""
    # one row per session, bounded by the calendar
    p = panel.join(F.broadcast(calendar), "trading_date")
    off = F.when(F.col("session_no") % 13 == 0, F.lit(100).cast("long")).otherwise(F.lit(0).cast("long"))
    return p.withColumns(
        {"close": F.col("close") + off, "high": F.col("high") + off, "provider": F.lit("p2")}
    ).drop("session_no")


def official_index(panel: DataFrame, code: str) -> DataFrame:
    """Volume-weighted level and turnover per session, as an official index series."""
    return panel.groupBy("trading_date").agg(
        F.lit(code).alias("index_code"),
        (F.sum(F.col("close") * F.col("volume")).cast("double") / F.nullif(F.sum("volume"), F.lit(0))).alias("close"),
        F.sum("value").cast("double").alias("turnover"),
    )
