"""Table scans and sinks: CSV, Parquet, staged revisions and published files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.sources.payloads import BAR_COLUMNS

INTERVAL_COLUMNS = {
    "universe": ("index_code", "symbol", "effective_from", "effective_to", "source", "source_snapshot_id"),
    "sector": (
        "symbol", "sector_code", "sector_name", "taxonomy_version", "effective_from", "effective_to", "source", "source_snapshot_id",
    ),
}


def _text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, header names lower-cased and stripped."""
    d = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return d.withColumnsRenamed({c: c.strip().lower() for c in d.columns})


def _csv_rows(spark: SparkSession, path: str, provider: str, start, end, symbol: str | None) -> DataFrame:
    """Typed rows in [start, end] with ``__problem``: the first column that cannot be read, else null."""
    d = _text_csv(spark, path)
    lacking = sorted({"trading_date", "open", "high", "low", "close", "volume"} - set(d.columns))
    if lacking:
        raise ValueError(f"SCHEMA_MISSING: {lacking}")
    d = d.withColumn("trading_date", F.col("trading_date").try_cast("date"))
    d = d.where(F.col("trading_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if "value" not in d.columns:
        d = d.withColumn("value", F.lit(None).cast("string"))
    if symbol is not None:
        d = d.withColumn("symbol", F.lit(symbol))
    numbers = ("open", "high", "low", "close", "value", "volume")
    unread = [F.when((F.trim(c) != "") & F.col(c).try_cast("double").isNull(), F.lit(c)) for c in numbers]
    typed = {c: F.col(c).try_cast("double") for c in numbers} | {"volume": F.col("volume").try_cast("double").try_cast("long")}
    return d.withColumn("__problem", F.coalesce(*unread)).withColumns({**typed, "provider": F.lit(provider)})


def csv_bars(spark: SparkSession, path: str, provider: str, start, end, symbol: str | None = None) -> DataFrame:
    """Bars from CSV files with a header, limited to [start, end].

    Blank numbers are null; a row with text for a number is left out here and
    listed by ``csv_problems``.
    """
    return _csv_rows(spark, path, provider, start, end, symbol).where("__problem IS NULL").select(*BAR_COLUMNS)


def csv_problems(spark: SparkSession, path: str, provider: str, start, end, symbol: str | None = None) -> DataFrame:
    """Rows ``csv_bars`` leaves out and the column that cannot be read."""
    bad = _csv_rows(spark, path, provider, start, end, symbol).where("__problem IS NOT NULL")
    return bad.select("symbol", "trading_date", F.col("__problem").alias("column"))


def csv_members(spark: SparkSession, path: str) -> DataFrame:
    return _text_csv(spark, path).select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct()


def csv_intervals(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Effective-dated membership: a bad start date fails, a bad end date is open."""
    d = _text_csv(spark, path)
    lacking = sorted(set(INTERVAL_COLUMNS[kind]) - set(d.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    # place in the files, for "the later row wins": file, then block, then row in the block
    d = d.withColumn("file_ordinal", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))
    d = d.withColumns(
        {"symbol": F.upper(F.trim("symbol")), "effective_from": F.col("effective_from").cast("date"), "effective_to": F.col("effective_to").try_cast("date")}
    )
    return d.select(*INTERVAL_COLUMNS[kind], "file_ordinal")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet files of a table, united by column name."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows; files already there are not read or rewritten."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def stage_revision(df: DataFrame, path: str, revision: str) -> None:
    """Write a revision next to the published ones; nobody reads it yet."""
    df.write.mode("overwrite").parquet(f"{path}/data/revision={revision}")


def publish(spark: SparkSession, path: str, revision: str, accepted_at) -> None:
    """Make staged rows visible by adding one manifest row."""
    row = spark.createDataFrame([(revision, accepted_at)], "revision string, accepted_at timestamp")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_published(spark: SparkSession, path: str, schema=None, latest_only: bool = False) -> DataFrame:
    """Rows of the published revisions, or of the latest one.

    The manifest holds one row per accepted batch and prunes the revision folders.
    """
    m = spark.read.parquet(f"{path}/manifest")
    reader = spark.read.option("basePath", f"{path}/data")
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)
    if latest_only:
        newest = m.agg(F.max_by("revision", F.struct("accepted_at", "revision")).alias("r")).first().r  # one row
        d = reader.parquet(f"{path}/data/revision={newest}")
        return d.withColumn("revision", F.lit(newest))
    data = reader.parquet(f"{path}/data")
    return data.withColumn("revision", F.col("revision").cast("string")).join(m.select("revision").distinct(), "revision", "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def with_known_evidence(records: DataFrame, raw_snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split reference records into those that point at stored raw evidence and others."""
    known = raw_snapshots.select(F.col("provider").alias("source"), F.col("snapshot_id").alias("source_snapshot_id"))
    keys = ["source", "source_snapshot_id"]
    return records.join(known, keys, "left_semi"), records.join(known, keys, "left_anti")
