"""Daily bars from ticks, the same aggregate in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bars_from_ticks(ticks: DataFrame, late: str | None = None, width: str = "1 day") -> DataFrame:
    """OHLCV per key and window from (key, ts, seq, price, size).

    ``seq`` breaks ties of equal timestamps. With ``late`` a watermark bounds the
    state of a stream; rows later than that are dropped there.
    """
    d = ticks.withWatermark("ts", late) if late else ticks
    at = F.struct("ts", "seq")
    agg = d.groupBy(F.window("ts", width).alias("w"), "key").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume"),
    )
    return agg.select(
        F.col("key").alias("symbol"), F.to_date("w.start").alias("trading_date"), "open", "high", "low", "close", "volume"
    )


def bars_stream(ticks: DataFrame, out: str, checkpoint: str, late: str, width: str = "1 day") -> StreamingQuery:
    """Write the windows each batch changes, open ones included, to a folder of the batch's own.

    A batch that runs again overwrites its folder. ``read_bar_stream`` takes the
    newest state of every window, so the last one is there before the watermark
    closes it. Ends when all that has landed is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch=b{batch_id:012d}")

    s = bars_from_ticks(ticks, late, width).writeStream.outputMode("update").foreachBatch(write)
    return s.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_bar_stream(spark: SparkSession, out: str) -> DataFrame:
    """Newest state of each window."""
    d = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in d.columns if c not in ("symbol", "trading_date", "batch")]
    newest = d.groupBy("symbol", "trading_date").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select("symbol", "trading_date", *[f"r.{c}" for c in rest])
