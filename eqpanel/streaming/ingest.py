"""Continuous ingest of landed payload files, published batch by batch or not at all.

Every table below the root is written to a folder of the batch's own, named after
its batch id, and becomes readable only when the batch's manifest row exists,
which is written last. A batch that fails half-way leaves readers as they were; a
batch that is run again overwrites its own folders, so replays add nothing.

Nothing is dropped in silence. ``snapshots`` has one row per landed row with what
became of it: ACCEPTED, REPEATED (the id was seen before), LATE (older than the
newest by more than the recheck window; kept with its payload), REFUSED (could
not be mapped). Bars of accepted snapshots go to ``bars``, to ``held`` (their
group has a blocking finding) or are ``stored`` already; the manifest counts all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.functions.ordered import join_null_safe
from eqpanel.functions.series import unique_bars
from eqpanel.operators import quality as Q
from eqpanel.operators.ingest import BAR_KEY, new_observations
from eqpanel.sources.payloads import json_bars, refused

PAYLOAD_SCHEMA = "provider string, snapshot_id string, payload string, ingested_at timestamp"
BARS = "symbol string, trading_date date, open double, high double, low double, close double, volume long, value double, provider string"
TABLES = {
    "bars": BARS,
    "held": f"{BARS}, reason string",
    "findings": "symbol string, severity string, code string, field string, occurrences long",
    "snapshots": "provider string, snapshot_id string, ingested_at timestamp, fate string, problem string, payload string",
}
MANIFEST = (
    "batch_id long, snapshots long, accepted long, repeated long, late long, refused long, decoded long, written long, held long, stored long, "
    "published boolean, newest timestamp"
)


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed snapshot rows. Repeats and late rows are sorted out, and kept, by ``publish_batch``."""
    return spark.readStream.schema(PAYLOAD_SCHEMA).parquet(path)


def ingest_stream(payloads: DataFrame, field_map: Mapping[str, str], root: str, checkpoint: str, late: str = "7 days", hold: str = "symbol") -> StreamingQuery:
    """Run ``publish_batch`` over what has landed; ends when all of it is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, batch_id, field_map, root, late, hold)

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_batch(batch: DataFrame, batch_id: int, field_map: Mapping[str, str], root: str, late: str = "7 days", hold: str = "symbol") -> None:
    """Decode, check and publish one batch.

    ``hold`` says what a blocking finding keeps back: the ``symbol`` it concerns,
    or the whole ``batch`` (then no bar of it is published at all).
    """
    if hold not in ("symbol", "batch"):
        raise ValueError("hold must be 'symbol' or 'batch'")
    spark = batch.sparkSession
    before = manifest(spark, root).where(F.col("batch_id") < batch_id)
    newest = before.agg(F.max("newest")).first()[0]
    landed = checkpointed(_with_fate(batch, _earlier(spark, root, "snapshots", before), newest, late))
    bad = refused(landed.where("fate = 'ACCEPTED'"), field_map).withColumnRenamed("problem", "__p")
    snapshots = landed.join(bad, ["provider", "snapshot_id"], "left")
    mapped = F.col("fate") != "ACCEPTED"
    snapshots = checkpointed(
        snapshots.select(
            "provider", "snapshot_id", "ingested_at", F.when(mapped | F.col("__p").isNull(), F.col("fate")).otherwise("REFUSED").alias("fate"),
            F.when(~mapped, F.col("__p")).alias("problem"), "payload",
        )
    )
    incoming = checkpointed(json_bars(snapshots.where("fate = 'ACCEPTED'"), field_map))
    issues = checkpointed(Q.validate_bars(incoming, ["symbol"]))
    errors = issues.where("severity = 'ERROR'")
    if hold == "batch":
        # one row: the batch as a whole is held or not
        held = incoming.join(F.broadcast(errors.limit(1).select(F.lit("BATCH_HELD").alias("reason"))))
        fresh = incoming if errors.isEmpty() else incoming.limit(0)
    else:
        blocked = errors.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("reason"))
        held = join_null_safe(incoming, blocked, ["symbol"])
        fresh = join_null_safe(incoming, blocked.withColumn("__held", F.lit(True)), ["symbol"], "left").where("__held IS NULL").select(incoming.columns)
    fresh = checkpointed(fresh)
    new = checkpointed(new_observations(unique_bars(fresh, BAR_KEY), _stored(spark, root, fresh, before)))
    _stage(new.withColumn("year", F.year("trading_date")), root, "bars", batch_id, "year")
    _stage(held.select(*[c.split()[0] for c in TABLES["held"].split(", ")]), root, "held", batch_id)
    _stage(issues, root, "findings", batch_id)
    # the payload stays with the rows that have to be looked at again
    kept = F.when(F.col("fate").isin("LATE", "REFUSED"), F.col("payload"))
    _stage(snapshots.withColumn("payload", kept), root, "snapshots", batch_id)
    _record(spark, root, batch_id, snapshots, incoming, new, fresh, newest)


def _with_fate(batch: DataFrame, seen: DataFrame, newest, late: str) -> DataFrame:
    """One row per landed row with its fate; of rows that share an id in the batch the first stays."""
    d = batch.select("provider", "snapshot_id", "payload", "ingested_at")
    ids = ["provider", "snapshot_id"]
    # repeats are counted, not ranked, so that a much repeated id is no hot group
    rows = d.groupBy(*ids).agg(F.min(F.struct("ingested_at", "payload")).alias("__r"), F.count(F.lit(1)).alias("__n"))
    old = seen.where("fate <> 'REPEATED'").select(*ids).distinct().withColumn("__old", F.lit(True))
    rows = rows.join(old, ids, "left")
    limit = F.lit(newest) - F.expr(f"INTERVAL {late}") if newest is not None else F.lit(None).cast("timestamp")
    fate = F.when(F.col("__old"), "REPEATED").when(F.col("__r.ingested_at") < limit, "LATE").otherwise("ACCEPTED")
    first = rows.select(*ids, F.col("__r.payload").alias("payload"), F.col("__r.ingested_at").alias("ingested_at"), fate.alias("fate"))
    again = rows.where("__n > 1").select(
        *ids, F.lit(None).cast("string").alias("payload"), F.col("__r.ingested_at").alias("ingested_at"), F.lit("REPEATED").alias("fate"),
        F.explode(F.sequence(F.lit(2), F.col("__n"))).alias("__k"),
    )
    return first.unionByName(again.drop("__k"))


def _folder(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/revision=b{batch_id:012d}"


def _stage(df: DataFrame, root: str, name: str, batch_id: int, *partition: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(_folder(root, name, batch_id))


def _record(spark: SparkSession, root: str, batch_id: int, snapshots: DataFrame, incoming: DataFrame, new: DataFrame, fresh: DataFrame, newest) -> None:
    """The manifest row, written last: from here on readers see the batch."""
    fate = lambda s: F.count_if(F.col("fate") == s)
    s = snapshots.agg(
        F.count(F.lit(1)).alias("n"), fate("ACCEPTED").alias("a"), fate("REPEATED").alias("r"), fate("LATE").alias("l"), fate("REFUSED").alias("x"),
        F.max("ingested_at").alias("t"),
    ).first()
    decoded, kept, written = incoming.count(), fresh.count(), new.count()
    top = max((t for t in (newest, s.t) if t is not None), default=None)
    row = (batch_id, s.n, s.a, s.r, s.l, s.x, decoded, written, decoded - kept, kept - written, decoded == 0 or kept > 0, top)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(_folder(root, "manifest", batch_id))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished batch."""
    path = f"{root}/manifest"
    d = spark.read.schema(MANIFEST).parquet(path) if _exists(spark, path) else spark.createDataFrame([], MANIFEST)
    return d.select(*[c.split()[0] for c in MANIFEST.split(", ")])


def read_stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table from finished batches only."""
    return _earlier(spark, root, name, manifest(spark, root)).drop("batch_id", "year")


def _earlier(spark: SparkSession, root: str, name: str, batches: DataFrame) -> DataFrame:
    schema = f"{TABLES[name]}, revision string" + (", year int" if name == "bars" else "")
    path = f"{root}/{name}"
    d = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    # one manifest row per batch; the join prunes the folders of unfinished ones
    return d.withColumn("batch_id", F.substring("revision", 2, 12).cast("long")).drop("revision").join(batches.select("batch_id"), "batch_id", "left_semi")


def _stored(spark: SparkSession, root: str, incoming: DataFrame, batches: DataFrame) -> DataFrame:
    """Stored bars of the years that ``incoming`` touches (a handful, read as partitions)."""
    years = [r.y for r in incoming.select(F.year("trading_date").alias("y")).distinct().collect()]
    return _earlier(spark, root, "bars", batches).where(F.col("year").isin(years) if years else F.lit(False))
