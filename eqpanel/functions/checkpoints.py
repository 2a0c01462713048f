"""Cutting lineage through a table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, so the
    data outlives its executors. Stored as Parquet: later readers take only the
    columns they use. Only a local session without that setting gets a scratch
    folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not hasattr(checkpoint_dir, "scratch"):
        checkpoint_dir.scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return checkpoint_dir.scratch
