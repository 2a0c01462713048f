"""Exact ranks, quantiles and running results for groups of any size.

A window sorts each group in one task. That is fine when a group is known to be
small (``fits_one_task``). Otherwise the group is cut into ordered blocks by range
partitioning, each block is worked on its own, and the small per-block totals
carry what the blocks before contribute. A single group holding most of the rows
is then spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel import params as P
from eqpanel.functions.checkpoints import checkpointed


def fits_one_task(group_bound: int | None, limit: int = P.MAX_WINDOW_GROUP) -> bool:
    """True when the caller proved that no group has more than ``limit`` rows."""
    return group_bound is not None and group_bound <= limit


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group (one aggregated row comes back)."""
    sizes = df.groupBy(*keys).count() if keys else df.select(F.count(F.lit(1)).alias("count"))
    return sizes.agg(F.max("count")).first()[0] or 0


def average_rank_pct(value: Column, *keys: str) -> Column:
    """Percentile 0..100 with ties sharing their mean rank; null stays null.

    For groups that fit one task. The mean rank lies halfway between the first and
    the last rank of the ties, and both come from one sort. Nulls sort last and
    are not counted.
    """
    w = Window.partitionBy(*keys)
    by_value = w.orderBy(value.asc_nulls_last())
    upto = F.count(value).over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(value.isNotNull(), (F.rank().over(by_value) + upto) / 2 / F.count(value).over(w) * 100)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; a null key meets a null key."""
    named = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(named)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in named.items()])
    return left.join(right, same, how).drop(*named.values())


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values of each group with the rows before them.

    Output: keys, value, ``n`` (rows with it), ``before`` (rows with less) and
    ``total``. Equal values collapse in the first (map-side combined) aggregate.
    """
    keys = list(keys)
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the block id has to be the same in both uses below, also after lost executors
    blocks = checkpointed(
        counts.repartitionByRange(parts, *keys, value).withColumn("blk", F.spark_partition_id())
    )
    per_block = blocks.groupBy(*keys, "blk").agg(F.sum("n").alias("bn"))
    by_key = Window.partitionBy(*keys)
    per_block = per_block.withColumns(
        {
            "total": F.sum("bn").over(by_key),
            "earlier": F.coalesce(
                F.sum("bn").over(by_key.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        }
    ).drop("bn")
    inside = Window.partitionBy(*keys, "blk").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        join_null_safe(blocks.withColumn("upto", F.sum("n").over(inside)), per_block, [*keys, "blk"])
        .withColumn("before", F.col("earlier") + F.col("upto") - F.col("n"))
        .select(*keys, value, "n", "before", "total")
    )


def with_rank_pct(
    df: DataFrame, keys: Sequence[str], value: str, out: str, group_bound: int | None = None
) -> DataFrame:
    """Add the average-tie percentile of ``value`` within ``keys``."""
    return with_rank_pcts(df, [(keys, value, out)], group_bound)


def with_rank_pcts(
    df: DataFrame, ranks: Sequence[tuple[Sequence[str], str, str]], group_bound: int | None = None
) -> DataFrame:
    """Add several (keys, value, out) percentiles."""
    if fits_one_task(group_bound):
        return df.withColumns({out: average_rank_pct(F.col(value), *keys) for keys, value, out in ranks})
    # each rank table is built from the stored rows, not from the joins before it
    base = result = checkpointed(df)
    for keys, value, out in ranks:
        pct = (F.col("before") + (F.col("n") + 1) / 2) / F.col("total") * 100
        table = value_positions(base, keys, value).select(*keys, value, pct.alias(out))
        result = join_null_safe(result, table, [*keys, value], "left")
    return result.select(*df.columns, *[out for _, _, out in ranks])


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, group_bound: int | None = None
) -> DataFrame:
    """Number the rows of each group in a total order, from 1."""
    keys = list(keys)
    if fits_one_task(group_bound):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("__blk", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__blk").orderBy(*order))
    d = join_null_safe(blocks.withColumn("__rn", inside), sizes, [*keys, "__blk"])
    return d.withColumn(out, F.col("__before") + F.col("__rn")).select(*df.columns, out)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, float],
    group_bound: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; ``fractions`` names them.

    A group without a value may be absent, so join the result from the left.
    """
    keys = list(keys)
    if fits_one_task(group_bound):
        aggs = [F.percentile(value, q).alias(name) for name, q in fractions.items()]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    pos = value_positions(df, keys, value)
    aggs = []
    for name, q in fractions.items():
        at = F.lit(float(q)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)

        def pick(i: Column) -> Column:
            return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value)))

        share = F.max(at - low)
        aggs.append((pick(low) + (pick(high) - pick(low)) * share).alias(name))
    return pos.groupBy(*keys).agg(*aggs) if keys else pos.agg(*aggs)
