"""As-of lookups as one sort of both sides together, without comparing pairs.

Requests and facts are united, sorted by time within their keys, and each request
takes the last fact before it. Work and memory do not depend on how far back the
fact lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, take: Sequence[str], tie: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """``left`` with the ``take`` columns of the last ``right`` row of its keys at or before its time.

    ``strict`` leaves out facts of the same time. Of facts with one time the last
    by ``tie`` wins. Null keys meet null keys; a null time finds nothing; every
    left row stays, repeated ones too. A key's rows are sorted by one task, so
    keys need a bounded history (a symbol's sessions); without keys use
    ``as_of_calendar``.
    """
    keys = list(keys)
    order = F.lit(1 if strict else 0)
    facts = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("__t"), order.alias("__o"), F.struct(*take).alias("__f"), F.struct(F.lit(0), *tie).alias("__tie"), F.lit(False).alias("__ask")
    )
    asked = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__o"), F.struct(*left.columns).alias("__l"), F.lit(True).alias("__ask"))
    w = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__o", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    d = facts.unionByName(asked, allowMissingColumns=True).withColumn("__f", F.last("__f", ignorenulls=True).over(w)).where("__ask")
    return d.select("__l.*", *[F.col(f"__f.{c}").alias(c) for c in take])


def as_of_calendar(left: DataFrame, left_time: str, right: DataFrame, right_time: str, take: Sequence[str], strict: bool = False) -> DataFrame:
    """The same against one calendar: ``right`` has a row per session, ``left`` any size.

    Only the distinct times of ``left``, bounded by the calendar too, are merged
    with it; the answer goes back as a join on the time.
    """
    times = left.where(F.col(left_time).isNotNull()).select(F.col(left_time).alias("__at")).distinct()
    found = as_of(times, right, [], "__at", right_time, take, strict=strict)
    return left.join(F.broadcast(found), F.col(left_time) == F.col("__at"), "left").drop("__at")
