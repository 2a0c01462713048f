"""Point-in-time joins over effective-dated intervals and session calendars.

An interval covers ``effective_from <= date <= effective_to``; a missing end is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqpanel.functions.asof import as_of_calendar
from eqpanel.functions.series import spread

SECTOR_FIELDS = {
    "sector": "sector_name",
    "sector_code": "sector_code",
    "sector_taxonomy_version": "taxonomy_version",
    "sector_source_snapshot_id": "source_snapshot_id",
}


def covers(day: Column, start: Column, end: Column) -> Column:
    return (start <= day) & (end.isNull() | (day <= end))


def sectors_as_of(panel: DataFrame, intervals: DataFrame) -> DataFrame:
    """Attach the classification in force on each bar's date, else ``UNKNOWN``.

    Where intervals overlap the later row of the source file wins. Equi-join on
    symbol with the dates as a residual; the pick is an aggregate of the matches.
    """
    m = intervals.select(
        F.upper("symbol").alias("__s"), "effective_from", "effective_to", "file_ordinal",
        F.struct(*[F.col(src).alias(out) for out, src in SECTOR_FIELDS.items()]).alias("__m"),
    )
    base = panel.drop(*SECTOR_FIELDS)
    hit = base.select("symbol", "trading_date").join(
        m, (F.upper("symbol") == F.col("__s")) & covers(F.col("trading_date"), F.col("effective_from"), F.col("effective_to"))
    )
    best = hit.groupBy("symbol", "trading_date").agg(F.max_by("__m", "file_ordinal").alias("__m"))
    d = base.join(best, ["symbol", "trading_date"], "left")
    return d.select(*base.columns, *[F.coalesce(f"__m.{c}", F.lit("UNKNOWN")).alias(c) for c in SECTOR_FIELDS])


def sectors_from_master(panel: DataFrame, master: DataFrame) -> DataFrame:
    """Current classification for every date (a proxy); the last master row wins."""
    m = master.groupBy(F.upper("symbol").alias("__s")).agg(F.max_by("sector", "file_ordinal").alias("sector"))
    d = panel.drop("sector").join(m, F.upper("symbol") == F.col("__s"), "left").drop("__s")
    return d.withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))


def universe_as_of(
    dates: DataFrame, intervals: DataFrame, index_code: str, current_members: DataFrame | None = None, symbols_bound: int | None = None,
) -> DataFrame:
    """Index members on each date: one row per date and member.

    ``dates`` has one column ``as_of`` and is bounded by the calendar. A date no
    interval covers takes ``current_members`` (column ``symbol``) labelled as a proxy
    when given; without it the date is absent here and listed by ``uncovered_dates``.
    """
    days = _numbered(dates)
    members = intervals.where(F.col("index_code") == index_code).withColumn("symbol", F.upper(F.trim("symbol")))
    strict = (
        _covered(members.select("symbol", "effective_from", "effective_to", "source", "source_snapshot_id"), days, symbols_bound)
        .groupBy("as_of", "symbol")
        .agg(F.min("source").alias("source"), F.min("source_snapshot_id").alias("source_snapshot_id"))
        .select("as_of", "symbol", F.lit("STRICT_PIT").alias("mode"), "source", "source_snapshot_id")
    )
    if current_members is None:
        return strict
    # every member stands for each bare date: as many rows as the answer has
    bare = uncovered_dates(dates, intervals, index_code).agg(F.array_sort(F.collect_set("as_of")).alias("__days"))  # bounded by the calendar
    symbols = current_members.select(F.upper("symbol").alias("symbol")).distinct()
    proxy = symbols.join(F.broadcast(bare)).select(F.explode("__days").alias("as_of"), "symbol").select(
        "as_of", "symbol", F.lit("CURRENT_UNIVERSE_PROXY").alias("mode"),
        F.lit("current-provider-membership").alias("source"), F.lit(None).cast("string").alias("source_snapshot_id"),
    )
    return strict.unionByName(proxy)


def _numbered(dates: DataFrame) -> DataFrame:
    """Distinct dates with consecutive numbers from 0; bounded by the calendar."""
    return dates.select("as_of").where("as_of IS NOT NULL").distinct().withColumn("__no", F.row_number().over(Window.orderBy("as_of")) - 1)


def _placed(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """``intervals`` with the numbers of the first and last date they cover; those that cover none are left out."""
    last = days.agg(F.max("__no").alias("__end"))  # one row
    d = as_of_calendar(intervals, "effective_from", days.select("as_of", F.col("__no").alias("__before")), "as_of", ["__before"], strict=True)
    d = as_of_calendar(d, "effective_to", days.select("as_of", F.col("__no").alias("__upto")), "as_of", ["__upto"])
    d = d.crossJoin(F.broadcast(last)).where("effective_from IS NOT NULL")
    d = d.withColumns(
        {"__from": F.coalesce(F.col("__before") + 1, F.lit(0)), "__to": F.when(F.col("effective_to").isNull(), F.col("__end")).otherwise(F.coalesce("__upto", F.lit(-1)))}
    )
    return d.where("__from <= __to").drop("__before", "__upto", "__end")


def _covered(intervals: DataFrame, days: DataFrame, symbols_bound: int | None = None) -> DataFrame:
    """A row for each interval and date it covers: no more than the answer holds.

    Intervals are few and their rows many, so they are dealt out before they are spread.
    """
    d = spread(_placed(intervals, days), symbols_bound, "symbol").withColumn("__no", F.explode(F.sequence("__from", "__to")))
    return d.join(F.broadcast(days), "__no").drop("__no", "__from", "__to")


def uncovered_dates(dates: DataFrame, intervals: DataFrame, index_code: str) -> DataFrame:
    """Dates without any member interval: the error rows of a strict resolution.

    Intervals open and close at dates of the calendar; a running sum of both says
    how many are open.
    """
    days = _numbered(dates)
    spans = _placed(intervals.where(F.col("index_code") == index_code).select("effective_from", "effective_to").distinct(), days)
    steps = spans.select(F.explode(F.array(F.struct(F.col("__from").alias("__no"), F.lit(1).alias("s")), F.struct((F.col("__to") + 1).alias("__no"), F.lit(-1).alias("s")))).alias("e"))
    steps = steps.select("e.*").groupBy("__no").agg(F.sum("s").alias("s"))
    run = F.sum(F.coalesce("s", F.lit(0))).over(Window.orderBy("__no").rowsBetween(Window.unboundedPreceding, 0))
    bare = days.join(steps, "__no", "left").withColumn("open", run).where("open = 0").select("as_of")
    return dates.select("as_of").join(F.broadcast(bare), "as_of", "left_semi")


def universe_summary(members: DataFrame) -> DataFrame:
    return members.groupBy("as_of", "mode").agg(
        F.count(F.lit(1)).alias("members"),
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"),  # few review sources
    )


def exactly_one(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Classification of each (symbol, as_of) request with ``matches``; 1 is valid."""
    m = intervals.withColumnRenamed("symbol", "__s")
    hit = requests.join(
        m, (F.upper("symbol") == F.upper("__s")) & covers(F.col("as_of"), F.col("effective_from"), F.col("effective_to")), "left"
    )
    out = hit.groupBy("symbol", "as_of").agg(
        F.count("__s").alias("matches"), F.max_by("sector_name", "file_ordinal").alias("sector_name")
    )
    return out.select(
        "symbol", "as_of", "matches", F.when(F.col("matches") == 1, F.col("sector_name")).alias("sector_name"),
        F.when(F.col("matches") != 1, "not exactly one classification").alias("error"),
    )


def interval_conflicts(intervals: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of the same symbol has ended."""
    w = Window.partitionBy("symbol", "taxonomy_version").orderBy("effective_from", "effective_to")
    d = intervals.select("symbol", "taxonomy_version", "effective_from", "effective_to", "source_snapshot_id").distinct()
    d = d.withColumns({"__n": F.row_number().over(w), "previous_to": F.lag("effective_to").over(w)})
    clash = (F.col("__n") > 1) & (F.col("previous_to").isNull() | (F.col("effective_from") <= F.col("previous_to")))
    return d.where(clash).select(
        "symbol", "taxonomy_version", "effective_from", "previous_to",
        F.when(F.col("previous_to").isNull(), "open-ended interval overlaps a later one").otherwise("overlapping intervals").alias("problem"),
    )


def numbered_sessions(days: DataFrame) -> DataFrame:
    """The calendar with consecutive numbers; one row per session."""
    return days.select("trading_date").distinct().withColumn(
        "session_no", F.row_number().over(Window.orderBy("trading_date"))
    )


def add_sessions(rows: DataFrame, day: str, calendar: DataFrame, n: int, out: str) -> DataFrame:
    """The session ``n`` sessions after the one on ``day``."""
    c = calendar.select(
        F.col("trading_date").alias(day), F.lead("trading_date", n).over(Window.orderBy("trading_date")).alias(out)
    )
    return rows.join(F.broadcast(c), day, "left")  # bounded by the calendar


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar sessions a symbol has no bar for.

    Found from the gaps between the sessions it does have, so the work is one row
    per bar and one per gap, not symbols times sessions.
    """
    c = calendar.select("trading_date", "session_no")
    ends = c.agg(F.max("session_no").alias("__last"))  # one row
    have = bars.select("symbol", "trading_date").distinct().join(F.broadcast(c), "trading_date")
    w = Window.partitionBy("symbol").orderBy("session_no")
    d = have.join(F.broadcast(ends)).withColumns(
        {
            "__before": F.coalesce(F.lag("session_no").over(w), F.lit(0)) + 1,
            "__final": F.lead("session_no").over(w).isNull(),
        }
    )
    none = F.array().cast("array<int>")
    before = F.when(F.col("__before") < F.col("session_no"), F.sequence("__before", F.col("session_no") - 1)).otherwise(none)
    after = F.when(
        F.col("__final") & (F.col("session_no") < F.col("__last")), F.sequence(F.col("session_no") + 1, F.col("__last"))
    ).otherwise(none)
    gaps = d.select("symbol", F.explode(F.concat(before, after)).alias("session_no"))
    return gaps.join(F.broadcast(c), "session_no").select("symbol", "trading_date")
