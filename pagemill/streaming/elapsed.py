"""How long results took: ends of work joined with its starts, in batches and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elapsed_ms(started: Column, now: Column) -> Column:
    """Whole milliseconds from start to now; null without a start, and for differences that are negative or not finite."""
    gap = now - started
    finite = ~F.isnan(gap) & (F.abs(gap) < float("inf"))
    return F.when(started.isNotNull() & finite & (gap >= 0), F.floor(gap + 0.5))


def _ms(time: Column) -> Column:
    return (F.unix_micros(time) / 1000).cast("double")


def with_elapsed(starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", stream: bool = False, within: str | None = None) -> DataFrame:
    """id, elapsed of every end: starts (id, started_at), ends (id, ended_at), one start of each id.

    Every end gives a row: null for an id that is null or has no start, and for an end before its start. Of several
    starts of an id the earliest counts, in a stream the first that comes within ``delay``. With ``within``, an end
    later than that after its start counts as having none; a stream always has this bound, ``delay``.

    In a stream an end that found its start is given out at once. One that did not waits until the watermarks of both
    sides say that no start can come any more, and is then given out with null: both sides may be up to ``delay`` late,
    and state older than that is dropped. Ends without a time are left out there, as no watermark passes them.
    """
    if stream:
        first = starts.withWatermark("started_at", delay).dropDuplicatesWithinWatermark(["id"]).withColumnRenamed("id", "start_id")
        ends = ends.withWatermark("ended_at", delay)
        on = (F.col("id") == F.col("start_id")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {delay}"))
        joined = ends.join(first, on, "left_outer")
    else:
        joined = ends.join(starts.groupBy("id").agg(F.min("started_at").alias("started_at")), "id", "left")
    elapsed = elapsed_ms(_ms(F.col("started_at")), _ms(F.col("ended_at")))
    if within and not stream:
        elapsed = F.when(F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"), elapsed)
    return joined.select("id", elapsed.alias("elapsed"))
