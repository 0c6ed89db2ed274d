"""Queries that run the session rules as streams: what is there comes in several runs, in order of time, and the rows are those of the batch rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, views
from ..streaming import elapsed, requests, sessions
from . import streams
from .registration import registration

QUERIES, SQL, query = registration()

#: Event time that no run of these queries reaches.
NEVER_MS = 10**13


def _in_runs(spark: SparkSession, inputs: dict[str, DataFrame], time: dict[str, str], start: Callable, runs: int = 3) -> None:
    """Append slices of equal length in time to folders and run ``start(streams)`` over what is new after each; one checkpoint carries its state on."""
    top = readers.scratch(spark)
    spans = [inputs[k].agg(F.min(c), F.max(c)).first() for k, c in time.items()]
    ends = [x for s in spans for x in s if x is not None]
    if not ends:
        return
    low, step = min(ends), (max(ends) - min(ends)) / runs
    for k in range(runs):
        for name, df in inputs.items():
            at = F.col(time[name])
            inside = (at >= F.lit(low + k * step)) & ((at < F.lit(low + (k + 1) * step)) if k < runs - 1 else F.lit(True))
            df.filter(inside).write.mode("append").parquet(f"{top}/{name}")
        start({name: spark.readStream.schema(df.schema).parquet(f"{top}/{name}") for name, df in inputs.items()}).awaitTermination()


def _to_table(spark: SparkSession, found: DataFrame, path: str):
    return found.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()


def _sessions_in_runs(spark: SparkSession, events: DataFrame, rule: Callable) -> DataFrame:
    path, events = readers.scratch(spark), readers.stored(events.withColumn("ts", F.col("ts").cast("timestamp")))
    _in_runs(spark, {"events": events}, {"events": "ts"}, lambda s: _to_table(spark, rule(s["events"], idle_ms=NEVER_MS), path))
    return spark.read.schema("session long, ts timestamp, seq long, kind string, gen long").parquet(f"{path}/rows")


@query("r1_stream_stale_results", streams.SQL["r1_stale_results"])
def r1_stream(spark, d):
    return _sessions_in_runs(spark, views.sessions(spark, d), sessions.stream_current_results).select("session", "seq", "gen")


@query("r2_stream_active_request", streams.SQL["r2_active_request"])
def r2_stream(spark, d):
    kind = F.when(F.col("kind") == "capture", "request").otherwise("reply")
    found = _sessions_in_runs(spark, views.sessions(spark, d).withColumn("kind", kind), sessions.stream_active_replies)
    return found.groupBy("session").agg(F.count("*").alias("replies"))


def _work(spark, d):
    """Starts and ends of work, an id for each event: errors have no start, views two; an end comes by the event's value after its start, or before it, or too late."""
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    starts = e.filter("event_type <> 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.explode(F.when(F.col("event_type") == "view", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    gap = F.round(F.col("value") * 4000 - 60000).cast("long")
    return starts.drop("n"), e.select(F.col("event_id").alias("id"), F.timestamp_micros(F.unix_micros("ts") + gap * 1000).alias("ended_at"))


ELAPSED = """SELECT event_id AS id, CASE WHEN event_type <> 'error' AND gap BETWEEN 0 AND 600000 THEN gap END AS elapsed
    FROM (SELECT *, CAST(round(value * 4000 - 60000) AS BIGINT) AS gap FROM events)"""


@query("r3_elapsed_of_work", ELAPSED)
def r3_joined(spark, d):
    starts, ends = _work(spark, d)
    return elapsed.with_elapsed(starts, ends, within="10 minutes")


@query("r3_stream_elapsed", ELAPSED)
def r3_stream(spark, d):
    """The same as a stream-stream outer join; a last start and end, of no id, push the watermarks past all that waits."""
    path = readers.scratch(spark)
    starts, ends = (readers.stored(x) for x in _work(spark, d))
    late = starts.agg(F.max("started_at").alias("t")).crossJoin(ends.agg(F.max("ended_at").alias("u"))).select((F.greatest("t", "u") + F.expr("interval 2 days")).alias("t")).filter("t is not null")
    none = F.lit(None).cast("long").alias("id")
    starts = starts.unionByName(late.select(none, F.col("t").alias("started_at")))
    ends = ends.unionByName(late.select(none, F.col("t").alias("ended_at")))
    _in_runs(
        spark, {"starts": readers.stored(starts), "ends": readers.stored(ends)}, {"starts": "started_at", "ends": "ended_at"},
        lambda s: _to_table(spark, elapsed.with_elapsed(s["starts"], s["ends"], stream=True), path))
    return spark.read.schema("id long, elapsed long").parquet(f"{path}/rows").filter("id is not null")


@query("r4_stream_requests", streams.SQL["s9_request_lines"])
def r4_stream(spark, d):
    """Request lines through the stream with two sinks, in three runs; the rows are what readers of both tables see."""
    top = readers.scratch(spark)
    events = views.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.expr(streams.REQUESTS).alias("value"))
    tables = f"{top}/requests", f"{top}/errors"
    _in_runs(spark, {"lines": events}, {"lines": "ts"}, lambda s: requests.start_request_stream(s["lines"].select("value"), *tables, f"{top}/state"))
    good, bad = requests.read_requests(spark, *tables)
    return good.unionByName(bad, allowMissingColumns=True)
