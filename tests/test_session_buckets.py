"""Sessions that share a bucket of stream state: the rows of the batch rule, and each one's state dropped on its own."""

import random
from datetime import datetime, timedelta

from pagemill.streaming import sessions

EVENT = "session long, ts timestamp, seq long, kind string, gen long"
START = datetime(2024, 1, 1)


def ran(spark, top, slices, **bounds):
    """The rows of a stream that gets one slice of events a run, and the rows of state left."""
    for rows in slices:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{top}/in")
        source = spark.readStream.schema(EVENT).parquet(f"{top}/in")
        out = sessions.stream_current_results(source, **bounds).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state")
        q = out.trigger(availableNow=True).start()
        q.awaitTermination()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return sorted((r.session is None, r.session or 0, r.seq, r.gen) for r in spark.read.schema(EVENT).parquet(f"{top}/out").collect()), state


def test_buckets_give_the_rows_of_the_batch_rule(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for seq in range(1500):
        s = rng.choice([*range(60), 2**60 + 1, 2**60 + 2, -5, None])
        rows.append((s, START + timedelta(seconds=seq), seq, rng.choice(["capture", "result", "other", None]), rng.choice([None, *range(4)])))
    want = sorted((r.session is None, r.session or 0, r.seq, r.gen) for r in sessions.current_results(spark.createDataFrame(rows, EVENT)).collect())
    got, state = ran(spark, tmp_path, [rows[:500], rows[500:900], rows[900:]], buckets=3, idle_ms=10**13)
    assert got == want and len(got) > 50
    assert state <= 4  # one a bucket and one for events without a session, not one a session


def test_idle_sessions_of_a_bucket_are_dropped_alone(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    slices = [
        [(1, at(0), 1, "capture", 7), (2, at(0), 2, "capture", 7)],
        [(2, at(50), 3, "capture", 8)],
        [(3, at(90), 4, "capture", 1)],  # the watermark comes to 80 minutes, past 60 for session 1 and not past 110 for session 2
        [(1, at(95), 5, "result", 7), (2, at(95), 6, "result", 8)],
    ]
    assert ran(spark, tmp_path, slices, buckets=1)[0] == [(False, 2, 6, 8)]
