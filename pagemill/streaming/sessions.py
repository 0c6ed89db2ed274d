"""Session rules over event streams: stale results, the active request, elapsed time, requests split in two.

Each rule has a batch form over a whole table and a streaming form; given the same events
in the same order both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .elapsed import elapsed_ms, with_elapsed  # noqa: F401  rules of their own modules
from .requests import read_requests, split_requests, start_request_stream  # noqa: F401


def current_results(events: DataFrame, opens: str = "capture", answers: str = "result") -> DataFrame:
    """Rows of kind ``answers`` whose generation is still the newest of their session; events: session, ts, seq, kind, gen."""
    before = Window.partitionBy("session").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.max(F.when(F.col("kind") == opens, F.col("gen"))).over(before)
    return events.withColumn("_newest", newest).filter((F.col("kind") == answers) & (F.col("gen") == F.col("_newest"))).drop("_newest")


#: Stands for a generation that is not there.
_NONE = -(2**63)


def stream_current_results(events: DataFrame, opens: str = "capture", answers: str = "result", delay: str = "10 minutes", idle_ms: int = 3_600_000, buckets: int = 1024) -> DataFrame:
    """The same over a stream: two numbers of state per session, dropped ``idle_ms`` of event time after its last event.

    Sessions are dealt to ``buckets`` by a hash, and a bucket's state and rows are worked on together, since a
    call for each session costs far more than its rows; so a bucket holds its share of all live sessions. Events
    may come up to ``delay`` late; within a batch they are put in order, and what is later than that is
    dropped. Timeouts follow the watermark, so a run over what is there ends by itself.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, newest, ends = map(list, state.get) if state.exists else ([], [], [])
        known = pd.DataFrame({"newest": newest, "end": ends}, index=pd.Index(names, dtype="int64"), dtype="int64")
        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["_session", "ts", "seq"])
            session = rows["_session"]
            before = known["newest"].reindex(session.unique(), fill_value=_NONE)
            opened = rows["_gen"].where(rows["kind"] == opens, _NONE)
            now = np.maximum(opened.groupby(session).cummax().to_numpy(), before.loc[session].to_numpy())
            keep = ((rows["kind"] == answers) & (rows["_gen"] == now) & (now != _NONE)).to_numpy()
            last = pd.DataFrame({"newest": now, "ts": rows["ts"].to_numpy()}).groupby(session.to_numpy()).agg({"newest": "max", "ts": "max"})
            # whole milliseconds, rounded down
            end = np.maximum(last["ts"].to_numpy().astype("datetime64[ms]").astype("int64"), passed) + idle_ms
            seen = pd.DataFrame({"newest": last["newest"], "end": end}, index=last.index)
            seen = seen[seen["newest"] != _NONE]
            known = pd.concat([known[~known.index.isin(seen.index)], seen])
            kept = rows[keep]
            if len(kept):
                kept = kept[["_session", "ts", "seq", "kind", "_gen"]].rename(columns={"_session": "session", "_gen": "gen"})
                yield kept.assign(session=None) if key[0] < 0 else kept
        known = known[known["end"] >= passed]
        if len(known):
            state.update((known.index.tolist(), known["newest"].tolist(), known["end"].tolist()))
            state.setTimeoutTimestamp(int(known["end"].min()))
        elif state.exists:
            state.remove()

    session = F.col("session")
    bucket = F.when(session.isNull(), -1).otherwise(F.pmod(F.xxhash64("session"), F.lit(buckets))).cast("int")
    dealt = events.withWatermark("ts", delay).select(
        bucket.alias("_bucket"), F.coalesce(session, F.lit(0)).cast("long").alias("_session"), "ts", "seq", "kind", F.coalesce(F.col("gen").cast("long"), F.lit(_NONE)).alias("_gen"))
    return dealt.groupBy("_bucket").applyInPandasWithState(
        step, "session long, ts timestamp, seq long, kind string, gen long", "sessions array<long>, newest array<long>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def active_replies(events: DataFrame) -> DataFrame:
    """Replies to the newest request of their session; the rule is that of current results."""
    return current_results(events, "request", "reply")


def stream_active_replies(events: DataFrame, **bounds) -> DataFrame:
    """The same over a stream; see ``stream_current_results`` for the bounds."""
    return stream_current_results(events, "request", "reply", **bounds)
