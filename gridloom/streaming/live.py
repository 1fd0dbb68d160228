"""The run log as streams: latest states, duplicate events, and the review queue with its time limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def without_repeats(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Each event id once, as long as repeats come within the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def latest_steps(events: DataFrame) -> DataFrame:
    """The running state of each step; for complete or update mode."""
    key = F.struct("ts", "seq")
    return events.groupBy("run_id", "step").agg(F.max_by("kind", key).alias("kind"), F.max("ts").alias("ts"))


def step_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind in each window of event time; rows that come later than ``late`` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "kind", "n")


def reviews(messages: DataFrame, wait_s: int = 3600, late: str = "1 minute") -> DataFrame:
    """messages (run_id, kind request/answer, answer, ts) -> (run_id, status, answer): the first answer of a request, or timed_out after wait_s of event time.

    An answer without a request is kept for one that comes later within the same limit. State lives for ``wait_s`` after the watermark.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (waiting, _, _) = state.get
            state.remove()
            if waiting:
                yield pd.DataFrame({"run_id": [key[0]], "status": ["timed_out"], "answer": [None]})
            return
        waiting, answer, done = state.get if state.exists else (False, None, False)
        last = 0
        for rows in batches:
            for kind, text, ts in rows.sort_values("ts")[["kind", "answer", "ts"]].itertuples(index=False, name=None):
                last = max(last, int(ts.timestamp() * 1000))
                waiting = waiting or kind == "request"
                answer = text if kind == "answer" and answer is None else answer
        if waiting and answer is not None and not done:
            done, waiting = True, False
            yield pd.DataFrame({"run_id": [key[0]], "status": ["answered"], "answer": [answer]})
        state.update((waiting and not done, answer, done))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + 1000 * wait_s)

    stream = messages.withWatermark("ts", late).groupBy("run_id")
    return stream.applyInPandasWithState(
        step, "run_id string, status string, answer string", "waiting boolean, answer string, done boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
