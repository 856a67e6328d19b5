"""A job queue as a stateful stream: attempts, retries that fall due, and retention, per job.

Events say that a job was queued, has failed or is done.  A failure makes the job wait ``delay`` seconds, doubled with each attempt,
then it is due; after ``attempts`` failures it has failed.  Done and failed jobs are kept for a while and then removed.  Waiting and
removal need no event: they are timers, so a job's rows depend on event times alone and not on how events fall into batches.

State is one small row a job; a timer ends it at last, so it does not grow with the stream.  A hot job is one key, whose events are folded
one by one and never held together.

Defined cases: events of a job are taken by time, then id; an event after a job's end begins it anew; events of other kinds, and
those without a job or a time, change nothing; a failure while a retry is waited for counts as the next attempt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Attempts, first delay and time to keep, in seconds.
ATTEMPTS, DELAY, KEEP_DONE, KEEP_FAILED = 3, 2, 24 * 3600, 7 * 24 * 3600
ROWS = "job long, at long, status string, attempts int, next long"
STATE = "status string, attempts int, next long"
#: A job without state: status, attempts, and the time of its timer (microseconds; 0: none).
NEW = ("", 0, 0)
_S = 1_000_000


def due(state: tuple, until: int) -> tuple[list[tuple], tuple]:
    """Rows of the timers that are over by ``until``, and the state behind them."""
    rows = []
    status, attempts, at = state
    while status and at and at <= until:
        if status == "delayed":
            rows.append((at, "due", attempts, 0))
            status, at = "due", 0
        else:
            rows.append((at, "removed", attempts, 0))
            status, attempts, at = NEW
    return rows, (status, attempts, at)


def after(state: tuple, at: int, kind: str) -> tuple[list[tuple], tuple]:
    """Rows and state after an event; timers that were over by then come first."""
    rows, (status, attempts, timer) = due(state, at)
    if status in ("done", "failed"):
        return rows, (status, attempts, timer)  # closed: only its removal is left
    if kind == "queued":
        if not status:
            rows.append((at, "waiting", 0, 0))
            status, attempts, timer = "waiting", 0, 0
    elif kind == "failed":
        attempts += 1
        if attempts >= ATTEMPTS:
            status, timer = "failed", at + KEEP_FAILED * _S
        else:
            status, timer = "delayed", at + DELAY * 2 ** (attempts - 1) * _S
        rows.append((at, status, attempts, timer))
    elif kind == "done":
        status, timer = "done", at + KEEP_DONE * _S
        rows.append((at, status, attempts, timer))
    return rows, (status, attempts, timer)


def job_events(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``job, ts, event_id, kind`` of the events whose type ``kinds`` names."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return events.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind")).filter("job is not null and ts is not null and kind is not null")


def _fold(until: int):
    """Events sorted by job and time to rows; one job's state is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state, last = None, NEW, []

        def closed() -> list[tuple]:
            return [(job, *r) for r in due(state, until)[0]]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["job", "at", "status", "attempts", "next"])

        for batch in batches:
            out = []
            for key, at, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != job:
                    if job is not None:
                        out += closed()
                    job, state = key, NEW
                rows, state = after(state, at, kind)
                out += [(job, *r) for r in rows]
            if out:
                yield packed(out)
        if job is not None:
            last = closed()
        if last:
            yield packed(last)

    return run


def replay(jobs: DataFrame, until: str) -> DataFrame:
    """``job, at, status, attempts, next`` over a table of job events, with timers up to ``until``; times are microseconds."""
    end = int(pd.Timestamp(until).value // 1000)
    rows = jobs.select("job", F.unix_micros("ts").alias("at"), "kind", "event_id").filter(F.col("at") <= end)
    dealt = rows.repartition("job").sortWithinPartitions("job", "at", "event_id")
    return dealt.select("job", "at", "kind").mapInArrow(_fold(end), ROWS)


def track(jobs: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same rows as a stream (append mode); a timer's row comes once the watermark has passed its time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else NEW
        rows: list[tuple] = []
        if held.hasTimedOut:
            rows, state = due(state, held.getCurrentWatermarkMs() * 1000)
        else:
            events = pd.concat(frames).sort_values(["at", "event_id"])
            for at, kind in zip(events["at"].tolist(), events["kind"].tolist(), strict=True):
                more, state = after(state, at, kind)
                rows += more
        if state[0]:
            held.update(state)
            if state[2]:
                # a timer must lie ahead of the watermark; one that is behind fires at the next batch
                held.setTimeoutTimestamp(max(-(-state[2] // 1000), held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["job", "at", "status", "attempts", "next"])

    rows = jobs.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("job").applyInPandasWithState(step, ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
