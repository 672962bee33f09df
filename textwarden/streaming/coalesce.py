"""In-flight coalescing: while a job for a key runs, further requests for it start none and are only counted.

A job runs from the request that started it for ``busy`` seconds; a request at its end or later starts the next one. Times are event times.
On a stream the state of a key is its running job, which a timer ends; nothing is kept of a key without one. A table is dealt by key, sorted
by time and read as a stream of batches, so a key with a third of all rows takes no more memory than another.

Rows with a null time are left out; rows of one key and time are taken in any order, and the first starts the job; null keys are one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(df: DataFrame, keys: list[str], order: list[str], read: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], out: str, kind: str) -> DataFrame:
    """df with ``out``, the answers of a fold over each key's rows in order.

    ``step`` gets the state and the values of the columns ``read`` and gives the next state and the answer; ``start`` makes a key's first state. Rows
    come as a sorted stream of batches, so only one state and one batch are held, whatever the size of a key.
    """
    df = df.drop(out)
    names = df.columns
    d = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64()}[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            own = zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True)
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in read), strict=True)
            answers = []
            for key, row in zip(own, rows, strict=True):
                if state is None or key != now:
                    now, state = key, start()
                state, answer = step(state, row)
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, arrow)], [*names, out])

    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)
    return d.mapInArrow(work, f"{kinds}, `{out}` {kind}")


def coalesced(df: DataFrame, keys: list[str], ts: str = "ts", busy: float = 60) -> DataFrame:
    """df with ``job_start``: the start, in microseconds, of the job that each row starts or finds running."""
    length = int(busy * 1_000_000)

    def step(began: int, row: tuple) -> tuple[int, int]:
        at = row[0]
        began = at if began is None or began < 0 or at >= began + length else began
        return began, began

    timed = df.where(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    return folded(timed, keys, ["_at"], ["_at"], lambda: -1, step, "job_start", "bigint").drop("_at")


def jobs(df: DataFrame, keys: list[str], ts: str = "ts", busy: float = 60) -> DataFrame:
    """(keys, job_start, merged): a row for each job, with the requests that came while it ran."""
    return coalesced(df, keys, ts, busy).groupBy(*keys, "job_start").agg((F.count(F.lit(1)) - 1).alias("merged"))


class Running(StatefulProcessor):
    """The running job of a key: start and merged requests; a timer at its end tells and forgets it."""

    def __init__(self, busy_ms: int) -> None:
        self.busy = busy_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "start long, merged long")

    def ended(self, key: tuple) -> Row:
        start, merged = self.job.get()
        self.job.clear()
        return Row(key=key[0], what="ended", at_ms=start + self.busy, merged=merged)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for at in sorted(r.at_ms for r in rows):
            if self.job.exists():
                start, merged = self.job.get()
                if at < start + self.busy:
                    self.job.update((start, merged + 1))
                    continue
                self.handle.deleteTimer(start + self.busy)
                yield self.ended(key)
            self.job.update((at, 0))
            self.handle.registerTimer(at + self.busy)
            yield Row(key=key[0], what="started", at_ms=at, merged=0)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.job.exists() and self.job.get()[0] + self.busy <= expiredTimerInfo.getExpiryTimeInMs():
            yield self.ended(key)

    def close(self) -> None:
        pass


def coalesced_stream(stream: DataFrame, key: str, ts: str = "ts", busy: float = 60, late: str = "0 seconds") -> DataFrame:
    """(key, what, at_ms, merged): a row when a job starts, and one with the merged requests when it has ended.

    The session needs STORE as ``spark.sql.streaming.stateStore.providerClass``.
    """
    d = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), ts)
    return d.groupBy("key").transformWithState(Running(int(busy * 1000)), "key string, what string, at_ms long, merged long", "append", "EventTime")
