"""Stateful stream operators: time-to-live dedupe, last-three ring, gates and the rows of a sync.

Reference points for time are event times, so results don't depend on when a batch runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textwarden.functions import text as X
from textwarden.functions.dialect import SPARK
from textwarden.streaming.coalesce import folded


def ttl_dedupe(stream: DataFrame, ts: str = "ts", text_col: str = "text", ttl: str = "60 seconds") -> DataFrame:
    """Drops rows whose (stripped) text came within the time to live; works on streams, whose state the watermark bounds."""
    keyed = stream.withColumn("text_hash", F.expr(X.text_hash(SPARK, text_col)))
    return keyed.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["text_hash"])


def ttl_dedupe_batch(df: DataFrame, ts: str, key: str, seconds: int = 60) -> DataFrame:
    """The same for a table: a row goes if a row of its key lies up to ``seconds`` before it."""
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(ts).over(w)
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_b").cast("timestamp")) > seconds * 1_000_000)).drop("_b")


def ring(texts: list[str], keep: list[bool] | None = None, size: int = 3) -> list[bool]:
    """Which texts are analysed: those not among the last ``size`` analysed ones; rows marked in ``keep`` always are."""
    last: list[str] = []
    out = []
    for i, t in enumerate(texts):
        go = t not in last or bool(keep and keep[i])
        if go:
            last = [*last, t][-size:]
        out.append(go)
    return out


def last_three(df: DataFrame, key: str, order: str, text_col: str = "text", always: str | None = None) -> DataFrame:
    """df with ``analysed``: per key in order, the ring over analysed rows only (it can't be a window: what counts depends on earlier answers).

    Rows of a key pass by as a sorted stream, so that the largest key takes no more memory than its last three texts.
    """
    d = df.withColumn("_always", F.coalesce(F.expr(always), F.lit(False)) if always else F.lit(False))

    def step(last: list[str], row: tuple) -> tuple[list[str], bool]:
        go = row[0] not in last or row[1]
        return ([*last, row[0]][-3:] if go else last), go

    return folded(d, [key], [order], [text_col, "_always"], list, step, "analysed", "boolean").drop("_always")


class Ring(StatefulProcessor):
    """The last three analysed texts of a key; with times, a timer forgets a key that has been idle."""

    def __init__(self, order: str, text_col: str, ts: str | None, idle_ms: int) -> None:
        self.order, self.text_col, self.ts, self.idle = order, text_col, ts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "texts array<string>, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, until = self.last.get() if self.last.exists() else ([], 0)
        last, before = list(last), until
        for r in sorted(rows, key=lambda r: r[self.order]):
            go = r[self.text_col] not in last
            if go:
                last = [*last, r[self.text_col]][-3:]
            if self.ts:
                until = max(until, int(r[self.ts].timestamp() * 1000) + self.idle)
            yield Row(**r.asDict(), analysed=go)
        self.last.update((last, until))
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_three_stream(stream: DataFrame, key: str, order: str, text_col: str = "text", ts: str | None = None, idle: float = 3600) -> DataFrame:
    """The same for a stream; the state of a key is its last three analysed texts.

    With ``ts``, the time of a row, a key is forgotten ``idle`` seconds after its last row, so that state follows the keys in use. The session
    needs :data:`coalesce.STORE` as ``spark.sql.streaming.stateStore.providerClass``.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes) + ", analysed boolean"
    if ts:
        stream = stream.withWatermark(ts, "0 seconds")
    return stream.groupBy(key).transformWithState(Ring(order, text_col, ts, int(idle * 1000)), schema, "append", "EventTime" if ts else "None")


def changed(df: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """Rows whose text differs from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_p", F.lag(F.md5(text_col)).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.md5(text_col))).drop("_p")


def gate(df: DataFrame, paused: str = "false", in_scope: str = "true", snoozes: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Rows that aren't paused, are in scope and outside all (start, end) snoozes."""
    d = df.where(f"NOT ({paused}) AND ({in_scope})")
    if snoozes is None:
        return d
    s = snoozes.select(F.col("start").alias("_s"), F.col("end").alias("_e"))
    return d.join(s, (F.col(ts) >= F.col("_s")) & (F.col(ts) < F.col("_e")), "left_anti")


def sync_after(df: DataFrame, last_id: int, order: str = "event_id", limit: int = 200) -> DataFrame:
    """The next rows to send, in order of id."""
    return df.where(F.col(order) > last_id).orderBy(order).limit(limit)
