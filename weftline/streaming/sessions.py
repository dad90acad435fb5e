"""Sessions over a stream: packed values as state, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id long, session_no long, first timestamp, last timestamp, n long, total double"

RUN = np.dtype([("first", np.int64), ("last", np.int64), ("n", np.int64), ("total", np.float64)])


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started inside keep their state in the store that state variables and timers need."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def merged(runs: list[tuple], gap: int) -> list[tuple]:
    """Runs (first, last, n, total) in order, those less than ``gap`` apart made one."""
    out: list[tuple] = []
    for first, last, n, total in sorted(runs):
        if out and first < out[-1][1] + gap:
            a, b, m, t = out[-1]
            out[-1] = (a, max(b, last), m + n, t + total)
        else:
            out.append((first, last, n, total))
    return out


class Sessions(StatefulProcessor):
    """A key's open sessions, the ids it has seen and how many sessions it has closed, as values.

    An event makes a run of its own, and runs that come closer than the gap are
    one, so events may come in any order, and no event is kept. A timer stands
    at the earliest time at which a session is over. An id is forgotten when
    the watermark has passed its time, as Spark drops what comes after that.
    Runs are one packed value, and so are ids with their times: a call of the state store
    goes through a socket, and their number is of batches, not of events. Times are microseconds.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "n long")
        self.open = handle.getValueState("open", "runs binary")
        self.seen = handle.getValueState("seen", "ids binary")

    def _over(self, run: tuple) -> int:
        """The millisecond at which a session can't grow any more."""
        return -(-(run[1] + self.gap) // 1000)

    def _keep(self, runs: list[tuple]) -> None:
        if runs:
            self.open.update((np.array(runs, RUN).tobytes(),))
        else:
            self.open.clear()
        due = [min(map(self._over, runs))] if runs else []
        now = list(self.handle.listTimers())
        if now != due:
            for t in now:
                self.handle.deleteTimer(t)
            for t in due:
                self.handle.registerTimer(t)

    def _runs(self) -> list[tuple]:
        return np.frombuffer(self.open.get()[0], RUN).tolist() if self.open.exists() else []

    def _seen(self) -> dict[int, int]:
        """The ids seen, with their times."""
        if not self.seen.exists():
            return {}
        packed = np.frombuffer(self.seen.get()[0], np.int64).reshape(-1, 2)
        return dict(packed.tolist())

    def _remember(self, known: dict[int, int]) -> None:
        if known:
            self.seen.update((np.array(list(known.items()), np.int64).tobytes(),))
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._seen()
        before, new = len(known), []
        for part in rows:
            for i, at, value in zip(part["event_id"], part["at"], part["value"], strict=True):
                if pd.notna(i):
                    if int(i) in known:
                        continue
                    known[int(i)] = int(at)
                new.append((int(at), int(at), 1, 0.0 if pd.isna(value) else float(value)))
        if len(known) > before:
            self._remember(known)
        if new:
            self._keep(merged([*self._runs(), *new], self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        runs = merged(self._runs(), self.gap)
        over, rest = [r for r in runs if self._over(r) <= now], [r for r in runs if self._over(r) > now]
        n = self.closed.get()[0] if self.closed.exists() else 0
        self.closed.update((n + len(over),))
        known = self._seen()
        late = {i: at for i, at in known.items() if at >= now * 1000}
        if len(late) < len(known):
            self._remember(late)
        self._keep(rest)
        yield _frame([(key[0], n + i, *r) for i, r in enumerate(over, 1)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["user_id", "session_no", "first", "last", "n", "total"])
    for c in ("first", "last"):
        out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
    return out.astype({"session_no": "int64", "n": "int64", "total": "float64"})


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users in a stream of events (event_id, user_id, ts, value), each once, when it is over: user_id, session_no, first, last, n, total.

    An event that comes ``gap`` or more after the one before begins a new
    session. Repeated ids count once, ids that are null always; events without
    a time are left out, and so are those that come later than ``late``.
    Start the stream inside state_store(), in append mode.
    """
    gap_us = pd.Timedelta(gap) // pd.Timedelta(1, "us")
    own = events.where("ts is not null").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return own.select("event_id", "user_id", "ts", "at", "value").groupBy("user_id").transformWithStateInPandas(Sessions(gap_us), OUTPUT, "append", "eventTime")


def batch_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """closed_sessions() of a whole table. With ``late`` the sessions that a stream would still hold open at its end are left out."""
    gap_us = pd.Timedelta(gap) // pd.Timedelta(1, "us")
    own = events.where("ts is not null").withColumn("at", F.unix_micros("ts"))
    one = own.where("event_id is not null").groupBy("event_id").agg(F.min_by(F.struct("user_id", "at", "value"), "at").alias("e")).select("e.*").unionByName(own.where("event_id is null").select("user_id", "at", "value"))
    by = Window.partitionBy("user_id").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(by) >= gap_us, F.lit(True)).cast("int")
    numbered = one.withColumn("b", begins).withColumn("session_no", F.sum("b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("user_id", "session_no").agg(F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    if late is not None:
        end = own.agg((F.floor(F.max("at") / 1000) - pd.Timedelta(late) // pd.Timedelta(1, "ms")).alias("watermark"))
        out = out.join(F.broadcast(end), F.ceil((F.col("z") + gap_us) / 1000) <= F.col("watermark"))  # one row
    return out.select("user_id", F.col("session_no").cast("long").alias("session_no"), F.timestamp_micros("a").alias("first"), F.timestamp_micros("z").alias("last"), "n", "total")
