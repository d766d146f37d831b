"""A keyed work queue on a stream: one open task for each key, retried by timers until it is done or given up."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a key's state holds while its task is open.
TASK = "reason string, since timestamp, attempts int, due timestamp"
#: What the queue says: queued, kept (a second request changed nothing), retry, done, given_up.
LOG = "key long, what string, reason string, attempts int, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(t) -> dt.datetime | None:
    return None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime().replace(tzinfo=None)


class Task:
    """One key's task, moved on by events in the order of their times; each move is a row of the log.

    ``put`` opens a task, or leaves an open one as it is; ``done`` closes it; ``fail`` makes it due at once. A task that is due
    is retried, and due again after ``wait`` seconds; after ``most`` attempts it is given up. Events for a key without a task
    change nothing.
    """

    def __init__(self, key: int, wait: float, most: int, state: tuple | None):
        self.key, self.wait, self.most, self.log = key, dt.timedelta(seconds=wait), most, []
        self.state = (state[0], _plain(state[1]), int(state[2]), _plain(state[3])) if state else None

    def _say(self, what: str, at: dt.datetime, reason: str | None = None) -> None:
        self.log.append((self.key, what, reason if reason is not None else self.state[0], self.state[2] if self.state else 0, at))

    def tick(self, now: dt.datetime) -> None:
        """All that falls due up to a time, each at its own."""
        while self.state and self.state[3] <= now:
            reason, since, attempts, due = self.state
            if attempts >= self.most:
                self._say("given_up", due)
                self.state = None
            else:
                self.state = (reason, since, attempts + 1, due + self.wait)
                self._say("retry", due)

    def on(self, action: str, reason: str | None, at: dt.datetime) -> None:
        self.tick(at)
        if action == "put":
            if self.state:
                self._say("kept", at, reason)
            else:
                self.state = (reason, at, 1, at + self.wait)
                self._say("queued", at)
        elif self.state and action == "done":
            self._say("done", at)
            self.state = None
        elif self.state and action == "fail":
            self.state = (*self.state[:3], at)
            self.tick(at)


class Queue(StatefulProcessor):
    """Tasks in keyed state; a timer wakes a key when its task is due and the watermark has passed that."""

    def __init__(self, wait: float, most: int):
        self.wait, self.most = wait, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", TASK)

    def _settled(self, task: Task, before: dt.datetime | None) -> Iterator[pd.DataFrame]:
        due = task.state[3] if task.state else None
        if due != before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if due:
                self.handle.registerTimer(int(due.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
        if task.state:
            self.task.update(task.state)
        else:
            self.task.clear()
        if task.log:
            yield pd.DataFrame(task.log, columns=["key", "what", "reason", "attempts", "at"])

    def _open(self, key) -> tuple[Task, dt.datetime | None]:
        state = tuple(self.task.get()) if self.task.exists() else None
        task = Task(int(key[0]), self.wait, self.most, state)
        return task, task.state[3] if task.state else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        task, before = self._open(key)
        for _, seq, action, reason, at in sorted((_plain(r.at), r.seq, r.action, None if pd.isna(r.reason) else r.reason, _plain(r.at)) for part in rows for r in part.itertuples()):
            task.on(action, reason, at)
        yield from self._settled(task, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        task, before = self._open(key)
        task.tick(dt.datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000, dt.timezone.utc).replace(tzinfo=None))
        yield from self._settled(task, before)

    def close(self) -> None:
        pass


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, whose state lies in RocksDB, as keyed state with timers needs, and whose times are UTC."""
    out = spark.newSession()
    out.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out.conf.set("spark.sql.session.timeZone", "UTC")
    return out


def queue_log(events: DataFrame, wait: float = 3600.0, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """The queue's log over a stream of events (key, seq, action, reason, at); events later than ``late`` are dropped.

    Its session must keep state in RocksDB (``stream_session``). Every key's task is state of its own: no batch rewrites others.
    """
    rows = events.select(F.col("key").cast("long"), "seq", "action", "reason", "at").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Queue(wait, most), LOG, "append", "eventTime")


def run_queue(events: DataFrame, path: str, checkpoint: str, wait: float = 3600.0, most: int = 3, late: str = "10 minutes") -> StreamingQuery:
    """Appends the log to ``path`` with all that is there; a query that starts again with the checkpoint goes on behind its last
    batch, and files of a batch that did not end are not read."""
    out = queue_log(events, wait, most, late)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def open_tasks(log: DataFrame) -> DataFrame:
    """What is open behind a log: key, reason, since, attempts."""
    opened = log.where("what <> 'kept'").withColumn("turn", F.struct("at", F.when(F.col("what") == "queued", 1).otherwise(0)))
    last = opened.groupBy("key").agg(F.max_by(F.struct("what", "reason", "attempts"), "turn").alias("l"), F.max(F.when(F.col("what") == "queued", F.col("at"))).alias("since"))
    return last.where("l.what not in ('done', 'given_up')").select("key", "l.reason", "since", "l.attempts")
