"""Stateful streams: task events from history and live, and states of jobs with timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States of a job in the order in which it takes them; the last two end it.
JOB_STATES = {"pending": 0, "running": 1, "parsing": 2, "chunking": 3, "embedding": 4, "indexing": 5, "done": 6, "failed": 6}
#: States that end a task's events.
ENDS = ("complete", "failed")

EVENT = "task_id string, seq long, kind string, status string, data string"


class _Relay(StatefulProcessor):
    """Per task: the sequence number up to which events went out, events that wait for an
    earlier one, and when the next heartbeat is due."""

    def __init__(self, heartbeat_ms: int):
        self.heartbeat_ms = heartbeat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "seq long, ended boolean")
        self.waiting = handle.getMapState("waiting", "seq long", "status string, data string")

    def _beat_after(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.heartbeat_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, ended = self.sent.get() if self.sent.exists() else (0, False)
        out = []
        for pdf in rows:
            for seq, status, data in zip(pdf["seq"], pdf["status"], pdf["data"], strict=True):
                if not ended and seq > last:
                    self.waiting.updateValue((int(seq),), (status, data))
        while not ended and self.waiting.containsKey((last + 1,)):
            last += 1
            status, data = self.waiting.getValue((last,))
            self.waiting.removeKey((last,))
            out.append((key[0], last, "event", status, data))
            ended = status in ENDS
        self.sent.update((last, ended))
        if ended:
            out.append((key[0], last, "done", out[-1][3] if out else None, None))
            self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            self._beat_after(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out if not ended or len(out) > 1 else [], columns=["task_id", "seq", "kind", "status", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, ended = self.sent.get()
        if not ended:
            self._beat_after(timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame([(key[0], last, "heartbeat", None, None)], columns=["task_id", "seq", "kind", "status", "data"])


def task_events(history: DataFrame, live: DataFrame, heartbeat_ms: int = 15_000) -> DataFrame:
    """One stream of each task's events: first those of ``history``, then those of ``live`` (both
    streams of task_id, seq from 1, status, data), in order of ``seq``.

    An event that is in both, or comes again, goes out once; one that comes before its
    predecessor waits for it. After a final status a row of kind ``done`` follows and later events are
    dropped. A task that is silent for ``heartbeat_ms`` of processing time gives a ``heartbeat``. State lives in
    the checkpoint: a restart neither loses nor repeats an event. Tasks are dealt by key; the state of
    one holds only what waits. Needs the RocksDB state store (see ``stateful``)."""
    columns = [F.col("task_id").cast("string").alias("task_id"), F.col("seq").cast("long").alias("seq"), "status", "data"]
    both = history.select(*columns).unionByName(live.select(*columns)).where("task_id is not null and seq is not null")
    return both.groupBy("task_id").transformWithStateInPandas(_Relay(heartbeat_ms), outputStructType=EVENT, outputMode="Append", timeMode="ProcessingTime")


def stateful(spark) -> None:
    """Set the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- job states

CHANGE = "job_id string, at timestamp, state string, accepted boolean, reason string"


class _Jobs(StatefulProcessor):
    """Per job: rank and time of its last accepted state. An event-time timer fails it."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "rank int, at long")

    def _wait_from(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        every["ms"] = every["at"].astype("datetime64[ms]").astype("int64")
        every["rank"] = every["state"].map(JOB_STATES).fillna(-1).astype(int)
        rank, at = self.now.get() if self.now.exists() else (-1, None)
        out = []
        for r in every.sort_values(["ms", "rank", "state"]).itertuples():
            if at is not None and rank < 6 and r.ms > at + self.timeout_ms:
                at, rank = at + self.timeout_ms, 6
                out.append((key[0], pd.Timestamp(at, unit="ms"), "failed", True, "timeout"))
            good = r.rank > rank
            out.append((key[0], r.at, r.state, good, None if good else "ended" if rank == 6 else "unknown state" if r.rank < 0 else "not forward"))
            if good:
                rank, at = r.rank, r.ms
        if at is not None:
            self.now.update((rank, at))
        if rank in (-1, 6):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            self._wait_from(at)
        yield pd.DataFrame(out, columns=["job_id", "at", "state", "accepted", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rank, at = self.now.get()
        if rank < 6:
            self.now.update((6, at + self.timeout_ms))
            yield pd.DataFrame([(key[0], pd.Timestamp(at + self.timeout_ms, unit="ms"), "failed", True, "timeout")], columns=["job_id", "at", "state", "accepted", "reason"])


def job_states(updates: DataFrame, timeout_ms: int = 600_000, late: str = "5 minutes") -> DataFrame:
    """State changes of jobs: a row for each row of the stream ``updates`` (job_id, state, at), which
    says whether it was accepted, and one for each job that a timeout failed.

    A state is accepted if it lies further on than all accepted before (stages may be skipped); after ``done`` or
    ``failed`` none is. A job whose last accepted state is older than ``timeout_ms`` of event time fails then,
    once the watermark has passed. Rows behind the watermark are dropped by Spark. Updates of
    a job within a batch are taken in order of time."""
    rows = updates.select(F.col("job_id").cast("string").alias("job_id"), "state", "at").where("job_id is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(timeout_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def job_states_of(updates: DataFrame, timeout_ms: int, until: Column) -> DataFrame:
    """``job_states`` of a whole table, as at ``until``: the same rows, from windows over each job in order of
    time. The first accepted state after a pause over the timeout comes too late, and with it
    all that follow."""
    ranks = F.create_map(*(F.lit(x) for pair in JOB_STATES.items() for x in pair))
    rows = updates.select(F.col("job_id").cast("string").alias("job_id"), "state", F.col("at").cast("timestamp").alias("at")).where("job_id is not null and at is not null")
    rows = rows.withColumns({"ms": F.unix_millis("at"), "rank": F.coalesce(F.try_element_at(ranks, F.col("state")), F.lit(-1))})
    order = Window.partitionBy("job_id").orderBy("ms", "rank", "state")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("top", F.coalesce(F.max("rank").over(before), F.lit(-1)))
    rows = rows.withColumn("forward", F.col("rank") > F.col("top"))
    rows = rows.withColumn("last", F.max(F.when(F.col("forward"), F.col("ms"))).over(before))
    # The pause before any row, forward or not, ends a job that has begun and not ended.
    lapsed = (F.col("top").between(0, 5)) & (F.col("ms") > F.col("last") + timeout_ms)
    rows = rows.withColumn("cut", F.min(F.when(lapsed, F.col("last") + timeout_ms)).over(Window.partitionBy("job_id")))
    dead = F.coalesce(F.col("ms") > F.col("cut"), F.lit(False))
    reason = F.when(dead, F.lit("ended")).when(~F.col("forward"), F.when(F.col("top") == 6, "ended").when(F.col("rank") < 0, "unknown state").otherwise("not forward"))
    said = rows.select("job_id", "at", "state", (F.col("forward") & ~dead).alias("accepted"), reason.alias("reason"))
    ends = rows.groupBy("job_id").agg(F.min("cut").alias("cut"), F.max("rank").alias("top"), F.max(F.when(F.col("forward"), F.col("ms"))).alias("last"))
    over = F.coalesce("cut", F.when(F.col("top").between(0, 5) & (F.unix_millis(until.cast("timestamp")) > F.col("last") + timeout_ms), F.col("last") + timeout_ms))
    failed = ends.withColumn("over", over).where("over is not null")
    return said.unionByName(failed.select("job_id", F.timestamp_millis("over").alias("at"), F.lit("failed").alias("state"), F.lit(True).alias("accepted"), F.lit("timeout").alias("reason")))
