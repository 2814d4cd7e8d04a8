"""Streams of task events and job states, over files, with restarts."""

import json
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docquarry.streaming import tasks


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    tasks.stateful(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def event(task, seq, status="run"):
    return {"task_id": task, "seq": seq, "status": status, "data": f"{task}{seq}"}


def test_history_then_live_over_restarts(spark, tmp_path):
    schema = "task_id string, seq long, status string, data string"
    for name in ("history", "live"):
        (tmp_path / name).mkdir()

    def run(files):
        """Start the query anew, wait until it has read so many files, stop it."""
        streams = [spark.readStream.schema(schema).json(str(tmp_path / n)) for n in ("history", "live")]
        out = tasks.task_events(*streams, heartbeat_ms=3_600_000)
        # Timers of processing time keep batches coming, so the query is stopped from outside.
        q = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        seen = 0
        for _ in range(200):
            time.sleep(0.3)
            assert q.exception() is None
            done = len(list((tmp_path / "check" / "commits").glob("[0-9]*")))
            read = sum(len(list((tmp_path / "check" / "sources" / n).glob("[0-9]*"))) for n in "01")
            seen = seen or (read >= files and done + 1)
            if seen and done > seen:
                break
        q.stop()
        return [(r.task_id, r.seq, r.kind) for r in spark.read.schema(tasks.EVENT).json(str(tmp_path / "out")).collect()]

    put(tmp_path / "history", "1", [event("a", s) for s in (1, 2, 3)] + [event("b", 1)])
    put(tmp_path / "live", "1", [event("a", 3), event("a", 5), event("b", 2), event("b", 2)])  # overlaps; 4 is not there yet
    first = run(2)
    assert Counter(first) == Counter([("a", s, "event") for s in (1, 2, 3)] + [("b", s, "event") for s in (1, 2)])
    put(tmp_path / "live", "2", [event("a", 4), event("b", 3, "complete"), event("b", 4)])
    second = run(3)  # a new query from the checkpoint
    assert Counter(second) - Counter(first) == Counter([("a", 4, "event"), ("a", 5, "event"), ("b", 3, "event"), ("b", 3, "done")])
    put(tmp_path / "live", "3", [event("a", 1), event("a", 6, "failed"), event("b", 3, "complete"), event("b", 5)])
    third = run(4)
    assert Counter(third) - Counter(second) == Counter([("a", 6, "event"), ("a", 6, "done")])


def test_heartbeat(spark, tmp_path):
    schema = "task_id string, seq long, status string, data string"
    put(tmp_path / "in", "1", [event("quiet", 1)])
    (tmp_path / "none").mkdir()
    streams = [spark.readStream.schema(schema).json(str(tmp_path / n)) for n in ("in", "none")]
    q = tasks.task_events(*streams, heartbeat_ms=500).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if any(r.kind == "heartbeat" for r in spark.table("beats").collect()):
                break
    finally:
        q.stop()
    assert {r.kind for r in spark.table("beats").collect()} == {"event", "heartbeat"}


START = datetime(2026, 1, 1)


def update(job, minute, state):
    return {"job_id": job, "state": state, "at": (START + timedelta(minutes=minute)).isoformat()}


def test_job_states_time_out_and_go_forward_only(spark, tmp_path):
    batches = [
        [update("a", 0, "pending"), update("a", 1, "parsing"), update("a", 2, "pending"), update("b", 1, "running"), update("c", 0, "odd"), update("d", 0, "pending"), update("d", 3, "done"), update("d", 4, "failed")],
        [update("a", 8, "embedding"), update("a", 9, "done"), update("a", 10, "indexing")],
        [update("b", 30, "chunking"), update("e", 31, "running"), update("e", 32, "indexing")],
        [update("late", 1, "pending"), update("z", 60, "pending")],
        [update("z", 61, "done")],
    ]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        put(tmp_path / "in", str(i), rows)
        stream = spark.readStream.schema("job_id string, state string, at timestamp").json(str(tmp_path / "in"))
        q = tasks.job_states(stream, 600_000, "2 minutes").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    minute = lambda r: (r.at.replace(tzinfo=None) - START).total_seconds() / 60
    got = {(r.job_id, minute(r), r.state, r.accepted, r.reason) for r in spark.read.schema(tasks.CHANGE).json(str(tmp_path / "out")).collect()}
    late = [r for b in batches for r in b if r["job_id"] != "late"]  # dropped behind the watermark
    table = spark.createDataFrame([(r["job_id"], r["state"], datetime.fromisoformat(r["at"])) for r in late], "job_id string, state string, at timestamp")
    twin = tasks.job_states_of(table, 600_000, F.lit((START + timedelta(minutes=59)).isoformat()))
    assert got == {(r.job_id, minute(r), r.state, r.accepted, r.reason) for r in twin.collect()}
    assert ("b", 11.0, "failed", True, "timeout") in got and ("e", 42.0, "failed", True, "timeout") in got and ("b", 30.0, "chunking", False, "ended") in got
    assert ("a", 2.0, "pending", False, "not forward") in got and ("c", 0.0, "odd", False, "unknown state") in got and ("d", 4.0, "failed", False, "ended") in got
