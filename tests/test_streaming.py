"""Streaming jobs against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import exactly_once, monitor

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"select * from {name}")


def test_transitions(spark, tmp_path):
    rows = [[("a", "pending", START), ("a", "running", START + timedelta(seconds=1)), ("b", "pending", START)], [("a", "pending", START + timedelta(seconds=2)), ("b", "succeeded", START + timedelta(seconds=1))]]
    live, table = stream(spark, tmp_path, rows, "k string, status string, ts timestamp")
    got = {tuple(r) for r in drain(monitor.stream_invalid_transitions(live, "k", "status", "ts"), "bad_changes").collect()}
    want = {tuple(r) for r in monitor.invalid_transitions(table, "k", "status", ["ts"]).select("k", "previous", "status").collect()}
    assert got == want == {("a", "running", "pending"), ("b", "pending", "succeeded")}


def test_windows(spark, tmp_path):
    rows = [[(i, START + timedelta(seconds=20 * i), "x") for i in range(30)]]
    live, table = stream(spark, tmp_path, rows, "id int, ts timestamp, kind string")
    got = sorted(map(tuple, drain(monitor.windowed_counts(live, "ts", "1 minute", "kind"), "counts", "complete").collect()))
    assert got == sorted(map(tuple, monitor.windowed_counts(table, "ts", "1 minute", "kind").collect())) and len(got) == 10
    assert monitor.session_counts(table, "ts", "30 seconds", "kind").count() == 1


def test_stale_by_timers_and_retractions(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [[("r", "s", "a", "running", at(0)), ("r", "s", "b", "running", at(0)), ("r", "s", None, "running", at(0)), ("r", "t", None, "running", at(0))],
            [("r", "s", "b", "running", at(400))],  # a, and both stages, are silent by now; timers go off in the next batch
            [("r", "s", "b", "running", at(410))],
            [("r", "s", "b", "running", at(500)), ("r", "t", None, "running", at(480)), ("r", "u", None, "succeeded", at(500))],  # t is heard again
            [("r", "s", "a", "succeeded", at(650)), ("r", "s", "b", "running", at(700))]]  # a ends; s has no stale item now
    live, table = stream(spark, tmp_path, rows, "run_id string, stage string, item string, status string, ts timestamp")
    changes = drain(monitor.stream_stale(live, ["run_id", "stage", "item"], "status", "ts", 300), "silent")
    changes = spark.createDataFrame(changes.collect(), changes.schema)  # the memory sink cannot be joined with itself
    seen = sorted((r["stage"], r["item"] or "", r["change"]) for r in changes.collect())
    assert seen == [("s", "", 1), ("s", "a", -1), ("s", "a", 1), ("t", "", -1), ("t", "", 1)]
    assert {tuple(r) for r in monitor.current_stale_markers(changes).collect()} == {("r", "s", None)}
    latest = table.groupBy("run_id", "stage", "item").agg(F.max("ts").alias("heartbeat_at"), F.max_by("status", "ts").alias("status")).withColumnRenamed("item", "job_id")
    twin = monitor.stale_markers(latest.where("job_id is null"), latest.where("job_id is not null"), at(700))
    assert {tuple(r) for r in twin.collect()} == {("r", "s", None)}


def test_stale_markers_of_tables(spark):
    stages = spark.createDataFrame([("r", "s", "running", START), ("r", "t", "running", START)], "run_id string, stage string, status string, heartbeat_at timestamp")
    items = stages.where("stage = 's'").withColumn("job_id", F.lit("j"))
    assert {tuple(r) for r in monitor.stale_markers(stages, items, START + timedelta(hours=1)).collect()} == {("r", "s", "j"), ("r", "t", None)}
    stale = spark.createDataFrame([(True, 1), (False, 0), (False, 2)], "output_complete boolean, recovery_attempt int")
    assert [r["decision"] for r in monitor.recovery_decision(stale).collect()] == ["succeeded", "pending", "needs_review"]


def test_status_counts_follow_each_batch(spark, tmp_path):
    """Counts after every batch equal those of the table so far; each batch writes only its changes."""
    batches = [[("j1", "x", "pending", 1), ("j2", "x", "pending", 1), ("j3", "y", "pending", 1)], [("j1", "x", "running", 2), ("j1", "x", "failed", 3), ("j2", "x", "pending", 2)],
               [("j1", "x", "running", 2), ("j3", "y", None, 9), (None, "y", "failed", 9)], [("j1", "x", "pending", 4), ("j2", "x", "running", 5), ("j4", "y", "running", 1)]]
    schema = "job string, stage string, status string, at long"
    source, out = str(tmp_path / "in"), str(tmp_path / "counts")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(schema).parquet(source)
        monitor.stream_status_counts(live, "job", "status", "at", out, str(tmp_path / "state"), "stage").awaitTermination(120)
        got = sorted(map(tuple, monitor.current_status_counts(spark, out, "stage string, status string").collect()))
        twin = monitor.status_counts(spark.read.parquet(source).dropna(), "job", "status", "at", "stage")
        assert got == sorted(map(tuple, twin.collect()))
    changes = exactly_once.committed(spark, out, "stage string, status string, n long", with_batch=True)
    by_batch = {r["batch"]: r["count"] for r in changes.groupBy("batch").count().collect()}
    assert by_batch[0] == 2 and 2 not in by_batch and changes.count() == 2 + 2 + 3


def test_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    """A batch that dies after its rows are written, and is run again, leaves one copy."""
    schema = "k string, n int"
    rows = [[("a", 1), ("b", 1)], [("b", 2), ("c", 2)], [("c", 3), ("d", 3)]]
    live, _ = stream(spark, tmp_path, rows, schema)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def start():
        return monitor.incremental(live, lambda d: d, ["k"], schema, out, state)

    real, broken = exactly_once.commit_record, []

    def dies(spark, path, batch, attempt, n):
        if batch == 1 and not broken:
            broken.append(attempt)
            raise OSError("lost the driver")
        real(spark, path, batch, attempt, n)

    monkeypatch.setattr(exactly_once, "commit_record", dies)
    with pytest.raises(Exception, match="lost the driver"):
        start().awaitTermination(120)
    assert sorted(r["k"] for r in exactly_once.committed(spark, out, schema).collect()) == ["a", "b"]
    assert len(list((tmp_path / "out" / "data" / "batch=1").iterdir())) == 1  # written, but not committed
    start().awaitTermination(120)
    assert sorted(r["k"] for r in exactly_once.committed(spark, out, schema).collect()) == ["a", "b", "c", "d"]
    assert len([p for p in (tmp_path / "out" / "data" / "batch=1").iterdir() if p.is_dir()]) == 2 and broken
    again = spark.createDataFrame([("z", 9)], schema)
    assert not exactly_once.commit_batch(again, 1, out) and exactly_once.committed(spark, out, schema).count() == 4
    with pytest.raises(Exception, match="(?i)exists"):  # of two writers of one batch the second is refused
        real(spark, out, 1, "other", 1)


def test_dedupe(spark, tmp_path):
    live, _ = stream(spark, tmp_path, [[("a", START)], [("a", START), ("b", START)]], "k string, ts timestamp")
    assert sorted(r["k"] for r in drain(monitor.dedupe_tasks(live, "k", "ts"), "tasks").collect()) == ["a", "b"]
    events = spark.createDataFrame([("r", "p", 1, 1), ("r", "p", 3, 2), ("r", "p", 2, 3)], "r string, p string, done int, o int")
    assert monitor.progress_regressions(events, "r", "p", "done", "o").count() == 1


def test_stale_by_last_heartbeats(spark, tmp_path, monkeypatch):
    """Late, equal and retried heartbeats; the markers are those of the tables. No marker passes Python's state."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [[("r", "s", "a", "running", at(0)), ("r", "s", None, "running", at(0)), ("r", "t", None, "running", at(10)), ("r", "u", "x", "succeeded", at(0)), ("r", "u", "x", "running", at(0))],
            [("r", "s", "a", "running", at(650)), ("r", "t", None, None, at(700)), ("r", "v", "y", "running", at(400))],
            [("r", "s", "a", "succeeded", at(5)), ("r", "v", "y", "running", at(399)), ("r", "w", "z", "running", at(100)), ("q", "w", "z", "running", at(700))]]
    live, table = stream(spark, tmp_path, rows, "run_id string, stage string, item string, status string, ts timestamp")
    monkeypatch.setattr(type(table.groupBy("run_id")), "transformWithState", None)
    keys, path = ["run_id", "stage", "item"], str(tmp_path / "seen")
    for _ in range(2):  # the second run has nothing new
        monitor.stream_last_seen(live, keys, "status", "ts", path, str(tmp_path / "state")).awaitTermination(120)
    last = exactly_once.committed(spark, path, "run_id string, stage string, item string, seen long, status string")
    stale = monitor.stale_by_last_seen(last, keys, 300)
    assert {tuple(r) for r in stale.collect()} == {("r", "s", None), ("r", "t", None), ("r", "w", "z")}
    assert {tuple(r) for r in monitor.items_before_stages(stale).collect()} == {("r", "s", None), ("r", "t", None), ("r", "w", "z")}
    latest = table.dropna(subset=["status"]).groupBy(*keys).agg(F.max(F.struct("ts", "status")).alias("l")).select("run_id", "stage", F.col("item").alias("job_id"), F.col("l.ts").alias("heartbeat_at"), F.col("l.status").alias("status"))
    twin = monitor.stale_markers(latest.where("job_id is null"), latest.where("job_id is not null"), at(700))
    assert {tuple(r) for r in twin.collect()} == {("r", "s", None), ("r", "t", None), ("r", "w", "z")}
