"""Monitoring of runs as Structured Streaming jobs, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.window import Window

from tessera.streaming.exactly_once import commit_batch, committed, is_committed

# Legal changes of a run's or stage's status.
TRANSITIONS = [
    ("pending", "running"), ("running", "paused"), ("running", "needs_review"), ("running", "failed"), ("running", "succeeded"),
    ("running", "cancelled"), ("paused", "running"), ("needs_review", "running"), ("failed", "pending"),
]


def windowed_counts(events: DataFrame, time: str, window: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts by key and tumbling window; works on streams and tables. ``late``: watermark delay."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def status_counts(events: DataFrame, key: str, status: str, order: str, *by: str) -> DataFrame:
    """Counts of the keys' latest statuses, of a table; stream_status_counts is the same on a stream."""
    latest = events.groupBy(key, *by).agg(F.max_by(status, F.struct(order, status)).alias(status))
    return latest.groupBy(*by, status).agg(F.count("*").alias("n"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestStatus(StatefulProcessor):
    """For each key the latest (order, status). A change gives the old status back (-1) and counts the
    new one (+1); older events than the one held change nothing."""

    def __init__(self, keys: list[str], state: str, status: str, order: str):
        self.keys, self.state, self.status, self.order = keys, state, status, order

    def _change(self, key: tuple, status: str, change: int) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **{self.status: status, "change": change})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.last.get()) if self.last.exists() else None
        best = max((r[self.order], r[self.status]) for r in rows)
        if held is not None and best <= held:
            return
        self.last.update(best)
        if held is not None and held[1] != best[1]:
            yield self._change(key, held[1], -1)
        if held is None or held[1] != best[1]:
            yield self._change(key, best[1], 1)

    def close(self) -> None:
        pass


def status_changes(source: DataFrame, key: str, status: str, order: str, *by: str) -> DataFrame:
    """The stream of (by, key, status, change): +1 where a key takes a status, -1 where it leaves it. Rows without
    key, status or order are left out. State: one small row for each key."""
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(source.dtypes)
    keys = [*by, key]
    out = ", ".join(f"{c} {kinds[c]}" for c in [*keys, status]) + ", change int"
    processor = LatestStatus(keys, f"at {kinds[order]}, status {kinds[status]}", status, order)
    return source.select(*keys, status, order).dropna(subset=[key, status, order]).groupBy(*keys).transformWithState(processor, out, "Append", "None")


def stream_status_counts(source: DataFrame, key: str, status: str, order: str, path: str, checkpoint: str, *by: str):
    """Start a stream that keeps the latest status of each key as state and writes, for each batch, by how much
    the counts of (by, status) changed: work and output are linear in the batch. current_status_counts
    sums them. A batch that is run again is written once."""

    def write(batch: DataFrame, number: int) -> None:
        commit_batch(batch.groupBy(*by, status).agg(F.sum("change").alias("n")).where("n <> 0"), number, path)

    changes = status_changes(source, key, status, order, *by)
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(by, status, n) as of the last committed batch; schema: the by columns and the status."""
    changes = committed(spark, path, f"{schema}, n long")
    names = [c for c in changes.columns if c != "n"]
    return changes.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")


def stale_heartbeats(jobs: DataFrame, now, seconds: int = 300) -> DataFrame:
    """Running items whose heartbeat is older than ``seconds``; an item's marker stands for its
    stage's."""
    limit = F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(seconds))
    return jobs.where((F.col("status") == "running") & (F.coalesce("heartbeat_at", F.lit("1970-01-01").cast("timestamp")) < limit))


def stale_markers(stages: DataFrame, items: DataFrame, now, seconds: int = 300) -> DataFrame:
    """(run_id, stage, item): stale items, and stale stages that have no stale item."""
    stale_items = stale_heartbeats(items, now, seconds).select("run_id", "stage", F.col("job_id").alias("item"))
    stale_stages = stale_heartbeats(stages, now, seconds).select("run_id", "stage").join(stale_items, ["run_id", "stage"], "left_anti")
    return stale_items.unionByName(stale_stages.withColumn("item", F.lit(None).cast("string")))


def recovery_decision(stale: DataFrame) -> DataFrame:
    """With output complete: succeeded; on the first recovery: pending; else needs_review."""
    return stale.withColumn("decision", F.when(F.col("output_complete"), "succeeded").when(F.col("recovery_attempt") == 0, "pending").otherwise("needs_review"))


class Heartbeats(StatefulProcessor):
    """For each marker its last heartbeat and a timer. A running marker that stays silent is counted as
    stale (+1); one that is heard again, or ends, is given back (-1)."""

    def __init__(self, keys: list[str], status: str, time: str, seconds: int):
        self.keys, self.status, self.time, self.seconds = keys, status, time, seconds

    def _change(self, key: tuple, seen: int, change: int) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), last_seen=datetime.fromtimestamp(seen / 1000), change=change)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seen long, running boolean, stale boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held.get()
        seen, running, stale = (-1, False, False) if held is None else tuple(held)
        newest = max((int(r[self.time].timestamp() * 1000), r[self.status]) for r in rows)
        if newest[0] < seen:
            return
        wait = self.seconds * 1000 + 1
        old = seen + wait if running and not stale else None  # the only timer that a marker has
        seen, running = newest[0], newest[1] == "running"
        late = running and seen + wait <= timerValues.getCurrentWatermarkInMs()
        new = seen + wait if running and not late else None
        if old != new:  # each call goes to the state store
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.held.update((seen, running, late))
        if late != stale:
            yield self._change(key, seen, 1 if late else -1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        seen, running, stale = tuple(self.held.get())
        if running and not stale:
            self.held.update((seen, True, True))
            yield self._change(key, seen, 1)

    def close(self) -> None:
        pass


def stream_stale(heartbeats: DataFrame, keys: list[str], status: str, time: str, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """The stream of (keys, last_seen, change): +1 where a running marker has been silent for ``seconds`` of
    event time, -1 where it is heard again or ends. A null key is a marker of its own (a stage's,
    beside its items'). Rows without time or status are left out."""
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(heartbeats.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", last_seen timestamp, change int"
    rows = heartbeats.select(*keys, status, time).dropna(subset=[status, time]).withWatermark(time, late)
    return rows.groupBy(*keys).transformWithState(Heartbeats(keys, status, time, seconds), out, "Append", "EventTime")


def current_stale_markers(changes: DataFrame) -> DataFrame:
    """(run_id, stage, item) from the changes of stream_stale over those keys: what stale_markers gives of the
    tables. A stage's own marker counts only where none of its items is stale."""
    return items_before_stages(changes.groupBy("run_id", "stage", "item").agg(F.sum("change").alias("n")).where("n > 0").drop("n"))


def items_before_stages(stale: DataFrame) -> DataFrame:
    """Stale markers (run_id, stage, item; null: the stage's own) without those of stages that have a stale item."""
    items = stale.where("item is not null")
    stages = stale.where("item is null").select("run_id", "stage").join(items, ["run_id", "stage"], "left_anti")
    return items.unionByName(stages.withColumn("item", F.lit(None).cast(dict(stale.dtypes)["item"])))


def stream_last_seen(heartbeats: DataFrame, keys: list[str], status: str, time: str, path: str, checkpoint: str):
    """Start a stream that keeps each marker's last heartbeat (seen, in ms) with its status, and writes for each batch those
    that it changed. stale_by_last_seen says which are stale. Spark's own aggregate holds the state, a row for each
    marker; no row passes Python. Where stale markers are asked for and not each change at its time, it stands for
    stream_stale. Rows without time or status are left out; a batch that is run again is written once."""
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    beat = F.struct(F.unix_millis(F.col(time).cast("timestamp")).alias("seen"), F.col(status).alias("status"))
    last = heartbeats.dropna(subset=[status, time]).groupBy(*keys).agg(F.max(beat).alias("last")).select(*keys, "last.seen", "last.status")
    write = lambda batch, number: commit_batch(batch, number, path) and None
    return last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_by_last_seen(last: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """(keys) of running markers that have been silent for ``seconds`` before the newest heartbeat of all. last: (keys,
    seen, status), what stream_last_seen has committed."""
    now = last.agg(F.max("seen").alias("now_"))  # one row
    latest = last.groupBy(*keys).agg(F.max(F.struct("seen", "status")).alias("last_"))
    return latest.join(now).where((F.col("last_.status") == "running") & (F.col("last_.seen") + seconds * 1000 < F.col("now_"))).select(*keys)


def dedupe_tasks(tasks: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Insert-or-ignore on a stream: the first of each key within the watermark."""
    return tasks.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def invalid_transitions(events: DataFrame, key: str, status: str, order: list[str], legal: list[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Changes of a key's status that are not legal: (key, previous, status)."""
    previous = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, b in legal))
    changes = events.withColumn("previous", previous).where((F.col("previous").isNotNull()) & (F.col("previous") != F.col(status)))
    return changes.where(~F.array_contains(pairs, F.concat("previous", F.lit(">"), status)))


def stream_invalid_transitions(events: DataFrame, key: str, status: str, time: str, legal: list[tuple[str, str]] = TRANSITIONS, late: str = "1 hour", forget_s: int = 7 * 86_400) -> DataFrame:
    """The same on a stream; each key keeps its last status until it has been silent for ``forget_s``
    seconds of event time."""
    allowed = set(legal)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, bad = (state.get[0] if state.exists else None), []
        rows = pd.concat(list(frames)).sort_values(time)
        for now in rows[status]:
            if last is not None and now != last and (last, now) not in allowed:
                bad.append((name[0], last, now))
            last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(int(rows[time].max().value // 1_000_000), state.getCurrentWatermarkMs()) + forget_s * 1000)
        yield pd.DataFrame(bad, columns=[key, "previous", status])

    kind = dict(events.dtypes)[key]
    return events.select(key, status, time).withWatermark(time, late).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, previous string, {status} string", "last string", "append", GroupStateTimeout.EventTimeTimeout)


def progress_regressions(events: DataFrame, key: str, phase: str, done: str, order: str, unit: str | None = None) -> DataFrame:
    """Progress events that go back, or (with the column ``unit``) change the unit within a phase; with
    the value and unit ``before``."""
    by = Window.partitionBy(key, phase).orderBy(order)
    seen = events.withColumn("before", F.lag(done).over(by))
    wrong = F.col(done) < F.col("before")
    if unit:
        seen = seen.withColumn("unit_before", F.lag(unit).over(by))
        wrong = wrong | (F.col("unit_before") != F.col(unit))
    return seen.where(F.coalesce(wrong, F.lit(False)))


def incremental(source: DataFrame, transform: Callable[[DataFrame], DataFrame], key: list[str], schema: str, path: str, checkpoint: str):
    """Start a stream that writes ``transform`` of rows whose key (kept by ``transform``) has no output yet;
    ``schema`` is that of the output. Read it with exactly_once.committed. A batch that fails, or is run again,
    leaves one copy: keys are looked up in committed batches alone."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not is_committed(spark, path, number):
            new = batch.dropDuplicates(key).join(committed(spark, path, schema).select(*key), key, "left_anti")
            commit_batch(transform(new), number, path)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
