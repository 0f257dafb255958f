"""Folders that all executors reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of a keyed step takes, about.
ROWS_PER_TASK = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) gets a temporary
    folder, which is then its checkpoint folder; on a cluster, whose executors could not read that, it
    is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def task_count(rows: int) -> int:
    """Partitions for so many rows: a task's share, and so its memory, does not grow with the table."""
    return 1 + rows // ROWS_PER_TASK


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed in this block is dealt to tasks of about ROWS_PER_TASK rows, ``rows`` being those of the largest table.

    Spark joins shuffle partitions up to 64 MB as compressed and scans 128 MB of a file at once; columns of made ids
    compress so well that this is many million rows, which a task then hashes and sorts. Here the limits are 4 and 8 MB.
    Tables are broadcast by their size as shuffled alone, as that of their files says little about their rows."""
    partitions = "spark.sql.shuffle.partitions"
    limits = {partitions: str(max(int(spark.conf.get(partitions)), task_count(rows))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.files.maxPartitionBytes": "8m",
              "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written once below the shared folder, for steps that read them several times."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
