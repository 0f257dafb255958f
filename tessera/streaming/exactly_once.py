"""Micro-batches that are written once, however often they are run.

A batch goes to a folder of its own attempt; then one small record that names batch and attempt is written,
and refused if the batch has one. Readers see the attempts that records name. A writer that fails
before the record leaves a folder that nobody reads; one that is run again after it does nothing.
Batch numbers are those of one stream: use a new path with a new stream checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "batch long, attempt string, n long"


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_RECORD).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    commits = _commits(spark, path)
    return commits is not None and commits.where(F.col("batch") == batch).limit(1).count() > 0


def commit_batch(rows: DataFrame, batch: int, path: str) -> bool:
    """Write the rows of a batch unless it is there; whether this call wrote it. Nothing is evaluated
    for a batch that is there."""
    spark = rows.sparkSession
    if is_committed(spark, path, batch):
        return False
    attempt = uuid.uuid4().hex
    folder = f"{path}/data/batch={batch}/attempt={attempt}"
    rows.write.mode("errorifexists").parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()
    commit_record(spark, path, batch, attempt, n)
    return True


def commit_record(spark: SparkSession, path: str, batch: int, attempt: str, n: int) -> None:
    """Make an attempt the batch's; an error if it has one."""
    spark.createDataFrame([(batch, attempt, n)], _RECORD).coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/of={batch}")


def committed(spark: SparkSession, path: str, schema: str, with_batch: bool = False) -> DataFrame:
    """Rows of all committed batches; no rows where there are none. Folders that no record names are
    not read: they are partitions that the join prunes."""
    wide = f"{schema}, batch long, attempt string"
    commits = _commits(spark, path)
    if commits is None:
        rows = spark.createDataFrame([], wide)
    else:
        rows = spark.read.schema(wide).option("basePath", f"{path}/data").parquet(f"{path}/data").join(commits.select("batch", "attempt"), ["batch", "attempt"], "left_semi")
    return rows.drop("attempt") if with_batch else rows.drop("attempt", "batch")
