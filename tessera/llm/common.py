"""Helpers shared by the text operators: tables, shared scratch space, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import by_bytes, texts_of

#: The white space of the word contracts: space and U+0009 to U+000D.
#: ``bytes.split()`` without arguments splits at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
STRIP_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a filter judges at once.
SLICE_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a cluster, whose
    executors could not read that, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, max_records: int | None = None, by: list[str] | None = None) -> None:
    """Write ``df`` at ``path``. Nothing reads the write's shuffle files again, so Spark drops them
    when it ends."""
    spark = df.sparkSession
    writer = df.write.option("compression", "zstd").mode("overwrite")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if by:
        writer = writer.partitionBy(*by)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, max_records: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    write_table(df, path, max_records)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what numpy and Arrow have freed back to the machine: workers stay alive for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filter_texts(docs: DataFrame, verdict: Callable[[pa.Array], np.ndarray], text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) the verdict is true for, all columns as they
    are. The verdict gets whole texts, some ``SLICE_BYTES`` of them at once. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in by_bytes(texts_of(batch.column(batch.schema.get_field_index(text_column))), SLICE_BYTES):
                yield batch.slice(at, len(part)).filter(pa.array(verdict(part), pa.bool_()))
                at += len(part)
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
