"""Writers. Each writes with Spark's own commit protocol, so lost tasks are run again safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.integrity import duplicate_keys
from tessera.operators.review import override_violations
from tessera.sources.records import release_path, scan_file_inventory
from tessera.sources.shared import task_count


def canonical_lines(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"})


def write_jsonl(rows: DataFrame, key: str, path: str) -> None:
    """Canonical JSON lines in key order over all part files."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(canonical_lines(rows).alias("value")).write.mode("overwrite").text(path)


def checksum_lines(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy("relative_path").select(F.concat_ws("  ", "sha256", "relative_path").alias("value"))


def write_checksum_list(root: str, path: str, spark) -> None:
    checksum_lines(scan_file_inventory(spark, root)).write.mode("overwrite").text(path)


def write_release_table(rows: DataFrame, root: str, table: str, version: str, release_id: str) -> None:
    """A table of a release under a fresh partition; an existing one is refused with Spark's error."""
    rows.drop("version", "release_id").write.mode("errorifexists").parquet(release_path(root, table, version, release_id))


#: Tables of a release's index.
INDEX_TABLES = ("blocks", "states", "visual_variants", "annotations", "search_text")


def write_release_index(root: str, version: str, release_id: str, **tables: DataFrame) -> None:
    """All tables of a release's index (INDEX_TABLES), each under its own fresh partition."""
    if set(tables) != set(INDEX_TABLES):
        raise ValueError(f"a release has the tables {INDEX_TABLES}")
    for name in INDEX_TABLES:
        write_release_table(tables[name], root, name, version, release_id)


def manifest_row(rows: DataFrame, counts: dict[str, Column], hashes: dict[str, Column], status: Column) -> DataFrame:
    """One row: counts and hashes (aggregates of ``rows``) as structs, and a status over both."""
    row = rows.agg(F.struct(*(c.alias(n) for n, c in counts.items())).alias("counts"), F.struct(*(c.alias(n) for n, c in hashes.items())).alias("hashes"))
    return row.withColumn("status", status)


def write_manifest(rows: DataFrame, counts: dict[str, Column], path: str, hashes: dict[str, Column] | None = None, status: Column | None = None) -> None:
    """A one-row JSON file of counts, hashes and status."""
    if hashes is None:
        row = rows.agg(*(c.alias(n) for n, c in counts.items()))
    else:
        row = manifest_row(rows, counts, hashes, status if status is not None else F.lit("succeeded"))
    row.coalesce(1).write.mode("overwrite").json(path)


def publish_pointer(spark, log: str, version: str, release_id: str, default: bool = False) -> None:
    """Append to the pointer log; the newest row of a version is current, and the version of the newest
    row with ``default`` is the default."""
    row = spark.range(1).select(F.lit(version).alias("version"), F.lit(release_id).alias("release_id"), F.lit(default).alias("is_default"), F.current_timestamp().alias("updated_at"))
    row.write.mode("append").parquet(log)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_manual_package(records: DataFrame, path: str, kind: str = "schema_id", key: str = "record_id", targets: dict[str, DataFrame] | None = None) -> None:
    """Manual records by schema id, in key order in each folder. With ``targets`` (review.override_violations'
    tables) nothing is written unless all references hold and no key repeats within a schema."""
    if targets is not None:
        wrong = duplicate_keys(records, kind, key).limit(1).count() + override_violations(records.withColumnsRenamed({kind: "schema_id", key: "record_id"}), **targets).limit(1).count()
        if wrong:
            raise ValueError("manual records repeat or name missing targets")
    records.repartitionByRange(task_count(records.count()), F.col(kind), F.col(key)).sortWithinPartitions(kind, key).write.mode("overwrite").partitionBy(kind).json(path)
