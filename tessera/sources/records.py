"""Readers: JSON lines, documents, inventories, checksum lists, releases, run tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def parse_jsonl(lines: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """Parsed columns of each line, ``raw`` and ``error``: bad_utf8, bad_json or not_object instead of
    a failed job. ``value`` is a string or binary column."""
    raw = F.col(value)
    bytes_ = dict(lines.dtypes)[value] == "binary"
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")) if bytes_ else raw
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*struct.fields, T.StructField("corrupt_", T.StringType())])
    parsed = lines.select("*", text.alias("text_")).withColumn("r_", F.from_json("text_", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"}))
    error = (F.when(F.col(value).isNotNull() & F.col("text_").isNull(), "bad_utf8").when(F.try_parse_json("text_").isNull(), "bad_json")
             .when(~F.trim("text_").startswith("{"), "not_object").when(F.col("r_.corrupt_").isNotNull(), "bad_record"))
    out = parsed.withColumn("error", error)
    return out.select(*(F.when(F.col("error").isNull(), F.col("r_")[f.name]).alias(f.name) for f in struct.fields), F.col("text_").alias("raw"), "error",
                      *(c for c in lines.columns if c != value))


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema)


def scan_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects only; blank lines and other values are left out."""
    return scan_jsonl_tolerant(spark, path, schema).where("error is null").drop("error")


def jsonl_format_issues(spark: SparkSession, path: str) -> DataFrame:
    """(path, code): carriage returns, empty lines, a missing final line feed, of each file."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("t"), "length")
    codes = F.array_compact(F.array(
        F.when(F.col("t").contains("\r"), "TEXT_NOT_LF"), F.when((F.col("length") > 0) & ~F.col("t").endswith("\n"), "JSONL_MISSING_FINAL_LF"),
        F.when(F.col("t").rlike(r"(^|\n)\n"), "JSONL_EMPTY_LINE")))
    return files.select("path", F.explode(codes).alias("code"))


def scan_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Records, and issues (path, code) of lines and files."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    parsed = parse_jsonl(lines, schema)
    codes = {"bad_utf8": "JSONL_READ_FAILED", "bad_json": "JSONL_PARSE_FAILED", "not_object": "JSONL_RECORD_NOT_OBJECT", "bad_record": "SCHEMA_VALIDATION_FAILED"}
    code = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    bad = parsed.where("error is not null and raw <> ''").select("path", F.element_at(code, F.col("error")).alias("code"))
    return parsed.where("error is null"), bad.unionByName(jsonl_format_issues(spark, path))


def scan_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return parse_jsonl(spark.read.text(path, wholetext=True), schema)


def scan_file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size, sha256) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.regexp_replace("path", rf"^.*?{_quoted(base)}/", "").alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def parse_checksum_list(lines: DataFrame) -> DataFrame:
    """(list, line_no, sha256, path, issue) of rows (list, line_no, value): bad line, bad path, repeated
    path or wrong order, each within its list. Without a column ``list`` all lines are one list."""
    if "list" not in lines.columns:
        lines = lines.withColumn("list", F.lit(""))
    pattern = r"^([0-9a-f]{64})  (.+)$"
    rows = lines.select("list", "line_no", "value", F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("sha256"), F.nullif(F.regexp_extract("value", pattern, 2), F.lit("")).alias("path"))
    bad_path = F.col("path").rlike(r"[\\\x00]|^/|^[A-Za-z]:") | F.exists(F.split("path", "/"), lambda p: p.isin("", ".", ".."))
    repeated = rows.where("path is not null").groupBy("list", "path").agg(F.min("line_no").alias("first_"))
    cuts = F.lag("path").over(Window.partitionBy("list").orderBy("line_no"))
    rows = rows.join(repeated, ["list", "path"], "left").withColumn("before_", cuts)
    issue = (F.when(F.col("path").isNull(), "CHECKSUM_LINE_INVALID").when(bad_path, "CHECKSUM_PATH_INVALID").when(F.col("line_no") > F.col("first_"), "CHECKSUM_PATH_DUPLICATE")
             .when(F.col("path") < F.col("before_"), "CHECKSUM_ORDER_INVALID"))
    return rows.select("list", "line_no", "sha256", "path", issue.alias("issue"))


def scan_checksum_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("list"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "value"))
    return parse_checksum_list(lines)


def parse_payload(rows: DataFrame, payload: str, schema: T.StructType | str) -> DataFrame:
    """Key columns with the JSON payload as a struct ``record``; ``valid`` is false for bad JSON."""
    return rows.withColumn("record", F.from_json(payload, schema)).withColumn("valid", F.try_parse_json(payload).isNotNull()).drop(payload)


def scan_release(spark: SparkSession, root: str, version: str, release_id: str, table: str) -> DataFrame:
    """One table of one release: its partition alone is read."""
    return spark.read.parquet(release_path(root, table, version, release_id)).withColumns({"version": F.lit(version), "release_id": F.lit(release_id)})


def release_path(root: str, table: str, version: str, release_id: str) -> str:
    for name in (version, release_id):
        if not re.fullmatch(r"[A-Za-z0-9_.\-]+", name):
            raise ValueError(f"not a name of a version or release: {name!r}")
    return f"{root}/{table}/version={version}/release_id={release_id}"


def resolve_release(pointers: DataFrame, requested: str | None = None) -> DataFrame:
    """(status, version, release_id, available): the requested version's release, else that of the
    version which was made the default last; a missing version yields the versions that exist."""
    latest = pointers.groupBy("version").agg(F.max_by("release_id", "updated_at").alias("release_id"), F.max(F.when(F.col("is_default"), F.col("updated_at"))).alias("default_at"))
    hit = (F.col("version") == requested) if requested is not None else F.col("default_at").isNotNull()
    found = latest.agg(F.max(F.when(hit, F.struct("default_at", "version", "release_id"))).alias("r"), F.array_sort(F.collect_set("version")).alias("available"))
    return found.select(F.when(F.col("r").isNull(), "missing").otherwise("ok").alias("status"), F.col("r.version").alias("version"), F.col("r.release_id").alias("release_id"),
                        F.when(F.col("r").isNull(), F.col("available")).alias("available"))


def latest_checks(checks: DataFrame, limit: int = 50) -> DataFrame:
    """The newest check of each (version, export_id), newest first."""
    rest = [c for c in checks.columns if c not in ("version", "export_id")]
    newest = checks.groupBy("version", "export_id").agg(F.max_by(F.struct(*rest), F.struct("checked_at", "check_id")).alias("c")).select("version", "export_id", "c.*")
    return newest.orderBy(F.desc("checked_at"), F.desc("check_id")).limit(max(1, min(100, limit)))


def all_runs(runs: DataFrame, version: str | None = None) -> DataFrame:
    return (runs.where(F.col("version") == version) if version else runs).orderBy("workspace", "run_id")
