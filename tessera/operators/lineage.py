"""Input signatures, batches, retries and lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import hash_text
from tessera.sources.shared import shared_folder, task_count


def with_ordinal(rows: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """A gapless global number from 0 in key order (unique keys, null first). Spark deals the rows by ranges
    of the key into a written table; each range is numbered apart and moved by the sizes of the ranges before
    it, one row for each range. No task sees the whole, and a row costs the same however many ranges there are."""
    spark = rows.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, "ordinals")
    dealt = rows.repartitionByRange(parts, F.col(key).asc_nulls_first()).withColumn("range_", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    base = dealt.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", F.coalesce(before, F.lit(0)).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(F.col(key).asc_nulls_first())) - 1
    return dealt.withColumn("in_", inside).join(base, "range_").withColumn(name, F.col("base_") + F.col("in_")).drop("range_", "in_", "base_")


def fixed_batches(rows: DataFrame, key: str, size: int = 12, prefix: str = "ai_batch_") -> DataFrame:
    """(batch_key, members): rows in key order in batches of ``size``, keys numbered from 0."""
    numbered = with_ordinal(rows.select(key), key)
    batch = numbered.withColumn("batch", F.floor(F.col("ordinal") / size))
    return batch.groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("members")).select(F.format_string(f"{prefix}%04d", "batch").alias("batch_key"), "members")


def input_signature(*inputs: Column) -> Column:
    """SHA-256 over the inputs' texts, each with its length in bytes before it, so that fields never run together;
    null is told apart from an empty text."""
    framed = [F.coalesce(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(i.cast("string"))), 16, "0")), i.cast("string").cast("binary")), F.unhex(F.lit("FF" * 8))) for i in inputs]
    return F.sha2(F.concat(*framed), 256)


def changed_inputs(now: DataFrame, done: DataFrame, key: str, signature: str) -> DataFrame:
    """Rows whose (key, signature) has no finished output."""
    return now.join(done.select(key, signature), [key, signature], "left_anti")


def output_conflicts(now: DataFrame, done: DataFrame, key: str, signature: str, output: str) -> DataFrame:
    """(key, signature): same inputs, other output."""
    return now.join(done.select(key, signature, F.col(output).alias("other_")), [key, signature]).where(F.col(output) != F.col("other_")).select(key, signature)


def jobs_hash(jobs: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
    """(run_id, name): SHA-256 of the canonical JSON of each run: its id, ``effective_config_hash`` and
    its jobs (the fields) in order. The jobs of one run are put together in one task."""
    job = F.struct(*(F.col(f).cast("string").alias(f) for f in sorted(fields)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), job.alias("j")))), lambda x: x["j"])
    plan = F.to_json(F.struct(F.first("effective_config_hash").alias("effective_config_hash"), listed.alias("jobs"), F.first(F.col("run_id").cast("string")).alias("run_id")), {"ignoreNullFields": "false"})
    return jobs.groupBy("run_id").agg(hash_text(plan).alias(name))


def plan_hash(jobs: DataFrame) -> DataFrame:
    """(run_id, plan_hash) of jobs (run_id, effective_config_hash, job_id, logical_key,
    recomputed_payload_signature) in the order of key and id."""
    return jobs_hash(jobs, ["logical_key", "job_id"], ["job_id", "logical_key", "recomputed_payload_signature"], "plan_hash")


def wave_hash(wave: DataFrame) -> DataFrame:
    """(run_id, wave_hash) of retries (run_id, effective_config_hash, logical_key and the ids and input
    signatures of source and child)."""
    return jobs_hash(wave, ["source_logical_key", "source_job_id"], ["source_job_id", "child_job_id", "source_input_signature", "child_input_signature"], "wave_hash")


def without_child(jobs: DataFrame) -> DataFrame:
    """Jobs that no job of their run retries: by its ``retry_of_job_id``, or by a logical key that begins
    with theirs and ``:retry:``."""
    named = jobs.where("retry_of_job_id is not null").select("run_id", F.col("retry_of_job_id").alias("job_id"))
    by_key = jobs.where(F.col("logical_key").contains(":retry:")).select("run_id", F.posexplode(F.split("logical_key", ":retry:")).alias("n", "part"), F.split("logical_key", ":retry:").alias("parts"))
    prefixes = by_key.where("n > 0").select("run_id", F.array_join(F.slice("parts", F.lit(1), F.col("n")), ":retry:").alias("logical_key")).distinct()
    return jobs.join(named, ["run_id", "job_id"], "left_anti").join(prefixes, ["run_id", "logical_key"], "left_anti")


def retry_wave(jobs: DataFrame, signature: Callable[[Column, Column], Column] | None = None, stage: str = "AI_ANNOTATE") -> DataFrame:
    """A child for each job of the stage that failed or needs review with an item-local code and has none
    yet: (run_id, source_job_id, source_logical_key, source_input_signature, nonce, logical_key,
    child_input_signature, child_job_id, effective_config_hash).

    nonce: hash of source id and signature; the child's key ends in its first 8 digits; its id is a hash
    of run, key and signature. ``signature`` makes the child's input signature from the source's and the
    nonce (default: a hash of both).
    """
    open_ = jobs.where((F.col("stage") == stage) & F.col("status").isin("failed", "needs_review") & (error_class(F.col("error_code")) == "item_local"))
    # Children are looked for among all jobs, sources come from the open ones.
    source = without_child(jobs.where(F.col("stage") == stage)).join(open_.select("run_id", "job_id"), ["run_id", "job_id"], "left_semi")
    zero = lambda *parts: F.concat_ws("\x00", *parts)
    nonce = hash_text(zero(F.col("job_id"), F.col("input_signature")))
    child = signature(F.col("source_input_signature"), F.col("nonce")) if signature else hash_text(zero(F.col("source_input_signature"), F.col("nonce")))
    named = source.select("run_id", "effective_config_hash", F.col("job_id").alias("source_job_id"), F.col("logical_key").alias("source_logical_key"), F.col("input_signature").alias("source_input_signature"), nonce.alias("nonce"))
    named = named.withColumn("logical_key", F.concat("source_logical_key", F.lit(":retry:"), F.substring("nonce", 8, 8))).withColumn("child_input_signature", child)
    return named.withColumn("child_job_id", F.concat(F.lit("job_"), F.substring(F.sha2(zero(F.col("run_id"), F.col("logical_key"), F.col("child_input_signature")), 256), 1, 32)))


# Codes of outside services that stop a run, that come from its control, and a retired one.
FATAL = [
    "PROVIDER_NOT_CONFIGURED", "PROVIDER_CONFIG_INVALID", "PROVIDER_CAPABILITY_MISSING", "PROVIDER_AUTH_FAILED",
    "PROVIDER_PERMISSION_DENIED", "PROVIDER_MODEL_UNAVAILABLE",
]
CONTROL = ["PROVIDER_CANCELLED"]
RETIRED = {"PROVIDER_STORAGE_UNSUPPORTED": "PROVIDER_UNKNOWN"}


def error_class(code: Column, retired: dict[str, str] = RETIRED, fatal: list[str] = FATAL, control: list[str] = CONTROL) -> Column:
    """Retired codes take their new name; then fatal, control or item_local (also for no code)."""
    pairs = [F.lit(x) for pair in retired.items() for x in pair]
    now = F.coalesce(F.element_at(F.create_map(*pairs), code), code) if pairs else code
    return F.when(now.isin(fatal), "fatal").when(now.isin(control), "control").otherwise("item_local")


def lineage_violations(requests: DataFrame, jobs: DataFrame, artifacts: DataFrame, annotations: DataFrame) -> DataFrame:
    """(code, subject): requests without a job of the same signature and ids, artifacts without a
    request of the same ids, annotations that differ from their artifact in anything but verified.
    Id lists are compared as sets. What is looked up is made distinct first, and annotations meet their
    artifacts in as many tasks as there are rows for."""
    ids = lambda t, c: t.withColumn("ids_", F.array_sort(F.array_distinct(c)))
    q, j, a = ids(requests, "ids"), ids(jobs, "ids"), ids(artifacts, "ids")
    one = q.join(j.select("input_signature", "ids_").distinct(), ["input_signature", "ids_"], "left_anti").select(F.lit("REQUEST_WITHOUT_JOB").alias("code"), F.col("request_id").alias("subject"))
    two = a.join(q.select("ids_").distinct(), "ids_", "left_anti").select(F.lit("ARTIFACT_WITHOUT_REQUEST").alias("code"), F.col("artifact_id").alias("subject"))
    made = artifacts.select(F.explode("items").alias("item")).select("item.annotation_id", F.col("item.content").alias("made_"))
    tasks = task_count(annotations.count())
    three = annotations.repartition(tasks, "annotation_id").join(made.repartition(tasks, "annotation_id"), "annotation_id", "left").where(~F.col("content").eqNullSafe(F.col("made_"))).select(F.lit("ANNOTATION_DIFFERS").alias("code"), F.col("annotation_id").alias("subject"))
    return one.unionByName(two).unionByName(three)


def no_active_sibling(jobs: DataFrame) -> DataFrame:
    """Pending jobs of runs and stages without a running one."""
    return jobs.where("status = 'pending'").join(jobs.where("status = 'running'").select("run_id", "stage").distinct(), ["run_id", "stage"], "left_anti")


def profile_mismatches(jobs: DataFrame, profile: DataFrame, fields: list[str]) -> DataFrame:
    """(job_id, field): fields in which a job differs from its run's frozen profile (run_id and the
    fields); nulls are equal to nulls. A run without a profile differs in all of them."""
    frozen = profile.select("run_id", *(F.col(f).alias(f"frozen_{f}") for f in fields), F.lit(True).alias("known_"))
    joined = jobs.join(frozen, "run_id", "left")
    wrong = F.array_compact(F.array(*(F.when(F.col("known_").isNull() | ~F.col(f).eqNullSafe(F.col(f"frozen_{f}")), F.lit(f)) for f in fields)))
    return joined.select("job_id", F.explode(wrong).alias("field"))


def lineage_gate(requests: DataFrame, jobs: DataFrame, artifacts: DataFrame, annotations: DataFrame, profile: DataFrame, fields: list[str]) -> DataFrame:
    """(code, subject) of everything that breaks the lineage: lineage_violations, and jobs that differ
    from the frozen profile."""
    drift = profile_mismatches(jobs, profile, fields).select(F.concat(F.lit("PROFILE_DIFFERS_"), F.upper("field")).alias("code"), F.col("job_id").alias("subject"))
    return lineage_violations(requests, jobs, artifacts, annotations).unionByName(drift)
