"""Results that must not depend on how large a table is, or how its work is dealt."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import export_rules, integrity, lineage
from tessera.plans import export_queries
from tessera.sources import shared


def fingerprint(lines):
    """The rule of table_fingerprint in plain Python."""
    seen = Counter(hashlib.sha256(x.encode()).hexdigest() for x in lines)
    buckets = {}
    for h in sorted(seen):
        buckets.setdefault(h[:2], []).append(f"{h}:{seen[h]}")
    whole = "".join(f"{b}:{hashlib.sha256(''.join(x).encode()).hexdigest()}" for b, x in sorted(buckets.items()))
    return sum(seen.values()), hashlib.sha256(whole.encode()).hexdigest()


def test_fingerprints_follow_one_rule_at_any_size(spark):
    """Tables of less and more rows than the buckets are meant for, with repeats that fill several batches."""
    rows = spark.range(3000).select((F.col("id") % 700).alias("k")).unionByName(spark.range(25_000).select(F.lit(-1).cast("long").alias("k")))
    want = fingerprint(f'{{"k":{r["k"]}}}' for r in rows.collect())
    for per_bucket in (1, 50, 1 << 16):
        assert tuple(integrity.table_fingerprint(rows, per_bucket).first()) == want
    assert tuple(integrity.table_fingerprint(rows.where("k > 9999")).first()) == (0, hashlib.sha256(b"").hexdigest())


def test_a_task_of_member_mismatch_has_bounded_rows(spark, monkeypatch):
    """Partitions follow the number of rows; nulls and repeats count as before."""
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 100)
    parents = spark.range(300).select("id", F.array(F.lit(1), F.lit(1), F.lit(2), F.lit(None).cast("int")).alias("said")).unionByName(spark.sql("SELECT NULL AS id, array(7) AS said"))
    children = spark.range(1, 300).select("id", F.lit(1).alias("m")).unionByName(spark.sql("SELECT 5L AS id, 9 AS m UNION ALL SELECT 5, NULL UNION ALL SELECT NULL, 7"))
    found = integrity.member_mismatch(parents, children, "id", "said", "m")
    assert found.rdd.getNumPartitions() > 10
    want = {(0, 1, "declared"), (5, 9, "actual"), (5, None, "actual"), (None, 7, "declared"), (None, 7, "actual"), *((i, m, "declared") for i in range(300) for m in (2, None))}
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_lineage_looks_up_distinct_rows(spark, monkeypatch):
    """Many jobs of one signature are one row in the join; annotations meet artifacts in tasks by their number."""
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 10)
    ids = F.array(F.lit("x"))
    many = spark.range(40)
    jobs = many.select(F.lit("s").alias("input_signature"), ids.alias("ids"))
    requests = many.select(F.concat(F.lit("q"), "id").alias("request_id"), F.when(F.col("id") == 3, "t").otherwise("s").alias("input_signature"), ids.alias("ids"))
    artifacts = many.select(F.concat(F.lit("a"), "id").alias("artifact_id"), ids.alias("ids"), F.array(F.struct(F.col("id").cast("string").alias("annotation_id"), F.lit("c").alias("content"))).alias("items"))
    annotations = many.select(F.col("id").cast("string").alias("annotation_id"), F.when(F.col("id") == 4, "d").otherwise("c").alias("content"))
    found = lineage.lineage_violations(requests, jobs, artifacts, annotations)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("REQUEST_WITHOUT_JOB", "q3"), ("ANNOTATION_DIFFERS", "4")}
    assert plan.count("Aggregate [") >= 2 and "RepartitionByExpression [annotation_id" in plan and ", 5" in plan


def test_manifests_are_parsed_once(spark):
    """The issues come from a written table; a schema that is there twice gives two issues."""
    text = '{"status":"failed","platform":{"os_name":"Plan9"},"schema_inventory":[{"schema_id":"export-block.v1","schema_sha256":"sha256:0"},{"schema_id":"none"}]}'
    manifests = spark.createDataFrame([("a", text), ("b", "{"), ("c", "[1]"), ("d", None), ("e", '{"platform":null}')], "export string, value string")
    schemas = spark.createDataFrame([("export-block.v1", "{}"), ("export-block.v1", "{} "), ("s", "{"), ("t", "7")], "schema_id string, value string")
    found = export_rules.manifest_document_issues(manifests, schemas)
    assert found._jdf.queryExecution().analyzed().toString().count("try_parse_json") <= 2  # of the schemas alone
    got = sorted((r["code"], r["subject"], r["detail"]) for r in found.where("subject <> 'e'").collect())
    assert got == [("FAILED_EXPORT_NOT_ACCEPTED", "a", None), ("MANIFEST_NOT_OBJECT", "c", None), ("MANIFEST_READ_FAILED", "b", None), ("MANIFEST_READ_FAILED", "d", None), ("PLATFORM_ARCHITECTURE_UNSUPPORTED", "a", None),
                   ("PLATFORM_UNSUPPORTED", "a", "Plan9"), ("SCHEMA_INVENTORY_HASH_MISMATCH", "a", "export-block.v1"), ("SCHEMA_INVENTORY_HASH_MISMATCH", "a", "export-block.v1"), ("SCHEMA_INVENTORY_ORDER", "a", None),
                   ("SCHEMA_NOT_OBJECT", "t", None), ("SCHEMA_READ_FAILED", "s", None)]


def test_mapping_rules_read_written_tables(spark, monkeypatch):
    names = []
    monkeypatch.setattr(export_rules, "stored", lambda rows, name: names.append(name) or rows)
    empty = lambda schema: spark.createDataFrame([], schema)
    export_rules.mapping_issues(empty("block_id string, default_state_id string"), empty("block_id string, state_id string, is_default boolean, mapping_status string, variant_ids array<string>"),
                                empty("block_id string, variant_id string, status string, canonical_state_id string, represented_state_ids array<string>"), empty("variant_id string"))
    assert names == ["own-states", "first-variants"]


def test_gates_are_dealt_to_small_tasks(spark, monkeypatch):
    """All that quality_gates executes is dealt by rows, not by compressed bytes; the session's settings come back."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold"]
    settings = lambda: [spark.conf.get(n) for n in names]
    before, seen, write = settings(), [], shared.stored
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(export_queries, "stored", lambda rows, name: seen.append([name, *settings()]) or write(rows, name))
    report = export_queries.quality_gates(spark, "/root/testdata/sf0.001")
    rows = max(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("lineitem", "events"))
    wanted = [str(max(int(before[0]), 1 + rows // 100)), "4m", "8m", "-1"]
    assert seen == [[name, *wanted] for name in ("states", "variants", "gates")] and settings() == before
    assert len(report.inputFiles()) == 1 and report.count() == 12
    with pytest.raises(ZeroDivisionError), shared.small_tasks(spark, 1):
        1 / 0
    assert settings() == before
