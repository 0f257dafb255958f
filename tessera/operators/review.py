"""Routing of records to review, decisions, and closing checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical_json, deterministic_id, sensitive
from tessera.operators.integrity import array_references, missing_evidence, row_difference
from tessera.operators.schema_rules import violations as schema_violations


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 0.65, "high").when(confidence < 0.80, "normal")


def hash_sample(run: Column, key: Column, rate: int) -> Column:
    """Deterministic sample of ``rate`` percent."""
    rate = max(0, min(100, rate))
    if rate in (0, 100):
        return F.lit(rate == 100)
    text = F.concat(run.cast("string"), F.lit("\x00"), key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 10_000 < rate * 100


def review_tasks(found: DataFrame, target_type: Column | str, target: str, reason: Column | str, severity: Column | str, dedupe_key: Column | str | None = None) -> DataFrame:
    """Tasks (review_id, target_type, target_id, reason_code, severity, status): the id is a hash of the
    canonical JSON of target, reason, severity and dedupe key."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    rows = found.select(column(target_type).alias("target_type"), F.col(target).cast("string").alias("target_id"), column(reason).alias("reason_code"), column(severity).alias("severity"), column(dedupe_key).alias("dedupe_key"))
    identity = canonical_json("target_type", "target_id", "reason_code", "severity", "dedupe_key")
    return rows.select(F.concat(F.lit("review_"), F.substring(F.sha2(identity, 256), 1, 32)).alias("review_id"), "target_type", "target_id", "reason_code", "severity", F.lit("open").alias("status")).distinct()


def insert_new(tasks: DataFrame, known: DataFrame, key: str = "review_id") -> DataFrame:
    """Tasks whose id is not known."""
    return tasks.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def reopen(known: DataFrame, tasks: DataFrame, key: str = "review_id") -> DataFrame:
    """Known tasks; those found again are open."""
    again = tasks.select(key, F.lit(True).alias("again_")).distinct()
    return known.join(again, key, "left").withColumn("status", F.when(F.col("again_"), "open").otherwise(F.col("status"))).drop("again_")


def review_queue(tasks: DataFrame, limit: int = 50) -> DataFrame:
    """Open tasks, high severity first, then by time and id; limit 1 to 200."""
    return (tasks.where("status = 'open'").orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "created_at", "review_id")
            .limit(max(1, min(200, limit))))


def reconcile(tasks: DataFrame, satisfied: dict[str, DataFrame]) -> DataFrame:
    """Open tasks are resolved if their target is among the satisfied of their reason (target_id)."""
    done = reduce(DataFrame.unionByName, [t.select(F.col("target_id").cast("string"), F.lit(r).alias("reason_code")) for r, t in satisfied.items()]).distinct().withColumn("done_", F.lit(True))
    return tasks.join(done, ["target_id", "reason_code"], "left").withColumn(
        "status", F.when((F.col("status") == "open") & F.col("done_"), "resolved").otherwise(F.col("status"))).drop("done_").select(*tasks.columns)


def apply_decisions(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks with the status that the last decision on them gives (accept, edit, skip and retry resolve,
    request leaves open), and the evidence of all of them in order, distinct, the first 64."""
    ordered = F.array_sort(F.collect_list(F.struct("decided_at", "decision", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))))
    said = decisions.groupBy("review_id").agg(ordered.alias("said_")).withColumn("last_", F.element_at("said_", -1)["decision"])
    status = F.when(F.col("last_").isin("accept", "edit", "skip", "retry"), "resolved").when(F.col("last_") == "request", "open")
    none = F.array().cast("array<string>")
    merged = F.slice(F.array_distinct(F.concat(F.coalesce("evidence", none), F.coalesce(F.flatten(F.transform("said_", lambda s: s["evidence"])), none))), 1, 64)
    return tasks.join(said, "review_id", "left").withColumns({
        "status": F.coalesce(status, F.col("status")), "evidence": merged, "verified": F.coalesce(F.col("last_").isin("accept", "edit"), F.lit(False))}).drop("said_", "last_")


def decision_overrides(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(override_id, target_id, review_id, decision, decided_at) that edit and skip decisions add: one
    each, with an id of target, review and time."""
    made = decisions.where("decision in ('edit', 'skip')").join(tasks.select("review_id", "target_id"), "review_id")
    return made.select(deterministic_id("override_", F.col("target_id"), F.col("review_id"), F.col("decided_at")).alias("override_id"), "target_id", "review_id", "decision", "decided_at")


def unverified_annotations(annotations: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Annotations (annotation_id, subject_id, verified) with ``verified`` as the last decision on their
    subject's task says: true after accept or edit, false after retry."""
    last = decisions.groupBy("review_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    of_subject = tasks.join(last, "review_id").groupBy(F.col("target_id").alias("subject_id")).agg(F.max_by("decision", "review_id").alias("decision"))
    now = F.when(F.col("decision").isin("accept", "edit"), F.lit(True)).when(F.col("decision") == "retry", F.lit(False))
    return annotations.join(of_subject, "subject_id", "left").withColumn("verified", F.coalesce(now, F.col("verified"))).select(*annotations.columns)


def batch_hash_mismatch(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Batches (batch_id, artifact_sha256) whose artifact is missing or has another hash."""
    real = actual.select("batch_id", F.col("artifact_sha256").alias("real_"))
    return declared.join(real, "batch_id", "left").where(~F.col("artifact_sha256").eqNullSafe(F.col("real_"))).select("batch_id")


def batch_output(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch_id, missing, extra, repeated): batches whose returned ids are not the expected ones
    once each. Both: (batch_id, item_id)."""
    said = expected.groupBy("batch_id", "item_id").agg(F.count("*").alias("e"))
    real = returned.groupBy("batch_id", "item_id").agg(F.count("*").alias("r"))
    joined = said.join(real, ["batch_id", "item_id"], "full_outer")
    return joined.groupBy("batch_id").agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("r") > 1).alias("repeated")).where("missing + extra + repeated > 0")


def audited_skips(blocks: DataFrame, variants: DataFrame, reviews: DataFrame) -> DataFrame:
    """Blocks without a selected variant, and without a skipped one whose review names both its
    failure and its target. reviews: (target_id, failure_ref)."""
    selected = variants.where("status = 'selected'").select("block_id").distinct()
    skipped = variants.where("status = 'skipped'").join(reviews, (F.col("variant_id") == F.col("target_id")) & (F.col("failure_id") == F.col("failure_ref")), "left_semi").select("block_id")
    return blocks.select("block_id").join(selected, "block_id", "left_anti").join(skipped, "block_id", "left_anti")


def qualified_exclusions(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Excluded rows that cite no review with the same target and value."""
    cited = rows.where("candidate_qualification = 'excluded'").select("variant_id", "candidate_qualification", F.explode_outer("review_refs").alias("review_id"))
    good = cited.join(reviews.select("review_id", F.col("target_id").alias("variant_id"), F.col("value").alias("candidate_qualification")), ["review_id", "variant_id", "candidate_qualification"], "left_semi")
    return cited.select("variant_id").distinct().join(good.select("variant_id"), "variant_id", "left_anti")


def skip_closure(failures: DataFrame, reviews: DataFrame, targets: tuple[str, ...] = ("variant_id", "state_id", "block_id")) -> DataFrame:
    """Failures without a skip review on any of their targets."""
    long = failures.select("failure_id", F.explode(F.array_compact(F.array(*targets))).alias("target_id"))
    return failures.join(long.join(reviews.select("target_id").distinct(), "target_id", "left_semi"), "failure_id", "left_anti")


def import_failure_reviews(failures: DataFrame, variants: DataFrame) -> DataFrame:
    """High tasks for variant and render failures of skipped variants; without a reason: OTHER."""
    skipped = variants.where("status = 'skipped'").select("variant_id")
    hit = failures.where(F.col("scope").isin("variant", "render")).join(skipped, "variant_id", "left_semi").withColumn("reason_code", F.coalesce("reason_code", F.lit("OTHER")))
    return review_tasks(hit, "variant", "variant_id", F.col("reason_code"), "high")


def record_tasks(variants: DataFrame, annotations: DataFrame, complete: DataFrame, open_roots: DataFrame, rules: list, record: str = "record_json") -> DataFrame:
    """High tasks of what validation finds in variants: records against the rules, annotation references
    that do not resolve, eligible ones without any semantics (no reference, not complete by hand, no
    open review), excluded ones without a review. complete, open_roots: (variant_id)."""
    wrong = schema_violations(variants, "variant_id", record, rules).select(F.col("subject").alias("variant_id"), F.lit("SCHEMA_INVALID").alias("code"))
    refs = array_references(variants, "variant_id", "annotation_refs", annotations, "annotation_id").select("variant_id", F.lit("ANNOTATION_REFERENCE_INVALID").alias("code"))
    bare = variants.where(F.col("candidate_qualification").isin("eligible", "conditional") & (F.coalesce(F.size("annotation_refs"), F.lit(0)) <= 0))
    missing = missing_evidence(missing_evidence(bare, complete, "variant_id"), open_roots, "variant_id").select("variant_id", F.lit("MISSING_SEMANTIC").alias("code"))
    excluded = variants.where((F.col("candidate_qualification") == "excluded") & (F.coalesce(F.size("qualification_review_refs"), F.lit(0)) <= 0)).select("variant_id", F.lit("QUALIFICATION_REVIEW_MISSING").alias("code"))
    found = reduce(DataFrame.unionByName, [wrong, refs, missing, excluded]).distinct()
    return review_tasks(found, "variant", "variant_id", F.col("code"), "high", F.col("code"))


def closure_errors(variants: DataFrame, annotations: DataFrame, complete: DataFrame, qualification_reviews: DataFrame, failures: DataFrame, skip_reviews: DataFrame,
                   expected_text: DataFrame, stored_text: DataFrame) -> DataFrame:
    """(target_id, code) of what keeps a run from closing: selected eligible variants without verified
    semantics (own referenced annotation, or complete by hand), excluded ones without a valid review,
    failures without a skip review, and a stored text index that is not the expected one.

    qualification_reviews: (review_id, target_id, qualification); skip_reviews: (target_id,
    failure_ref); annotations: (annotation_id, subject_id, verified).
    """
    selected = variants.where("status = 'selected'")
    searchable = selected.where(F.col("candidate_qualification").isin("eligible", "conditional"))
    own = searchable.select("variant_id", F.explode("annotation_refs").alias("annotation_id"))
    verified = own.join(annotations.where("verified").select("annotation_id", F.col("subject_id").alias("variant_id")), ["annotation_id", "variant_id"], "left_semi").select("variant_id")
    bare = missing_evidence(missing_evidence(searchable, verified, "variant_id"), complete, "variant_id")
    cited = selected.where("candidate_qualification = 'excluded'").select("variant_id", F.explode_outer("qualification_review_refs").alias("review_id"))
    good = cited.join(qualification_reviews.where("qualification = 'excluded'").select("review_id", F.col("target_id").alias("variant_id")), ["review_id", "variant_id"], "left_semi").select("variant_id")
    long = failures.select("failure_id", F.explode(F.array_compact(F.array("variant_id", "state_id", "block_id"))).alias("target_id"))
    skipped = long.join(skip_reviews.select("target_id", F.col("failure_ref").alias("failure_id")), ["target_id", "failure_id"], "left_semi").select("failure_id")
    open_failures = missing_evidence(failures, skipped, "failure_id").select(F.coalesce("variant_id", "state_id", "block_id", "failure_id").alias("target_id"))
    index = row_difference(expected_text, stored_text).limit(1)
    return reduce(DataFrame.unionByName, [
        bare.select(F.col("variant_id").alias("target_id"), F.lit("MISSING_VERIFIED_SEMANTIC").alias("code")),
        missing_evidence(cited.select("variant_id").distinct(), good, "variant_id").select(F.col("variant_id").alias("target_id"), F.lit("QUALIFICATION_REVIEW_MISSING").alias("code")),
        open_failures.withColumn("code", F.lit("SKIP_REVIEW_MISSING")),
        index.select(F.lit("index").alias("target_id"), F.lit("FTS_COVERAGE_MISSING").alias("code"))])


# Schemas of manual records.
MANUAL, SKIP, QUALIFICATION = "manual-override.v1", "skip-review.v1", "qualification-review.v1"


def override_violations(records: DataFrame, blocks: DataFrame, states: DataFrame, variants: DataFrame, failures: DataFrame) -> DataFrame:
    """(record_id, code) of manual records (schema_id, record_id, target_id, failure_ref, note) that do
    not hold: unknown schema, sensitive text, target of no legal kind, skip of an unknown failure,
    qualification of something else than a variant, or a variant that does not name the record back
    (override_refs, or qualification_review_refs for qualifications)."""
    ids = lambda t, k: t.select(F.col(k).cast("string").alias("target_id"))
    of_variants = ids(variants, "variant_id").distinct()
    every = ids(blocks, "block_id").union(ids(states, "state_id")).union(of_variants).distinct()
    back = variants.select(F.col("variant_id").alias("target_id"), F.explode("override_refs").alias("record_id")).withColumn("plain_", F.lit(True)).unionByName(
        variants.select(F.col("variant_id").alias("target_id"), F.explode("qualification_review_refs").alias("record_id")).withColumn("plain_", F.lit(False))).distinct()
    known = records.where(F.col("schema_id").isin(MANUAL, SKIP, QUALIFICATION))
    code = lambda rows, name: rows.select("record_id", F.lit(name).alias("code"))
    named = known.join(of_variants, "target_id", "left_semi").withColumn("plain_", F.col("schema_id") != QUALIFICATION)
    return reduce(DataFrame.unionByName, [
        code(records.where(~F.coalesce(F.col("schema_id").isin(MANUAL, SKIP, QUALIFICATION), F.lit(False))), "OVERRIDE_SCHEMA_UNKNOWN"),
        code(known.where(sensitive(F.col("note"))), "OVERRIDE_TEXT_SENSITIVE"),
        code(known.join(every, "target_id", "left_anti"), "OVERRIDE_TARGET_MISSING"),
        code(known.where(F.col("schema_id") == SKIP).join(failures.select(F.col("failure_id").alias("failure_ref")), "failure_ref", "left_anti"), "OVERRIDE_FAILURE_MISSING"),
        code(known.where(F.col("schema_id") == QUALIFICATION).join(of_variants, "target_id", "left_anti"), "OVERRIDE_TARGET_NOT_VARIANT"),
        code(named.join(back, ["target_id", "record_id", "plain_"], "left_anti"), "OVERRIDE_NOT_REFERENCED")])
