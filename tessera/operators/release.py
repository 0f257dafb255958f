"""Release gates: each is one row (gate, status, observed, error_code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical_json_text, hash_text
from tessera.operators.integrity import domain_violations, full_comparison, ordered_hash, row_difference
from tessera.operators.schema_rules import violations as schema_violations
from tessera.operators.search import eligible, verified

# Gate names in the order of the report.
GATES = [
    "REGISTRY_COVERAGE_100", "BLOCK_VARIANT_OR_AUDITED_SKIP", "EXCLUDED_QUALIFICATION_REVIEW_VALID", "IMAGE_READABLE_AND_HASHED",
    "LEGAL_STATE_VALID", "MACHINE_SCHEMA_VALID", "AI_SCHEMA_VALID", "OVERRIDE_REFERENCES_VALID", "NO_FALSE_IDS",
    "HIGH_REVIEW_ZERO", "FTS_READY", "RELEASE_HASH_MANIFEST",
]


def gate(name: str, violations: DataFrame) -> DataFrame:
    """Violations are counted, not listed: one row whatever the table's size."""
    n = F.count("*")
    return violations.agg(F.lit(name).alias("gate"), F.when(n == 0, "pass").otherwise("fail").alias("status"), n.alias("observed"), F.when(n > 0, F.concat(F.lit("GATE_"), F.lit(name))).alias("error_code"))


def quality_report(violations: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [gate(n, v) for n, v in violations.items()])


# Error codes of the gates, each gate's in the order in which it reports them.
CODES = {
    "REGISTRY_COVERAGE_100": ["EXPORT_CHECKSUM_INVALID", "REGISTRY_COVERAGE_INVALID"],
    "BLOCK_VARIANT_OR_AUDITED_SKIP": ["BLOCK_VARIANT_OR_AUDITED_SKIP_INVALID"],
    "EXCLUDED_QUALIFICATION_REVIEW_VALID": ["EXCLUDED_QUALIFICATION_REVIEW_INVALID"],
    "IMAGE_READABLE_AND_HASHED": ["IMAGE_ARTIFACT_INVALID"],
    "LEGAL_STATE_VALID": ["LEGAL_STATE_INVALID", "STATE_VARIANT_RELATION_INVALID", "VARIANT_STATE_RELATION_INVALID"],
    "MACHINE_SCHEMA_VALID": ["MACHINE_SCHEMA_INVALID", "MACHINE_FACTS_MISMATCH", "FEATURE_TRUTH_INVALID"],
    "AI_SCHEMA_VALID": ["AI_SCHEMA_INVALID", "AI_SEMANTIC_MISSING", "AI_LINEAGE_INVALID"],
    "OVERRIDE_REFERENCES_VALID": ["OVERRIDE_REFERENCE_INVALID"],
    "NO_FALSE_IDS": ["FALSE_ID_REFERENCE"],
    "HIGH_REVIEW_ZERO": ["OPEN_REVIEW_EXISTS"],
    "FTS_READY": ["FTS_NOT_READY"],
    "RELEASE_HASH_MANIFEST": ["RELEASE_HASH_INVALID"],
}


def gate_report(violations: dict[str, DataFrame], records: dict[str, DataFrame]) -> DataFrame:
    """(gate, status, observed, violations, error_code) for the twelve gates, in their order.

    ``violations``: each gate's rows, with its codes in a column ``code``; the last one where there is none. ``records``: what
    each gate looked at (``observed`` is their number). A gate that is not named is ``not_run``. All
    violations are tagged with their gate and counted in one aggregation, all records in another; neither is
    listed, so tables of any size give twelve rows.
    """
    spark = next(iter(violations.values())).sparkSession

    def tagged(name: str, rows: DataFrame) -> DataFrame:
        rank = F.lit(len(CODES[name]) - 1)
        if "code" in rows.columns:
            rank = F.coalesce(*(F.when(F.col("code") == c, i) for i, c in enumerate(CODES[name])), rank)
        return rows.select(F.lit(name).alias("gate"), rank.alias("rank"))

    bad = reduce(DataFrame.unionByName, [tagged(n, v) for n, v in violations.items()]).groupBy("gate").agg(F.count("*").alias("violations"), F.min("rank").alias("rank"))
    seen = reduce(DataFrame.unionByName, [v.select(F.lit(n).alias("gate")) for n, v in records.items()]).groupBy("gate").agg(F.count("*").alias("observed"))
    all_gates = spark.createDataFrame([(i, g, g in violations, CODES[g]) for i, g in enumerate(GATES)], "place int, gate string, run boolean, codes array<string>")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(~F.col("run"), "not_run").when(F.col("violations") > 0, "failed").otherwise("passed")
    return all_gates.join(bad, "gate", "left").join(seen, "gate", "left").orderBy("place").select(
        "gate", status.alias("status"), zero("observed"), zero("violations"), F.get("codes", F.col("rank")).alias("error_code"))


def buildable(report: DataFrame) -> DataFrame:
    """One row: all gates but the last, which needs the written files, pass."""
    before = report.where(F.col("gate") != GATES[-1])
    return before.agg(F.coalesce(F.bool_and(F.col("status").isin("pass", "passed")), F.lit(False)).alias("buildable"), F.count("*").alias("gates"))


def registry_coverage(registry: DataFrame, workspace: DataFrame, key: str) -> DataFrame:
    """Registry keys that repeat or are missing, and workspace keys that are not registered."""
    counted = registry.groupBy(key).agg(F.count("*").alias("r")).join(workspace.groupBy(key).agg(F.count("*").alias("w")), key, "full_outer")
    return counted.where("coalesce(r, 0) <> 1 or coalesce(w, 0) <> 1").select(key)


def registry_hash_differs(declared: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """The row of ``declared`` (count, sha256) if the registry has another number of distinct keys or another
    ordered hash."""
    keys = registry.select(key).distinct()
    one = declared.join(keys.agg(F.count("*").alias("n_"))).join(ordered_hash(keys, key))  # a row each
    return one.where(~(F.col("count").eqNullSafe(F.col("n_")) & F.col("sha256").eqNullSafe(F.concat(F.lit("sha256:"), "set_hash")))).select("count", "sha256")


def state_violations(blocks: DataFrame, states: DataFrame, variants: DataFrame) -> DataFrame:
    """(code, subject) of blocks, states and variants that do not fit together.

    LEGAL_STATE_INVALID: blocks whose default states are not exactly the one they name, states of no
    block, and states that are not legal (legal_state, where there is such a column).
    STATE_VARIANT_RELATION_INVALID: states whose variant_ids are not, without repeats, the variants of their block
    if they are mapped, and none if not. VARIANT_STATE_RELATION_INVALID: variants whose canonical state is
    not their block's default or not represented, or whose represented states are not, without
    repeats, the mapped states of their block. blocks: block_id, default_state_id; ids of blocks and states are unique.
    """
    found = lambda rows, code, key: rows.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("subject"))
    defaults = states.where("is_default").groupBy("block_id").agg(F.count("*").alias("n_"), F.min("state_id").alias("default_"))
    own = blocks.select("block_id", "default_state_id").join(defaults, "block_id", "left")
    wrong = [found(own.where(~(F.coalesce("n_", F.lit(0)) == 1) | ~F.col("default_").eqNullSafe(F.col("default_state_id"))), "LEGAL_STATE_INVALID", "block_id")]
    known = blocks.select("block_id").distinct()
    wrong.append(found(states.join(known, "block_id", "left_anti"), "LEGAL_STATE_INVALID", "state_id"))
    if "legal_state" in states.columns:
        wrong.append(found(states.join(known, "block_id", "left_semi").where("not legal_state <=> true"), "LEGAL_STATE_INVALID", "state_id"))
    sets = lambda rows, of, name: rows.groupBy("block_id").agg(F.array_sort(F.collect_set(of)).alias(name))
    none = F.array().cast("array<string>")
    refs = F.coalesce("variant_ids", none)
    expected = F.when(F.col("mapping_status") == "mapped", F.coalesce("chosen_", none)).otherwise(none)
    related = states.join(known, "block_id", "left_semi").join(sets(variants, "variant_id", "chosen_"), "block_id", "left")
    wrong.append(found(related.where(F.array_sort(refs) != expected), "STATE_VARIANT_RELATION_INVALID", "state_id"))
    shown = F.coalesce("represented_state_ids", none)
    whole = variants.join(blocks.select("block_id", "default_state_id"), "block_id", "left").join(sets(states.where("mapping_status = 'mapped'"), "state_id", "mapped_"), "block_id", "left")
    good = F.col("canonical_state_id").eqNullSafe(F.col("default_state_id")) & F.array_contains(shown, F.col("canonical_state_id")) & (F.array_sort(shown) == F.coalesce("mapped_", none))
    wrong.append(found(whole.where(~F.coalesce(good, F.lit(False))), "VARIANT_STATE_RELATION_INVALID", "variant_id"))
    return reduce(DataFrame.unionByName, wrong)


def false_ids(blocks: DataFrame, states: DataFrame, variants: DataFrame, annotations: DataFrame) -> DataFrame:
    """(code, subject) of records that name an id which does not exist, or not where they say: variants that
    are not their block's, without block, canonical state, annotation or represented state of their block;
    states without block or with an unknown variant; annotations of no block and no variant."""
    ids = lambda t, key, name: t.select(F.col(key).alias(name)).distinct()
    every = lambda t, key, refs, name: t.select(F.col(key).alias("subject"), F.explode(refs).alias(name), *([c for c in t.columns if c == "block_id"]))
    of_blocks, of_states, of_variants = ids(blocks, "block_id", "block_id"), ids(states, "state_id", "canonical_state_id"), ids(variants, "variant_id", "ref")
    represented = every(variants, "variant_id", "represented_state_ids", "state_id").join(states.select("state_id", "block_id").distinct(), ["state_id", "block_id"], "left_anti")
    cited = every(variants.drop("block_id"), "variant_id", "annotation_refs", "annotation_id").join(ids(annotations, "annotation_id", "annotation_id"), "annotation_id", "left_anti")
    named = every(states.drop("block_id"), "state_id", "variant_ids", "ref").join(of_variants, "ref", "left_anti")
    subjects = of_blocks.union(of_variants).toDF("subject_id").distinct()
    of = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("subject"))
    found = [of(variants.where("not variant_id <=> block_id"), "variant", "variant_id"), of(variants.join(of_blocks, "block_id", "left_anti"), "variant", "variant_id"),
             of(variants.join(of_states, "canonical_state_id", "left_anti"), "variant", "variant_id"), of(cited, "variant", "subject"), of(represented, "variant", "subject"),
             of(states.join(of_blocks, "block_id", "left_anti"), "state", "state_id"), of(named, "state", "subject"), of(annotations.join(subjects, "subject_id", "left_anti"), "annotation", "annotation_id")]
    return reduce(DataFrame.unionByName, found).distinct().select(F.lit("FALSE_ID_REFERENCE").alias("code"), "subject")


def machine_violations(sources: dict[str, tuple[DataFrame, str, str, list]], expected: DataFrame, workspace: DataFrame, states: DataFrame, blocks: DataFrame) -> DataFrame:
    """(code, subject) of what breaks the machine facts: records against their schema's rules (name ->
    table, key, JSON column, rules), a workspace that is not the projection of its source, and states
    whose properties are not in their block's domain."""
    wrong = [schema_violations(t, key, record, rules).select(F.lit("MACHINE_SCHEMA_INVALID").alias("code"), "subject").distinct() for t, key, record, rules in sources.values()]
    drift = row_difference(expected, workspace).select(F.lit("MACHINE_FACTS_MISMATCH").alias("code"), F.col(expected.columns[0]).cast("string").alias("subject"))
    outside = domain_violations(states, "state_id", "block_id", "properties", blocks, "domain").select(F.lit("MACHINE_FACTS_MISMATCH").alias("code"), F.col("state_id").cast("string").alias("subject"))
    return reduce(DataFrame.unionByName, [*wrong, drift, outside]).distinct()


def semantic_violations(variants: DataFrame, blocks: DataFrame, annotations: DataFrame, complete: DataFrame, rules: list, lineage: DataFrame | None = None) -> DataFrame:
    """(code, subject) of what breaks the written facts: annotations (annotation_id, subject_id, record_json,
    source struct with verified) against the rules or of no known subject, eligible variants without a
    verified annotation that are not complete by hand, and breaks of lineage (code, subject)."""
    subjects = variants.select(F.col("variant_id").alias("subject_id")).union(blocks.select("block_id")).distinct()
    bad = schema_violations(annotations, "annotation_id", "record_json", rules).select("subject").distinct()
    lost = annotations.join(subjects, "subject_id", "left_anti").select(F.col("annotation_id").cast("string").alias("subject"))
    bare = eligible(variants).select("variant_id").join(verified(annotations).select(F.col("subject_id").alias("variant_id")), "variant_id", "left_anti").join(complete.select("variant_id"), "variant_id", "left_anti")
    found = [bad.union(lost).distinct().select(F.lit("AI_SCHEMA_INVALID").alias("code"), "subject"), bare.select(F.lit("AI_SEMANTIC_MISSING").alias("code"), F.col("variant_id").cast("string").alias("subject"))]
    if lineage is not None:
        found.append(lineage.select(F.lit("AI_LINEAGE_INVALID").alias("code"), "subject"))
    return reduce(DataFrame.unionByName, found)


def open_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.where("status = 'open' and severity in ('high', 'normal')")


def written_files(checksums: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, status) of files that a written release lacks, has too many or has with another hash."""
    return full_comparison(checksums, inventory, "path", "sha256")


def artifact_mismatches(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts (path, sha256, hash_mode) whose file (path, content) is missing or has another hash: of
    its bytes, or in the mode ``jcs`` of its canonical JSON."""
    text = F.col("content").cast("string")
    real = F.when(F.col("hash_mode") == "jcs", hash_text(canonical_json_text(text))).otherwise(hash_text(F.col("content").cast("binary")))
    joined = declared.join(actual.select("path", "content"), "path", "left").withColumn("real_", real)
    return joined.where(~F.col("sha256").eqNullSafe(F.col("real_"))).select("path")


def image_violations(declared: DataFrame, actual: DataFrame, side: int = 512) -> DataFrame:
    """Images (path, sha256) that are missing, unreadable, of another size or hash."""
    joined = declared.join(actual.select("path", F.col("sha256").alias("real_"), "width", "height", "error"), "path", "left")
    good = (F.col("sha256") == F.col("real_")) & (F.col("width") == side) & (F.col("height") == side) & F.col("error").isNull()
    return joined.where(~F.coalesce(good, F.lit(False))).select("path")


def index_parity(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows in which the stored index and the recomputed one differ."""
    return row_difference(expected, stored)
