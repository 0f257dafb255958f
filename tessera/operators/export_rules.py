"""The export's rule catalogue: rows (code, subject, detail) over blocks, states, variants, failures.

Every rule is a join, an anti-join or an aggregate by key; groups are counted, not collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import PATTERNS, canonical_key, safe_path
from tessera.operators.integrity import all_issues, duplicate_keys, exactly_one, full_comparison, issues, member_mismatch, missing_evidence, ordered_hash, orphans, parent_mismatch
from tessera.operators.projections import tint_rule
from tessera.sources.records import parse_checksum_list
from tessera.sources.shared import stored

# Shape of an entity id.
BLOCK_ID = r"^[a-z0-9_.-]+:[a-z0-9_./-]+$"


def _no(column: Column) -> Column:
    return ~F.coalesce(column, F.lit(False))


def record_issues(blocks: DataFrame, states: DataFrame, variants: DataFrame) -> DataFrame:
    """Ids, references and the canonical spelling of state ids."""
    found = [issues(blocks.where(_no(F.col("block_id").rlike(BLOCK_ID))), "BLOCK_ID_INVALID", "block_id")]
    for table, key, code in ((blocks, "block_id", "BLOCK_ID_DUPLICATE"), (states, "state_id", "STATE_ID_DUPLICATE"), (variants, "variant_id", "VARIANT_ID_DUPLICATE")):
        found.append(issues(duplicate_keys(table.where(F.col(key).isNotNull()), key), code, key))
    for table, key, code in ((states, "state_id", "STATE_BLOCK_REFERENCE_INVALID"), (variants, "variant_id", "VARIANT_BLOCK_REFERENCE_INVALID")):
        found += [issues(orphans(table, blocks, "block_id", "block_id"), code, key, "block_id"), issues(table.where("block_id is null"), code, key)]
    found.append(issues(variants.where("variant_id <> block_id"), "VARIANT_ID_BLOCK_MISMATCH", "variant_id", "block_id"))
    spelled = canonical_key(F.col("block_id"), F.col("properties"))
    found.append(issues(states.where(spelled != F.col("state_id")), "STATE_CANONICAL_ID_INVALID", "state_id", spelled))
    return all_issues(*found)


def mapping_issues(blocks: DataFrame, states: DataFrame, variants: DataFrame, failures: DataFrame) -> DataFrame:
    """Default states, and how states, variants and failures of a block fit together. States of blocks and the
    blocks' first variants are written once, as most rules read them."""
    with_states = blocks.join(states.select("block_id").distinct(), "block_id", "left_semi")
    found = [issues(blocks.join(states.select("block_id").distinct(), "block_id", "left_anti"), "BLOCK_HAS_NO_STATES", "block_id")]
    legal = states.select("block_id", F.col("state_id").alias("default_state_id"))
    found.append(issues(with_states.join(legal, ["block_id", "default_state_id"], "left_anti"), "DEFAULT_STATE_NOT_LEGAL", "block_id", "default_state_id"))
    own = stored(states.join(with_states.select("block_id"), "block_id", "left_semi"), "own-states")
    found.append(issues(exactly_one(own, "block_id", F.col("is_default"), "state_id", with_states, "default_state_id"), "DEFAULT_STATE_UNIQUE_INVALID", "block_id", "n"))
    numbers = with_states.select("block_id").join(variants.groupBy("block_id").agg(F.count("*").alias("n")), "block_id", "left")
    found.append(issues(numbers.where("coalesce(n, 0) <> 1"), "BLOCK_VARIANT_COUNT_INVALID", "block_id", "n"))
    mapped = own.where("mapping_status = 'mapped'")
    found.append(issues(mapped.where("coalesce(size(variant_ids), 0) <= 0"), "MAPPED_STATE_WITHOUT_VARIANT", "state_id"))
    targets = variants.select(F.col("variant_id").alias("reference"), "block_id")
    found.append(issues(mapped.select("state_id", "block_id", F.explode("variant_ids").alias("reference")).join(targets, ["reference", "block_id"], "left_anti"), "STATE_VARIANT_REFERENCE_INVALID", "state_id", "reference"))
    found.append(issues(own.where("mapping_status = 'skipped' and size(variant_ids) > 0"), "SKIPPED_STATE_HAS_VARIANT", "state_id"))
    first = variants.groupBy("block_id").agg(F.min_by(F.struct("variant_id", "status", "canonical_state_id", "represented_state_ids"), "variant_id").alias("v"))
    first = stored(with_states.select("block_id", "default_state_id").join(first, "block_id").select("block_id", "default_state_id", "v.*"), "first-variants")
    selected, other = first.where("status = 'selected'"), first.where("not status <=> 'selected'")
    wrong = member_mismatch(selected, own.join(selected.select("block_id"), "block_id", "left_semi"), "block_id", "represented_state_ids", "state_id")
    found.append(issues(wrong.select("block_id").distinct(), "REPRESENTED_STATE_SET_INVALID", "block_id"))
    found.append(issues(selected.where("not canonical_state_id <=> default_state_id"), "REPRESENTATIVE_NOT_DEFAULT", "block_id", "canonical_state_id"))
    of_selected = own.join(selected.select("block_id", F.col("variant_id").alias("its_")), "block_id")
    found.append(issues(of_selected.where(_no((F.col("mapping_status") == "mapped") & (F.col("variant_ids") == F.array("its_")))), "SELECTED_STATE_MAPPING_INVALID", "state_id"))
    found.append(issues(missing_evidence(other, failures.where("variant_id is not null").select("variant_id").distinct(), "variant_id"), "SKIPPED_VARIANT_FAILURE_MISSING", "variant_id"))
    of_other = own.join(other.select("block_id"), "block_id", "left_semi")
    found.append(issues(of_other.where(_no((F.col("mapping_status") == "skipped") & (F.size("variant_ids") == 0))), "SKIPPED_BLOCK_STATE_MAPPING_INVALID", "state_id"))
    return all_issues(*found)


def failure_issues(blocks: DataFrame, states: DataFrame, variants: DataFrame, failures: DataFrame) -> DataFrame:
    """The scope decides which references must resolve, and to the same block."""
    scoped = failures.where(F.col("scope").isin("block", "state", "variant", "render"))
    of_state, of_variant = scoped.where("scope = 'state'"), scoped.where("scope in ('variant', 'render')")
    absent = lambda rows, table, key: rows.join(table.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    chosen = variants.where("status = 'selected'")
    return all_issues(
        issues(absent(scoped, blocks, "block_id"), "FAILURE_BLOCK_REFERENCE_INVALID", "failure_id", "block_id"),
        issues(absent(of_state, states, "state_id"), "FAILURE_STATE_REFERENCE_INVALID", "failure_id", "state_id"),
        issues(parent_mismatch(of_state, states, "state_id", "state_id", "block_id"), "FAILURE_STATE_BLOCK_MISMATCH", "failure_id", "state_id"),
        issues(absent(of_variant, variants, "variant_id"), "FAILURE_VARIANT_REFERENCE_INVALID", "failure_id", "variant_id"),
        issues(parent_mismatch(of_variant, variants, "variant_id", "variant_id", "block_id"), "FAILURE_VARIANT_BLOCK_MISMATCH", "failure_id", "variant_id"),
        issues(absent(of_variant.where("scope = 'render' and variant_id is not null"), chosen, "variant_id"), "FAILURE_RENDER_TARGET_NOT_SELECTED", "failure_id", "variant_id"))


def manifest_issues(manifest: DataFrame, blocks: DataFrame, states: DataFrame, variants: DataFrame, failures: DataFrame) -> DataFrame:
    """Declared counts, the registry's ordered hash, and one export id in all records. manifest: one
    row (export_id, registry_snapshot_sha256, counts map<string,long>). Failures may have a
    ``review_status``; pending ones are counted too."""
    ids = blocks.where(F.col("block_id").rlike(BLOCK_ID)).select("block_id").distinct()
    digest = ordered_hash(ids, "block_id").select(F.concat(F.lit("sha256:"), "set_hash").alias("h"))
    one = manifest.join(ids.agg(F.count("*").alias("n"))).join(digest)  # a row each
    real = reduce(DataFrame.unionByName, [
        blocks.agg(F.lit("block_records").alias("name"), F.count("*").alias("n")), states.agg(F.lit("state_records").alias("name"), F.count("*").alias("n")),
        variants.agg(F.lit("selected_variant_records").alias("name"), F.count_if(F.col("status") == "selected").alias("n")),
        variants.agg(F.lit("skipped_variant_records").alias("name"), F.count_if(F.col("status") == "skipped").alias("n")),
        failures.agg(F.lit("failure_records").alias("name"), F.count("*").alias("n")),
        *([failures.agg(F.lit("pending_review_records").alias("name"), F.count_if(F.col("review_status") == "pending").alias("n"))] if "review_status" in failures.columns else [])])
    said = manifest.select(F.explode("counts").alias("name", "said"))
    alien = reduce(DataFrame.unionByName, [t.select(F.col(k).cast("string").alias("subject"), "export_id") for t, k in ((blocks, "block_id"), (states, "state_id"), (variants, "variant_id"), (failures, "failure_id"))])
    return all_issues(
        issues(one.where("not registry_snapshot_sha256 <=> h"), "REGISTRY_SNAPSHOT_HASH_MISMATCH", F.lit("registry_snapshot_sha256")),
        issues(one.where("not counts['registry_blocks'] <=> n"), "REGISTRY_COUNT_MISMATCH", F.lit("registry_blocks"), "n"),
        issues(real.join(said, "name", "left").where("not n <=> said"), "MANIFEST_COUNT_MISMATCH", "name", "n"),
        issues(alien.join(F.broadcast(manifest.select("export_id")), "export_id", "left_anti"), "EXPORT_ID_MISMATCH", "subject", "export_id"))


def render_issues(variants: DataFrame, files: DataFrame) -> DataFrame:
    """Rendered files of selected variants against an inventory (relative_path, sha256)."""
    parts = F.split("block_id", ":")
    base = F.concat(F.lit("renders/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))
    chosen = variants.where("status = 'selected'").withColumn("base", base)
    bad = chosen.where(~safe_path(F.col("base").substr(F.lit(1), F.length("base") - 1)))
    kinds = (("preview.png", "image_sha256", "PREVIEW_HASH_MISMATCH"), ("mask.png", "mask_sha256", "MASK_HASH_MISMATCH"), ("render.json", "render_metadata_sha256", "RENDER_METADATA_HASH_MISMATCH"))
    wanted = reduce(DataFrame.unionByName, [chosen.select("variant_id", F.concat("base", F.lit(n)).alias("relative_path"), F.col(h).alias("said"), F.lit(code).alias("mismatch")) for n, h, code in kinds])
    joined = wanted.join(files.select("relative_path", F.concat(F.lit("sha256:"), "sha256").alias("real")), "relative_path", "left")
    folder = lambda t: t.select(F.regexp_replace("relative_path", "/[^/]*$", "").alias("folder"))
    real, want = folder(files.where(F.col("relative_path").startswith("renders/"))).distinct(), folder(wanted).distinct()
    name = F.regexp_extract("relative_path", r"[^/]*$", 0)
    inside = files.select(F.regexp_replace("relative_path", "/[^/]*$", "").alias("folder"), name.alias("name")).join(want, "folder", "left_semi")
    own = F.col("name").isin(RENDER_FILES)
    odd = inside.groupBy("folder").agg(F.count_distinct(F.when(own, F.col("name"))).alias("n"), F.count_if(~own).alias("other")).where(F.col("other") + len(RENDER_FILES) - F.col("n") > 0)
    of_skipped = variants.where("status = 'skipped'").select(F.regexp_replace(base, "/$", "").alias("folder"))
    differ = real.join(want, "folder", "left_anti").unionByName(want.join(real, "folder", "left_anti"))
    return all_issues(
        issues(bad, "RENDER_PATH_INVALID", "block_id"), issues(joined.where("real is null"), "RENDER_FILE_MISSING", "variant_id", "relative_path"),
        joined.where("real <> said").select(F.col("mismatch").alias("code"), F.col("variant_id").alias("subject"), F.col("relative_path").alias("detail")),
        issues(odd, "RENDER_FILE_SET_INVALID", "folder"), issues(differ, "RENDER_VARIANT_SET_MISMATCH", "folder"),
        issues(real.join(want, "folder", "left_anti").join(of_skipped, "folder", "left_semi"), "RENDER_SKIPPED_DIRECTORY_PRESENT", "folder"))


def image_issues(stats: DataFrame, checkers: DataFrame) -> DataFrame:
    """Issues of rendered images from pixels.quality_stats and pixels.checker_test."""
    return all_issues(
        issues(stats.where("empty"), "BACKGROUND_ONLY_RENDER", "image_id"), issues(stats.where("too_small and not empty"), "OBJECT_TOO_SMALL", "image_id", "object_pixels"),
        issues(stats.where("off_canvas"), "OBJECT_OFF_CANVAS", "image_id"), issues(checkers.where("checker"), "MISSING_TEXTURE", "image_id"))


# Files of an export, files of a rendered variant, schemas in order, and what original
# assets look like.
REQUIRED_FILES = ["manifest.json", "blocks.jsonl", "states.jsonl", "variants.jsonl", "failures.jsonl", "checksums.sha256", "exporter.log"]
RENDER_FILES = ["preview.png", "mask.png", "render.json"]
SCHEMA_IDS = ["export-block.v1", "export-failure.v1", "export-manifest.v1", "export-state.v1", "export-variant.v1", "render-metadata.v1"]
ASSET_ENDINGS = [".jar", ".zip", ".mcpack", ".mcmeta", ".7z", ".rar"]
ASSET_FOLDERS = ["assets", "blockstates", "models", "textures", "font", "fonts", "sound", "sounds"]


def _of(rows: DataFrame, code: str, detail: Column | str | None = None) -> DataFrame:
    """Issues of exports: the subject is the export's name."""
    return issues(rows, code, "export", detail)


def directory_issues(exports: DataFrame, inventory: DataFrame) -> DataFrame:
    """Names of exports (export, manifest_export_id) and their folders. inventory: (export,
    relative_path)."""
    staging = F.col("export").startswith(".") & F.col("export").endswith(".staging")
    files = inventory.select("export").distinct()
    rendered = inventory.where(F.col("relative_path").startswith("renders/")).select("export").distinct()
    return all_issues(
        _of(exports.join(files, "export", "left_anti"), "EXPORT_DIR_MISSING"), _of(exports.where(staging), "EXPORT_DIR_STAGING"),
        _of(exports.where(~staging & ~F.col("export").rlike(PATTERNS["export_id"])), "EXPORT_DIR_NAME_INVALID"),
        _of(exports.join(files, "export", "left_semi").join(rendered, "export", "left_anti"), "RENDERS_DIR_MISSING"),
        _of(exports.where(F.col("manifest_export_id") != F.col("export")), "EXPORT_DIR_NAME_MISMATCH", "manifest_export_id"))


def file_issues(inventory: DataFrame) -> DataFrame:
    """Files that an export lacks or must not have. inventory: (export, relative_path)."""
    path = F.col("relative_path")
    wanted = inventory.select("export").distinct().select("export", F.explode(F.array(*map(F.lit, REQUIRED_FILES))).alias("relative_path"))
    rendered = path.startswith("renders/")
    ending = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    asset = ending.isin(ASSET_ENDINGS) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ASSET_FOLDERS)))
    return all_issues(
        _of(wanted.join(inventory.select("export", "relative_path"), ["export", "relative_path"], "left_anti"), "REQUIRED_FILE_MISSING", "relative_path"),
        _of(inventory.where(~rendered & ~path.isin(REQUIRED_FILES)), "UNDECLARED_FILE", "relative_path"),
        _of(inventory.where(rendered & ~F.regexp_extract(path, r"[^/]*$", 0).isin(RENDER_FILES)), "UNDECLARED_RENDER_FILE", "relative_path"),
        _of(inventory.where(asset & ~(rendered & ending.isin(".png", ".json"))), "ORIGINAL_ASSET_BLACKLISTED", "relative_path"))


def text_issues(files: DataFrame) -> DataFrame:
    """Line ends of text files (export, relative_path, content)."""
    text = F.col("content").cast("string")
    return all_issues(
        _of(files.where(text.contains("\r")), "TEXT_NOT_LF", "relative_path"),
        _of(files.where((F.length(text) > 0) & ~text.endswith("\n")), "TEXT_MISSING_FINAL_LF", "relative_path"))


def checksum_issues(lines: DataFrame, inventory: DataFrame, exports: DataFrame) -> DataFrame:
    """Checksum lists (export, line_no, value) against the files (export, relative_path, sha256) that
    they must name, all but the lists themselves. exports: (export) with a list or not."""
    parsed = parse_checksum_list(lines.withColumnRenamed("export", "list")).withColumnRenamed("list", "export")
    key = F.struct("export", "relative_path").alias("file")
    said = parsed.where("issue is null or issue = 'CHECKSUM_ORDER_INVALID'").withColumnRenamed("path", "relative_path").select(key, "sha256")
    real = inventory.where("relative_path <> 'checksums.sha256'").select(key, "sha256")
    named = lines.select("export").distinct()
    compared = full_comparison(said, real, "file", "sha256").select("file.export", "file.relative_path", "status").join(named, "export", "left_semi")
    code = F.create_map(*(F.lit(x) for pair in (("missing", "CHECKSUM_FILES_EXTRA"), ("extra", "CHECKSUM_FILES_MISSING"), ("mismatch", "CHECKSUM_MISMATCH")) for x in pair))
    return all_issues(
        _of(exports.select("export").join(named, "export", "left_anti"), "CHECKSUM_FILE_READ_FAILED"),
        parsed.where("issue is not null").select(F.col("issue").alias("code"), F.col("export").alias("subject"), F.col("line_no").cast("string").alias("detail")),
        compared.select(F.element_at(code, F.col("status")).alias("code"), F.col("export").alias("subject"), F.col("relative_path").alias("detail")))


def manifest_document_issues(manifests: DataFrame, schemas: DataFrame) -> DataFrame:
    """Manifests as JSON texts (export, value) and the schemas that they list. schemas: (schema_id,
    value) as JSON texts; their hashes are over the text. Each text is parsed once, into a written table; the
    schemas' hashes are compared with each listed pair once, not with each manifest."""
    parsed = manifests.withColumn("v_", F.try_parse_json("value"))
    kind = F.schema_of_variant("v_")
    get = lambda path: F.try_variant_get("v_", path, "string")
    listing = F.from_json("value", "schema_inventory array<struct<schema_id:string,schema_sha256:string>>")["schema_inventory"]
    parsed = stored(parsed.select(
        "export", F.col("v_").isNotNull().alias("read"), F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("object"), get("$.status").alias("status"), get("$.platform.os_name").alias("os"),
        get("$.platform.architecture").alias("arch"), F.try_variant_get("v_", "$.platform", "variant").isNotNull().alias("has_platform"), listing.alias("listed")), "manifests")
    good = parsed.where("object")
    listed = good.where("listed is not null").select("export", F.explode("listed").alias("s")).select("export", "s.*")
    real = schemas.select("schema_id", F.concat(F.lit("sha256:"), F.sha2("value", 256)).alias("real_"))
    # A schema may be there several times: an issue for each.
    pairs = listed.where("schema_id is not null").select("schema_id", "schema_sha256").distinct().join(real, "schema_id").where(~F.col("schema_sha256").eqNullSafe(F.col("real_")))
    wrong = stored(pairs.groupBy("schema_id", "schema_sha256").agg(F.count("*").cast("int").alias("times")), "wrong-schemas").toDF("id_", "hash_", "times")
    wrong = listed.join(wrong, (F.col("schema_id") == F.col("id_")) & F.col("schema_sha256").eqNullSafe(F.col("hash_")))
    read = schemas.select("schema_id", F.try_parse_json("value").alias("v_"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    if_ = lambda test, code, detail=F.lit(None): F.when(test, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))
    found = F.array_compact(F.array(
        if_(~F.col("read"), "MANIFEST_READ_FAILED"), if_(F.col("read") & ~F.col("object"), "MANIFEST_NOT_OBJECT"), if_(F.col("object") & (F.col("status") == "failed"), "FAILED_EXPORT_NOT_ACCEPTED"),
        if_(F.col("object") & F.col("listed").isNotNull() & (F.col("listed.schema_id") != F.array(*map(F.lit, SCHEMA_IDS))), "SCHEMA_INVENTORY_ORDER"),
        if_(F.col("object") & F.col("has_platform") & no(F.col("os").isin("Windows", "Linux")), "PLATFORM_UNSUPPORTED", F.col("os")),
        if_(F.col("object") & F.col("has_platform") & no(F.col("arch") == "x86_64"), "PLATFORM_ARCHITECTURE_UNSUPPORTED", F.col("arch"))))
    return all_issues(
        parsed.select("export", F.explode(found).alias("f")).select("f.code", F.col("export").cast("string").alias("subject"), "f.detail"),
        _of(wrong.select("export", "schema_id", F.explode(F.array_repeat(F.lit(1), F.col("times")))), "SCHEMA_INVENTORY_HASH_MISMATCH", "schema_id"),
        issues(read.where("v_ is null"), "SCHEMA_READ_FAILED", "schema_id"), issues(read.where(F.col("v_").isNotNull() & ~kind.startswith("OBJECT")), "SCHEMA_NOT_OBJECT", "schema_id"))


# Issues that fail an export.
FAILING = [
    "CHECKSUM_MISMATCH", "CHECKSUM_FILES_MISSING", "CHECKSUM_FILES_EXTRA", "CHECKSUM_LINE_INVALID", "CHECKSUM_PATH_INVALID", "CHECKSUM_ORDER_INVALID",
    "REQUIRED_FILE_MISSING", "UNDECLARED_FILE", "UNDECLARED_RENDER_FILE", "MANIFEST_READ_FAILED", "JSONL_READ_FAILED",
    "RENDER_FILE_MISSING", "RENDER_PATH_INVALID", "RENDER_METADATA_PARSE_FAILED", "RENDER_FILE_SET_INVALID", "RENDER_SKIPPED_DIRECTORY_PRESENT", "RENDER_VARIANT_SET_MISMATCH",
    "VARIANT_ID_BLOCK_MISMATCH", "EXPORT_DIR_NAME_INVALID", "EXPORT_DIR_NAME_MISMATCH", "EXPORT_DIR_STAGING",
    "BACKGROUND_ONLY_RENDER", "OBJECT_TOO_SMALL", "OBJECT_OFF_CANVAS", "MISSING_TEXTURE", "REGISTRY_COUNT_MISMATCH",
    "INVENTORY_SYMLINK_REJECTED", "INVENTORY_HARDLINK_REJECTED", "STATE_BLOCK_REFERENCE_INVALID", "VARIANT_BLOCK_REFERENCE_INVALID",
    "FAILURE_STATE_BLOCK_MISMATCH", "FAILURE_VARIANT_BLOCK_MISMATCH", "BLOCK_ID_DUPLICATE", "STATE_ID_DUPLICATE", "VARIANT_ID_DUPLICATE", "SCHEMA_VALIDATION_FAILED",
]


def status_issues(exports: DataFrame, found: DataFrame) -> DataFrame:
    """Exports (export, status, pending: number of failures that wait for review) whose status is not the
    one that their issues (export, code) give: failed, else needs_review with pending ones, else
    succeeded."""
    failing = found.where(F.col("code").isin(FAILING)).select("export", F.lit(True).alias("fails_")).distinct()
    expected = F.when(F.col("fails_"), "failed").when(F.col("pending") > 0, "needs_review").otherwise("succeeded")
    return _of(exports.join(failing, "export", "left").withColumn("expected_", expected).where(~F.col("status").eqNullSafe(F.col("expected_"))), "MANIFEST_STATUS_MISMATCH", "expected_")


def metadata_issues(metadata: DataFrame) -> DataFrame:
    """Metadata of rendered variants as JSON texts (variant_id, value)."""
    parsed = metadata.withColumn("v_", F.try_parse_json("value"))
    kind = F.schema_of_variant("v_")
    get = lambda path, type_: F.try_variant_get("v_", path, type_)
    objects = parsed.where(F.col("v_").isNotNull() & kind.startswith("OBJECT"))
    has_mask = F.coalesce(F.schema_of_variant(get("$.mask", "variant")).startswith("OBJECT"), F.lit(False))
    return all_issues(
        issues(parsed.where("v_ is null"), "RENDER_METADATA_PARSE_FAILED", "variant_id"), issues(parsed.where(F.col("v_").isNotNull() & ~kind.startswith("OBJECT")), "RENDER_METADATA_NOT_OBJECT", "variant_id"),
        issues(objects.where(~get("$.variant_id", "string").eqNullSafe(F.col("variant_id"))), "RENDER_METADATA_VARIANT_MISMATCH", "variant_id"),
        issues(objects.where(~has_mask | ~get("$.mask.format", "string").eqNullSafe(F.lit("PNG-RGBA"))), "MASK_METADATA_FORMAT_INVALID", "variant_id"),
        issues(objects.where(has_mask & ~get("$.mask.channel", "string").eqNullSafe(F.lit("alpha"))), "MASK_METADATA_CHANNEL_INVALID", "variant_id"),
        issues(objects.where(~tint_rule(get("$.tint_sensitive", "boolean"), get("$.baseline_biome", "string"))), "TINT_BASELINE_INVALID", "variant_id"))


def export_issues(blocks: DataFrame, states: DataFrame, variants: DataFrame, failures: DataFrame, manifest: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All issues of an export's tables."""
    found = [record_issues(blocks, states, variants), mapping_issues(blocks, states, variants, failures), failure_issues(blocks, states, variants, failures)]
    if manifest is not None:
        found.append(manifest_issues(manifest, blocks, states, variants, failures))
    if files is not None:
        found.append(render_issues(variants, files))
    return all_issues(*found)
