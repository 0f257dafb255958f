"""Projections of export records to workspace, index and outside views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import redact_list
from tessera.operators.geometry import box_union
from tessera.operators.integrity import priority_match

# Fields of the semantic view, and machine facts that may leave the system.
SEMANTIC = ["synonyms_zh", "synonyms_en", "summary_zh", "summary_en", "color_terms", "shape_terms", "material_impressions", "building_roles", "style_tags", "avoid_for", "confidence"]
GEOMETRY = ["width", "height", "depth", "occupied_volume", "is_full_cube", "is_horizontal_sheet", "geometry_classes"]
BEHAVIOR = ["transparent", "emissive", "emission_level", "passable", "waterloggable", "requires_support", "redstone_related"]


def _struct(rows: DataFrame, parent: str, names: list[str]) -> Column:
    """The named fields that the struct has."""
    have = rows.select(f"{parent}.*").columns
    return F.struct(*(F.col(f"{parent}.{n}").alias(n) for n in names if n in have))


def project_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        F.lit("block-record.v1").alias("schema_version"), "export_id", "minecraft_version", "block_id", "translation_key",
        F.struct(F.col("name_zh_cn").alias("zh_cn"), F.col("name_en_us").alias("en_us")).alias("official_names"), "default_state_id", "properties", "tags",
        F.struct("has_item", "has_block_entity").alias("machine_facts"), "source")


def state_failures(states: DataFrame, failures: DataFrame) -> DataFrame:
    """(state_id, failure_id): the first failure of the state itself, else of its block. failures
    carry ``ordinal``, their place in the file."""
    own = failures.where("scope = 'state'").select("state_id", "ordinal", "failure_id")
    shared = failures.where(F.col("scope").isin("block", "variant", "render")).groupBy("block_id").agg(F.min("ordinal").alias("ordinal"), F.min_by("failure_id", "ordinal").alias("failure_id"))
    return priority_match(states.select("state_id", "block_id"), "state_id", [(own, "state_id"), (shared, "block_id")], "ordinal", "failure_id")


def project_states(states: DataFrame, failures: DataFrame) -> DataFrame:
    out = states.join(state_failures(states, failures), "state_id", "left")
    return out.select(F.lit("state-record.v1").alias("schema_version"), "export_id", "minecraft_version", "state_id", "block_id", "properties", "is_default", "legal_state",
                      "shape", "collision", "behavior", "variant_ids", "mapping_status", "failure_id", "source")


def selected(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.where(F.col(status) == "selected")


def is_horizontal_sheet(width: Column, height: Column, depth: Column) -> Column:
    """Lower than an eighth, and at least three quarters wide and deep."""
    return (height > 0) & (height <= 0.125) & (width >= 0.75) & (depth >= 0.75)


def tint_rule(sensitive: Column, baseline: Column, biome: str = "minecraft:plains") -> Column:
    """Whether the baseline fits: the fixed biome for what takes a tint, none for what takes none;
    unknown fits anything."""
    return F.when(sensitive, baseline.eqNullSafe(F.lit(biome))).when(~sensitive, baseline.isNull()).otherwise(F.lit(True))


def project_variants(variants: DataFrame, features: DataFrame) -> DataFrame:
    """Selected variants with their features; the geometry comes from the union of the shape's boxes,
    and the tag full_cube stays only where the union proves it."""
    boxes = variants.select("variant_id", F.explode_outer("machine_facts.shape.boxes").alias("b")).select("variant_id", "b.*")
    shape = box_union(boxes, "variant_id").withColumnRenamed("volume", "occupied_volume").withColumnRenamed("full_cube", "is_full_cube")
    rows = selected(variants).join(features, "variant_id").join(shape, "variant_id")
    sheet = is_horizontal_sheet(F.col("width"), F.col("height"), F.col("depth"))
    classes = F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.filter("geometry_classes", lambda c: c != "full_cube"),
        F.array(F.when(F.col("is_full_cube"), "full_cube"), F.when(F.col("height") <= 0.125, "thin").when(F.col("height") < 1, "partial_height"))))))
    tags = F.filter("machine_tags", lambda t: (t != "full_cube") | F.col("is_full_cube"))
    geometry = F.struct(F.col("machine_facts.shape.signature").alias("geometry_signature"), F.col("machine_facts.collision.signature").alias("collision_signature"), "width", "height", "depth",
                        "occupied_volume", "is_full_cube", sheet.alias("is_horizontal_sheet"), classes.alias("geometry_classes"), "feature_extractor_version", F.col("input_sha256").alias("feature_input_sha256"))
    facts = F.struct(geometry.alias("geometry"), F.col("machine_facts.behavior_by_state").alias("behavior_by_state"), tags.alias("machine_tags"))
    return rows.select(F.lit("visual-variant-record.v1").alias("schema_version"), "export_id", "variant_id", "block_id", "canonical_state_id", "represented_state_ids", "candidate_qualification", "warnings",
                       facts.alias("machine_facts"), F.struct(*RENDER_HASHES).alias("render"), F.array().cast("array<string>").alias("annotation_refs"))


def behavior_of_canonical_state(variants: DataFrame, states: DataFrame) -> DataFrame:
    """(variant_id, behavior): by the canonical id in the variant's map, else the state's own."""
    own = states.select(F.col("state_id").alias("canonical_state_id"), F.col("behavior").alias("own_"))
    return variants.join(own, "canonical_state_id", "left").select("variant_id", F.coalesce(F.element_at("machine_facts.behavior_by_state", F.col("canonical_state_id")), F.col("own_")).alias("behavior"))


def display_name(zh: Column, en: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(zh, F.lit("")), F.nullif(en, F.lit("")), key)


def semantic_view(annotations: DataFrame, key: str) -> DataFrame:
    return annotations.select(key, *(c for c in SEMANTIC if c in annotations.columns))


def metadata_view(projected: DataFrame) -> DataFrame:
    """Allowlisted machine facts of projected variants; machine tags within the limits of lists (64 items
    of 512 characters, none sensitive)."""
    behavior = F.element_at("machine_facts.behavior_by_state", F.col("canonical_state_id"))
    with_behavior = projected.withColumn("behavior_", behavior)
    return with_behavior.select("variant_id", "block_id", "canonical_state_id", _struct(projected, "machine_facts.geometry", GEOMETRY).alias("geometry"),
                                redact_list(F.col("machine_facts.machine_tags")).alias("machine_tags"), _struct(with_behavior, "behavior_", BEHAVIOR).alias("behavior"))


def payload_text(tiles: Column, metadata: Column, name: str = "metadata") -> Column:
    """Tiles first, then metadata, as one JSON text without ``<``."""
    safe = lambda c: F.replace(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("<"), F.lit("\\u003c"))
    return F.concat(F.lit('{"tiles":'), safe(tiles), F.lit(f',"{name}":'), safe(metadata), F.lit("}"))


# Where a release keeps its images, and the prefix that ids lose in paths.
PREVIEWS, NAMESPACE = "previews/minecraft/", "minecraft:"
RENDER_HASHES = ["image_sha256", "mask_sha256", "render_metadata_sha256"]


def index_rows(projected: DataFrame, features: DataFrame) -> DataFrame:
    """Flat index columns, and record and features (variant_id, ...) as canonical JSON. Variants without
    features are left out: they may not be in a release."""
    record = F.to_json(F.struct(*(F.col(c) for c in sorted(projected.columns))), {"ignoreNullFields": "false"})
    own = features.select("variant_id", F.to_json(F.struct(*(F.col(c) for c in sorted(features.columns) if c != "variant_id")), {"ignoreNullFields": "false"}).alias("feature_json"))
    base = F.concat(F.lit(PREVIEWS), F.regexp_replace("variant_id", rf"^{NAMESPACE}", ""))
    paths = {"preview_path": "preview.png", "mask_path": "mask.png", "render_metadata_path": "render.json"}
    return projected.withColumn("record_json", record).join(own, "variant_id").select(
        "variant_id", "block_id", "canonical_state_id", F.to_json("represented_state_ids").alias("represented_state_ids_json"),
        *(F.concat(base, F.lit(f"/{n}")).alias(c) for c, n in paths.items()), *(F.col(f"render.{h}").alias(h) for h in RENDER_HASHES),
        "candidate_qualification", F.to_json("warnings").alias("warnings_json"), "record_json", "feature_json")
