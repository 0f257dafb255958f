"""Two-block export: clean as it is; each changed field yields its code."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import export_rules, projections

BOX = "array<struct<min_x:double,min_y:double,min_z:double,max_x:double,max_y:double,max_z:double>>"
SHAPE = f"struct<boxes:{BOX},signature:string>"
BEHAVIOR = "struct<transparent:string,emissive:string,emission_level:int>"
BLOCKS = "export_id string, minecraft_version string, block_id string, translation_key string, name_zh_cn string, name_en_us string, default_state_id string, properties map<string,array<string>>, has_item string, has_block_entity string, tags array<string>, source struct<stage:string>"
STATES = f"export_id string, minecraft_version string, state_id string, block_id string, properties map<string,string>, is_default boolean, legal_state boolean, shape {SHAPE}, collision {SHAPE}, behavior {BEHAVIOR}, variant_ids array<string>, mapping_status string, source struct<stage:string>"
VARIANTS = f"export_id string, variant_id string, block_id string, canonical_state_id string, represented_state_ids array<string>, status string, candidate_qualification string, warnings array<string>, machine_facts struct<shape:{SHAPE},collision:{SHAPE},behavior_by_state:map<string,{BEHAVIOR}>>, image_sha256 string, mask_sha256 string, render_metadata_sha256 string"
FAILURES = "export_id string, failure_id string, scope string, block_id string, state_id string, variant_id string, ordinal int"
CUBE = ([(0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "s")
DARK = ("false", "false", 0)


def package():
    blocks = [["e", "1", "m:stone", "k", "石", "Stone", "m:stone[a=1]", {"a": ["1", "2"]}, "true", "false", ["t"], ("x",)],
              ["e", "1", "m:air", "k", "", "Air", "m:air", {}, "false", "false", [], ("x",)]]
    states = [["e", "1", f"m:stone[a={i}]", "m:stone", {"a": str(i)}, i == 1, True, CUBE, CUBE, DARK, ["m:stone"], "mapped", ("x",)] for i in (1, 2)]
    states.append(["e", "1", "m:air", "m:air", {}, True, True, ([], "s"), ([], "s"), DARK, [], "skipped", ("x",)])
    variants = [["e", "m:stone", "m:stone", "m:stone[a=1]", ["m:stone[a=1]", "m:stone[a=2]"], "selected", "eligible", [], (CUBE, CUBE, {"m:stone[a=1]": DARK}), "sha256:p", "sha256:m", "sha256:r"],
                ["e", "m:air", "m:air", None, None, "skipped", None, [], None, None, None, None]]
    failures = [["e", "f1", "variant", "m:air", None, "m:air", 0]]
    return {"blocks": blocks, "states": states, "variants": variants, "failures": failures}


def frames(spark, p):
    return [spark.createDataFrame([tuple(r) for r in p[n]], s) for n, s in (("blocks", BLOCKS), ("states", STATES), ("variants", VARIANTS), ("failures", FAILURES))]


def manifest(spark, digest=None, **counts):
    digest = digest or "sha256:" + hashlib.sha256(b"m:air\nm:stone").hexdigest()
    real = dict(registry_blocks=2, block_records=2, state_records=3, selected_variant_records=1, skipped_variant_records=1, failure_records=1) | counts
    return spark.createDataFrame([("e", digest, real)], "export_id string, registry_snapshot_sha256 string, counts map<string,long>")


def files(spark, rows=(("renders/m/stone/preview.png", "p"), ("renders/m/stone/mask.png", "m"), ("renders/m/stone/render.json", "r"))):
    return spark.createDataFrame(list(rows), "relative_path string, sha256 string")


def test_clean(spark):
    assert export_rules.export_issues(*frames(spark, package()), manifest(spark), files(spark)).count() == 0


CASES = [
    ("blocks", 0, 2, "Bad Id", "BLOCK_ID_INVALID"), ("states", 0, 3, "m:none", "STATE_BLOCK_REFERENCE_INVALID"), ("variants", 0, 2, "m:none", "VARIANT_ID_BLOCK_MISMATCH"),
    ("states", 1, 2, "m:stone[a=1]", "STATE_ID_DUPLICATE"), ("states", 1, 4, {"a": "3"}, "STATE_CANONICAL_ID_INVALID"), ("blocks", 0, 6, "m:stone[a=9]", "DEFAULT_STATE_NOT_LEGAL"),
    ("states", 1, 5, True, "DEFAULT_STATE_UNIQUE_INVALID"), ("states", 0, 10, [], "MAPPED_STATE_WITHOUT_VARIANT"), ("states", 0, 10, ["m:air"], "STATE_VARIANT_REFERENCE_INVALID"),
    ("states", 2, 10, ["m:air"], "SKIPPED_STATE_HAS_VARIANT"), ("variants", 0, 4, ["m:stone[a=1]"], "REPRESENTED_STATE_SET_INVALID"), ("variants", 0, 3, "m:stone[a=2]", "REPRESENTATIVE_NOT_DEFAULT"),
    ("states", 0, 11, "skipped", "SELECTED_STATE_MAPPING_INVALID"), ("failures", 0, 5, None, "SKIPPED_VARIANT_FAILURE_MISSING"), ("states", 2, 11, "mapped", "SKIPPED_BLOCK_STATE_MAPPING_INVALID"),
    ("failures", 0, 3, "m:none", "FAILURE_BLOCK_REFERENCE_INVALID"), ("failures", 0, 2, "state", "FAILURE_STATE_REFERENCE_INVALID"), ("failures", 0, 3, "m:stone", "FAILURE_VARIANT_BLOCK_MISMATCH"),
    ("failures", 0, 5, "m:none", "FAILURE_VARIANT_REFERENCE_INVALID"), ("failures", 0, 2, "render", "FAILURE_RENDER_TARGET_NOT_SELECTED"),
]


@pytest.mark.parametrize("table,row,column,value,code", CASES)
def test_one_change_one_code(spark, table, row, column, value, code):
    p = package()
    p[table][row][column] = value
    assert code in {r["code"] for r in export_rules.export_issues(*frames(spark, p)).collect()}


def test_manifest_and_files(spark):
    tables = frames(spark, package())
    codes = lambda **k: {r["code"] for r in export_rules.export_issues(*tables, **k).collect()}
    assert codes(manifest=manifest(spark, digest="sha256:0")) == {"REGISTRY_SNAPSHOT_HASH_MISMATCH"}
    assert codes(manifest=manifest(spark, registry_blocks=3, failure_records=2)) == {"REGISTRY_COUNT_MISMATCH", "MANIFEST_COUNT_MISMATCH"}
    rows = (("renders/m/stone/preview.png", "other"), ("renders/m/stone/mask.png", "m"), ("renders/m/extra/mask.png", "m"))
    assert codes(files=files(spark, rows)) == {"PREVIEW_HASH_MISMATCH", "RENDER_FILE_MISSING", "RENDER_FILE_SET_INVALID", "RENDER_VARIANT_SET_MISMATCH"}
    p = package()
    p["states"][0][0] = "other"
    assert {r["code"] for r in export_rules.export_issues(*frames(spark, p), manifest(spark)).collect()} == {"EXPORT_ID_MISMATCH"}


def test_projections(spark):
    blocks, states, variants, failures = frames(spark, package())
    assert projections.project_blocks(blocks).where("block_id = 'm:stone'").first()["official_names"]["zh_cn"] == "石"
    done = {r["state_id"]: r["failure_id"] for r in projections.project_states(states, failures).collect()}
    assert done == {"m:stone[a=1]": None, "m:stone[a=2]": None, "m:air": "f1"}
    features = spark.createDataFrame([("m:stone", ["full_cube"], ["full_cube", "x"], "v", "h")], "variant_id string, geometry_classes array<string>, machine_tags array<string>, feature_extractor_version string, input_sha256 string")
    made = projections.project_variants(variants, features)
    row = made.first()
    assert row["machine_facts"]["geometry"]["is_full_cube"] and row["machine_facts"]["geometry"]["geometry_classes"] == ["full_cube"] and row["machine_facts"]["machine_tags"] == ["full_cube", "x"]
    view = projections.metadata_view(made).first()
    assert view["behavior"]["transparent"] == "false" and view["geometry"]["width"] == 1
    assert json.loads(projections.index_rows(made, features).first()["record_json"])["block_id"] == "m:stone"
    flat = projections.index_rows(made.withColumn("variant_id", F.lit("minecraft:stone")), features.withColumn("variant_id", F.lit("minecraft:stone"))).first()
    assert flat["mask_path"] == "previews/minecraft/stone/mask.png" and flat["image_sha256"] == "sha256:p" and json.loads(flat["feature_json"])["input_sha256"] == "h"
    assert projections.behavior_of_canonical_state(variants.where("status = 'selected'"), states).first()["behavior"]["emission_level"] == 0
    text = spark.range(1).select(projections.payload_text(F.array(F.struct(F.lit("<a").alias("t"))), F.array(F.struct(F.lit(1).alias("m"))))).first()[0]
    assert text == '{"tiles":[{"t":"\\u003ca"}],"metadata":[{"m":1}]}'
    assert spark.range(1).select(projections.display_name(F.lit(""), F.lit("en"), F.lit("id"))).first()[0] == "en"
