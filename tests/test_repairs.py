"""Cases that single rules must get right: defaults, fresh partitions, nulls, evidence, units."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators import diff, integrity, pixels, projections, review, search, text_index
from tessera.operators.schema_rules import Rule, violations
from tessera.sources import records, sinks
from tessera.streaming import monitor
from tests.test_operators import png


def test_the_last_default_wins(spark):
    log = spark.createDataFrame([("9.0", "r9", True, 1), ("10.0", "r10", True, 2), ("9.0", "r9b", False, 3)], "version string, release_id string, is_default boolean, updated_at int")
    assert records.resolve_release(log).first()["release_id"] == "r10"
    assert records.resolve_release(log, "9.0").first()["release_id"] == "r9b"


def test_a_release_is_written_once(spark, tmp_path):
    rows = spark.range(2)
    sinks.write_release_table(rows, str(tmp_path), "t", "1.20", "r1")
    with pytest.raises(AnalysisException):
        sinks.write_release_table(rows, str(tmp_path), "t", "1.20", "r1")
    assert records.scan_release(spark, str(tmp_path), "1.20", "r1", "t").count() == 2
    with pytest.raises(ValueError):
        records.release_path("r", "t", "../x", "r1")
    with pytest.raises(ValueError):
        sinks.write_release_index(str(tmp_path), "1", "r2", blocks=rows)


def test_null_values_are_values(spark):
    a = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "y")], "id int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (3, None), (5, None)], "id int, v string")
    assert {tuple(r) for r in integrity.full_comparison(a, b, "id", "v").collect()} == {(2, "mismatch"), (3, "mismatch"), (4, "missing"), (5, "extra")}


def test_decisions_keep_all_evidence(spark):
    tasks = spark.createDataFrame([("r", "t", "open", ["old"])], "review_id string, target_id string, status string, evidence array<string>")
    said = spark.createDataFrame([("r", "retry", ["a", "old"], 1), ("r", "edit", ["b"], 2)], "review_id string, decision string, evidence array<string>, decided_at int")
    row = review.apply_decisions(tasks, said).first()
    assert row["evidence"] == ["old", "a", "b"] and row["status"] == "resolved" and row["verified"]
    many = said.limit(1).withColumn("evidence", F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: i.cast("string")))
    assert len(review.apply_decisions(tasks, many).first()["evidence"]) == 64
    made = review.decision_overrides(tasks, said).collect()
    assert [r["decision"] for r in made] == ["edit"] and made[0]["override_id"].startswith("override_")
    notes = spark.createDataFrame([("n", "t", False), ("m", "other", True)], "annotation_id string, subject_id string, verified boolean")
    assert {r["annotation_id"]: r["verified"] for r in review.unverified_annotations(notes, tasks, said).collect()} == {"n": True, "m": True}


def test_a_changed_unit_is_found(spark):
    rows = spark.createDataFrame([("k", "p", 1, 1, "files"), ("k", "p", 2, 2, "rows"), ("k", "p", 3, 1, "rows"), ("k", "q", 1, 0, "x")], "key string, phase string, at int, done int, unit string")
    assert sorted(r["at"] for r in monitor.progress_regressions(rows, "key", "phase", "done", "at", "unit").collect()) == [2, 3]


def test_checksum_lists_are_told_apart(spark):
    h = "0" * 64
    lines = spark.createDataFrame([("a", 1, f"{h}  b"), ("b", 1, f"{h}  a"), ("b", 2, f"{h}  b")], "list string, line_no int, value string")
    assert records.parse_checksum_list(lines).where("issue is not null").count() == 0


def test_large_boxes_and_slabs(spark):
    """Four hundred unit cells and a box over them: one entity of many boxes."""
    cells = spark.range(400).select(F.lit("e").alias("e"), (F.col("id") % 20).cast("double").alias("min_x"), F.floor(F.col("id") / 20).cast("double").alias("min_y"), F.lit(0.0).alias("min_z"))
    boxes = cells.select("e", "min_x", "min_y", "min_z", (F.col("min_x") + 1).alias("max_x"), (F.col("min_y") + 1).alias("max_y"), F.lit(1.0).alias("max_z"))
    boxes = boxes.unionByName(spark.sql("SELECT 'e' AS e, 5D AS min_x, 5D AS min_y, 0.5D AS min_z, 9D AS max_x, 9D AS max_y, 3D AS max_z"))
    from tessera.operators.geometry import box_union

    assert box_union(boxes, "e").first()["volume"] == 400 + 4 * 4 * 2


def test_search_texts(spark):
    docs = spark.createDataFrame([("1", "a_b"), ("2", "axb"), ("3", "none")], "doc_id string, text string")
    tokens = spark.createDataFrame([("r", "a_")], "request_id string, token string")
    assert {r["doc_id"] for r in search.recall(docs, tokens, text_index.postings(docs)).collect()} == {"1", "2"}
    assert search.phrase_query(docs, "  ").count() == 0 and search.phrase_query(docs, "a_", 0).count() == 1
    ordered = search.stable_byte_sort(spark.createDataFrame([("b",), (None,), ("é",), ("a",)], "k string"), "k")
    assert [r["k"] for r in ordered.collect()] == [None, "a", "b", "é"]


def test_truncated_schema_violations(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, '{"a":1}')], "id int, j string")
    rules = [Rule(f"$.f{i}", required=True) for i in range(10)]
    got = violations(rows, "id", "j", rules).groupBy("subject", "code").count().collect()
    assert {(r["subject"], r["code"]): r["count"] for r in got} == {(s, c): n for s in "12" for c, n in (("SCHEMA_VALIDATION_FAILED", 8), ("SCHEMA_VALIDATION_TRUNCATED", 1))}


def test_fields_at_any_depth(spark):
    rows = spark.createDataFrame([(1, ("v", [("w", 2)]))], "id int, s struct<export_id:string,l:array<struct<export_id:string,n:int>>>")
    assert diff.strip_fields(rows, ["export_id"]).first().asDict(True) == {"id": 1, "s": {"l": [{"n": 2}]}}


def test_mixed_filters_of_a_large_image(spark):
    """Filters of all kinds in one picture, among them those that depend on two neighbours."""
    import numpy as np

    rng = np.random.default_rng(3)
    image = [[tuple(int(v) for v in rng.integers(0, 256, 4)) for _ in range(9)] for _ in range(7)]
    for kind in (3, 4):
        width, height, raw = pixels._decoded(png(9, 7, image, kind))
        assert (width, height) == (9, 7) and raw == bytes(v for row in image for p in row for v in p)
    files = spark.createDataFrame([("a", png(9, 7, image, 4)), ("b", png(2, 1, [[(1, 2, 3, 0), (0, 0, 0, 0)]]))], "path string, content binary")
    codes = {(r["code"], r["subject"]) for r in pixels.image_codes(pixels.decode_images(files), "MASK", side=9).collect()}
    assert codes == {("MASK_FORMAT_INVALID", "a"), ("MASK_FORMAT_INVALID", "b"), ("MASK_OBJECT_EMPTY", "b")}


def test_tint(spark):
    rows = spark.createDataFrame([(True, "minecraft:plains", True), (True, None, False), (False, None, True), (False, "x", False), (None, "x", True)], "s boolean, b string, want boolean")
    assert rows.where(projections.tint_rule(F.col("s"), F.col("b")) != F.col("want")).count() == 0
