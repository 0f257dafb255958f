"""Operators on small fixtures: one changed field, one violation; definitions by hand."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import color, nested, text
from tessera.operators import diff, geometry, integrity, lineage, overrides, pixels, progress, release, review, search, text_index
from tessera.sources import records, sinks


def one(df):
    return df.first()[0]


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ａb\t C ß ", ["b", "a", "", "b"], {"k2": "2", "k1": "1"}, "x/../y", "a/b.txt")], "t string, l array<string>, m map<string,string>, bad string, good string")
    assert one(row.select(text.normalize_unicode("t"))) == "ab c ss"
    assert one(row.select(text.fold_case("t"))) == "ａb c ss"
    assert one(row.select(text.search_document(F.col("l"), F.array(F.lit("c"))))) == "a b c"
    assert one(row.select(text.canonical_key(F.lit("id"), F.col("m")))) == "id[k1=1,k2=2]"
    assert one(row.select(text.canonical_key(F.lit("id"), F.map_filter("m", lambda k, v: F.lit(False))))) == "id"
    assert list(row.select(text.safe_path(F.col("bad")), text.safe_path(F.col("good"))).first()) == [False, True]
    framed = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in (b"a", b"bc"))).hexdigest()
    assert one(row.select(text.framed_hash(F.lit("a"), F.lit("bc")))) == framed
    assert one(row.select(text.zero_framed_hash(F.lit("a"), F.lit("bc")))) == hashlib.sha256(b"a\0bc\0").hexdigest()
    assert one(row.select(text.substring_score(F.lit("ab"), F.lit("xabx")))) == 0.75
    assert one(row.select(text.like_wildcards(F.lit("a\\bXc"), F.lit("\\b_c")))) is True
    assert one(row.select(text.redact(F.lit("my password")))) is None
    assert one(row.select(nested.redact_map(F.create_map(F.lit("secret"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("image_path"), F.lit("x"))))) == {"b": "2"}


def test_colors(spark):
    row = spark.range(1)
    white = [F.lit(255.0)] * 3
    lab, ok = row.select(color.rgb_to_lab(*white), color.rgb_to_oklab(*white)).first()
    assert lab[0] == pytest.approx(100, abs=1e-3) and abs(lab[1]) < 0.02 and ok[0] == pytest.approx(1, abs=1e-6)
    score = color.weighted_score({"shape": F.lit(1.0), "color": F.lit(0.0), "use": F.lit(None).cast("double")})
    assert one(row.select(score)) == pytest.approx(round(0.35 / 0.65, 8))
    assert one(row.select(color.weighted_score({"use": F.lit(None).cast("double")}))) == 0
    assert one(row.select(color.color_similarity(F.array().cast("array<double>"), F.array().cast("array<double>"), F.array().cast("array<struct<lab:array<double>,oklab:array<double>>>")))) == 0


def plain_replay(base, operations):
    state = list(base)
    for op, values in operations:
        state = state + values if op == "add" else [x for x in state if x not in values] if op == "remove" else list(values)
    return sorted(set(state))


def test_replay_equals_a_plain_fold(spark):
    rng, ops, bases, want = random.Random(3), [], [], {}
    for s in range(120):
        base = rng.sample("abcde", rng.randrange(4)) if s % 2 else None
        mine = [(rng.choice(["add", "add", "remove", "set"]), rng.sample("abcde", rng.randrange(3))) for _ in range(rng.randrange(1, 7))]
        ops += [(str(s), "f", i, op, v, None) for i, (op, v) in enumerate(mine)]
        if base is not None:
            bases.append((str(s), "f", base))
        want[str(s)] = plain_replay(base or [], mine)
    o = spark.createDataFrame(ops, "subject string, field string, seq long, op string, values array<string>, scalar string")
    b = spark.createDataFrame(bases, "subject string, field string, values array<string>")
    assert {r["subject"]: r["values"] for r in overrides.replay_lists(o, b).collect()} == want


def test_human_complete_and_forbidden(spark):
    lists = spark.createDataFrame([("a", "x", ["1"]), ("a", "y", []), ("b", "x", [])], "subject string, field string, values array<string>")
    scalars = spark.createDataFrame([("a", "s", "text"), ("a", "confidence", "0.5"), ("b", "s", " ")], "subject string, field string, scalar string")
    got = {r["subject"]: r["complete"] for r in overrides.human_complete(lists, scalars, ["x", "y"], ["s"], "confidence").collect()}
    assert got == {"a": True, "b": False}
    ops = spark.createDataFrame([("o1", '{"set_shape":1,"x":[{"add_tag":2,"remove_image":3}]}'), ("o2", "no json"), ("o3", None)], "override_id string, record_json string")
    assert sorted(map(tuple, overrides.forbidden_fields(ops).collect())) == [("o1", "image"), ("o1", "shape")]


def box_volume(boxes):
    boxes = [b for b in boxes if all(b[i] < b[i + 3] for i in range(3))]
    axes = [sorted({b[i] for b in boxes} | {b[i + 3] for b in boxes}) for i in range(3)]
    total = 0.0
    for x0, x1 in zip(axes[0], axes[0][1:]):
        for y0, y1 in zip(axes[1], axes[1][1:]):
            for z0, z1 in zip(axes[2], axes[2][1:]):
                c = ((x0 + x1) / 2, (y0 + y1) / 2, (z0 + z1) / 2)
                if any(all(b[i] <= c[i] < b[i + 3] for i in range(3)) for b in boxes):
                    total += (x1 - x0) * (y1 - y0) * (z1 - z0)
    return total


def test_box_union(spark):
    rng, rows, want = random.Random(5), [], {}
    for e in range(25):
        boxes = [tuple(rng.randrange(0, 9) / 8 for _ in range(6)) for _ in range(rng.randrange(1, 6))]
        rows += [(e, *b) for b in boxes]
        want[e] = box_volume(boxes)
    rows += [(100, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5), (100, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "e int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = {r["e"]: r for r in geometry.box_union(df, "e").collect()}
    assert all(got[e]["volume"] == pytest.approx(v) for e, v in want.items())
    assert got[100]["full_cube"] and got[100]["volume"] == 1.0
    classes = spark.range(1).select(geometry.geometry_classes(F.lit(True), F.lit(True), F.lit(0.1)), geometry.geometry_classes(F.lit(False), F.lit(False), F.lit(0.5))).first()
    assert list(classes) == [["full_cube", "horizontal_sheet", "thin"], ["partial_height"]]


def png(width, height, rows, kind=0):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    data, before = b"", bytes(width * 4)
    for row in rows:
        raw = bytes(v for p in row for v in p)
        left = lambda i, r: r[i - 4] if i >= 4 else 0
        if kind == 1:
            line = bytes((raw[i] - left(i, raw)) & 255 for i in range(len(raw)))
        elif kind == 2:
            line = bytes((raw[i] - before[i]) & 255 for i in range(len(raw)))
        elif kind == 3:
            line = bytes((raw[i] - (left(i, raw) + before[i]) // 2) & 255 for i in range(len(raw)))
        elif kind == 4:
            def paeth(i):
                a, b, c = left(i, raw), before[i], left(i, before)
                p = a + b - c
                return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line = bytes((raw[i] - paeth(i)) & 255 for i in range(len(raw)))
        else:
            line = raw
        data += bytes([kind]) + line
        before = raw
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_images(spark):
    rng = random.Random(2)
    image = [[tuple(rng.randrange(256) for _ in range(3)) + (rng.choice([0, 255]),) for _ in range(5)] for _ in range(4)]
    files = [(f"k{k}", png(5, 4, image, k)) for k in range(5)] + [("bad", png(5, 4, image)[:-20]), ("text", b"no png")]
    done = {r["path"]: r for r in pixels.decode_images(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert all(bytes(done[f"k{k}"]["pixels"]) == bytes(v for row in image for p in row for v in p) for k in range(5))
    assert done["bad"]["error"] and done["text"]["error"] == "signature"
    checker = [[(0, 0, 0, 255) if (x < 2) == (y < 2) else (248, 0, 248, 255) for x in range(4)] for y in range(4)]
    both = spark.createDataFrame([("c", png(4, 4, checker)), ("i", png(5, 4, image))], "path string, content binary")
    decoded = pixels.decode_images(both).withColumnRenamed("path", "image_id")
    table = pixels.explode_pixels(decoded, decoded)
    assert {r["image_id"]: r["checker"] for r in pixels.checker_test(table).collect()} == {"c": True, "i": False}
    stats = {r["image_id"]: r for r in pixels.color_stats(table).collect()}
    seen = [p for row in image for p in row if p[3]]
    assert stats["i"]["average_rgb"][0] == pytest.approx(sum(p[0] for p in seen) / len(seen) / 255, abs=1e-7)
    assert stats["c"]["mask_coverage"] == 1
    edges = {r["image_id"]: r for r in pixels.edge_stats(table).collect()}
    assert edges["c"]["edge_density"] == pytest.approx(8 / 32)


def test_integrity_rules(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id int, v string")
    assert {tuple(r) for r in integrity.full_comparison(a.distinct(), b, "id", "v").collect()} == {(2, "mismatch"), (3, "extra")}
    assert integrity.row_difference(a, b).count() == 4 and integrity.row_difference(b, b).count() == 0
    assert one(integrity.set_equality(a, a.distinct(), "id")) is True
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, "c"), ("f", 3, "b")], "f string, n int, p string")
    assert [r["p"] for r in integrity.unsorted_lines(lines, "f", "n", "p").collect()] == ["b"]
    rows = spark.createDataFrame([(1, "b", {"k": "1"}), (2, "b", {"k": "9"}), (3, "b", {})], "id int, e string, p map<string,string>")
    entities = spark.createDataFrame([("b", {"k": ["1", "2"]})], "e string, d map<string,array<string>>")
    assert sorted(r["id"] for r in integrity.domain_violations(rows, "id", "e", "p", entities, "d").collect()) == [2, 3]
    union = spark.createDataFrame([("selected", "p", None), ("selected", "p", "r"), ("skipped", None, "r"), ("odd", None, None)], "status string, path string, reason string")
    assert integrity.union_fields(union, "status", {"selected": ["path"], "skipped": ["reason"]}).count() == 2
    assert one(integrity.table_fingerprint(a).select("fingerprint")) == one(integrity.table_fingerprint(a.orderBy(F.desc("id"))).select("fingerprint"))
    assert integrity.dual_subject(spark.createDataFrame([("v", "v")], "variant string, block string"), spark.createDataFrame([("v", "n")], "subject string, note string"), "variant", "block", "subject").count() == 1
    evidence = spark.createDataFrame([(1,)], "id int")
    assert [r["id"] for r in integrity.missing_evidence(b, evidence, "id").orderBy("id").collect()] == [2, 3]


def test_search_cases(spark):
    bad = [([], None), ([" "], None), (["stone", " stone "], None), (["k"] * 17, None), (["x" * 65], None), (["a"], 13), (["a"], 0)]
    requests = spark.createDataFrame([(str(i), k, n) for i, (k, n) in enumerate([*bad, (["a"], 12), ([" yellow ", "carpet"], None)])], "request_id string, keywords array<string>, `limit` int")
    checked = {r["request_id"]: r for r in search.input_rules(requests).collect()}
    assert all(checked[str(i)]["input_error"] for i in range(len(bad))) and not checked["7"]["input_error"] and checked["8"]["limit"] == 8
    docs = spark.createDataFrame([("1", "yellow carpet"), ("2", "stone 石 wall"), ("3", "carp")], "doc_id string, text string")
    tokens = search.keyword_tokens(spark.createDataFrame([("a", ["carpet"]), ("b", ["石"]), ("c", ["none"])], "request_id string, keywords array<string>"))
    for index in (None, text_index.postings(docs)):
        assert {tuple(r) for r in search.recall(docs, tokens, index).collect()} == {("a", "1"), ("b", "2")}
    ranked = spark.createDataFrame([("a", "T01", 1), ("a", "T02", 2)], "request_id string, candidate_id string, position int")
    outside = spark.createDataFrame([("a", "T01", 0.1, 2), ("a", "T02", 0.9, 1)], "request_id string, candidate_id string, fit double, pos int")
    assert [r["candidate_id"] for r in search.apply_external_ranking(ranked, outside).orderBy("final_position").collect()] == ["T02", "T01"]
    assert [r["candidate_id"] for r in search.apply_external_ranking(ranked, outside.limit(1)).orderBy("final_position").collect()] == ["T01", "T02"]
    unknown = spark.createDataFrame([(1, "true"), (2, "false"), (3, "unknown"), (4, None)], "id int, f string")
    assert [r["id"] for r in search.hard_filter(unknown, [("f", "not_eq", True)])[0].collect()] == [2]
    assert [r["doc_id"] for r in search.phrase_query(docs, "carp", 1).collect()] == ["1"]
    assert [r["doc_id"] for r in search.phrase_query(docs, "carp", 1, prelimit=False).collect()] == ["3"]


def test_review_and_lineage(spark):
    tasks = spark.createDataFrame([("r1", "t1", "open", []), ("r2", "t2", "open", ["x"])], "review_id string, target_id string, status string, evidence array<string>")
    decisions = spark.createDataFrame([("r1", "retry", ["a"], 1), ("r1", "accept", ["b"], 2)], "review_id string, decision string, evidence array<string>, decided_at int")
    got = {r["review_id"]: r for r in review.apply_decisions(tasks, decisions).collect()}
    assert got["r1"]["status"] == "resolved" and got["r1"]["verified"] and got["r2"]["status"] == "open"
    assert {r["review_id"]: r["status"] for r in review.reopen(tasks.withColumn("status", F.lit("resolved")), tasks.limit(1)).collect()} == {"r1": "open", "r2": "resolved"}
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(137)], "k string")
    assert sorted(r["ordinal"] for r in lineage.with_ordinal(keys, "k").collect()) == list(range(137))
    assert [r["k"] for r in lineage.with_ordinal(keys, "k").orderBy("ordinal").collect()] == [f"k{i:03d}" for i in range(137)]
    batches = lineage.fixed_batches(keys, "k", 10).orderBy("batch_key").collect()
    assert batches[0]["batch_key"] == "ai_batch_0000" and len(batches) == 14 and len(batches[-1]["members"]) == 7
    blocks = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "block_id string")
    variants = spark.createDataFrame([("b1", "v1", "selected", None), ("b2", "v2", "skipped", "f2"), ("b3", "v3", "skipped", "f3")], "block_id string, variant_id string, status string, failure_id string")
    reviews = spark.createDataFrame([("v2", "f2"), ("v3", "f9")], "target_id string, failure_ref string")
    assert [r["block_id"] for r in review.audited_skips(blocks, variants, reviews).collect()] == ["b3"]
    expected = spark.createDataFrame([("b", "1"), ("b", "2"), ("c", "1")], "batch_id string, item_id string")
    returned = spark.createDataFrame([("b", "1"), ("b", "1"), ("c", "1")], "batch_id string, item_id string")
    assert [tuple(r) for r in review.batch_output(expected, returned).collect()] == [("b", 1, 0, 1)]
    code = lineage.error_class(F.col("c"), {"OLD": "FATAL"}, ["FATAL"], ["STOP"])
    assert [r[0] for r in spark.createDataFrame([("OLD",), ("STOP",), ("X",)], "c string").select(code).collect()] == ["fatal", "control", "item_local"]


def test_diff_and_release(spark):
    old = spark.createDataFrame([(1, "skipped", "a", "v1"), (2, "selected", "b", "v1")], "id int, status string, f string, export string")
    new = spark.createDataFrame([(1, "selected", "a", "v2"), (2, "selected", "b", "v2"), (3, "selected", "c", "v2")], "id int, status string, f string, export string")
    assert {(r["id"], r["change"]) for r in diff.snapshot_diff(old, new, "id", ["export"]).collect()} == {(1, "changed"), (3, "added")}
    merged = diff.targeted_merge(old, new, "id", old.where("id = 1"), ["export"])
    assert sorted(map(tuple, merged.collect())) == [(1, "selected", "a", "v2"), (2, "selected", "b", "v2")]
    assert diff.snapshot_diff(merged, diff.targeted_merge(merged, new, "id", old.where("id = 1"), ["export"]), "id").count() == 0
    assert diff.transition_violations(old.where("id = 1"), new, "id", "status", "skipped", "selected", ["export"]).count() == 0
    assert diff.upsert(old, new, "id", replace=False).count() == 3
    report = release.quality_report({"A": old.limit(0), "B": old})
    assert {(r["gate"], r["status"], r["observed"]) for r in report.collect()} == {("A", "pass", 0), ("B", "fail", 2)}
    assert one(release.buildable(report)) is False
    deep = spark.createDataFrame([(1, ("x", "y"), [[("a", 1)], None, []], {"k": ("b", None)}, "z"), (2, None, None, None, None)],
                                 "id int, source struct<export_id:string,stage:string>, items array<array<struct<export_id:string,n:int>>>, m map<string,struct<export_id:string,n:int>>, export_id string")
    made = diff.rewrite_lineage(deep, {"export_id": F.lit("new"), "n": F.lit(None)}).collect()
    assert made[0].asDict(True) == {"id": 1, "source": {"export_id": "new", "stage": "y"}, "items": [[{"export_id": "new", "n": 1}], None, []], "m": {"k": {"export_id": "new", "n": None}}, "export_id": "new"}
    assert made[1]["source"] is None and made[1]["items"] is None and diff.rewrite_lineage(deep, {"other": F.lit(1)}).schema == deep.schema


def test_sources_and_sinks(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_bytes(b'{"id":1}\n[2]\n\n{"id":\n{"id":3}\r\n{"id":4}')
    tolerant = {r["raw"]: r["error"] for r in records.scan_jsonl_tolerant(spark, str(good), "id int").collect()}
    assert tolerant['{"id":1}'] is None and tolerant["[2]"] == "not_object" and tolerant['{"id":'] == "bad_json"
    assert records.scan_jsonl_lenient(spark, str(good), "id int").count() == 3
    _, problems = records.scan_jsonl_strict(spark, str(good), "id int")
    assert {r["code"] for r in problems.collect()} >= {"TEXT_NOT_LF", "JSONL_MISSING_FINAL_LF", "JSONL_EMPTY_LINE", "JSONL_PARSE_FAILED", "JSONL_RECORD_NOT_OBJECT"}
    raw = spark.createDataFrame([(b'{"id":1}',), (b"\xff\xfe",)], "value binary")
    assert sorted(str(r["error"]) for r in records.parse_jsonl(raw, "id int").collect()) == ["None", "bad_utf8"]
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/sub/x.txt").write_bytes(b"abc")
    inventory = records.scan_file_inventory(spark, str(tmp_path / "tree"))
    assert [tuple(r) for r in inventory.collect()] == [("sub/x.txt", 3, hashlib.sha256(b"abc").hexdigest())]
    h = "0" * 64
    lists = tmp_path / "sums"
    lists.write_text(f"{h}  b\n{h}  a\nbad\n{h}  b\n{h}  ../c\n")
    assert [r["issue"] for r in records.scan_checksum_list(spark, str(lists)).orderBy("line_no").collect()] == [None, "CHECKSUM_ORDER_INVALID", "CHECKSUM_LINE_INVALID", "CHECKSUM_PATH_DUPLICATE", "CHECKSUM_PATH_INVALID"]
    rows = spark.createDataFrame([(2, None), (1, "é")], "id int, v string")
    sinks.write_jsonl(rows, "id", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"id":1,"v":"é"}', '{"id":2,"v":null}']
    pointers = spark.createDataFrame([("1.0", "r1", True, 1), ("1.0", "r2", True, 2), ("2.0", "r3", False, 1)], "version string, release_id string, is_default boolean, updated_at int")
    assert records.resolve_release(pointers).first()["release_id"] == "r2" and records.resolve_release(pointers, "2.0").first()["release_id"] == "r3"
    assert records.resolve_release(pointers, "9").first()["available"] == ["1.0", "2.0"]
    sinks.write_release_table(rows, str(tmp_path / "rel"), "t", "1.0", "r1")
    assert records.scan_release(spark, str(tmp_path / "rel"), "1.0", "r1", "t").count() == 2
    sinks.publish_pointer(spark, str(tmp_path / "log"), "1.0", "r9", True)
    assert records.resolve_release(spark.read.parquet(str(tmp_path / "log"))).first()["release_id"] == "r9"


def test_progress(spark):
    rows = spark.createDataFrame([("a", "succeeded"), ("a", "pending"), ("b", "skipped")], "stage string, status string")
    assert {(r["stage"], r["percent"]) for r in progress.stage_progress(rows).collect()} == {("a", 50.0), ("b", 100.0), (None, 67.0)}
    view = progress.public_view(rows, {"stage": "^a$"})
    assert sorted(str(r["stage"]) for r in view.collect()) == ["None", "a", "a"]
