"""The stored text index: updates, compaction, parity, failed and competing writers."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, text_index
from tessera.operators.text_index import compact, create_index, ensure_index, open_index, posting_parity, recall_indexed, text_parity, texts, update_index


def docs(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id string, text string")


def wanted(rows, tokens):
    like = lambda t: re.compile(re.escape(t).replace("%", ".*").replace("_", "."), re.S | re.I)
    hit = lambda text, t: t in text if len(t) >= 3 else like(t).search(text)
    return {(r, d) for r, t in tokens for d, text in rows.items() if text is not None and hit(text, t)}


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


TOKENS = [("a", "stone"), ("a", "carp"), ("b", "one w"), ("c", "zz"), ("d", "a_"), ("e", "nothing-has-this"), ("f", "é"), ("g", "aaa")]


def corpus(seed, count=120):
    rng = random.Random(seed)
    words = ["stone", "wall", "carpet", "yellow", "one", "zzz", "axb", "é", "aaaa", "of"]
    return {f"d{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(8))) for i in range(count)}


def test_recall_over_updates_and_compaction(spark, tmp_path):
    tokens = spark.createDataFrame(TOKENS, "request_id string, token string")
    rows = corpus(1)
    index = create_index(docs(spark, rows), str(tmp_path / "i"))
    for step in range(4):
        assert {tuple(r) for r in recall_indexed(index, tokens).collect()} == wanted(rows, TOKENS)
        assert {r["doc_id"]: r["text"] for r in texts(index).collect()} == rows
        before = files(tmp_path / "i")
        rows = {k: v for k, v in rows.items() if k not in (f"d{step}", f"d{step + 30}")} | {f"d{step + 50}": "stone zz now", f"new{step}": "yellow carp"}
        if step == 2:
            rows["d0"] = "back again stone"  # removed before
        index = update_index(index, docs(spark, rows))
        assert before <= files(tmp_path / "i")  # nothing is written again
        log = spark.read.parquet(str(tmp_path / "i" / "log" / f"segment={index.segments[-1]}"))
        assert log.count() <= 5
    assert posting_parity(index).where("not equal").count() == 0
    for keep in (1, 0):
        small = compact(index, keep)
        assert len(small.segments) == keep + 1 and small.version > index.version
        assert {tuple(r) for r in recall_indexed(small, tokens).collect()} == wanted(rows, TOKENS)
        assert text_parity(small, docs(spark, rows)).count() == 0 and posting_parity(small).where("not equal").count() == 0
        index = small


def test_postings_are_not_dealt_out(spark, tmp_path, monkeypatch):
    """Neither an index, an update nor a compaction deals out postings; with few rows sent or all shuffled, and ids
    that come twice, the results are the same."""
    rows = corpus(3, 40)
    moved = []
    parquet = type(spark.range(1).write).parquet

    def watched(self, path, *a, **b):
        plan = self._df._jdf.queryExecution().optimizedPlan().toString()
        moved.append((path.split("/")[-2], "Repartition" in plan or "RebalancePartitions" in plan))
        return parquet(self, path, *a, **b)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", watched)
    tokens = spark.createDataFrame(TOKENS, "request_id string, token string")
    for few in (1 << 18, 1):
        monkeypatch.setattr(text_index, "FEW_ROWS", few, raising=False)
        first = create_index(docs(spark, rows), str(tmp_path / f"i{few}"), buckets=4)
        now = rows | {"d1": "stone zz now", "d2": None, "new": "yellow carp"}
        own = docs(spark, now).unionByName(docs(spark, {"new": "azure carp", "d7": "~ later text"}))  # ids twice: the least text
        now |= {"new": "azure carp"}
        second = update_index(first, own)
        log = spark.read.parquet(str(tmp_path / f"i{few}" / "log" / "segment=1"))
        assert {r["doc_id"]: r["text"] for r in log.collect()} == {"d1": "stone zz now", "d2": None, "new": "azure carp"}
        small = compact(second)
        assert {tuple(r) for r in recall_indexed(small if few > 1 else second, tokens).collect()} == wanted(now, TOKENS)
        assert text_parity(small, own).count() == 0 and posting_parity(small).where("not equal").count() == 0
    assert moved and not any(m[1] for m in moved if m[0] == "postings")


def test_same_texts_make_no_version_and_many_deltas_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "MOST_SEGMENTS", 3)
    rows = {"a": "stone", "b": "wall", "c": None}
    index = ensure_index(docs(spark, rows), str(tmp_path / "i"), buckets=2)
    assert ensure_index(docs(spark, rows), str(tmp_path / "i")) == index
    for step in range(4):
        rows["a"] = f"stone {step}"
        index = ensure_index(docs(spark, rows), str(tmp_path / "i"))
        assert len(index.segments) <= 3
    assert {r["doc_id"]: r["text"] for r in texts(index).collect()} == {"a": "stone 3", "b": "wall"}
    assert open_index(spark, str(tmp_path / "none")) is None


def test_failed_and_competing_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index = create_index(docs(spark, {"a": "stone"}), path)
    monkeypatch.setattr(text_index, "_commit", lambda i: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        update_index(index, docs(spark, {"a": "wall"}))
    monkeypatch.undo()
    assert open_index(spark, path) == index and texts(index).first()["text"] == "stone"
    newer = update_index(index, docs(spark, {"a": "carpet"}))
    with pytest.raises(Exception, match="(?i)exists"):
        update_index(index, docs(spark, {"a": "other"}))
    assert open_index(spark, path).version == newer.version


def test_parity_finds_what_is_wrong(spark, tmp_path):
    rows = {"a": "stone", "b": "wall"}
    index = create_index(docs(spark, rows), str(tmp_path / "i"), buckets=2)
    assert {tuple(r) for r in text_parity(index, docs(spark, {"a": "stones", "c": "new"})).select("doc_id").collect()} == {("a",), ("b",), ("c",)}
    extra = spark.createDataFrame([("sto", "b")], "gram string, doc_id string").withColumn("bucket", text_index.gram_bucket(F.col("gram"), 2))
    extra.write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "i" / "postings" / "segment=0"))
    assert posting_parity(index).where("not equal").count() == 1


def test_plan_of_long_tokens_has_no_nested_loop(spark, tmp_path):
    index = create_index(docs(spark, corpus(2)), str(tmp_path / "i"))
    tokens = spark.createDataFrame([("a", "stone")], "request_id string, token string")
    found = recall_indexed(index, tokens.where("length(token) >= 3"))
    long = found._jdf.queryExecution().executedPlan().toString()
    assert "contains(text" in long and "DynamicPruning" in long.replace("dynamicpruning", "DynamicPruning") or "bucket" in long


def test_search_over_a_release(spark, tmp_path):
    """Catalog from variants, states and blocks; candidates with all columns; exclusions by their reasons."""
    variants = spark.createDataFrame([("v1", "b1", "s1", "eligible", ["w"], ["opaque"]), ("v2", "b1", "s2", "conditional", [], []), ("v3", "b2", "s3", "excluded", [], []), ("v4", "b2", "gone", "eligible", [], []),
                                      ("v5", "b2", "s3", "eligible", [], [])], "variant_id string, block_id string, canonical_state_id string, candidate_qualification string, warnings array<string>, machine_tags array<string>")
    states = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "state_id string, light int")
    blocks = spark.createDataFrame([("b1", None, "Red Stone"), ("b2", "", None)], "block_id string, zh_cn string, en_us string")
    notes = spark.createDataFrame([("v1", "A wall block", ["ruby"], ["facade"], ["modern"])], "variant_id string, summary_en string, synonyms_en array<string>, building_roles array<string>, style_tags array<string>")
    notes = notes.withColumn("synonyms_zh", F.array().cast("array<string>"))
    features = spark.createDataFrame([(f"v{i}", ["cube"], [50.0, 1.0, 1.0], [0.5, 0.1, 0.1]) for i in range(1, 6)], "variant_id string, geometry_classes array<string>, lab array<double>, oklab array<double>")
    catalog = search.search_catalog(variants, states, blocks, notes, features).withColumn("lit", F.when(F.col("doc_id") == "v2", "no").otherwise("yes"))
    index = create_index(catalog.select("doc_id", "text"), str(tmp_path / "i"))
    words = spark.createDataFrame([("cube", "shape_terms"), ("facade", "uses")], "token string, dimension string")
    colors = spark.createDataFrame([], "token string, lab array<double>, oklab array<double>")
    requests = spark.createDataFrame([("q", ["ruby facade"], 5), ("w", ["cube"], 5)], "request_id string, keywords array<string>, `limit` int")
    for way in (index, None):
        got, excluded = search.search(requests, catalog, words, colors, way, [("lit", "eq", "yes")])
        rows = {(r["request_id"], r["candidate_id"]): r for r in got.collect()}
        assert {k: r["doc_id"] for k, r in rows.items()} == {("q", "T01"): "v1", ("w", "T01"): "v1", ("w", "T02"): "v5"}
        first = rows["q", "T01"]
        assert (first["display_name"], first["block_id"], first["recommended_state_id"], first["candidate_qualification"], first["warnings"]) == ("Red Stone", "b1", "s1", "eligible", ["w"])
        assert rows["w", "T02"]["display_name"] == "v5" and first["reason"] == "Matches use, name_synonym."
        assert {tuple(r) for r in excluded.collect()} == {(r, "excluded qualification", 1) for r in "qw"} | {(r, "lit eq yes", 1) for r in "qw"} | {("q", "text recall", 1)}
