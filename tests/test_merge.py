"""Guarded merges, snapshots of several tables, and targets that are refreshed."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.merge import MATCHED, NEW, UNCHANGED, Clause, commit_snapshot, merge, read_snapshot, refresh_targets, upsert_clauses


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def test_first_clause_that_fits(spark):
    table = spark.createDataFrame([(1, "running", "w1", 0), (2, "running", "w2", 0), (3, "paused", "w1", 0), (4, "old", None, 0), (None, "nobody", None, 0)], "k int, status string, worker string, n int")
    changes = spark.createDataFrame([(1, "w1", 5), (2, "w1", 6), (3, "w1", 7), (8, "w1", 8), (9, None, 9), (7, "w1", 1), (7, "w1", 2), (None, "w1", 3)], "k int, worker string, n int")
    guard = (F.col("old.status") == "running") & (F.col("old.worker") == F.col("new.worker"))
    clauses = [Clause(MATCHED, "update", guard, {"status": F.lit("done")}), Clause(NEW, "insert", F.col("new.worker").isNotNull(), {"status": F.concat(F.lit("new "), F.col("new.worker"))}),
               Clause(UNCHANGED, "delete", F.col("old.status") == "old")]
    got, outcome = merge(table, changes, "k", clauses)
    assert got.schema == table.schema
    assert rows(got) == sorted([(1, "done", "w1", 5), (2, "running", "w2", 0), (3, "paused", "w1", 0), (None, "nobody", None, 0), (8, "new w1", "w1", 8)], key=str)
    assert rows(outcome) == sorted([(1, "update"), (2, "refused"), (3, "refused"), (8, "insert"), (9, "refused"), (7, "ambiguous"), (7, "ambiguous"), (None, "refused")], key=str)


def test_upserts_and_empty_tables(spark):
    table, changes = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(merge(table, changes, "k", upsert_clauses())[0]) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(merge(table, changes, "k", upsert_clauses(replace=False))[0]) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(merge(table, changes.limit(0), "k", upsert_clauses())[0]) == [(1, "a"), (2, "b")]
    assert rows(merge(table.limit(0), changes, "k", upsert_clauses())[0]) == [(2, "B"), (3, "C")]


def test_tables_change_together(spark, tmp_path):
    path = str(tmp_path / "s")
    one = spark.createDataFrame([(1,)], "k int")
    assert read_snapshot(spark, path) == (-1, {})
    assert commit_snapshot({"a": one, "b": one}, path, -1) == 0
    broken = {"a": one.union(one), "b": one.select((F.lit(1) / (F.col("k") - 1)).alias("k"))}
    with pytest.raises(Exception, match="(?i)zero"):
        commit_snapshot(broken, path, 0)  # the first table is written, the second fails: nothing changes
    version, tables = read_snapshot(spark, path)
    assert version == 0 and tables["a"].count() == 1
    assert commit_snapshot({"a": one.union(one), "b": one}, path, 0) == 1
    with pytest.raises(Exception, match="(?i)exists"):  # a writer that read version 0
        commit_snapshot({"a": one, "b": one}, path, 0)
    assert read_snapshot(spark, path)[1]["a"].count() == 2


def test_refreshed_targets(spark):
    frame = spark.createDataFrame
    old = {"blocks": frame([("b1", "old"), ("b2", "old")], "block_id string, record string"),
           "states": frame([("s1", "b1", "f1", "old"), ("s2", "b2", "f2", "old"), ("s3", "b1", "f1", "old")], "state_id string, block_id string, failure_id string, record string"),
           "variants": frame([("v1", "b1", "e1", "old"), ("v2", "b2", "e1", "old")], "variant_id string, block_id string, export_id string, record string"),
           "failures": frame([("f1", "b1", "old"), ("f2", "b2", "old"), ("f4", "b2", "old")], "failure_id string, block_id string, record string")}
    new = {"blocks": frame([("b1", "new")], "block_id string, record string"),
           "states": frame([("s1", "b1", None, "new")], "state_id string, block_id string, failure_id string, record string"),
           "variants": frame([("v1", "b1", "e2", "new"), ("v2", "b2", "e2", "new"), ("v3", "b1", "e2", "new"), ("v4", "b2", "e2", "new")], "variant_id string, block_id string, export_id string, record string"),
           "failures": frame([("f1", "b1", "new"), ("f2", "b2", "new"), ("f3", "b1", "new")], "failure_id string, block_id string, record string")}
    targets, resolved = frame([("b1",)], "block_id string"), frame([("f1",)], "failure_id string")
    done = refresh_targets(old, new, targets, resolved, ["export_id"])
    want = {"blocks": [("b1", "new"), ("b2", "old")], "states": [("s1", "b1", None, "new"), ("s2", "b2", "f2", "old"), ("s3", "b1", None, "old")],
            "variants": [("v1", "b1", "e2", "new"), ("v2", "b2", "e2", "old"), ("v3", "b1", "e2", "new")], "failures": [("f2", "b2", "new"), ("f3", "b1", "new"), ("f4", "b2", "old")]}
    assert {n: rows(t) for n, t in done.items()} == want
    again = refresh_targets(done, new, targets, resolved, ["export_id"])
    assert {n: rows(t) for n, t in again.items()} == want
