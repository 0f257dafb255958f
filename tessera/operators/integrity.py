"""Integrity rules. Each returns violations: (code, subject, detail)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import task_count


def issues(rows: DataFrame, code: str, subject: Column | str, detail: Column | str | None = None) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(F.lit(code).alias("code"), as_column(subject).cast("string").alias("subject"),
                       (as_column(detail) if detail is not None else F.lit(None)).cast("string").alias("detail"))


def all_issues(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is set and names no parent."""
    return children.where(F.col(child_key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def parent_mismatch(children: DataFrame, targets: DataFrame, reference: str, target_key: str, owner: str) -> DataFrame:
    """Children whose reference exists but belongs to another owner."""
    known = targets.select(F.col(target_key).alias(reference), F.col(owner).alias("target_owner"))
    return children.join(known, reference).where(F.col(owner) != F.col("target_owner"))


def array_references(rows: DataFrame, key: str, array: str, targets: DataFrame, target_key: str, owner: str | None = None) -> DataFrame:
    """(key, reference): elements of the array that no target has (of the same owner, if given)."""
    on = ["reference", *([owner] if owner else [])]
    long = rows.select(key, *([owner] if owner and owner != key else []), F.explode(array).alias("reference"))
    return long.join(targets.select(F.col(target_key).alias("reference"), *([owner] if owner else [])), on, "left_anti").select(key, "reference")


def scoped_references(rows: DataFrame, scope: str, targets: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows whose scope decides which reference must resolve: scope -> (column, table, key)."""
    return reduce(DataFrame.unionByName, [
        rows.where(F.col(scope) == name).join(known.select(F.col(key).alias(column)).where(F.col(column).isNotNull()), column, "left_anti").select(*rows.columns)
        for name, (column, known, key) in targets.items()])


def missing_evidence(rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    return rows.join(evidence.select(key), key, "left_anti")


def priority_match(rows: DataFrame, key: str, choices: list[tuple[DataFrame, str]], ordinal: str, value: str) -> DataFrame:
    """(key, value): the match of the first choice that has one, the first in its order. choices:
    (table with the row's columns to join on, join column)."""
    found = [rows.join(table.select(F.col(column), ordinal, value), column).select(key, F.struct(F.lit(i).alias("p"), F.col(ordinal)).alias("rank"), value)
             for i, (table, column) in enumerate(choices)]
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min_by(value, "rank").alias(value))


def dual_subject(variants: DataFrame, annotations: DataFrame, first: str, second: str, subject: str) -> DataFrame:
    """Annotations of a variant by either of its ids: two equi-joins, one row for each pair."""
    return reduce(DataFrame.unionByName, [variants.join(annotations.withColumnRenamed(subject, k), k).select(*variants.columns, *(c for c in annotations.columns if c != subject)) for k in (first, second)]).distinct()


def exactly_one(rows: DataFrame, group: str, flag: Column, value: str, declared: DataFrame | None = None, declared_column: str | None = None) -> DataFrame:
    """(group, n, value): groups without exactly one flagged row, or whose flagged row is not the
    declared one."""
    found = rows.groupBy(group).agg(F.count_if(flag).alias("n"), F.max(F.when(flag, F.col(value))).alias(value))
    wrong = F.col("n") != 1
    if declared is not None:
        found = found.join(declared.select(group, F.col(declared_column).alias("declared")), group, "left")
        wrong = wrong | ~F.col(value).eqNullSafe(F.col("declared"))
    return found.where(wrong).select(group, "n", value)


def member_mismatch(parents: DataFrame, children: DataFrame, key: str, declared: str, member: str) -> DataFrame:
    """(key, member, side): members that are declared but absent, or present but not declared. Both sides are
    dealt once, to as many tasks as their rows ask for, and put together by (key, member): no set is collected.
    A null key or member is on no other side."""
    said = parents.select(key, F.explode(declared).alias(member))
    real = children.select(key, member)
    size = parents.agg(F.sum(F.greatest(F.size(declared), F.lit(0)))).first()[0] or 0
    both = said.withColumn("said_", F.lit(True)).unionByName(real.withColumn("said_", F.lit(False)))
    dealt = both.repartition(task_count(size + children.count()), key, member)
    # Of a null pair both sides stay; the others are on one side if all their rows are.
    null = F.col(key).isNull() | F.col(member).isNull()
    sides = dealt.groupBy(key, member).agg(F.bool_or("said_").alias("any_"), F.bool_and("said_").alias("all_"))
    one = sides.where((F.col("any_") == F.col("all_")) | null)
    side = F.when(F.col("any_") == F.col("all_"), F.array(F.when(F.col("any_"), "declared").otherwise("actual"))).otherwise(F.array(F.lit("declared"), F.lit("actual")))
    return one.select(key, member, F.explode(side).alias("side"))


def domain_violations(rows: DataFrame, key: str, entity: str, properties: str, entities: DataFrame, domain: str) -> DataFrame:
    """Rows whose properties have other names than their entity's, or values that it does not list."""
    joined = rows.join(entities.select(entity, F.col(domain).alias("domain_")), entity)
    names = F.array_sort(F.map_keys(properties)) == F.array_sort(F.map_keys("domain_"))
    values = F.forall(F.map_entries(properties), lambda e: F.array_contains(F.element_at("domain_", e["key"]), e["value"]))
    return joined.where(~F.coalesce(names & values, F.lit(False))).select(key, entity)


def union_fields(rows: DataFrame, tag: str, fields: dict[str, list[str]]) -> DataFrame:
    """Rows of a tagged union that carry fields of another tag, or an unknown tag."""
    every = sorted({f for names in fields.values() for f in names})
    legal = F.lit(False)
    for name, own in fields.items():
        alien = [F.col(f).isNull() for f in every if f not in own]
        legal = legal | ((F.col(tag) == name) & reduce(lambda a, b: a & b, alien, F.lit(True)))
    return rows.where(~F.coalesce(legal, F.lit(False)))


def full_comparison(declared: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): missing, extra or mismatch. A null value is a value: equal to null alone."""
    said, real = (t.select(key, F.struct(value).alias(n)) for t, n in ((declared, "said"), (actual, "real")))
    joined = said.join(real, key, "full_outer")
    status = F.when(F.col("real").isNull(), "missing").when(F.col("said").isNull(), "extra").when(~F.col(f"said.{value}").eqNullSafe(F.col(f"real.{value}")), "mismatch")
    return joined.select(key, status.alias("status")).where("status is not null")


def set_difference(a: DataFrame, b: DataFrame, key: str, excluded: list | None = None) -> DataFrame:
    """(key, side): keys of one side only."""
    x, y = (t.select(key).distinct() for t in (a, b))
    out = x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))
    return out.where(~F.col(key).isin(excluded)) if excluded else out


def row_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (with repeats) of one side only; map columns are compared as sorted entries."""
    plain = lambda t: t.select(*(F.array_sort(F.map_entries(c)).alias(c) if kind.startswith("map") else F.col(c) for c, kind in t.dtypes))
    a, b = plain(expected), plain(actual).select(*expected.columns)
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("actual")))


def unsorted_lines(lines: DataFrame, by: str, number: str, value: str) -> DataFrame:
    """Lines that are below the line before them in byte order."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(number))
    return lines.withColumn("before_", before).where(F.col(value) < F.col("before_")).drop("before_")


#: Bytes of joined keys that one row of an ordered hash holds.
PIECE_BYTES = 1 << 16


def ordered_hash(rows: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 of the byte-sorted keys (null: none) joined by line feeds, of a table of any size.

    Keys are put in order over ranges and joined to pieces of text there; the pieces stream through one hash.
    SHA-256 is sequential, so the bytes pass through one task, but a piece at a time. Large tables that need no
    fixed hash take table_fingerprint, which is spread over tasks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0
        for batch in batches:
            done = []
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(text)
                size += len(text) + 1
                if size >= PIECE_BYTES:
                    done.append((part, number, "\n".join(held)))
                    number, held, size = number + 1, [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["part", "number", "text"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (part, number, "\n".join(held))], ["part", "number", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, between = hashlib.sha256(), b""
        for batch in batches:
            for text in batch.column(2).to_pylist():
                state.update(between + text.encode())
                between = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["set_hash"])

    keys = rows.select(F.col(key).cast("string").alias("k")).where("k is not null")
    dealt = keys.repartitionByRange("k").sortWithinPartitions("k").select(F.spark_partition_id().alias("part"), "k")
    pieces = dealt.mapInArrow(join, "part long, number long, text string")
    one = pieces.repartition(1).sortWithinPartitions("part", "number").mapInArrow(digest, "set_hash string")
    return one.agg(F.coalesce(F.max("set_hash"), F.sha2(F.lit(""), 256)).alias("set_hash"))


def table_fingerprint(rows: DataFrame, rows_per_bucket: int = 65_536) -> DataFrame:
    """(n, fingerprint): independent of row order. Row hashes are dealt to 256 buckets by their first two digits,
    put in order there and streamed through a hash for each bucket: a line ``hash:count`` for each different row.
    The buckets' hashes are hashed to one. The same rule holds for tables of any size: ``rows_per_bucket`` only
    says how many tasks share the buckets. A task sorts (and spills) hashes, it collects none."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, state, n, last, count, held = None, None, 0, None, 0, []
        for batch in chain(batches, [None]):  # None: the end
            done = []
            runs = pc.run_end_encode(batch.column(0)) if batch is not None and len(batch) else None
            ends = runs.run_ends.to_pylist() if runs is not None else []
            for h, repeats in zip(runs.values.to_pylist() if runs is not None else [], (b - a for a, b in zip([0, *ends], ends)), strict=False):
                if h == last:  # a run goes on in the next batch
                    count += repeats
                    continue
                if last is not None:
                    held.append(f"{last}:{count}")
                    n += count
                if h[:2] != bucket:
                    if bucket is not None:
                        state.update("".join(held).encode())
                        done.append((bucket, n, state.hexdigest()))
                    bucket, state, n, held = h[:2], hashlib.sha256(), 0, []
                last, count = h, repeats
            if batch is None and last is not None:
                state.update(("".join(held) + f"{last}:{count}").encode())
                done.append((bucket, n + count, state.hexdigest()))
            elif held:
                state.update("".join(held).encode())
                held = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["b", "n", "h"])

    named = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    tasks = min(256, 1 + rows.count() // rows_per_bucket)
    hashed = rows.select(F.unhex(F.sha2(named, 256)).alias("h"))
    dealt = hashed.repartition(tasks, F.substring("h", 1, 1)).sortWithinPartitions("h").select(F.lower(F.hex("h")).alias("h"))
    buckets = dealt.mapInArrow(digest, "b string, n long, h string")
    line = F.concat_ws(":", "b", "h")
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("fingerprint"))


def duplicate_content(rows: DataFrame, key: str, *content: str) -> DataFrame:
    """(content_hash, n, first): groups of equal content."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content)), 256)
    return rows.select(h.alias("content_hash"), key).groupBy("content_hash").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def manifest_counts(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: how many rows satisfy each test."""
    return rows.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))


def set_equality(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (equal): both sides have the same keys."""
    return set_difference(a, b, key).agg((F.count("*") == 0).alias("equal"))
