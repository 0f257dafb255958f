"""Comparison and merging of table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_fields(rows: DataFrame, volatile: list[str]) -> DataFrame:
    """``rows`` without the named fields at any depth: columns, fields of structs, and structs in
    arrays."""

    def stripped(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [stripped(value[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in volatile]
            return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(value, lambda v: stripped(v, kind.elementType))
        return value

    return rows.select(*(stripped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in volatile))


def content_hash(columns: list[str], volatile: list[str] = ()) -> Column:
    """Hash of the columns that are not volatile, in alphabetical order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns) if c not in volatile)), {"ignoreNullFields": "false"}), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, volatile: list[str] = (), allowed: DataFrame | None = None) -> DataFrame:
    """(key, change, allowed): added, removed and changed rows; with a table of allowed keys, whether
    each is among them."""
    a, b = (t.select(key, content_hash([c for c in t.columns if c != key], volatile).alias(n)) for t, n in ((old, "old_"), (new, "new_")))
    change = F.when(F.col("old_").isNull(), "added").when(F.col("new_").isNull(), "removed").when(F.col("old_") != F.col("new_"), "changed")
    out = a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")
    if allowed is None:
        return out.withColumn("allowed", F.lit(False))
    return out.join(allowed.select(key, F.lit(True).alias("allowed")).distinct(), key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def rebase(rows: DataFrame, source: DataFrame, key: str, lineage: list[str]) -> DataFrame:
    """Rows keep their own columns but take the lineage columns of ``source`` where it has them."""
    fresh = source.select(key, *(F.col(c).alias(f"new_{c}_") for c in lineage))
    out = rows.join(fresh, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"new_{c}_"), F.col(c)) for c in lineage}).drop(*(f"new_{c}_" for c in lineage)).select(*rows.columns)


def targeted_merge(old: DataFrame, new: DataFrame, key: str, targets: DataFrame, lineage: list[str]) -> DataFrame:
    """Target rows come from ``new``, all others from ``old`` with the lineage of ``new``. Merging
    the result again changes nothing."""
    targets = targets.select(key).distinct()
    kept = rebase(old.join(targets, key, "left_anti"), new, key, lineage)
    return kept.unionByName(new.join(targets, key, "left_semi").select(*old.columns))


def transition_violations(old: DataFrame, new: DataFrame, key: str, field: str, before: str, after: str, free: list[str]) -> DataFrame:
    """(key, problem): rows that do not go from one state to the other with only free fields changed:
    missing, state or field."""
    same = content_hash([c for c in old.columns if c != key], [field, *free])
    a, b = (t.select(key, F.col(field).alias(f"{n}state"), same.alias(f"{n}hash")) for t, n in ((old, "old_"), (new, "new_")))
    problem = F.when(F.col("new_hash").isNull(), "missing").when((F.col("old_state") != before) | (F.col("new_state") != after), "state").when(F.col("old_hash") != F.col("new_hash"), "field")
    return a.join(b, key, "left").select(key, problem.alias("problem")).where("problem is not null")


def rewrite_lineage(rows: DataFrame, values: dict[str, Column], columns: list[str] | None = None) -> DataFrame:
    """New values for the fields of these names wherever they stand: as columns, in structs, and in structs
    within arrays and maps, at any depth. ``columns``: those that are searched (all by default). Fields whose
    new value is null stay as they are. nested.rewrite_json does the same to free-form JSON."""

    def rewritten(value: Column, kind: T.DataType, name: str) -> Column | None:
        """None where nothing is to be changed."""
        if name in values:
            return F.coalesce(values[name].cast(kind), value)
        if isinstance(kind, T.StructType):
            new = {f.name: n for f in kind.fields if (n := rewritten(value[f.name], f.dataType, f.name)) is not None}
            if not new:
                return None
            return F.when(value.isNotNull(), F.struct(*(new.get(f.name, value[f.name]).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.ArrayType) and rewritten(F.lit(None), kind.elementType, "") is not None:
            return F.transform(value, lambda item: rewritten(item, kind.elementType, ""))
        if isinstance(kind, T.MapType) and rewritten(F.lit(None), kind.valueType, "") is not None:
            return F.transform_values(value, lambda _, item: rewritten(item, kind.valueType, ""))
        return None

    changed = {f.name: rewritten(F.col(f"`{f.name}`"), f.dataType, f.name) for f in rows.schema.fields if columns is None or f.name in columns}
    return rows.withColumns({n: c for n, c in changed.items() if c is not None})


def equal_candidates(candidates: DataFrame, run: str, fingerprint: str, least: int = 2) -> DataFrame:
    """Built candidates of a run that share their fingerprint with at least ``least`` in all."""
    built = candidates.where("status = 'built'")
    groups = built.groupBy(run, fingerprint).agg(F.count_distinct("candidate_id").alias("n")).where(F.col("n") >= least)
    return built.join(groups.select(run, fingerprint), [run, fingerprint], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """Rows by key: new ones replace old ones, or are ignored where one exists."""
    if replace:
        return old.join(new.select(key), key, "left_anti").unionByName(new)
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))
