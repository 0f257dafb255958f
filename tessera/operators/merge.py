"""Keyed merges with several guarded actions, and snapshots of several tables that change at once.

A merge joins a table and its changes by key once. For each key the first clause that fits decides:
``update`` and ``insert`` take new values, ``delete`` drops the row, ``keep`` leaves it. Changes that no
clause takes are refused and told apart from those that were applied. Tables of one snapshot are written
below a folder of their own; a commit that names it makes all of them visible together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder

MATCHED, NEW, UNCHANGED = "matched", "new", "unchanged"


@dataclass(frozen=True)
class Clause:
    """``on``: MATCHED (the key is in table and changes), NEW (in the changes alone) or UNCHANGED (in the table
    alone). ``guard``: a condition over the structs ``old`` and ``new``; null counts as false. ``values``: what an
    update or insert sets, as expressions over both; columns that are not named come from the change
    where it has them (update, insert), else from the old row."""

    on: str
    action: str
    guard: Column | None = None
    values: dict[str, Column] = field(default_factory=dict)


def merge(table: DataFrame, changes: DataFrame, key: str, clauses: list[Clause]) -> tuple[DataFrame, DataFrame]:
    """The table after the merge, and the outcome (key, action) of every change: ``update``, ``insert``, ``delete``,
    ``keep``, ``refused``, or ``ambiguous`` for all changes of a key that has more than one (none is applied).

    Rows of the table that no clause speaks of stay. Keys of the table are unique; rows with a null key match nothing: those
    of the table stay, those of the changes are refused.
    """
    spark = table.sparkSession
    counted = changes.groupBy(key).agg(F.count("*").alias("times"), F.any_value(F.struct(*changes.columns)).alias("new"))
    old = table.select(F.col(key).alias("key_"), F.struct(*table.columns).alias("old"))
    # eqNullSafe would match two null keys.
    joined = old.join(counted.withColumnRenamed(key, "new_key_"), F.col("key_") == F.col("new_key_"), "full_outer")
    place = F.when(F.col("old").isNull(), NEW).when(F.col("new").isNull(), UNCHANGED).otherwise(MATCHED)
    fits = [(F.col("on_") == c.on) & (F.coalesce(c.guard, F.lit(False)) if c.guard is not None else F.lit(True)) for c in clauses]
    which = reduce(lambda rest, one: F.when(one[1], one[0]).otherwise(rest), reversed(list(enumerate(fits))), F.lit(-1))
    which = F.when((F.col("times") > 1) | ((F.col("on_") == NEW) & F.col("new_key_").isNull()), -1).otherwise(which)

    def value(name: str) -> Column:
        before = F.col(f"old.{name}")
        out = before
        for i, c in reversed(list(enumerate(clauses))):
            if c.action in ("update", "insert"):
                own = c.values[name] if name in c.values else F.col(f"new.{name}") if name in changes.columns else before
                out = F.when(F.col("which_") == i, own.cast(table.schema[name].dataType)).otherwise(out)
        return out.alias(name)

    action = reduce(lambda rest, one: F.when(F.col("which_") == one[0], one[1].action).otherwise(rest), enumerate(clauses),
                    F.when((F.col("times") > 1) & F.col("new_key_").isNotNull(), "ambiguous").when(F.col("on_") == UNCHANGED, "keep").otherwise("refused"))
    decided = joined.withColumn("on_", place).withColumn("which_", which)
    path = shared_folder(spark, "merge")
    decided.select("on_", "times", "new_key_", action.alias("action_"), F.struct(*(value(c) for c in table.columns)).alias("row_")).write.parquet(path)
    stored = spark.read.parquet(path)
    stays = ((F.col("on_") != NEW) & (F.col("action_") != "delete")) | (F.col("action_") == "insert")
    result = stored.where(stays).select("row_.*")
    outcome = stored.where(F.col("on_") != UNCHANGED).select(F.col("new_key_").alias(key), F.col("action_").alias("action"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n_")).drop("n_")
    return result, outcome


def upsert_clauses(replace: bool = True) -> list[Clause]:
    """Insert or replace, or insert or ignore."""
    return [Clause(MATCHED, "update" if replace else "keep"), Clause(NEW, "insert")]


_COMMIT = "version long, folder string, tables array<string>"


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_snapshot(spark: SparkSession, path: str) -> tuple[int, dict[str, DataFrame]]:
    """The newest version and its tables; -1 and none where nothing was committed."""
    commits = _commits(spark, path)
    last = None if commits is None else commits.orderBy(F.desc("version")).first()
    if last is None:
        return -1, {}
    return last["version"], {t: spark.read.parquet(f"{path}/{last['folder']}/{t}") for t in last["tables"]}


def commit_snapshot(tables: dict[str, DataFrame], path: str, before: int) -> int:
    """Write all tables and make them version ``before + 1`` together; an error, and no change, if that version is there
    already: someone else changed the snapshot that was read."""
    spark, folder, version = next(iter(tables.values())).sparkSession, f"data/{uuid.uuid4().hex}", before + 1
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{folder}/{name}")
    spark.createDataFrame([(version, folder, list(tables))], _COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/version={version}")
    return version


def refresh_targets(old: dict[str, DataFrame], new: dict[str, DataFrame], targets: DataFrame, resolved: DataFrame, lineage: list[str]) -> dict[str, DataFrame]:
    """Tables ``blocks``, ``states``, ``variants`` and ``failures`` after an export of some blocks (targets: block_id)
    was carried into a run. Doing it again changes nothing.

    Blocks and states take the new record. ``resolved`` failures (failure_id) go, whatever the new export says of
    them; its other failures are inserted or replace what stands under their id. A state of a resolved
    failure that has no new record names none. Variants of the targets come from the new export; the
    others keep their record and take its lineage columns. Keys: block_id, state_id, variant_id, failure_id;
    states have failure_id, variants have block_id.
    """
    gone = resolved.select("failure_id", F.lit(True).alias("resolved")).distinct()
    mark = lambda rows: rows.join(gone, "failure_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    failures, _ = merge(mark(old["failures"]), mark(new["failures"]), "failure_id", [
        Clause(MATCHED, "delete", F.col("new.resolved")), Clause(UNCHANGED, "delete", F.col("old.resolved")), Clause(MATCHED, "update"), Clause(NEW, "keep", F.col("new.resolved")), Clause(NEW, "insert")])
    blocks, _ = merge(old["blocks"], new["blocks"], "block_id", [Clause(MATCHED, "update")])
    marked = mark(old["states"])
    states, _ = merge(marked, new["states"], "state_id", [
        Clause(MATCHED, "update"), Clause(UNCHANGED, "update", F.col("old.resolved"), {c: F.col(f"old.{c}") for c in marked.columns} | {"failure_id": F.lit(None)})])
    aimed = targets.select("block_id", F.lit(True).alias("aimed")).distinct()
    own = new["variants"].join(aimed, "block_id", "left").withColumn("aimed", F.coalesce("aimed", F.lit(False)))
    kept = {c: F.col(f"old.{c}") for c in old["variants"].columns if c not in lineage}
    variants, _ = merge(old["variants"], own, "variant_id", [
        Clause(MATCHED, "update", F.col("new.aimed")), Clause(MATCHED, "update", values=kept), Clause(NEW, "insert", F.col("new.aimed"))])
    plain = lambda rows, name: rows.select(*old[name].columns)
    return {"blocks": blocks, "states": plain(states, "states"), "variants": variants, "failures": plain(failures, "failures")}
