"""Order-dependent replay of list and scalar changes, in relational form.

Operations are rows (subject, field, seq, op, values, scalar): op is ``add``, ``remove`` or ``set``;
seq orders the operations of a subject and field. For a field, let s be the sequence of its last
``set`` (before everything if there is none, the base being the value set). An element stays if its
last addition after s, or s itself if it is in the value set, comes after its last removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nested import MACHINE_FIELDS, forbidden_keys

KEYS = ["subject", "field"]


def replay_lists(operations: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(subject, field, values): sorted distinct elements; fields with operations but nothing left
    have an empty list. base: (subject, field, values)."""
    last_set = operations.where("op = 'set'").groupBy(*KEYS).agg(F.max("seq").alias("set_seq"))
    long = operations.join(last_set, KEYS, "left").withColumn("set_seq", F.coalesce("set_seq", F.lit(-1)))
    elements = long.select(*KEYS, "seq", "op", "set_seq", F.explode("values").alias("e"))
    if base is not None:
        start = base.join(last_set, KEYS, "left").where("set_seq is null")
        elements = elements.unionByName(start.select(*KEYS, F.lit(-1).cast("long").alias("seq"), F.lit("set").alias("op"), F.lit(-1).cast("long").alias("set_seq"), F.explode("values").alias("e")))
    adds = (F.col("op") == "add") & (F.col("seq") > F.col("set_seq")) | (F.col("op") == "set") & (F.col("seq") == F.col("set_seq"))
    kept = (elements.groupBy(*KEYS, "e").agg(F.max(F.when(adds, F.col("seq"))).alias("added"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("removed"))
            .where("added is not null and added > coalesce(removed, -2)"))
    lists = kept.groupBy(*KEYS).agg(F.array_sort(F.collect_list("e")).alias("values"))
    fields = operations.select(*KEYS).distinct()
    if base is not None:
        fields = fields.unionByName(base.select(*KEYS)).distinct()
    return fields.join(lists, KEYS, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def replay_scalars(operations: DataFrame) -> DataFrame:
    """(subject, field, scalar): the last one set."""
    return operations.where("op = 'set' and scalar is not null").groupBy(*KEYS).agg(F.max_by("scalar", "seq").alias("scalar"))


def label_union(annotations: DataFrame, subject: str, *fields: str) -> DataFrame:
    """Each subject's lists united over its annotations: distinct, in byte order."""
    return annotations.groupBy(subject).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f)))).alias(f) for f in fields))


def human_complete(replayed: DataFrame, scalars: DataFrame, lists: list[str], texts: list[str], number: str) -> DataFrame:
    """(subject, complete): all lists present, all texts not blank, the number within 0..1."""
    have = replayed.where(F.col("field").isin(lists)).groupBy("subject").agg(F.count_distinct("field").alias("n"))
    good = (F.col("field").isin(texts) & (F.trim("scalar") != "")) | ((F.col("field") == number) & F.col("scalar").cast("double").between(0, 1))
    said = scalars.where(good).groupBy("subject").agg(F.count_distinct("field").alias("m"))
    subjects = replayed.select("subject").union(scalars.select("subject")).distinct()
    return subjects.join(have, "subject", "left").join(said, "subject", "left").select(
        "subject", ((F.coalesce("n", F.lit(0)) == len(lists)) & (F.coalesce("m", F.lit(0)) == len(texts) + 1)).alias("complete"))


def valid_overrides(records: DataFrame, schema: str, raw: str = "record_json", target: str = "target_id") -> DataFrame:
    """Parsed override records whose scope names the row's own target."""
    parsed = records.withColumn("record", F.from_json(raw, schema))
    return parsed.where((F.col("record").isNotNull()) & (F.col("record.scope.variant_id") == F.col(target)))


def forbidden_fields(records: DataFrame, raw: str = "record_json", key: str = "override_id", forbidden: list[str] = MACHINE_FIELDS) -> DataFrame:
    """(key, field): keys of override records (JSON) that name fields which only machines write, at any depth, as
    they stand or behind ``set_``, ``add_`` and ``remove_``."""
    return records.select(key, F.explode(forbidden_keys(F.col(raw), forbidden)).alias("field"))
