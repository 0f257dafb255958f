"""Counts and views of runs, stages and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def stage_status_counts(rows: DataFrame, stage: str = "stage", status: str = "status") -> DataFrame:
    """(stage, status, n): by both, by status, and in all; one pass over grouping sets."""
    return rows.groupingSets([[F.col(stage), F.col(status)], [F.col(status)], []], F.col(stage), F.col(status)).agg(F.count("*").alias("n"))


def stage_progress(jobs: DataFrame, stage: str = "stage", status: str = "status", done: tuple[str, ...] = ("succeeded", "skipped")) -> DataFrame:
    """(stage, completed, total, percent), and a row with null stage for all; whole percents."""
    counts = jobs.groupingSets([[F.col(stage)], []], F.col(stage)).agg(F.count_if(F.col(status).isin(*done)).alias("completed"), F.count("*").alias("total"))
    return counts.withColumn("percent", F.when(F.col("total") > 0, F.bround(100.0 * F.col("completed") / F.col("total"), 0)).otherwise(0.0))


def run_progress(stages: DataFrame, key: str = "run_id", order: str = "position", status: str = "status", first: int = 6) -> DataFrame:
    """(key, completed_stages, total_stages, percent, first_completed, first_total, first_percent): a run's
    succeeded stages, of all and of its first ones (by position from 1); whole percents."""
    done, early = F.col(status) == "succeeded", F.col(order) <= first
    counts = stages.groupBy(key).agg(F.count_if(done).alias("completed_stages"), F.count("*").alias("total_stages"), F.count_if(done & early).alias("first_completed"), F.count_if(early).alias("first_total"))
    whole = lambda n, of: F.when(F.col(of) > 0, F.bround(100.0 * F.col(n) / F.col(of), 0).cast("long")).otherwise(0)
    return counts.withColumns({"percent": whole("completed_stages", "total_stages"), "first_percent": whole("first_completed", "first_total")})


def latest_events(events: DataFrame, run: Column, allowed: list[str], limit: int = 8, time: str = "created_at", key: str = "event_id", kind: str = "event_type") -> DataFrame:
    """The newest events of a run; then those of allowed types (the limit comes first)."""
    return events.where(run).orderBy(F.desc(time), F.desc(key)).limit(limit).where(F.col(kind).isin(allowed))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def public_view(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Allowlisted columns; values that do not match their pattern become null."""
    return rows.select(*(F.when(F.col(c).cast("string").rlike(p), F.col(c)).alias(c) for c, p in patterns.items()))


def distinct_entities(rows: DataFrame, column: str, limit: int) -> DataFrame:
    return rows.select(column).distinct().orderBy(column).limit(limit)


def index_counts(blocks: DataFrame, variants: DataFrame, skips: DataFrame) -> DataFrame:
    """(name, n) of entities, variants and audited skips."""
    named = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in (("entities", blocks), ("variants", variants), ("audited_skips", skips))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def index_info(release: DataFrame, blocks: DataFrame, variants: DataFrame, skips: DataFrame) -> DataFrame:
    """One row: the release's identity (version, release_id, ...) with the counts of its index."""
    counts = index_counts(blocks, variants, skips).groupBy().pivot("name", ["entities", "variants", "audited_skips"]).agg(F.first("n"))
    return release.crossJoin(counts)  # a row each


def runs_of_imports(runs: DataFrame, imports: DataFrame) -> DataFrame:
    """Runs with the columns of the import that they work on."""
    return runs.join(imports, "import_id")


def active_with(rows: DataFrame, key: str, others: DataFrame, states: list[str], status: str = "status", excluded: list | None = None) -> DataFrame:
    """Rows whose key has another row in one of the states (EXISTS), keys of a literal list left out (NOT
    IN)."""
    found = rows.join(others.where(F.col(status).isin(states)).select(key).distinct(), key, "left_semi")
    return found.where(~F.col(key).isin(excluded)) if excluded else found


def lookup(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """Rows with ``value`` of the one row of ``table`` with their key, null if there is none (scalar
    subquery); several rows for a key are an error."""
    one = table.groupBy(key).agg(F.count("*").alias("n_"), F.first(value).alias(value))
    one = one.where(F.when(F.col("n_") > 1, F.raise_error(F.lit("more than one row for a key"))).otherwise(F.lit(True))).drop("n_")
    return rows.join(one, key, "left")
