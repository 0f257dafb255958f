"""Type, length, enum and range tests of JSON records, as rows of violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a JSON path must hold. Keywords are tested in this order; the first broken one is reported."""

    path: str
    types: tuple[str, ...] = ()
    required: bool = False
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None


def observed_type(node: Column) -> Column:
    """missing, null, boolean, number, string, array or object of a variant."""
    name = F.schema_of_variant(node)
    return (F.when(node.isNull(), "missing").when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "array")
            .when(name.startswith("OBJECT"), "object").when(name == "STRING", "string").otherwise("number"))


def _test(record: Column, rule: Rule) -> Column:
    """Struct (path, keyword, observed_type, observed_length), null if the rule holds."""
    node = F.try_variant_get(record, rule.path, "variant")
    kind, text, number = observed_type(node), F.try_variant_get(record, rule.path, "string"), F.try_variant_get(record, rule.path, "double")
    length = F.when(kind == "string", F.length(text)).when(kind == "array", F.size(F.try_variant_get(record, rule.path, "array<variant>"))).when(kind == "object", F.size(F.try_variant_get(record, rule.path, "map<string,variant>")))
    there = kind != "missing"
    broken = F.when(~there & F.lit(rule.required), "required")
    if rule.types:
        broken = broken.when(there & ~kind.isin(*rule.types), "type")
    if rule.enum:
        broken = broken.when(there & ~F.coalesce(text.isin(*rule.enum), F.lit(False)), "enum")
    if rule.pattern:
        broken = broken.when((kind == "string") & ~text.rlike(rule.pattern), "pattern")
    if rule.min_length is not None:
        broken = broken.when(length < rule.min_length, "minLength")
    if rule.max_length is not None:
        broken = broken.when(length > rule.max_length, "maxLength")
    if rule.minimum is not None:
        broken = broken.when((kind == "number") & (number < rule.minimum), "minimum")
    if rule.maximum is not None:
        broken = broken.when((kind == "number") & (number > rule.maximum), "maximum")
    return F.when(broken.isNotNull(), F.struct(F.lit(rule.path).alias("path"), broken.alias("keyword"), kind.alias("observed_type"), length.cast("long").alias("observed_length")))


def violations(rows: DataFrame, key: str, record: str, rules: list[Rule], most: int = 8) -> DataFrame:
    """(code, subject, path, keyword, observed_type, observed_length): the first ``most`` violations of
    each record (JSON text) in path order; a record with more also has a row with the code
    SCHEMA_VALIDATION_TRUNCATED. Text that is no JSON object breaks the type of the path ``$``."""
    parsed = rows.select(F.col(key).cast("string").alias("subject"), F.try_parse_json(record).alias("r_"))
    root = observed_type(F.col("r_"))
    no_object = F.struct(F.lit("$").alias("path"), F.lit("type").alias("keyword"), root.alias("observed_type"), F.lit(None).cast("long").alias("observed_length"))
    found = F.when(root == "object", F.array_sort(F.array_compact(F.array(*(_test(F.col("r_"), rule) for rule in rules))))).otherwise(F.array(no_object))
    each = F.transform(F.slice("found_", 1, most), lambda v: F.struct(F.lit("SCHEMA_VALIDATION_FAILED").alias("code"), v["path"].alias("path"), v["keyword"].alias("keyword"), v["observed_type"].alias("observed_type"), v["observed_length"].alias("observed_length")))
    more = F.array(F.struct(F.lit("SCHEMA_VALIDATION_TRUNCATED").alias("code"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("observed_type"), F.lit(None).cast("long").alias("observed_length")))
    rows_ = F.when(F.size("found_") > most, F.concat(each, more)).otherwise(each)
    return parsed.select("subject", found.alias("found_")).select("subject", F.explode(rows_).alias("v")).select(F.col("v.code").alias("code"), "subject", "v.path", "v.keyword", "v.observed_type", "v.observed_length")
