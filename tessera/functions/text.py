"""Text, hash and JSON expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize_text(text: Column) -> Column:
    """Lower case, white-space runs to one space, trimmed. Exact for ASCII; see normalize_unicode."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


@F.pandas_udf(StringType())
def normalize_unicode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, full case folding, white-space runs to one space."""
    for series in texts:
        yield series.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")


@F.pandas_udf(StringType())
def fold_case(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Full case folding and white-space runs to one space, without NFKC (query side)."""
    for series in texts:
        yield series.map(lambda t: " ".join(t.casefold().split()), na_action="ignore")


def canonical_key(entity: Column, properties: Column) -> Column:
    """``id[k1=v1,k2=v2]`` with sorted keys; the bare id without properties."""
    pairs = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(properties), F.lit(0)) <= 0, entity).otherwise(F.concat(entity, F.lit("["), F.array_join(pairs, ","), F.lit("]")))


def search_document(*fields: Column) -> Column:
    """Distinct non-empty terms of array fields, in byte order, joined by spaces."""
    terms = F.filter(F.flatten(F.array(*(F.coalesce(f, F.array().cast("array<string>")) for f in fields))), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.array_join(F.array_sort(F.array_distinct(terms)), " ")


def folded_members(represented: Column, canonical: Column) -> Column:
    """Represented ids without the canonical one, sorted."""
    return F.array_sort(F.array_except(represented, F.array(canonical)))


def substring_score(query: Column, content: Column) -> Column:
    """1 if equal; 0.5 + half the share of the query if contained; else 0."""
    part = F.bround(0.5 + F.length(query) / F.greatest(F.length(content), F.lit(1)) / 2, 8)
    return F.when(content == query, 1.0).when(content.contains(query), part).otherwise(0.0)


def contains_any(texts: Column, terms: Column) -> Column:
    """1 if any term is a substring of the joined normalised texts; 0 for no terms."""
    haystack = F.array_join(F.transform(texts, lambda t: normalize_text(F.coalesce(t, F.lit("")))), " ")
    return F.when(F.exists(terms, lambda t: haystack.contains(normalize_text(t))), 1.0).otherwise(0.0)


def like_wildcards(content: Column, query: Column) -> Column:
    """SQL LIKE with the query's own ``%`` and ``_`` as wildcards, case-insensitive for ASCII."""
    escaped = F.regexp_replace(F.lower(query), r"\\", r"\\\\")
    return F.like(F.lower(content), F.concat(F.lit("%"), escaped, F.lit("%")))


def hash_text(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def framed_hash(*parts: Column) -> Column:
    """SHA-256 over parts with their 8-byte big-endian lengths before them."""
    framed = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary"))]
    return F.sha2(F.concat(*framed), 256)


def zero_framed_hash(*parts: Column) -> Column:
    """SHA-256 over parts that each end in a zero byte."""
    return F.sha2(F.concat(*(x for p in parts for x in (p.cast("binary"), F.unhex(F.lit("00"))))), 256)


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 32 hexadecimal digits that depend on the parts alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32))


def canonical_json(*columns: str | Column, names: list[str] | None = None) -> Column:
    """JSON of columns in alphabetical order of their names, nulls kept."""
    named = dict(zip(names or [c for c in columns if isinstance(c, str)], columns, strict=True))
    fields = [(F.col(named[n]) if isinstance(named[n], str) else named[n]).alias(n) for n in sorted(named)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def safe_path(path: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` parts, backslash, NUL or drive."""
    bad_part = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return path.isNotNull() & ~path.rlike(r"[\\\x00]|^/|^[A-Za-z]:") & ~bad_part


# What counts as sensitive in a text.
SENSITIVE = r"(?i:api[_-]?key|authorization|bearer\s|secret|password|token\s*=|usage\s*=|cost\s*=|budget\s*=)|^[A-Za-z]:[\\/]|^/|\\\\"


def sensitive(text: Column) -> Column:
    return F.coalesce(text.rlike(SENSITIVE), F.lit(False))


def redact(text: Column, limit: int = 512) -> Column:
    """Null if sensitive, else cut to ``limit`` characters."""
    return F.when(~sensitive(text), F.substring(text, 1, limit))


def redact_list(values: Column, limit: int = 64, text_limit: int = 512) -> Column:
    return F.transform(F.slice(F.filter(values, lambda v: ~sensitive(v)), 1, limit), lambda v: F.substring(v, 1, text_limit))


# Keys of identifiers; they come first and their texts are not cut.
IDENTITY = ["tile_id", "variant_id", "block_id", "canonical_state_id"]


@F.pandas_udf(StringType())
def canonical_json_text(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Free-form JSON with keys in order and no white space; bad JSON: null."""
    import json

    def one(text):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    for series in documents:
        yield series.map(one, na_action="ignore")


def snapshot_hash(path: Column, content: Column) -> Column:
    """Aggregate: SHA-256 over the files of a group in byte order of their paths, each as path, a zero
    byte, the content's length in 8 bytes, and the content. A group is one package's files and is
    put together in one task; larger sets take integrity.table_fingerprint."""
    raw = F.coalesce(content.cast("binary"), F.lit(b""))
    framed = F.concat(F.hex(path.cast("binary")), F.lit("00"), F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0"), F.hex(raw))
    ordered = F.array_sort(F.collect_list(F.struct(path.cast("binary").alias("p"), framed.alias("h"))))
    return hash_text(F.unhex(F.array_join(F.transform(ordered, lambda e: e["h"]), "")))


# Shapes of identifiers and times.
PATTERNS = {
    "export_id": r"^export_[0-9]{8}T[0-9]{6}Z(?:_(?:0[1-9]|[1-9][0-9]))?$",
    "hash": r"^sha256:[0-9a-f]{64}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z$",
    "entity_id": r"^[a-z0-9_.-]+:[a-z0-9_./-]+$",
}


def has_shape(value: Column, shape: str) -> Column:
    """Whether the text has the named shape of PATTERNS; false for null."""
    return F.coalesce(value.rlike(PATTERNS[shape]), F.lit(False))


def parse_time(value: Column) -> Column:
    """Timestamp of an ISO text, null if it is none."""
    return F.try_to_timestamp(value)
