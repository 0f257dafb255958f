"""Free-form JSON on the JVM: screens, bounded copies and rewriting at any depth.

Values of bounded depth are walked as VARIANT by nested array functions. Screens at any depth use the
compact text of the parsed value: there each string literal is followed by a colon exactly if it is a
key, and a quote inside a literal is always escaped, so one pattern cuts the text into its literals.
Nothing is exploded or shuffled; each document is one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import IDENTITY, sensitive

# Parts of keys whose values never leave; keys end with one of the last two.
SENSITIVE_KEYS = ["api_key", "authorization", "bearer", "credential", "directory", "file_path", "filepath", "filename", "password", "private_key", "secret", "token", "url"]
SENSITIVE_ENDS = ["_path", "_ref"]

# Fields that only machines write, and prefixes of operations on fields.
MACHINE_FIELDS = [
    "block_id", "variant_id", "state_id", "legal_state", "default_state_id", "geometry", "shape", "collision", "machine_facts", "behavior", "behaviors",
    "transparent", "emissive", "support", "waterloggable", "redstone_related", "image", "image_path", "image_sha256", "minecraft_version", "publish_status", "release_status",
]
OPERATION_PREFIXES = ["set_", "add_", "remove_"]

# Limits of a bounded copy.
TEXT_LIMIT, LIST_LIMIT, MAP_LIMIT, DEPTH_LIMIT, KEY_LIMIT = 512, 64, 64, 4, 128

#: A string literal of compact JSON, with the colon that makes it a key.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+":?'
_SCALAR = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,{}\[\]"]++)'


def sensitive_key(key: Column) -> Column:
    """Whether a key names a secret or a place: one of SENSITIVE_KEYS, alone or before ``_``, or an end of
    SENSITIVE_ENDS; case and ``-`` for ``_`` do not matter."""
    plain = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return plain.rlike(f"^(?:{'|'.join(SENSITIVE_KEYS)})(?:_|$)|(?:{'|'.join(SENSITIVE_ENDS)})$")


def redact_map(values: Column) -> Column:
    """Entries of a map of texts without sensitive keys and values, identifiers first, then in key order, at
    most MAP_LIMIT; texts are cut to TEXT_LIMIT, those of identifiers not."""
    kept = F.filter(F.map_entries(values), lambda e: ~sensitive_key(e["key"]) & ~sensitive(e["value"]))
    ranked = F.array_sort(F.transform(kept, lambda e: F.struct((~e["key"].isin(IDENTITY)).alias("rank"), e["key"].alias("key"), e["value"].alias("value"))))
    cut = F.transform(F.slice(ranked, 1, MAP_LIMIT), lambda e: F.struct(e["key"].alias("key"), F.when(e["rank"], F.substring(e["value"], 1, TEXT_LIMIT)).otherwise(e["value"]).alias("value")))
    return F.map_from_entries(cut)


def _literals(json: Column) -> Column:
    return F.regexp_extract_all(F.to_json(F.try_parse_json(json)), F.lit(_LITERAL), 0)


def _decoded(literal: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(literal), "$", "string")


def json_strings(json: Column) -> Column:
    """All string values of a JSON text, at any depth and in order; null if it is no JSON."""
    return F.transform(F.filter(_literals(json), lambda t: ~t.endswith(":")), _decoded)


def json_keys(json: Column) -> Column:
    """All keys of a JSON text, at any depth and in order; null if it is no JSON."""
    return F.transform(F.filter(_literals(json), lambda t: t.endswith(":")), lambda t: _decoded(F.rtrim(t, F.lit(":"))))


def sensitive_json(json: Column) -> Column:
    """Whether any string value is sensitive; what is no JSON counts as one string; null: false."""
    return F.coalesce(F.exists(json_strings(json), sensitive), sensitive(json))


def forbidden_keys(json: Column, forbidden: list[str] = MACHINE_FIELDS) -> Column:
    """The distinct forbidden fields that keys name, at any depth, as they stand or behind the prefixes of
    operations; no JSON: null."""
    plain = lambda k: F.regexp_replace(k, "^" + "".join(f"(?:{p})?" for p in OPERATION_PREFIXES), "")
    named = F.transform(json_keys(json), lambda k: F.when(k.isin(forbidden), k).otherwise(plain(k)))
    return F.array_distinct(F.filter(named, lambda k: k.isin(forbidden)))


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _bounded(value: Column, key: Column | None, depth: int) -> Column:
    """JSON of a bounded VARIANT; null if it may not stay."""
    text = F.try_variant_get(value, "$", "string")
    cut = F.substring(text, 1, TEXT_LIMIT)
    string = F.when(~sensitive(text), _quoted(cut if key is None else F.when(key.isin(IDENTITY), text).otherwise(cut)))
    other = F.coalesce(F.to_json(value), F.lit("null"))
    scalar = F.when(F.schema_of_variant(value) == "STRING", string).otherwise(F.when(other.rlike("Infinity|NaN"), "null").otherwise(other))
    entries, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    if depth == DEPTH_LIMIT:
        return F.when(entries.isNull() & items.isNull(), scalar)

    def pair(entry: Column) -> Column:
        name = F.substring(entry["key"], 1, KEY_LIMIT)
        return F.struct((~name.isin(IDENTITY)).alias("rank"), name.alias("key"), F.when(~sensitive_key(name), _bounded(entry["value"], name, depth + 1)).alias("json"))

    pairs = F.array_sort(F.filter(F.transform(F.map_entries(entries), pair), lambda p: p["json"].isNotNull()))
    mapping = F.array_join(F.transform(F.slice(pairs, 1, MAP_LIMIT), lambda p: F.concat(_quoted(p["key"]), F.lit(":"), p["json"])), ",")
    listed = F.filter(F.transform(F.slice(items, 1, LIST_LIMIT), lambda i: _bounded(i, None, depth + 1)), lambda j: j.isNotNull())
    return (F.when(entries.isNotNull(), F.concat(F.lit("{"), mapping, F.lit("}")))
            .when(items.isNotNull(), F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).otherwise(scalar))


def redact_json(json: Column) -> Column:
    """Bounded copy of free-form JSON: strings to TEXT_LIMIT (those of identifiers whole), lists to their first
    LIST_LIMIT items, maps to MAP_LIMIT entries, identifiers first and then by key; what lies deeper than
    DEPTH_LIMIT, sensitive keys and sensitive strings are left out. Null for what is no JSON (also for
    keys that repeat), or a sensitive string."""
    value = F.try_parse_json(json)
    return F.when(value.isNotNull(), _bounded(value, None, 0))


def rewrite_json(json: Column, values: dict[str, Column]) -> Column:
    """The compact JSON with new texts for the scalar values of the named keys, at any depth; keys whose new text
    is null stay as they are. No JSON: null."""
    out = F.to_json(F.try_parse_json(json))
    for name, value in values.items():
        fresh = F.regexp_replace(F.concat(F.lit(f'"{name}":'), _quoted(value)), r"([\\$])", r"\\$1")
        out = F.coalesce(F.regexp_replace(out, F.lit(f'"{name}":{_SCALAR}'), fresh), out)
    return out
