"""Line dedup on DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import STRIP_CHARS, materialize, text_or_empty

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOTH = ["ld_key_1_", "ld_key_2_"]
#: A key is hot from this many lines on, and from this part of all lines: so many keys can be.
HOT_LINES, HOT_KEYS = 1000, 1000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIP_CHARS)), _UPPER, _LOWER)


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, id_column: str, text_column: str) -> DataFrame:
    """(ld_id_, ld_text_, ld_dropped_): for each document that loses lines, their positions.

    A line travels as two 64-bit hashes of its key, never as text; lines are taken apart and hashed
    once, into a written table. The count per key is combined before the shuffle, so a line of a third
    of all documents is a few rows there. Hot keys (with a thousandth of all lines or more: a thousand
    at most) are sent to the lines; the others are joined by key.
    """
    lines = docs.select(
        F.col(id_column).alias("ld_id_"), F.xxhash64(text_column).alias("ld_text_"),
        F.posexplode(F.transform(F.split(text_or_empty(text_column), "\n"), line_key)).alias("ld_pos_", "ld_line_"),
    ).where(F.char_length("ld_line_") >= min_chars)
    lines = lines.select("ld_id_", "ld_text_", "ld_pos_", F.xxhash64("ld_line_").alias(_BOTH[0]), F.xxhash64(F.lit(1), "ld_line_").alias(_BOTH[1]))
    lines = materialize(lines)
    hot_lines = max(HOT_LINES, lines.count() // HOT_KEYS)
    keys = lines.groupBy(*_BOTH)
    if min_docs == 2:  # two documents or more: the least id and the greatest differ
        common = keys.agg(F.min("ld_id_").alias("ld_first_"), F.max("ld_id_").alias("ld_last_"), F.count("*").alias("ld_n_")).where("ld_first_ < ld_last_")
    else:
        common = keys.agg(F.min("ld_id_").alias("ld_first_"), F.count_distinct("ld_id_").alias("ld_docs_"), F.count("*").alias("ld_n_")).where(F.col("ld_docs_") >= min_docs)
    common = materialize(common.select(*_BOTH, "ld_first_", "ld_n_"))
    hot = F.broadcast(common.where(F.col("ld_n_") >= hot_lines).drop("ld_n_"))
    cold = common.where(F.col("ld_n_") < hot_lines).drop("ld_n_")
    found = lines.join(hot, _BOTH).unionByName(lines.join(hot.select(*_BOTH), _BOTH, "left_anti").join(cold, _BOTH))
    return (found.where("ld_id_ > ld_first_")
            .groupBy("ld_id_", "ld_text_").agg(F.collect_set("ld_pos_").alias("ld_dropped_")))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Drop lines whose key occurs in at least ``min_docs`` documents, except in the document with
    the smallest id among them.

    Lines are cut at \\n; keys have their ASCII white space stripped and A-Z lower-cased, and those
    under ``min_chars`` code points never count. Returns all columns of ``docs`` with the new text,
    and ``ld_lines_`` (before), ``ld_dropped_n_``. A null or empty text is one empty line and stays
    (null becomes empty). Repeats inside one document stay. Rows with a null id are not counted as
    documents and keep their lines; repeated rows of one id are one document. Column names that
    begin with ``ld_`` and end with ``_`` are taken.
    """
    gone = dropped_lines(docs, min_chars, min_docs, id_column, text_column)
    joined = docs.withColumn("ld_hash_", F.xxhash64(text_column)).join(
        gone, (F.col(id_column) == F.col("ld_id_")) & (F.col("ld_hash_") == F.col("ld_text_")), "left")
    parts = F.split(text_or_empty(text_column), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("ld_dropped_"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    return joined.withColumns({
        "ld_lines_": F.size(parts).cast("long"),
        "ld_dropped_n_": F.coalesce(F.size("ld_dropped_"), F.lit(0)).cast("long"),
        text_column: F.when(F.col("ld_dropped_").isNull(), text_or_empty(text_column)).otherwise(rest),
    }).drop("ld_id_", "ld_text_", "ld_hash_", "ld_dropped_")


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT d.doc_id, d.pos, d.line, coalesce(d.doc_id > c.first_doc, false) AS gone
  FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
