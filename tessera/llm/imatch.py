"""I-Match document fingerprints on DataFrame functions alone.

The lexicon holds the terms whose inverse document frequency ``ln(documents / documents with the
term)`` lies in a band. A text is reduced to its distinct lexicon terms, sorted; each of some
randomised subsets of the lexicon keeps a part of them, and the hash of that part is one place of the
fingerprint. Subsets of many densities (a half to 1 / 2 ** SCALES of the lexicon) make the share of equal
places a measure: dense subsets agree for copies only, sparse ones as often as texts share terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty

#: Subsets of density 1/2, 1/4, ..., 1 / 2 ** SCALES; at most SUBSETS (disjoint) of each, and no more than half
#: of all that there are.
SCALES, SUBSETS = 11, 16
#: Weight of the places of a scale that are all filled.
LEAST_WEIGHT = 0.05
#: What stands between terms.
BETWEEN_TERMS = r"[^\p{L}\p{N}]+"
#: A lexicon of up to so many terms (8 bytes each) is sent to the texts; a larger one is joined by term.
SENT_TERMS = 2_000_000

#: The place of no terms: a hash starts from its seed, 42.
EMPTY = 42 - (1 << 31)

_ROW = ["im_a_", "im_b_"]


def places_of(scale: int) -> int:
    return min(SUBSETS, 1 << (scale - 1))


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct terms: runs of letters and digits, lower-cased."""
    found = F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN_TERMS)), "")
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, min_idf: float, max_idf: float, text_column: str = "text") -> DataFrame:
    """(im_term_): the terms within the band, counted over all documents, one count for each document.

    A term of the band is in ``exp(-max_idf)`` of the documents at least, so there are at most
    ``exp(max_idf)`` times as many as a document has terms on average, whatever the size of the table.
    """
    total = docs.count()
    counted = docs.select(F.explode(terms(text_or_empty(text_column))).alias("im_term_")).groupBy("im_term_").agg(F.count("*").alias("n"))
    return materialize(counted.where(F.col("n").between(total * math.exp(-max_idf), total * math.exp(-min_idf))).select("im_term_"))


def place_hash(kept: Column) -> Column:
    """32 bits of the hash of sorted terms as int; EMPTY for no terms."""
    return (F.xxhash64(kept).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")


def subset_hashes(kept: Column) -> Column:
    """The hash of each randomised subset of the sorted terms. A term's hash is random itself: ``s`` bits of it
    that no other scale up to the tenth uses say which of the ``2 ** s`` subsets of scale ``s`` holds the term."""

    def scale(s: int) -> Column:
        start, mask = min(s * (s - 1) // 2, 64 - s), F.lit((1 << s) - 1).cast("long")
        own = lambda t: F.shiftrightunsigned(t, start).bitwiseAND(mask)
        some = F.filter(kept, lambda t: own(t) < places_of(s))
        return F.flatten(F.transform(F.array(some), lambda near: F.transform(
            F.sequence(F.lit(0), F.lit(places_of(s) - 1)), lambda j: place_hash(F.filter(near, lambda t: own(t) == j)))))

    return F.concat(*(scale(s) for s in range(1, SCALES + 1)))


def as_text(places: Column) -> Column:
    """Eight hex digits for each place, in order; 0000002a for an empty subset."""
    return F.array_join(F.transform(places, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def likeness(one: Column, two: Column) -> Column:
    """The share of equal places among those that are not empty in both, 1 if all are. The places of a scale
    weigh as much as part of them is empty in both: where every subset keeps many terms, equal places
    tell copies apart only; where few keep any, they are as frequent as common terms."""
    state = F.zip_with(one, two, lambda x, y: F.when(x != y, 1).when(x == EMPTY, 0).otherwise(2))  # 0 empty, 1 unequal, 2 equal
    sizes = [1, *(places_of(s) for s in range(1, SCALES + 1))]

    def counted(states: Column) -> Column:
        own = [F.slice(states, 1 + sum(sizes[:k]), size) for k, size in enumerate(sizes)]
        return F.array(*(F.struct(F.size(F.filter(o, lambda p: p > 0)).alias("filled"), F.size(F.filter(o, lambda p: p == 2)).alias("equal"), F.lit(float(n)).alias("n")) for o, n in zip(own, sizes, strict=True)))

    def add(sums: Column, scale: Column) -> Column:
        weight = F.lit(1 + LEAST_WEIGHT) - scale["filled"] / scale["n"]
        return F.struct((sums["equal"] + weight * scale["equal"]).alias("equal"), (sums["some"] + weight * scale["filled"]).alias("some"))

    def share(sums: Column) -> Column:
        return F.when(sums["some"] == 0, 1.0).otherwise(sums["equal"] / sums["some"])

    scales = F.flatten(F.transform(F.array(state), counted))
    return F.aggregate(scales, F.struct(F.lit(0.0).alias("equal"), F.lit(0.0).alias("some")), add, share)


def successors(docs: DataFrame, id_column: str) -> DataFrame:
    """(row key, n_chars, id, next row key): the document after each in descending id, null ids last,
    equal ids in the order of their row keys, rows equal in id and text as one; after the last the first.

    Rows are dealt by ranges of the id; what follows a range is the first row of the next.
    """
    spark = docs.sparkSession
    order = [F.col("im_id_").desc_nulls_last(), *map(F.col, _ROW)]
    each = docs.groupBy(*_ROW, F.col(id_column).alias("im_id_")).agg(F.max(F.char_length("im_text_")).cast("long").alias("im_n_"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(each.repartitionByRange(parts, *order).withColumn("im_part_", F.spark_partition_id()))
    inside = Window.partitionBy("im_part_").orderBy(*order)
    key = F.struct(*_ROW)
    placed = dealt.withColumn("im_next_", F.lead(key).over(inside)).withColumn("im_place_", F.row_number().over(inside))
    firsts = materialize(placed.where("im_place_ = 1").select("im_part_", key.alias("im_first_")))  # one row for each range
    ranges = Window.orderBy("im_part_")
    after = firsts.select("im_part_", F.coalesce(F.lead("im_first_").over(ranges), F.first("im_first_").over(ranges)).alias("im_after_"))
    return materialize(placed.join(after, "im_part_").withColumn("im_next_", F.coalesce("im_next_", "im_after_"))
                       .select(*_ROW, "im_id_", "im_n_", F.col("im_next_.im_a_").alias("im_next_a_"), F.col("im_next_.im_b_").alias("im_next_b_")))


def fingerprints(texts: DataFrame, keep: DataFrame, columns: dict[str, str], carried: list[str]) -> DataFrame:
    """Row key, ``carried`` columns and, for each text column of ``columns``, its places under the name
    given. Texts are taken apart where they lie; only terms of the lexicon ``keep`` are gathered again,
    by the row key, which the texts are dealt by already."""
    names = list(columns.values())
    apart = texts.select(*_ROW, F.monotonically_increasing_id().alias("im_row_"), *carried, *(terms(F.col(c)).alias(n) for c, n in columns.items()))
    whole = [place_hash(F.sort_array(n)).alias(f"im_all_{n}") for n in names]

    def tag(k: int, name: str) -> Column:
        return F.transform(F.col(name), lambda t: F.struct(F.lit(k).alias("which"), t.alias("term")))

    tagged = F.concat(*(tag(k, n) for k, n in enumerate(names)))
    once = F.struct(*carried, *whole)  # reckoned before texts are taken apart; goes with the first term only
    out = apart.select(*_ROW, "im_row_", once.alias("im_once_"), tagged.alias("im_terms_"))
    out = out.select(*_ROW, "im_row_", "im_once_", F.posexplode_outer("im_terms_").alias("im_pos_", "im_at_"))
    first = F.coalesce(F.col("im_pos_"), F.lit(0)) == 0
    out = out.select(*_ROW, "im_row_", first.alias("im_lead_"), F.when(first, F.col("im_once_")).alias("im_once_"), F.col("im_at_.which").alias("im_which_"), F.col("im_at_.term").alias("im_term_"))
    known = keep.withColumn("im_in_", F.lit(True))
    if keep.count() <= SENT_TERMS:
        known = F.broadcast(known)
    out = out.join(known, "im_term_", "left").where(F.col("im_in_") | F.col("im_lead_"))
    gathered = out.groupBy(*_ROW, "im_row_").agg(F.first("im_once_", ignorenulls=True).alias("im_once_"), *(
        F.sort_array(F.collect_list(F.when(F.col("im_in_") & (F.col("im_which_") == k), F.col("im_term_")))).alias(n) for k, n in enumerate(names)))
    return gathered.select(*_ROW, *(F.col(f"im_once_.{c}").alias(c) for c in carried), *(F.concat(F.array(f"im_once_.im_all_{n}"), subset_hashes(F.col(n))).alias(n) for n in names))


def edit_and_fingerprint(docs: DataFrame, min_idf: float = 3.0, max_idf: float = 8.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last half (rounded down, in code points) replaced by as much of the start of
    the next document (all, if that is shorter) in descending id. ``near_edited`` and ``near_next`` are the
    likeness of a text to its edited form and to the next document.

    Null and empty texts have no terms; texts without terms have equal, empty fingerprints and are
    wholly alike. The first place covers all terms, so texts without a lexicon term differ too. Equal
    texts have equal fingerprints. Null ids come last; equal ids stand in the order of a hash of the
    row; rows equal in id and text have one successor and are returned each. A single document follows
    itself. Empty tables give an empty one; other columns are not read. Names that begin with ``im_`` and
    end with ``_`` are taken.
    """
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias("im_doc_"), text.alias("im_text_"), F.xxhash64(F.col(id_column), text).alias("im_a_"), F.xxhash64(F.lit(1), text, F.col(id_column)).alias("im_b_"))
    keep = lexicon(docs, min_idf, max_idf, text_column)
    order = successors(rows, "im_doc_")
    wanted = order.select(F.col("im_next_a_").alias("im_a_"), F.col("im_next_b_").alias("im_b_"), F.struct(*_ROW, "im_id_", "im_n_").alias("im_of_"))
    starts = materialize(rows.drop("im_doc_").join(wanted, _ROW).select(
        "im_of_.*", F.col("im_a_").alias("im_next_a_"), F.col("im_b_").alias("im_next_b_"), F.substring("im_text_", F.lit(1), F.expr("cast(im_of_.im_n_ div 2 as int)")).alias("im_start_")))
    kept_part = F.substring("im_text_", F.lit(1), F.expr("cast(im_n_ - im_n_ div 2 as int)"))
    edited = rows.drop("im_doc_").join(starts.dropDuplicates(_ROW), _ROW).withColumn("im_edited_", F.concat(kept_part, "im_start_"))
    edited = edited.withColumn("edited_sha256", F.sha2("im_edited_", 256))
    both = materialize(fingerprints(edited, keep, {"im_text_": "im_own_", "im_edited_": "im_new_"}, ["im_id_", "im_n_", "im_next_a_", "im_next_b_", "edited_sha256"]))
    after = both.select(F.col("im_a_").alias("im_next_a_"), F.col("im_b_").alias("im_next_b_"), F.col("im_own_").alias("im_after_")).dropDuplicates(["im_next_a_", "im_next_b_"])
    return both.join(after, ["im_next_a_", "im_next_b_"]).select(
        F.col("im_id_").alias(id_column), F.col("im_n_").alias("n_chars"), "edited_sha256", as_text(F.col("im_own_")).alias("fingerprint"), as_text(F.col("im_new_")).alias("edited_fingerprint"),
        likeness(F.col("im_own_"), F.col("im_new_")).alias("near_edited"), likeness(F.col("im_own_"), F.col("im_after_")).alias("near_next"))
