"""A stored text index that is changed in place of rebuilt.

The index of a table (doc_id, text; one row for each id) is a folder of *segments*. Each has

* ``log``: the documents that the segment speaks of, with text and hash; without text: removed;
* ``postings``: (gram, doc_id) of its texts, in folders by a hash of the gram;
* ``grams``: how many documents of the segment hold each gram, in the same folders.

The newest segment that speaks of a document is right about it. An update compares hashes and writes one
segment for what was added, changed or removed; older files stay as they are. ``compact`` puts the live
rows of some segments into one. A *commit* names the segments of a version and is written last, once:
readers follow the newest commit, so a writer that fails leaves no trace, and of two writers of one
version the second is refused.

Postings are many times the rows of the texts, so they are never shuffled: each task cuts, sorts and writes those
of its own texts, few enough to be sorted in memory. Texts are compared by their hashes, and tables of known
few rows (tokens, replaced documents) are sent to the rows that they are looked up for.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import like_wildcards

_COMMIT = "version long, segments array<long>, size int, buckets int, id_type string, mark string"
#: Deltas are put together from so many on.
MOST_SEGMENTS = 8
#: Tables of so many rows at most are sent to all tasks; larger ones are shuffled.
FEW_ROWS = 1 << 18
#: Bytes of the stored texts, and of stored postings, that one task takes: their postings are sorted in memory.
TEXT_BYTES, POSTING_BYTES = 12 << 20, 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"


@dataclass(frozen=True)
class TextIndex:
    """A version of the index at ``path``: grams of ``size`` characters in ``buckets`` folders, the segments in the
    order in which they were written, the type of the ids, and the mark of the documents indexed last."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[int, ...]
    size: int
    buckets: int
    id_type: str
    mark: str


def postings(documents: DataFrame, size: int = 3, only: list[str] | None = None) -> DataFrame:
    """(gram, doc_id): distinct character grams of each text (doc_id, text); with ``only`` those grams
    alone. The stored tables below serve many requests."""
    # An empty match with a look ahead at each place: one pass over the text.
    if only is None:
        grams = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=({'.' * size}))"), 1))
    else:
        grams = F.filter(F.array(*map(F.lit, only)).cast("array<string>"), lambda g: F.col("text").contains(g))
    return documents.select("doc_id", F.explode(grams).alias("gram")).select("gram", "doc_id")


def gram_bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def open_index(spark: SparkSession, path: str) -> TextIndex | None:
    """The newest version, or None where nothing was committed."""
    try:
        commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = commits.orderBy(F.desc("version")).first()
    return None if last is None else TextIndex(spark, path, last["version"], tuple(last["segments"]), last["size"], last["buckets"], last["id_type"], last["mark"])


def _commit(index: TextIndex) -> TextIndex:
    row = index.spark.createDataFrame([(index.version, list(index.segments), index.size, index.buckets, index.id_type, index.mark)], _COMMIT)
    row.coalesce(1).write.mode("errorifexists").parquet(f"{index.path}/commits/commit={index.version}")
    return index


def _read(index: TextIndex, table: str, schema: str, segments: tuple[int, ...] | None = None) -> DataFrame:
    segments = index.segments if segments is None else segments
    if not segments:
        return index.spark.createDataFrame([], f"{schema}, segment long")
    reader = index.spark.read.schema(f"{schema}, segment long").option("basePath", f"{index.path}/{table}")
    return reader.parquet(*(f"{index.path}/{table}/segment={s}" for s in segments))


@contextmanager
def _tasks_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Tables that are read meanwhile are dealt to tasks by ``size`` bytes."""
    before = spark.conf.get(_SPLIT)
    spark.conf.set(_SPLIT, size)
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def _sent(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


def _latest(index: TextIndex) -> DataFrame:
    """(doc_id, latest): the newest segment after the first that speaks of a document."""
    return _read(index, "log", f"doc_id {index.id_type}", index.segments[1:]).groupBy("doc_id").agg(F.max("segment").alias("latest"))


def _live(index: TextIndex, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, segment, ...) of segments that are still right about the document."""
    if len(index.segments) > 1:
        few = _few(_read(index, "log", f"doc_id {index.id_type}", index.segments[1:]))
        rows = rows.join(_sent(_latest(index), few), "doc_id", "left").where(F.col("latest").isNull() | (F.col("latest") == F.col("segment"))).drop("latest")
    return rows


def texts(index: TextIndex) -> DataFrame:
    """(doc_id, text, hash) of all documents that the index holds."""
    return _live(index, _read(index, "log", f"doc_id {index.id_type}, text string, hash string")).where("text is not null").drop("segment")


def stored_postings(index: TextIndex, grams: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(gram, doc_id); with a table of grams (column gram) only theirs, from their folders alone; ``few``: the
    grams are sent to the postings."""
    rows = _read(index, "postings", f"gram string, doc_id {index.id_type}, bucket int")
    if grams is not None:
        wanted = grams.select("gram").distinct().withColumn("bucket", gram_bucket(F.col("gram"), index.buckets))
        rows = rows.join(_sent(wanted, few), ["bucket", "gram"], "left_semi")
    return _live(index, rows).select("gram", "doc_id")


def _write_segment(index: TextIndex, number: int, log: DataFrame) -> bool:
    """log: (doc_id, text, hash); whether it holds anything. Nothing more is written for an empty one."""
    _write_log(index, number, log)
    stored = index.spark.read.schema(log.schema).parquet(f"{index.path}/log/segment={number}")
    if not stored.limit(1).count() and number:
        return False
    with _tasks_of(index.spark, TEXT_BYTES):
        _write_postings(index, number, postings(stored.where("text is not null").select("doc_id", "text"), index.size))
    return True


def _write_log(index: TextIndex, number: int, log: DataFrame) -> None:
    """Row groups as small as what a task takes, however large the files are."""
    log.write.mode("overwrite").option("parquet.block.size", TEXT_BYTES).parquet(f"{index.path}/log/segment={number}")


def _write_postings(index: TextIndex, number: int, rows: DataFrame) -> None:
    """Both tables by bucket, the postings as their tasks hold them: the ids of a gram lie together in each file. Nothing of
    them is shuffled but the counts."""
    own = rows.select("gram", "doc_id", gram_bucket(F.col("gram"), index.buckets).alias("bucket")).sortWithinPartitions("bucket", "gram")
    own.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings/segment={number}")
    stored = _read(index, "postings", f"gram string, doc_id {dict(rows.dtypes)['doc_id']}, bucket int", (number,))
    counts = stored.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/grams/segment={number}")


def create_index(documents: DataFrame, path: str, size: int = 3, buckets: int = 16) -> TextIndex:
    """Version 0 of the index of ``documents`` (doc_id, text) at a path that holds none. Rows without id
    or text are left out; of rows with one id the least text stays."""
    index = TextIndex(documents.sparkSession, path, 0, (0,), size, buckets, dict(documents.dtypes)["doc_id"], documents_mark(documents))
    _write_segment(index, 0, _logged(documents))
    return _commit(index)


def documents_mark(documents: DataFrame) -> str:
    """Number and combined hashes of the rows: equal for equal tables, in one pass without a shuffle of rows."""
    one, two = F.bit_xor(F.xxhash64("doc_id", "text")), F.bit_xor(F.xxhash64(F.lit("second"), "text", "doc_id"))
    return ":".join(str(x) for x in documents.agg(F.count("*"), one, two).first())


def _logged(documents: DataFrame) -> DataFrame:
    own = documents.dropna(subset=["doc_id", "text"]).groupBy("doc_id").agg(F.min("text").alias("text"))
    return own.withColumn("hash", text_hash(F.col("text")))


def _hashes(documents: DataFrame) -> DataFrame:
    """(doc_id, hash) of _logged, without a shuffle of texts but those of ids with several."""
    known = documents.dropna(subset=["doc_id", "text"])
    own = known.select("doc_id", text_hash(F.col("text")).alias("hash")).groupBy("doc_id").agg(F.min("hash").alias("hash"), F.max("hash").alias("other"))
    several = own.where("hash <> other").select("doc_id")
    one = own.where("hash = other").select("doc_id", "hash")
    if not several.limit(1).count():
        return one
    return one.unionByName(_logged(known.join(_sent(several, _few(several)), "doc_id", "left_semi")).select("doc_id", "hash"))


def update_index(index: TextIndex, documents: DataFrame) -> TextIndex:
    """The index of ``documents`` as they are now: one more segment for documents that were added,
    changed or removed, none if there are none. Where there are MOST_SEGMENTS, the segments after the
    first are put together first."""
    if len(index.segments) >= MOST_SEGMENTS:
        index = compact(index, keep=1)
    ids = text_parity(index, documents).select("doc_id").persist()
    try:
        few, number = _few(ids), max(index.segments) + 1
        now = _logged(documents.join(_sent(ids, few), "doc_id", "left_semi"))
        if not _write_segment(index, number, _sent(ids, few).join(now, "doc_id", "left").select("doc_id", "text", "hash")):
            return index  # nothing names the empty segment
    finally:
        ids.unpersist()
    return _commit(replace(index, version=index.version + 1, segments=(*index.segments, number), mark=documents_mark(documents)))


def compact(index: TextIndex, keep: int = 0) -> TextIndex:
    """One segment in place of all but the first ``keep``. Postings are copied, not cut from texts again;
    removals are kept while an older segment could still hold the document."""
    some = index.segments[keep:]
    if not some:
        return index
    inner = replace(index, segments=some)
    number = max(index.segments) + 1
    log = _live(inner, _read(inner, "log", f"doc_id {index.id_type}, text string, hash string")).drop("segment")
    if not keep:
        log = log.where("text is not null")
    _write_log(index, number, log)
    with _tasks_of(index.spark, POSTING_BYTES):
        _write_postings(index, number, stored_postings(inner))
    return _commit(replace(index, version=index.version + 1, segments=(*index.segments[:keep], number)))


def ensure_index(documents: DataFrame, path: str, size: int = 3, buckets: int = 16) -> TextIndex:
    """The index at ``path`` brought up to ``documents``; a new one where there is none. Documents with the mark of
    those indexed last are taken for the same."""
    index = open_index(documents.sparkSession, path)
    if index is None:
        return create_index(documents, path, size, buckets)
    return index if index.mark == documents_mark(documents) else update_index(index, documents)


def recall_indexed(index: TextIndex, tokens: DataFrame, requests: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """(request_id, doc_id): documents (``among``: of this table's ids) that hold any token of the request.

    A token of ``index.size`` characters or more is a substring: its rarest gram by the stored counts
    is looked up in its folder, and the texts that hold it are searched for the token. A token with a
    gram that no text holds ends there. Shorter tokens are LIKE patterns over the texts, their own ``%``
    and ``_`` wildcards. With ``requests``, one without tokens recalls every document.
    """
    few = _few(tokens)
    distinct, held = tokens.select("token").distinct(), texts(index).select("doc_id", "text")
    if among is not None:
        held = held.join(among.select("doc_id"), "doc_id", "left_semi")
    at = F.transform(F.sequence(F.lit(1), F.length("token") - (index.size - 1)), lambda i: F.substring(F.col("token"), i, F.lit(index.size)))
    grams = distinct.where(F.length("token") >= index.size).select("token", F.explode(F.array_distinct(at)).alias("gram"))
    grams = grams.withColumn("bucket", gram_bucket(F.col("gram"), index.buckets))
    counts = _read(index, "grams", "gram string, n long, bucket int").join(_sent(grams.select("bucket", "gram").distinct(), few), ["bucket", "gram"], "left_semi")
    counted = grams.join(counts.groupBy("gram").agg(F.sum("n").alias("n")), "gram", "left")
    rarest = counted.groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).select("token", "least.*")
    # The counts say how many postings there are to look up.
    rarest, number = rarest.drop("n"), rarest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = stored_postings(index, rarest, few).join(_sent(rarest, few), "gram")
    long = _sent(hits, number <= FEW_ROWS).join(held, "doc_id").where(F.col("text").contains(F.col("token"))).select("token", "doc_id")
    short = held.join(distinct.where(F.length("token") < index.size), like_wildcards(F.col("text"), F.col("token"))).select("token", "doc_id")
    found = long.unionByName(short).join(tokens, "token").select("request_id", "doc_id").distinct()
    if requests is None:
        return found
    bare = requests.select("request_id").join(tokens.select("request_id"), "request_id", "left_anti").distinct()
    return found.unionByName(bare.join(held.select("doc_id")))


def text_parity(index: TextIndex, documents: DataFrame) -> DataFrame:
    """(doc_id, expected_hash, stored_hash) of documents whose stored text is not the present one."""
    own, stored = _hashes(documents).select("doc_id", F.col("hash").alias("expected_hash")), texts(index).select("doc_id", F.col("hash").alias("stored_hash"))
    return own.join(stored, "doc_id", "full_outer").where(~F.col("expected_hash").eqNullSafe(F.col("stored_hash")))


def posting_parity(index: TextIndex) -> DataFrame:
    """(segment, bucket, expected, stored, equal): each segment's postings against those of its own texts,
    by count and fingerprint; the texts' own hashes are checked as bucket -1."""
    mark = lambda: [F.count("*").alias("n"), F.bit_xor(F.xxhash64("gram", "doc_id")).alias("mark")]
    log = _read(index, "log", f"doc_id {index.id_type}, text string, hash string")
    cut = None
    for number in index.segments:
        own = postings(log.where((F.col("segment") == number) & F.col("text").isNotNull()).select("doc_id", "text"), index.size).withColumn("segment", F.lit(number).cast("long"))
        cut = own if cut is None else cut.unionByName(own)
    expected = cut.groupBy("segment", gram_bucket(F.col("gram"), index.buckets).alias("bucket")).agg(*mark())
    stored = _read(index, "postings", f"gram string, doc_id {index.id_type}, bucket int").groupBy("segment", "bucket").agg(*mark())
    both = expected.toDF("segment", "bucket", "expected", "m1").join(stored.toDF("segment", "bucket", "stored", "m2"), ["segment", "bucket"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    gone = log.groupBy("segment").agg(F.count_if(F.col("text").isNotNull()).alias("expected"), F.count_if(text_hash(F.col("text")) == F.col("hash")).alias("stored"))
    return both.select("segment", "bucket", zero("expected"), zero("stored"), (F.col("m1").eqNullSafe(F.col("m2")) & F.col("expected").eqNullSafe(F.col("stored"))).alias("equal")).unionByName(
        gone.select("segment", F.lit(-1).alias("bucket"), "expected", "stored", (F.col("expected") == F.col("stored")).alias("equal")))
