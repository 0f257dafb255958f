"""Hard-negative mining by angular triangle filtering.

Every vector keeps its angles to a few reference directions. For an anchor at angle ``s`` and a row at
angle ``t`` to one direction, the angle between the two lies in ``[|s - t|, min(s + t, 2 pi - s - t)]``,
so each direction gives an interval of the cosine; the directions' intervals are intersected and
multiplied by the norms. Bounds are widened by more than rounding can move them. Groups of rows that
are neighbours in angle are judged first, then the rows of the groups that are left, and only rows
whose bounds overlap a score window of the anchor are scored, in whole numbers.

The anchors are a stated query set. They meet the rows block by block: a block of anchors, bounded in
bytes, is sent to the tasks, which read the stored index once for the positives and once for the
negatives and keep the best few rows for each anchor and window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir, write_table

#: Bytes of anchors (components and angles) that are sent to the tasks at once.
ANCHOR_BYTES = 8 << 20
#: Rows of the sample that the directions are fitted to. Results do not depend on it.
SAMPLE_ROWS = 2048
#: Rows whose bounds are judged as one, anchors that are compared with a group at once.
GROUP_ROWS, ANCHORS_AT_ONCE = 256, 1024
#: Greatest component of a whole-number vector: scores of up to 32 767 components fit 64 bits.
LARGEST = 1 << 24
#: More than the error of a cosine bound; angles near 0 are known to some 1e-8.
SLACK = 1e-6
#: Rows of a partition of the index.
PARTITION_ROWS = 1 << 18

_INDEX = "id long, label long, anchor boolean, vector binary, norm double, cell int, own double, angles binary"


def padded(blobs: list[bytes], dtype: str, width: int = 0) -> np.ndarray:
    """One row for each blob, zeros after its end."""
    sizes = {len(b) for b in blobs}
    each = np.dtype(dtype).itemsize
    width = max(width, max(sizes, default=0) // each)
    if sizes == {width * each}:
        return np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), width)
    out = np.zeros((len(blobs), width), dtype)
    for row, blob in zip(out, blobs, strict=True):
        own = np.frombuffer(blob, dtype)
        row[: len(own)] = own
    return out


def fit_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors near the middles of the sample's bundles (a few rounds of spherical k-means)."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen = [unit[0]]
    for _ in range(min(count, len(unit)) - 1):  # start: each the least covered of the sample
        chosen.append(unit[np.argmin(np.max(unit @ np.array(chosen).T, axis=1))])
    middles = np.array(chosen)
    for _ in range(6):
        nearest = np.argmax(unit @ middles.T, axis=1)
        for k in range(len(middles)):
            total = unit[nearest == k].sum(axis=0)
            if np.linalg.norm(total) > 1e-9:
                middles[k] = total / np.linalg.norm(total)
    return middles


def angles_to(directions: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    width = max(directions.shape[1], vectors.shape[1])
    grown = [np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1]))) for x in (vectors, directions)]
    cosines = grown[0] @ grown[1].T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def index_rows(rows: DataFrame, directions: np.ndarray, scale: int, parts: int) -> DataFrame:
    """The stored index: whole-number vectors with norms and angles, neighbours in angle together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
            blobs = [part.tobytes() for part in np.split(flat, np.cumsum(sizes)[:-1])]
            vectors = padded(blobs, "<i4")
            norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
            angles = angles_to(directions, vectors, norms)
            some = angles.shape[1] > 0
            cell = angles.argmin(axis=1) if some else np.zeros(len(norms), np.int64)
            own = angles.min(axis=1) if some else np.zeros(len(norms))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(blobs, pa.binary()), pa.array(norms), pa.array(cell.astype(np.int32)),
                 pa.array(own), pa.array([a.tobytes() for a in angles], pa.binary())],
                ["id", "label", "anchor", "vector", "norm", "cell", "own", "angles"])

    found = rows.mapInArrow(run, _INDEX)
    return materialize(found.repartitionByRange(parts, "cell", "own", "id").sortWithinPartitions("cell", "own", "id"))


class Rows:
    """Vectors of a table of the index, in its order."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = {name: batch.column(name) for name in ("id", "label", "norm", "vector", "angles")}
        self.id, self.label, self.norm = (column[k].to_numpy(zero_copy_only=False) if isinstance(column[k], pa.Array) else column[k].to_numpy() for k in ("id", "label", "norm"))
        self.vector = padded(column["vector"].to_pylist(), "<i4")
        angles = padded(column["angles"].to_pylist(), "<f8")
        self.angle, self.cos, self.sin = angles, np.cos(angles), np.sin(angles)


def group_bounds(anchors: Rows, some: slice, rows: Rows, group: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with any row of the group."""
    s, t = anchors.angle[some], rows.angle[group]
    low, high = t.min(axis=0), t.max(axis=0)
    gap = np.maximum(0, np.maximum(s - high, low - s))
    least = np.where((s + low <= math.pi) & (s + high >= math.pi), -1.0, np.minimum(np.cos(s + low), np.cos(s + high)))
    return scaled(least.max(axis=1, initial=-1), np.cos(gap).min(axis=1, initial=1), anchors.norm[some], rows.norm[group].min(), rows.norm[group].max())


def pair_bounds(anchors: Rows, some: np.ndarray, rows: Rows, group: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with each row: cosines of sums and differences of angles."""
    size = (len(some), group.stop - group.start)
    least, most = np.full(size, -1.0), np.full(size, 1.0)
    for k in range(anchors.cos.shape[1]):
        along = np.multiply.outer(anchors.cos[some, k], rows.cos[group, k])
        across = np.multiply.outer(anchors.sin[some, k], rows.sin[group, k])
        np.maximum(least, along - across, out=least)
        np.minimum(most, along + across, out=most)
    norms = rows.norm[group][None]
    return scaled(least, most, anchors.norm[some][:, None], norms, norms)


def scaled(least, most, norm, shortest, longest):
    least, most = least - SLACK, most + SLACK
    return norm * np.where(least < 0, longest, shortest) * least - 1, norm * np.where(most > 0, longest, shortest) * most + 1


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as exact whole numbers: in doubles where those hold every sum, else in 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    kind = np.float64 if largest < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Best:
    """The best ``keep`` (score, id) of each key: higher scores first, then smaller ids."""

    def __init__(self, keys: int, keep: int):
        self.keep, self.least = keep, np.full(keys, np.iinfo(np.int64).min)
        self.rows, self.waiting, self.held = [], 0, 0

    def add(self, key: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.rows.append((key, score, row))
        self.waiting += len(key)
        if self.waiting > max(1 << 16, self.held):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return (np.zeros(0, np.int64),) * 3
        key, score, row = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((row, -score, key))
        key, score, row = key[order], score[order], row[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        stay = place < self.keep
        last = place == self.keep - 1
        self.least[key[last]] = score[last]
        self.rows, self.waiting, self.held = [(key[stay], score[stay], row[stay])], 0, int(stay.sum())
        return self.rows[0]


def search(batches: Iterator[pa.RecordBatch], anchors: Rows, low: np.ndarray, high: np.ndarray, same_label: bool, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, score, id) of the best rows for each window; key is anchor * windows + window. ``low`` and
    ``high`` hold each anchor's windows; one with low above high is empty."""
    windows = low.shape[1]
    best = Best(low.size, keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Rows(batch)
        for at in range(0, len(rows.id), GROUP_ROWS):
            group = slice(at, min(at + GROUP_ROWS, len(rows.id)))
            for first in range(0, len(anchors.id), ANCHORS_AT_ONCE):
                some = slice(first, min(first + ANCHORS_AT_ONCE, len(anchors.id)))
                floor = np.maximum(low[some], best.least.reshape(-1, windows)[some])
                least, most = group_bounds(anchors, some, rows, group)
                open_ = ((floor <= most[:, None]) & (high[some] >= least[:, None]) & (floor <= high[some])).any(axis=1)
                who = first + np.nonzero(open_)[0]
                if not len(who):
                    continue
                floor = floor[open_]
                labels = (anchors.label[who][:, None] == rows.label[group][None]) == same_label
                labels &= anchors.id[who][:, None] != rows.id[group][None]
                least, most = pair_bounds(anchors, who, rows, group)
                near = np.zeros(labels.shape, bool)
                for w in range(windows):
                    near |= (most >= floor[:, w, None]) & (least <= high[who, w, None])
                near &= labels
                i, j = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
                if not len(i):
                    continue
                score = whole_scores(anchors.vector[who[i]], rows.vector[group][j])
                near = near[np.ix_(i, j)]
                for w in range(windows):
                    a, b = np.nonzero(near & (score >= floor[i, w, None]) & (score <= high[who[i], w, None]))
                    if len(a):
                        best.add(who[i[a]] * windows + w, score[a, b], rows.id[group][j[b]])
    return best.settle()


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
                        directions: int = 8, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A vector's components become ``floor(scale * x)``; scores are their inner products. Anchors are the
    rows for which ``anchors`` is true. An anchor's positives are the ``positives`` best rows of its own
    label, its negatives to each of them the ``negatives`` best rows of other labels whose score is
    from ``window[0]`` to ``window[1]`` hundredths of the positive's. Ties: the smaller id first. Fewer
    rows than asked for: all. No positive or no negative: no row.

    Rows with a null id, label or vector, with a null or non-finite component, or with one beyond
    ``LARGEST`` after scaling take no part. Vectors of unequal length: missing components are zero; an
    empty vector scores zero. Rows with the anchor's own id are not its partners. Repeated rows count
    each, also as anchors. Empty tables give an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * float(scale))) <= LARGEST) & (F.abs(x) <= float(LARGEST)))
    used = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
                       F.coalesce(anchors, F.lit(False)).alias("anchor"), F.when(fits, vector).alias("vector")).dropna(subset=["id", "label", "vector"])
    total, width = used.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], schema)
    # By a hash of the row: the same sample on every run, and hot vectors are no more than their share.
    drawn = used.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("vector").toArrow()
    sample = padded([np.asarray(v, np.float64).tobytes() for v in drawn["vector"].to_pylist()], "<f8")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PARTITION_ROWS))
    index = index_rows(used, fit_directions(sample, directions), scale, parts)

    each = 4 * (width or 1) + 8 * directions + 24
    chosen = materialize(index.where("anchor").select(F.monotonically_increasing_id().alias("no"), "id", "label", "vector", "norm", "angles"))
    blocks = math.ceil(1.25 * each * chosen.count() / ANCHOR_BYTES)  # dealt by a hash: no block is a quarter above the mean
    path = shared_dir(spark)
    write_table(chosen.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(max(blocks, 1))).cast("int")), path, by=["block"])
    stored, out = spark.read.parquet(path) if blocks else None, []
    for block in range(blocks):
        table = stored.where(F.col("block") == block).orderBy("no").toArrow()
        if table.num_rows:
            out.append(shared_dir(spark))
            write_table(block_negatives(spark, index, table, positives, negatives, window), out[-1])
    return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)


def block_negatives(spark: SparkSession, index: DataFrame, table: pa.Table, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """The result for a block of anchors."""
    sent = spark.sparkContext.broadcast(table)
    none = np.iinfo(np.int64)

    def finder(windows: Callable[[int], tuple[np.ndarray, np.ndarray]], same_label: bool, keep: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = Rows(sent.value)
            low, high = windows(len(anchors.id))
            key, score, row = search(batches, anchors, low, high, same_label, keep)
            yield pa.RecordBatch.from_arrays([pa.array(key // low.shape[1]), pa.array(key % low.shape[1]), pa.array(score), pa.array(row)], ["at", "window", "score", "row"])

        return run

    def ranked(found: DataFrame, keep: int) -> DataFrame:
        order = Window.partitionBy("at", "window").orderBy(F.desc("score"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    found = index.mapInArrow(finder(lambda n: (np.full((n, 1), none.min), np.full((n, 1), none.max)), True, positives), "at long, window long, score long, row long")
    best = materialize(ranked(found, positives).select("at", "rank", F.col("score").alias("positive_score"), F.col("row").alias("positive_id")))
    low, high = np.full((table.num_rows, positives), 1), np.full((table.num_rows, positives), 0)
    own = best.select("at", "rank", "positive_score").toArrow()  # at most ``positives`` for each anchor of the block
    at, place, score = (own[c].to_numpy() for c in ("at", "rank", "positive_score"))
    low[at, place - 1] = [-(-window[0] * int(s) // 100) for s in score]
    high[at, place - 1] = [window[1] * int(s) // 100 for s in score]
    asked = spark.sparkContext.broadcast((low, high))
    found = index.mapInArrow(finder(lambda n: asked.value, False, negatives), "at long, window long, score long, row long")
    ids = spark.createDataFrame(pa.table({"at": pa.array(range(table.num_rows), pa.int64()), "anchor_id": table["id"]}))
    pairs = ranked(found, negatives).select("at", (F.col("window") + 1).cast("int").alias("place"), "rank", F.col("row").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(best.withColumnRenamed("rank", "place"), ["at", "place"]).join(ids, "at").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
