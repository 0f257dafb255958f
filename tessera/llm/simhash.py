"""SimHash near-duplicates through distributed vantage-point trees.

Fingerprints are points of 64-bit Hamming space. A vantage point ``v`` and a distance ``m`` part
them into an inner cell (distance to ``v`` at most ``m``) and an outer one. Two fingerprints at
most ``radius`` apart have a midpoint within ``ceil(radius / 2)`` of both, and the midpoint lies in
one leaf cell; so each fingerprint goes to every leaf that its ball of that half radius touches
(the triangle inequality prunes all other branches), and every linked pair meets in some leaf.

The upper levels of the tree come from a bounded sample of the fingerprints and only decide which
shard a fingerprint goes to; the lower levels are grown inside each shard. Results do not depend
on the sample. Shards return spanning forests, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.tokens import by_bytes, texts_of

#: Fingerprints from which the upper levels of the tree are grown, at least, and for each shard: what
#: the driver gets is at most 8 of each SHARD_SIZE fingerprints, 64 bytes of 32 768.
SAMPLE_SIZE, SAMPLE_PER_SHARD = 8192, 8
#: Distinct fingerprints for each shard, before those of neighbouring shards are added. There are as
#: many shards as this asks for, so a shard does not grow with the input.
SHARD_SIZE = 4096
#: A leaf of a shard compares all its fingerprints with each other, so many rows of pairs at once.
#: Fingerprints of unlike texts go to 0.7 of the cells at each level: below this size a further level
#: costs more than it saves.
LEAF_SIZE, ROWS_AT_ONCE = 4096, 256
#: Bytes of text that are fingerprinted at once, and hashes of a text that are taken apart to bits at once.
SLICE_BYTES, HASHES_AT_ONCE = 1 << 18, 1 << 14


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words joined by a space, repeats included; of the
    whole sequence if it is shorter; none for no words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= size:
        return [digest(text, 42)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return [digest(text[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)]


def fingerprints(texts: pa.Array, shingle_words: int) -> np.ndarray:
    """SimHash of each text as uint64: a bit is set if it is set in over half the hashes."""
    out = np.zeros((len(texts), 64), bool)
    at = 0
    for part in by_bytes(texts, SLICE_BYTES):
        for text in part.to_pylist():
            own = np.array(shingle_hashes(text.encode("utf-8").lower().split(), shingle_words), ">u8").view(np.uint8).reshape(-1, 8)
            counts = np.zeros(64, np.int64)
            for start in range(0, len(own), HASHES_AT_ONCE):  # bits take 64 times a byte
                counts += np.unpackbits(own[start:start + HASHES_AT_ONCE], axis=1).sum(axis=0, dtype=np.int32)
            out[at] = 2 * counts > len(own)
            at += 1
    return np.packbits(out, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprint_table(docs: DataFrame, shingle_words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long; 0 for texts without words and null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(texts_of(batch.column(1)), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, fp long")


@dataclass
class Node:
    """``point`` and ``within`` of an inner node; ``shard`` of a leaf."""

    point: np.uint64 | None = None
    within: int = 0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and distance, of a few drawn, that send the fewest points to both sides;
    None if nothing parts the points."""
    best, found = len(points) * 1.9, None
    trial = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    for point in trial[rng.integers(0, len(trial), 6)]:
        d = np.bitwise_count(trial ^ point)
        within = int(np.median(d))
        for m in (within - 1, within):
            low, high = int((d - 2.0 <= m).sum()), int((d + 2.0 > m).sum())
            cost = (low * low + high * high) / len(trial) * len(points) / len(trial)
            if min(low, high) < len(trial) and max(low, high) < 0.97 * len(trial) and cost < best:
                best, found = cost, (point, m)
    return found


def grow(points: np.ndarray, leaves: int, rng: np.random.Generator, numbers: Iterator[int]) -> Node:
    cut = split(points, rng) if leaves > 1 and len(points) > 8 else None
    if cut is None:
        return Node(shard=next(numbers))
    d = np.bitwise_count(points ^ cut[0])
    inner, outer = points[d <= cut[1]], points[d > cut[1]]
    if not len(inner) or not len(outer):
        return Node(shard=next(numbers))
    near = min(leaves - 1, max(1, round(leaves * len(inner) / len(points))))
    return Node(*cut, grow(inner, near, rng, numbers), grow(outer, leaves - near, rng, numbers))


def visit(node: Node, points: np.ndarray, rows: np.ndarray, half: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards, each with the rows whose ball of radius ``half`` touches it."""
    if not len(rows):
        return
    if node.point is None:
        yield node.shard, rows
        return
    d = np.bitwise_count(points[rows] ^ node.point).astype(np.int16)
    yield from visit(node.inner, points, rows[d - half <= node.within], half)
    yield from visit(node.outer, points, rows[d + half > node.within], half)


def forest(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that link what is within ``radius``: a spanning forest or, for few links, all."""
    found, links = [], 0
    if len(points) <= 16 * LEAF_SIZE:
        for at in range(0, len(points), ROWS_AT_ONCE):
            some = points[at:at + ROWS_AT_ONCE]
            i, j = np.nonzero(np.bitwise_count(some[:, None] ^ points[None, at:]) <= radius)
            later = j > i  # each pair once, none with itself
            links += int(later.sum())
            if links > len(points):
                break
            found.append((some[i[later]], points[at:][j[later]]))
        else:
            return [pair for pair in found if len(pair[0])]
    # Breadth first over what has not been reached: a dense group is used up by its first points.
    edges, rest = [], points
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for k, point in enumerate(front):
                near = np.bitwise_count(rest ^ point) <= radius
                if near.any():
                    new, rest = rest[near], rest[~near]
                    edges.append((np.full(len(new), point), new))
                    queue.append(new)
                    if not len(rest):
                        break
    return edges


def links_within(points: np.ndarray, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shard's own vantage-point tree, grown while it parts the points."""
    half = math.ceil(radius / 2)
    stack = [points]
    while stack:
        points = stack.pop()
        cut = split(points, rng) if len(points) > LEAF_SIZE else None
        if cut is None:
            yield from forest(points, radius)
            continue
        d = np.bitwise_count(points ^ cut[0]).astype(np.int16)
        stack += [points[d - half <= cut[1]], points[d + half > cut[1]]]


def linked_pairs(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose closure is that of all links
    of at most ``radius`` bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    shards = max(1, math.ceil(total / SHARD_SIZE))
    # Ordered by a hash of the fingerprint: the same sample on every run.
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(max(SAMPLE_SIZE, SAMPLE_PER_SHARD * shards)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = grow(sample, shards, np.random.default_rng(1), iter(range(1 << 30)))
    half = math.ceil(radius / 2)
    sent = spark.sparkContext.broadcast(tree)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for shard, rows in visit(sent.value, points, np.arange(len(points)), half):
                yield pd.DataFrame({"shard": np.full(len(rows), shard, np.int32), "fp": points[rows].view(np.int64)})

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(frame["fp"].to_numpy(np.int64)).view(np.uint64)
        pairs = list(links_within(points, radius, np.random.default_rng(key[0])))
        if not pairs:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    # A number of partitions of its own: shards are few bytes and much work, and would be put together.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, 20_000))
    dealt = distinct.select("fp").mapInPandas(deal, "shard int, fp long").repartition(parts, "shard")
    return dealt.groupBy("shard").applyInPandas(link, "a long, b long").distinct()


def connected_labels(edges: DataFrame) -> DataFrame:
    """(node, label): each node's smallest reachable node. Least label of the neighbours, then the
    label's own label, until nothing changes: rounds grow with the logarithm of a chain's length.
    Each round is a written table; only one number comes to the driver."""
    both = materialize(edges.union(edges.select("b", "a")).toDF("node", "other"))
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "further")
        new = materialize(least.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, shingle_words: int = 5, radius: int = 4,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row.

    Texts are A-Z lower-cased and cut at ASCII white space; shingles of ``shingle_words`` words.
    Fingerprints at most ``radius`` bits apart are linked; the component is the smallest id
    reachable. Texts without words and nulls: fingerprint zero, linked as any other. Repeated rows
    and ids: a row each. Null ids do not name a component unless it has no other id.
    """
    rows = materialize(fingerprint_table(docs, shingle_words, id_column, text_column))
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    labels = connected_labels(linked_pairs(distinct, radius))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(groups, "label").select("fp", "component_id")
    # Hot fingerprints are split by adaptive execution: the other side has one row for each.
    return rows.join(by_print, "fp").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, radius: int = 4,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they are; of
    rows equal in id and text one stays. A component without ids keeps its rows without id."""
    groups = near_duplicates(docs, shingle_words, radius, id_column, text_column)
    keep = groups.where(F.col(id_column).eqNullSafe(F.col("component_id"))).select(F.col(id_column).alias("kept_id_")).distinct()
    kept = docs.join(keep, docs[id_column].eqNullSafe(keep["kept_id_"]), "left_semi")
    return kept.dropDuplicates([id_column, text_column])
