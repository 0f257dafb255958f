"""Sharding by a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize, text_or_empty

#: Most (node, bucket) sums that one pass sends to the driver, and the fewest buckets of a node in it.
MAX_SUMS, MIN_BUCKETS = 1 << 17, 16
#: The groups' places are written each so many levels of the tree.
LEVELS_AT_ONCE = 3
#: Rows whose slots one task numbers.
SLOT_ROWS = 100_000


def default_dimensions(docs: DataFrame) -> list[Column]:
    """Numbers by which near documents are alike: length, source, language, place in the table."""
    found = [F.log2(F.col("size_") + 1.0)]
    for name in ("source", "lang"):
        if name in docs.columns:
            found.append(F.xxhash64(F.col(name).cast("string")).cast("double"))
    return [*found, F.col("id_").cast("double")]


def _tree(groups: DataFrame, dims: int, leaves: int) -> DataFrame:
    """``groups`` (weight_, c0_, c1_, ...) with shard_: a node is split along its widest dimension
    where the sides' bytes are closest to their shares of the leaves.

    The weighted median is found by histograms: each pass sums the weights of all open nodes in
    buckets of the coordinate and then looks into the one that holds the median, until that is a
    single coordinate or a hundredth of a leaf. The driver holds at most MAX_SUMS sums, of as many nodes
    at once as that allows, and a few numbers of each node.
    """
    level = 0
    spark = groups.sparkSession
    nodes = {1: (0, leaves)}  # node -> first shard, number of shards
    done: dict[int, int] = {}
    placed = groups.withColumn("node_", F.lit(1).cast("long"))
    coordinate = lambda dim: F.get(F.array(*(f"c{i}_" for i in range(dims))), dim)
    while nodes:
        done |= {node: first for node, (first, k) in nodes.items() if k == 1}
        nodes = {node: v for node, v in nodes.items() if v[1] > 1}
        if not nodes:
            break
        spans = placed.groupBy("node_").agg(F.sum("weight_").alias("w"), *(f(f"c{i}_").alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))))
        open_ = {}
        for r in spans.collect():
            if r["node_"] in nodes:
                dim = max(range(dims), key=lambda i: r[f"high{i}"] - r[f"low{i}"])
                open_[r["node_"]] = {"dim": dim, "low": r[f"low{dim}"], "high": r[f"high{dim}"], "before": 0, "all": r["w"]}
        for node in set(nodes) - set(open_):  # no rows
            done[node] = nodes[node][0]
        cuts = {}
        while open_:
            chosen = list(open_.items())[:MAX_SUMS // MIN_BUCKETS]
            buckets = max(MIN_BUCKETS, min(1024, MAX_SUMS // len(chosen)))
            rows = [(n, o["dim"], o["low"], (o["high"] - o["low"]) // buckets + 1, o["high"]) for n, o in chosen]
            look = F.broadcast(spark.createDataFrame(rows, "node_ long, dim_ int, low_ long, width_ long, high_ long"))
            sums = (placed.join(look, "node_").withColumn("at_", coordinate(F.col("dim_"))).where("at_ between low_ and high_")
                    .groupBy("node_", F.expr("(at_ - low_) div width_").alias("bucket_")).agg(F.sum("weight_").alias("w")).collect())
            found: dict[int, list] = {}
            for s in sums:
                found.setdefault(s["node_"], []).append((s["bucket_"], s["w"]))
            for node, _, low, width, high in rows:
                o, k = open_[node], nodes[node][1]
                run, want = o["before"], o["all"] * (k // 2) / k
                for bucket, w in sorted(found[node]):
                    if run + w >= want:
                        break
                    run += w
                first, last = low + bucket * width, min(high, low + bucket * width + width - 1)
                if width > 1 and w > o["all"] / k / 100:
                    o.update(low=first, high=last, before=run)
                    continue
                best = None
                for cut, left in ((first, run), (last + 1, run + w)):  # rows below the cut go left
                    if 0 < left < o["all"]:
                        own = min(k - 1, max(1, round(left / o["all"] * k)))
                        cost = max(left / own, (o["all"] - left) / (k - own))
                        best = min(best or (cost, cut, own), (cost, cut, own))
                if best is None:  # a single group of equal texts: it stays whole
                    done[node] = nodes[node][0]
                else:
                    cuts[node] = (o["dim"], best[1], best[2])
                del open_[node]
        split = {n: v for n, v in nodes.items() if n in cuts}
        nodes = {}
        for n, (first, k) in split.items():
            nodes |= {2 * n: (first, cuts[n][2]), 2 * n + 1: (first + cuts[n][2], k - cuts[n][2])}
        if cuts:
            table = F.broadcast(spark.createDataFrame([(n, d, c) for n, (d, c, _) in cuts.items()], "node_ long, dim_ int, cut_ long"))
            placed = placed.join(table, "node_", "left").withColumn(
                "node_", F.when(F.col("dim_").isNull(), F.col("node_")).otherwise(2 * F.col("node_") + (coordinate(F.col("dim_")) >= F.col("cut_")).cast("long"))).drop("dim_", "cut_")
            level += 1
            if level % LEVELS_AT_ONCE == 0:  # else each level's plan holds the joins of all before it
                placed = materialize(placed)
    shards = F.broadcast(spark.createDataFrame(list(done.items()), "node_ long, shard_ int"))
    return placed.join(shards, "node_")


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: list[Column] | None = None,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    size: UTF-8 bytes plus 1. Give the number of shards, or the bytes that a shard should have.
    Law ``bytes``: sizes are near equal, as far as groups of equal texts, which are never parted,
    allow. Slots are gapless from 0 in each shard. Null texts count as empty; null ids sort by
    their text; repeated rows get a slot each; an empty table gives no rows. A hot source or id
    range is split further: ties in a dimension are ordered by the text's hash. ``dimensions`` are
    numeric columns of ``docs``, or of ``id_`` and ``size_``.
    """
    text = text_or_empty(text_column)
    rows = docs.withColumns({"id_": F.col(id_column).cast("long"), "size_": (F.octet_length(text) + 1).cast("long")})
    dims = dimensions or default_dimensions(docs)
    rows = materialize(rows.select(
        "id_", "size_", F.crc32(text).alias("crc_"), F.xxhash64(text).alias("g1_"), F.xxhash64(F.lit(1), text).alias("g2_"),
        *(F.coalesce(d.cast("double"), F.lit(0.0)).alias(f"d{i}_") for i, d in enumerate(dims))))
    # Groups of equal texts; copies are combined before the shuffle.
    groups = materialize(rows.groupBy("g1_", "g2_").agg(F.sum("size_").alias("weight_"), *(F.min(f"d{i}_").alias(f"d{i}_") for i in range(len(dims)))))
    whole = groups.agg(F.sum("weight_").alias("w"), *(f(f"d{i}_").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("low", F.min), ("high", F.max)))).first()
    leaves = shards or max(1, math.ceil((whole["w"] or 0) / (target_bytes or 1 << 30)))
    for i in range(len(dims)):
        low, high = whole[f"low{i}"] or 0.0, whole[f"high{i}"] or 0.0
        share = (F.col(f"d{i}_") - low) / (high - low) if high > low else F.lit(0.0)
        # 30 bits of the value, then 32 of the text's hash: no two groups tie but by chance.
        groups = groups.withColumn(f"c{i}_", F.shiftleft((share * float((1 << 30) - 1)).cast("long"), 32) + F.col("g1_").bitwiseAND(F.lit(0xFFFFFFFF)))
    shard_of = _tree(groups, len(dims), leaves).select("g1_", "g2_", "shard_")
    # Equal texts in many rows are skewed on one side only, which adaptive execution splits.
    dealt = materialize(rows.select("id_", "size_", "crc_", "g1_", "g2_").join(shard_of, ["g1_", "g2_"])
                        .select("id_", "size_", "crc_", "shard_", F.xxhash64("id_", "g1_").alias("order_")))
    parts = max(1, math.ceil(dealt.count() / SLOT_ROWS))
    dealt = dealt.withColumn("part_", F.pmod("order_", F.lit(parts)))
    inside = Window.partitionBy("shard_", "part_").orderBy("id_", "order_")
    before = Window.partitionBy("shard_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard_", "part_").agg(F.count("*").alias("n_")).select("shard_", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    return dealt.withColumn("in_part_", F.row_number().over(inside) - 1).join(base, ["shard_", "part_"]).select(
        F.col("id_").alias(id_column), F.col("size_").alias("size"), F.col("crc_").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard_").cast("int").alias("shard"), (F.col("base_") + F.col("in_part_")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
