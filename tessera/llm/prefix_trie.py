"""Prefix trie of conversations by fixed-length block hashing.

A turn is a 128-bit digest of its role and text. The prefix of a conversation up to some turn is known
by the exclusive or of hashes of (place, digest): these can be taken in any order, so prefixes at block
borders come from two short running totals, not from a walk along a conversation. Conversations are
grouped by whole blocks of turns first: a *variant* is a block together with all that stands before it.
Where the variants after one prefix differ, they, and not the conversations, are taken apart to turns and
grouped again; where there is one variant, its turns are nodes as they stand.

Sums over a node's subtree are sums over its members: each node belongs to its smallest member, and a
member's own nodes are the end of its path. So nothing goes up the trie level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

BLOCK_TURNS = 8
#: Blocks of a conversation whose running totals one window task makes.
BLOCKS_AT_ONCE = 64
#: Bytes of joined ids that one row of the last step holds.
ENDS_BYTES = 1 << 16

_VARIANT = ["k", "p1", "p2", "e1", "e2", "n"]
_NODE = ["depth", "q1", "q2"]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over the role's length, the role and the text; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def number_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): places from 1 in the order of ``turn`` (null first); turns of one
    number in the order of their digests.

    Rows are dealt by ranges of (conversation, turn), so a very long conversation lies in many
    partitions, and numbered within a range; counts of the ranges before are added. Texts stay behind.
    """
    spark = conversations.sparkSession
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"))  # parts repeated rows
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "salt"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(turns.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "conv")
    sizes = dealt.groupBy("part", "conv").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", "conv", F.coalesce(before, F.lit(0)).alias("before"))
    local = dealt.withColumn("local", F.row_number().over(inside.orderBy(*order[1:])))
    return local.join(sizes, ["part", "conv"]).select("conv", (F.col("before") + F.col("local")).alias("pos"), "digest", "chars")


def graft_heads(turns: DataFrame, convs: DataFrame, head: Column, base: Column, longest_head: int) -> DataFrame:
    """Each conversation with its first ``head`` turns replaced by as many of conversation ``base`` (all
    if that has fewer, none if there is none). ``convs`` has one row for each conversation; ``head`` and
    ``base`` are expressions over its column ``conv``."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size"))
    shape = convs.select("conv", head.cast("long").alias("head"), base.alias("base"))
    shape = materialize(shape.join(sizes.toDF("base", "size"), "base", "left").select(
        "conv", "base", "head", F.least("head", F.coalesce("size", F.lit(0))).alias("given")))
    heads = turns.where(F.col("pos") <= longest_head).withColumnRenamed("conv", "base")
    given = shape.join(heads, "base").where("pos <= head").select("conv", "pos", "digest", "chars")
    own = turns.join(shape, "conv").where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "digest", "chars")
    return given.unionByName(own)


def block_members(turns: DataFrame) -> DataFrame:
    """One row for each conversation and block: hashes of the prefix before (p) and after it (e), code
    points before it, whether it is the last, and its turns."""
    turns = turns.select("conv", "pos", "chars", F.expr(f"(pos - 1) div {BLOCK_TURNS}").alias("k"),
                         F.xxhash64("pos", "digest").alias("x1"), F.xxhash64(F.lit("second"), "digest", "pos").alias("x2"))
    blocks = materialize(turns.groupBy("conv", "k").agg(
        F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("chars").alias("size"), F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "x1", "x2", "chars"))).alias("turns")).withColumn("run", F.expr(f"k div {BLOCKS_AT_ONCE}")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    def running(w, one, two, size):  # noqa: E306
        return (F.coalesce(F.bit_xor(one).over(before(w)), F.lit(0)), F.coalesce(F.bit_xor(two).over(before(w)), F.lit(0)), F.coalesce(F.sum(size).over(before(w)), F.lit(0)))

    runs = blocks.groupBy("conv", "run").agg(F.bit_xor("b1").alias("r1"), F.bit_xor("b2").alias("r2"), F.sum("size").alias("rs"), F.max("k").alias("top"))
    one, two, size = running(Window.partitionBy("conv").orderBy("run"), "r1", "r2", "rs")
    runs = runs.select("conv", "run", one.alias("o1"), two.alias("o2"), size.alias("os"), F.max("top").over(Window.partitionBy("conv")).alias("last_k"))
    one, two, size = running(Window.partitionBy("conv", "run").orderBy("k"), "b1", "b2", "size")
    local = blocks.select("*", one.alias("l1"), two.alias("l2"), size.alias("ls"))
    p1, p2 = F.col("l1").bitwiseXOR(F.col("o1")), F.col("l2").bitwiseXOR(F.col("o2"))
    return materialize(local.join(runs, ["conv", "run"]).select(
        "conv", "k", "n", "size", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("b1")).alias("e1"), p2.bitwiseXOR(F.col("b2")).alias("e2"),
        (F.col("ls") + F.col("os")).alias("pre"), (F.col("k") == F.col("last_k")).cast("long").alias("last"), "turns"))


def nodes_of(members: DataFrame, measures: list[str]) -> DataFrame:
    """Nodes of depth 1 or more from (conversation, block) rows; ``measures`` are summed over members."""
    sums = lambda names: [F.sum(m).alias(m) for m in names]
    variants = materialize(members.groupBy(*_VARIANT).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.sum("last").alias("n_ends"), F.min("pre").alias("pre"), F.any_value("turns").alias("turns"), *sums(measures)))
    siblings = variants.groupBy("k", "p1", "p2").agg(F.count("*").alias("siblings"))
    variants = variants.join(siblings, ["k", "p1", "p2"])

    def so_far(start: str, field: str, end: Column) -> Column:
        join = (lambda a, t: a + t[field]) if field == "chars" else (lambda a, t: a.bitwiseXOR(t[field]))
        return F.aggregate(F.slice("turns", F.lit(1), end), F.col(start), join)

    turns = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(
        (F.col("k") * BLOCK_TURNS + i).alias("depth"), so_far("p1", "x1", i).alias("q1"), so_far("p2", "x2", i).alias("q2"), so_far("p1", "x1", i - 1).alias("r1"),
        so_far("p2", "x2", i - 1).alias("r2"), so_far("pre", "chars", i - 1).alias("pre"), F.get("turns", i - 1)["chars"].alias("chars"), (i == F.col("n")).alias("top")))
    same = ["depth", "q1", "q2", "r1", "r2", "pre", "chars"]
    taken = variants.select("siblings", "conv", "n_convs", "n_ends", *measures, F.explode(turns).alias("t")).select(
        "siblings", *(F.col(f"t.{c}").alias(c) for c in same), "conv", "n_convs", F.when(F.col("t.top"), F.col("n_ends")).otherwise(0).alias("n_ends"), *measures)
    straight = taken.where("siblings = 1").drop("siblings")
    parted = taken.where("siblings > 1").groupBy(*same).agg(F.min("conv").alias("conv"), *sums(["n_convs", "n_ends", *measures]))
    return materialize(straight.unionByName(parted))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, q1, q2, ends_sha256) over the ids that end there, ascending, joined by commas.

    Ids are put in order over ranges, joined to pieces of text there, and the pieces of a node stream
    through one hash: SHA-256 is sequential, so a node's bytes meet in one task, but never in memory.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, texts, size = None, None, [], 0
        rows: list[tuple] = []
        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key or size > ENDS_BYTES:
                    if texts:
                        rows.append((*key, first, ",".join(texts)))
                    key, first, texts, size = own, conv, [], 0
                texts.append(str(conv))
                size += len(texts[-1]) + 1
            if rows:
                yield packed(rows, [*_NODE, "first", "text"])
                rows = []
        if texts:
            yield packed([(*key, first, ",".join(texts))], [*_NODE, "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        rows: list[tuple] = []
        for batch in batches:
            for *own, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if rows:
                yield packed(rows, [*_NODE, "ends_sha256"])
                rows = []
        if state is not None:
            yield packed([(*key, state.hexdigest())], [*_NODE, "ends_sha256"])

    def packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    keys = "depth long, q1 long, q2 long"
    pieces = ends.select(*_NODE, "conv").repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv").mapInArrow(join, f"{keys}, first long, text string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, f"{keys}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each
    distinct prefix, the empty one (depth 0) included.

    ``turns`` has (conv, pos, digest, chars) with places 1, 2, ... in each conversation, as
    ``number_turns`` and ``graft_heads`` return them; ``convs`` one row for each conversation (column conv),
    those without turns included. A node is named by its smallest member and its depth. Conversations
    without turns are members of the root alone. Empty tables: no row, not even a root. Conversations
    of any length are taken whole. Equal conversations share all their nodes.
    """
    members = block_members(turns)
    first = nodes_of(members, [])
    owned = first.groupBy("conv").agg(F.sum("chars").alias("own"), F.max((F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaf"))
    total = members.groupBy("conv").agg(F.sum("size").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = materialize(convs.select("conv").join(total, "conv", "left").join(owned, "conv", "left").select("conv", F.col("total").isNull().cast("long").alias("bare"), zero("total"), zero("own"), zero("leaf")))

    nodes = nodes_of(members.join(known.drop("bare"), "conv"), ["total", "own", "leaf"])
    root = known.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("total", "own", "leaf")), F.sum("bare").alias("n_ends")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in ("depth", "q1", "q2", "pre", "chars")), *(F.lit(None).cast("long").alias(c) for c in ("r1", "r2")),
                       "conv", "n_convs", "n_ends", "total", "own", F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(F.col("leaf")).alias("leaf"))
    nodes = materialize(nodes.unionByName(root))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("r1").alias("q1"), F.col("r2").alias("q2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("r1"), F.col("q2").alias("r2"), F.col("conv").alias("parent_conv_id"))
    last = members.where("last = 1").select((F.col("k") * BLOCK_TURNS + F.col("n")).alias("depth"), F.col("e1").alias("q1"), F.col("e2").alias("q2"), "conv")
    zeros = [F.lit(0).cast("long").alias(c) for c in _NODE]
    hashes = ends_hashes(last.unionByName(known.where("bare = 1").select(*zeros, "conv")))
    owner = known.select("conv", F.col("total").alias("owner_total"), F.col("own").alias("owner_own"))
    # Summed over the subtree: members times code points, less code points of the distinct nodes.
    paid = F.col("total") - F.col("n_convs") * F.col("pre")
    distinct = F.col("own") - F.col("owner_own") + F.col("owner_total") - F.col("pre")
    return (nodes.join(parents, ["depth", "r1", "r2"], "left").join(children, _NODE, "left").join(hashes, _NODE, "left").join(owner, "conv")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaf").alias("n_leaves"),
                    (paid - distinct).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


#: CRC-32 of the decimal id by its defining polynomial; the rest as the definition of the trie says.
PREFIX_TRIE_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i::UBIGINT AS v, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % 100 AS base,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INTEGER + 1]))) % 6 AS h
  FROM ids, tab),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
given AS (SELECT h.c, t.pos, t.chars, t.d FROM heads h JOIN turns t ON t.c = h.base AND t.pos <= h.h),
n_given AS (SELECT c, count(*) AS m FROM given GROUP BY c),
built AS (
  SELECT * FROM given
  UNION ALL
  SELECT t.c, t.pos - h.h + coalesce(m, 0), t.chars, t.d FROM turns t JOIN heads h ON h.c = t.c LEFT JOIN n_given g ON g.c = t.c WHERE t.pos > h.h),
paths AS (
  SELECT c, pos AS depth, chars, string_agg(d, '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path,
         pos = max(pos) OVER (PARTITION BY c) AS ends FROM built
  UNION ALL
  SELECT c, 0, 0, '', c NOT IN (SELECT c FROM built) FROM ids),
nodes AS (
  SELECT sha256(path) AS node, CASE WHEN depth > 0 THEN sha256(left(path, length(path) - 64)) END AS parent, depth, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
kids AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node),
up AS (
  SELECT node AS top, node, parent, saved, n_children FROM full_nodes
  UNION ALL
  SELECT p.node, u.node, p.parent, u.saved, u.n_children FROM up u JOIN full_nodes p ON p.node = u.parent),
sums AS (SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.top = n.node LEFT JOIN full_nodes p ON p.node = n.parent
"""
