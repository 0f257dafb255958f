"""Katz backoff n-gram model: tables of counts and backoff weights, made and looked up by exchanges of keys.

A *block* is a run of documents with its words numbered. For every distinct n-gram of a block one
64-bit key goes to the partition of the model's table that owns it, however often the block holds it,
so an n-gram of a third of all documents is a row per block there. The answer comes back as plain
numbers in the order of the keys asked for. Steps:

1. documents -> blocks (written table), numbered by their place;
2. keys of all orders with training counts -> totals: the model's table ``grams``, and the totals for
   the blocks that asked (both written);
3. each block evaluates its tokens: the discounted estimate of the highest order that was seen, to
   be multiplied by the weights of the contexts backed off from. An n-gram's first asker also adds
   its discounted count and its lower-order probability to its context;
4. contexts are summed by key, which gives the exact backoff weights: the model's table ``weights``.
   Texts with unseen n-grams (held-out ones alone, as all others were counted) are joined with the
   weights that they need: one for each order that their tokens back off from.

``score_stored`` looks other texts up in the stored tables; nothing is counted again.

Good-Turing: counts r of up to K are discounted by d_r from the counts of counts of their order,
larger ones are not. Each context counts UNSEEN of an unseen event more than it was seen, so that its
backoff weight is never zero. Order 1: additive estimate (c + 0.1) / (N + 0.1 (V + 1)), which sums to
one over the V training words and one unknown word.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir, write_table
from tessera.llm.tokens import by_bytes, split_words, texts_of

K = 5
SMOOTH = 0.1
UNSEEN = 0.1
#: Text of a block: about 1.6 million words, some 120 MB in a worker. Larger blocks repeat fewer keys.
BLOCK_BYTES = 10 << 20
#: Every HELD_OUT-th document, by the CRC of its id, is not trained on.
HELD_OUT = 10

BLOCK_SCHEMA = "block long, ids array<long>, lens array<int>, train array<boolean>, words array<long>, tokens binary"
#: Order of the registered query's model.
ORDER = 2


def _digest(value: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value)


#: No word holds white space, so these are not words.
START, END = b"\n<start>", b"\n<end>"


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their four byte planes: the upper ones are mostly zero and compress away."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def blocks_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents in blocks: token numbers of each text with the end token last, and the hashes of
    the block's words (the end token is the last of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32  # fixed by the written table
        for batch in batches:
            done = 0
            for part in by_bytes(texts_of(batch.column(1)), BLOCK_BYTES):
                number, place = place, place + 1
                offsets, at, words = split_words(pc.ascii_lower(part))
                # Numbered by frequency: small numbers for most tokens.
                order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
                number_of = np.empty(len(words), np.int64)
                number_of[order] = np.arange(len(words))
                at, names = number_of[at], words.take(pa.array(order)).to_pylist()
                hashes = np.fromiter((_digest(w.encode("utf-8")) for w in names), np.uint64, len(names))
                hashes = np.append(hashes, np.uint64(_digest(END)))
                tokens = np.insert(at, offsets[1:], len(names))
                ids = batch.column(0).slice(done, len(part))
                names_of = ["" if i is None else str(i) for i in ids.to_pylist()]
                train = [zlib.crc32(i.encode()) % HELD_OUT != 0 for i in names_of]
                row = [[number], [ids.to_pylist()], [(np.diff(offsets) + 1).astype(np.int32)], [train], [hashes.view(np.int64)], [_planes(tokens)]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])
                done += len(part)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A block's tokens and its distinct n-grams of each order up to ``order``; the same for each step.

    grams[n - 1] is each token's n-gram, as a number; context[n - 1] and suffix[n - 1] are each
    n-gram's context and the shorter n-gram with the same last word, both as numbers of order n - 1. A
    text's first token has as context a number of its own, after all others.
    """

    def __init__(self, lens, train, words, tokens, order: int):
        self.lens = np.asarray(lens, np.int64)
        self.train = np.asarray(train, bool)
        hashes = np.asarray(words, np.int64).view(np.uint64)
        self.tokens = _from_planes(tokens)
        self.in_train = np.repeat(self.train, self.lens)
        self.starts = np.cumsum(self.lens) - self.lens
        self.end = len(hashes) - 1
        self.grams, self.keys, self.context, self.suffix, self.last = [self.tokens], [hashes], [None], [None], [np.arange(len(hashes), dtype=np.int32)]
        for n in range(2, order + 1):
            before, keys = self.grams[-1], self.context_keys(n)
            context = np.empty_like(before)
            context[1:] = before[:-1]
            context[self.starts] = len(keys) - 1
            own, at, gram = np.unique(context.astype(np.int64) << 32 | self.tokens, return_index=True, return_inverse=True)
            self.context.append((own >> 32).astype(np.int32))
            self.suffix.append(before[at])
            self.last.append(self.tokens[at])
            self.grams.append(gram.astype(np.int32))
            self.keys.append(pair_keys(keys[self.context[-1]], hashes[self.last[-1]]))

    def context_keys(self, n: int) -> np.ndarray:
        """Keys of the contexts of order n; the last is that of a text's start."""
        return np.append(self.keys[n - 2], np.uint64(_digest(START)))

    def train_counts(self, n: int) -> np.ndarray:
        return np.bincount(self.grams[n - 1][self.in_train], minlength=len(self.keys[n - 1]))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts keys of a bucket together, and where each bucket begins."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def _rows(size: int, block: int, keys: np.ndarray, buckets: int, values: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that holds a key: keys and values as lists."""
    order, begins = _dealt(keys, buckets)
    some = np.flatnonzero(np.diff(begins))
    offsets = pa.array(np.append(begins[some], begins[-1]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (keys.view(np.int64), *values)]
    n = len(some)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(some.astype(np.int32)), pa.array(np.full(n, block, np.int64)), *lists],
                                      ["n", "bucket", "block", "keys", *(f"v{i}" for i in range(len(values)))])


def _answers(frame: pd.DataFrame, column: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Answers in the order of ``keys``."""
    frame = frame.sort_values("bucket")
    order, _ = _dealt(keys, buckets)
    got = np.concatenate([*frame[column], []]) if len(frame) else np.zeros(0)
    out = np.empty(len(keys), got.dtype)
    out[order] = got
    return out


def discounts(n: dict[int, int], k: int = K) -> np.ndarray:
    """d_0 (unused) to d_k from the counts of counts. Where they are too sparse for Good-Turing to
    give values in (0, 1], a smaller k is taken, and for k = 0 one absolute discount."""
    for top in range(k, 0, -1):
        if not all(n.get(r, 0) for r in range(1, top + 2)):
            continue
        rest = (top + 1) * n[top + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest < 1 else 2.0 for r in range(1, top + 1)]
        if all(0 < x <= 1 for x in d):
            return np.array([0.0, *d])
    one, two = n.get(1, 0), n.get(2, 0)
    absolute = one / (one + 2 * two) if one and two else 0.5
    return np.array([0.0, *((r - absolute) / r for r in range(1, k + 1))])


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


EVALUATED = ("kind int, block long, place long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
             "n int, context long, seen double, lower double, count long")
#: Kinds of its rows: texts, contexts with their sums, and contexts that a text backs off from.
_TEXT, _CONTEXT, _BACKED = 0, 1, 2


@dataclass(frozen=True)
class Totals:
    """What is known of the whole training corpus: texts, tokens, distinct words, and the discounts of each
    order from 2 on. ``buckets`` of the table of n-grams."""

    order: int
    buckets: int
    texts: int
    tokens: int
    words: int
    discounts: list[list[float]]


def evaluate(own: Block, number: int, ids, counts: list[np.ndarray], first: list[np.ndarray] | None, totals: Totals) -> pd.DataFrame:
    """Rows of EVALUATED for a block; ``counts`` are those of the corpus for each order's n-grams. ``first``
    tells for which of them this block adds up the context."""
    floor = totals.tokens + SMOOTH * (totals.words + 1)
    lower = (counts[0] + SMOOTH) / floor
    base = np.log10(lower)
    score, frames, unseen = base, [], []
    for n in range(2, totals.order + 1):
        d, c = np.asarray(totals.discounts[n - 2]), counts[n - 1]
        of_context = np.append(counts[n - 2], totals.texts)
        of_context[:-1][own.last[n - 2] == own.end] = 0  # nothing follows the end of a text
        seen = _discounted(c, d)
        size = of_context[own.context[n - 1]]
        shorter = own.suffix[n - 1]
        if first is not None:
            add, places = first[n - 1] & (c > 0), len(of_context)
            sums = [np.bincount(own.context[n - 1][add], weights=w, minlength=places) for w in (seen[add], lower[shorter[add]])]
            some = np.flatnonzero(sums[0])
            frames.append(_frame(some.size, {"kind": _CONTEXT, "n": n, "context": own.context_keys(n)[some].view(np.int64), "seen": sums[0][some], "lower": sums[1][some], "count": of_context[some]}, number))
        known = c > 0
        lower = np.where(known, seen / (size + UNSEEN), 0.0)  # contexts are only summed over what was seen
        score = np.where(known, np.log10(np.where(known, lower, 1.0)), score[shorter])
        # A context that was never seen has the weight 1.
        off = (~known & (size > 0))[own.grams[n - 1]]
        if off.any():
            place = np.repeat(np.arange(len(own.lens)), own.lens)[off]
            at, times = np.unique(place << 32 | own.context[n - 1][own.grams[n - 1][off]], return_counts=True)
            unseen.append(_frame(at.size, {"kind": _BACKED, "n": n, "place": at >> 32, "context": own.context_keys(n)[at & 0xFFFFFFFF].view(np.int64), "count": times}, number))
    of_text = lambda x: np.add.reduceat(x, own.starts)
    texts = _frame(len(own.lens), {
        "kind": _TEXT, "place": np.arange(len(own.lens)), "id": pd.array([None if i is None or i != i else int(i) for i in ids], dtype="Int64"), "held_out": ~own.train, "n_tokens": own.lens,
        "n_known": of_text((counts[0][own.tokens] > 0).astype(np.int64)), "base_score": of_text(base[own.tokens]), "score": of_text(score[own.grams[-1]])}, number)
    return pd.concat([texts, *frames, *unseen], ignore_index=True)


def _frame(n: int, values: dict, number: int) -> pd.DataFrame:
    """``n`` rows of EVALUATED with zeros where there are no values: no column turns into objects."""
    kinds = {"int": np.int32, "long": np.int64, "double": float, "boolean": bool}
    columns = dict(c.split() for c in EVALUATED.split(", "))
    zeros = {c: np.zeros(n, kinds[k]) for c, k in columns.items() if c not in ("id", "block")}
    full = zeros | {"id": pd.array(np.zeros(n, np.int64), dtype="Int64"), "block": np.full(n, number, np.int64)}
    full |= {c: np.full(n, v, kinds[columns[c]]) if np.isscalar(v) else v for c, v in values.items()}
    return pd.DataFrame({c: full[c] for c in columns})


def _asked(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(n, bucket, block, keys, v0): the blocks' distinct n-grams with their training counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, *parts = (batch.column(i)[row] for i in range(5))
                own = Block(*(p.values.to_numpy(zero_copy_only=False) for p in parts[:3]), parts[3].as_buffer(), order)
                for n in range(1, order + 1):
                    yield _rows(n, number.as_py(), own.keys[n - 1], buckets, [own.train_counts(n).astype(np.int32)])

    return blocks.select("block", "lens", "train", "words", "tokens").mapInArrow(ask, "n int, bucket int, block long, keys array<long>, v0 array<int>")


def _evaluated(blocks: DataFrame, counted: DataFrame, totals: Totals, adding: bool) -> DataFrame:
    """counted: (n, bucket, block, counts), counts being 2 c, plus 1 for the first asker."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        own = Block(row["lens"], row["train"], row["words"], row["tokens"], totals.order)
        got = [_answers(right[right["n"] == n], "counts", own.keys[n - 1], totals.buckets).astype(np.int64) for n in range(1, totals.order + 1)]
        return evaluate(own, row["block"], row["ids"], [g // 2 for g in got], [g % 2 == 1 for g in got] if adding else None, totals)

    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(run, EVALUATED)


def _scored(evaluated: DataFrame, weights: DataFrame, totals: Totals, id_column: str) -> DataFrame:
    backed = (evaluated.where(f"kind = {_BACKED}").select("block", "place", "n", "context", F.col("count").alias("times")).join(weights, ["n", "context"])
              .groupBy("block", "place").agg(F.sum(F.col("times") * F.col("weight")).alias("backed")))
    scored = evaluated.where(f"kind = {_TEXT}").join(backed, ["block", "place"], "left").select(
        "id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"))
    return scored.withColumnRenamed("id", id_column)


def score_texts(docs: DataFrame, order: int = ORDER, k: int = K, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; the model's tables
    are left at ``path`` (a new shared folder if none is given).

    Trained on the rows whose crc32(id as text) mod 10 is not 0 (a null id counts as an empty text:
    held out). Tokens: ASCII lower-cased words and one end token. Null and empty texts: the end
    token alone. Texts of any length are scored whole. Repeated rows count as often as they occur, and
    get a row each. An empty table gives no rows; with nothing to train on both scores are those of
    the unknown word. Other columns do not matter. Logarithms to base 10.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    blocks = materialize(blocks_of(docs, id_column, text_column), max_records=1)
    n_blocks, texts = blocks.select(F.count("*"), F.coalesce(F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0))).first()
    buckets = max(1, 2 * n_blocks)

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        keys, n = (np.concatenate(frame[c].to_list()) for c in ("keys", "v0"))
        own, first, at = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=n, minlength=len(own)).astype(np.int64)
        answer = 2 * counts[at]
        answer[first] += 1  # the first asker adds the key up for all
        cut = np.cumsum([len(x) for x in frame["keys"]])[:-1]
        few = np.bincount(counts[(counts > 0) & (counts <= k + 1)], minlength=k + 2)
        known = counts > 0
        rows = len(frame)
        return pd.DataFrame({  # an answer for each block, the table's rows, and the sums
            "kind": [*["answers"] * rows, "grams", "sums"], "n": key[0], "bucket": key[1], "block": pd.array([*frame["block"], None, None], dtype="Int64"), "keys": [*[None] * rows, own[known], None],
            "counts": [*np.split(answer, cut), counts[known], np.append(few[1:k + 2], [counts.sum(), known.sum()])]})

    write_table(_asked(blocks, order, buckets).groupBy("n", "bucket").applyInPandas(total, "kind string, n int, bucket int, block long, keys array<long>, counts array<long>"), f"{path}/counted", by=["kind"])
    counted = spark.read.schema("n int, bucket int, block long, keys array<long>, counts array<long>, kind string").parquet(f"{path}/counted") if n_blocks else spark.createDataFrame([], "n int, bucket int, block long, keys array<long>, counts array<long>, kind string")
    # k + 3 sums for each order.
    sums = {(r["n"], r["r"]): r["c"] for r in counted.where("kind = 'sums'").select("n", F.posexplode("counts").alias("r", "c")).groupBy("n", "r").agg(F.sum("c").alias("c")).collect()}
    found = [discounts({r: sums.get((n, r - 1), 0) for r in range(1, k + 2)}, k).tolist() for n in range(2, order + 1)]
    totals = Totals(order, buckets, int(texts), int(sums.get((1, k + 1), 0)), int(sums.get((1, k + 2), 0)), found)
    spark.createDataFrame([(json.dumps(asdict(totals)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/totals")
    evaluated = materialize(_evaluated(blocks, counted.where("kind = 'answers'").select("n", "bucket", "block", "counts"), totals, adding=True))
    contexts = evaluated.where(f"kind = {_CONTEXT}").groupBy("n", "context").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"), F.max("count").alias("count"))
    rest = 1 - F.col("seen") / (F.col("count") + UNSEEN)
    write_table(contexts.select("n", "context", F.log10(rest / F.greatest(1 - F.col("lower"), F.lit(1e-300))).alias("weight")), f"{path}/weights")
    return _scored(evaluated, spark.read.schema("n int, context long, weight double").parquet(f"{path}/weights"), totals, id_column)


def score_stored(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of score_texts for any texts by the tables at ``path``; held_out tells which texts would
    not have been trained on. Odd input as there."""
    spark = docs.sparkSession
    totals = Totals(**json.loads(spark.read.text(f"{path}/totals").first()[0]))
    blocks = materialize(blocks_of(docs, id_column, text_column), max_records=1)
    grams = spark.read.schema("n int, bucket int, keys array<long>, counts array<long>, kind string").parquet(f"{path}/counted").where("kind = 'grams'").select("n", "bucket", "keys", "counts")

    def look(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"n": [], "bucket": [], "block": [], "counts": []})
        keys, counts = (np.concatenate([*table[c], np.zeros(0, np.int64)]).astype(np.int64) for c in ("keys", "counts"))
        wanted = np.concatenate(asked["keys"].to_list())
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys, wanted, sorter=order), max(0, len(keys) - 1))
        found = np.zeros(len(wanted), np.int64)
        if len(keys):
            hit = keys[order[at]] == wanted
            found[hit] = 2 * counts[order[at[hit]]]
        cut = np.cumsum([len(x) for x in asked["keys"]])[:-1]
        return asked[["n", "bucket", "block"]].assign(counts=np.split(found, cut))

    asked = _asked(blocks, totals.order, totals.buckets).select("n", "bucket", "block", "keys")
    counted = materialize(asked.groupBy("n", "bucket").cogroup(grams.groupBy("n", "bucket")).applyInPandas(look, "n int, bucket int, block long, counts array<long>"))
    evaluated = materialize(_evaluated(blocks, counted, totals, adding=False))
    return _scored(evaluated, spark.read.schema("n int, context long, weight double").parquet(f"{path}/weights"), totals, id_column)
