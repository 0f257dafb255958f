"""Quality rules: an isolation forest over rule statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_texts, materialize
from tessera.llm.tokens import by_bytes, distinct_pieces, split_words, texts_of

#: Bound of the labelled rows that the forest and its threshold are fitted on.
MAX_LABELLED = 20_000
TREES, TREE_SAMPLE = 100, 256

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Lengths, repeated lines and digits are left out: they vary much among good documents.
FEATURES = ["word_length", "symbol_rate", "repeat_rate", "upper_rate", "mark_rate", "bar_rate", "short_rate"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _repeated(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words that lie in a 3-word window which the same text holds twice or more."""
    n = len(at)
    covered = np.zeros(n, bool)
    if n < 3:
        return _per_text(covered, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    start = np.flatnonzero(inside)
    pair = np.unique(at[start].astype(np.int64) << 32 | at[start + 1], return_inverse=True)[1]
    triple = np.unique(pair.astype(np.int64) << 32 | at[start + 2], return_inverse=True)[1]
    order = np.argsort(triple.astype(np.int64) << 32 | owner[start], kind="stable")
    key_t, key_o = triple[order], owner[start][order]
    same = (key_t[1:] == key_t[:-1]) & (key_o[1:] == key_o[:-1])
    twice = np.zeros(len(start), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = start[order[twice]]
    for k in range(3):
        covered[hit + k] = True
    return _per_text(covered, offsets)


def statistics(texts: pa.Array) -> pd.DataFrame:
    """COUNTS and FEATURES of every whole text."""
    frames = []
    for part in by_bytes(texts, 2 << 20):
        offsets, at, words = split_words(part)
        n_words = np.diff(offsets)
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        count = lambda p: pc.count_substring_regex(part, p).to_numpy(zero_copy_only=False).astype(np.int64)
        line_offsets, line_at, lines = distinct_pieces(pc.split_pattern(part, "\n"))
        worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line_at]
        owner = np.repeat(np.arange(len(part)), np.diff(line_offsets))
        first = np.zeros(len(line_at), bool)
        first[np.unique(owner.astype(np.int64) << 32 | line_at, return_index=True)[1]] = True
        base = pd.DataFrame({
            "n_words": n_words,
            "word_chars": _per_text(chars[at] if len(at) else at, offsets),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_dup_lines": _per_text(worded & ~first, line_offsets),
            "n_repeat_words": _repeated(offsets, at),
        }).astype(np.int64)
        of_words, of_chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
        short = chars[at] <= 3 if len(at) else np.zeros(0, bool)
        frames.append(base.assign(
            word_length=base["word_chars"] / of_words, symbol_rate=base["n_symbols"] / of_words,
            repeat_rate=base["n_repeat_words"] / of_words, upper_rate=count("[A-Z]") / of_chars,
            mark_rate=count("[!?;:]") / of_words, bar_rate=count(r"[|_=~^\\{}\[\]]") / of_words,
            short_rate=_per_text(short, offsets) / of_words))
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in COUNTS + FEATURES})


def base_failed(stats: pd.DataFrame) -> np.ndarray:
    return ((stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])).to_numpy(bool)


@dataclass
class Forest:
    """Trees in arrays: feature (-1 at a leaf), split, children at 2i+1 and 2i+2, and a leaf's path
    length (depth plus the mean length of an unbuilt tree over its rows)."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    threshold: float = float("-inf")

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of every row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1))
        for tree in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth - 1):
                f = self.feature[tree][node]
                go = f >= 0
                if not go.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.value[tree][node]
                node = np.where(go, 2 * node + 1 + right, node)
            total += self.path[tree][node]
        return total / len(self.feature)


def _unbuilt(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree over n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = 7) -> Forest:
    """Isolation forest: each tree splits a random sample at random values of random features.

    Half the splits fall within the values of the node's own rows, half within the node's box,
    which starts as the range ``low`` to ``high`` of each feature. So the empty space around the
    rows is split off too, and a document in it has a short path.
    """
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(2, min(sample, len(x)))))) + 1
    size = 2 ** (depth + 1) - 1
    feature, value, path = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
    for tree in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), min(sample, len(x)), replace=False)], low, high)]
        while todo:
            node, level, rows, a, b = todo.pop()
            path[tree, node] = level + _unbuilt(len(rows))
            if level == depth or len(rows) < 2:
                continue
            p, q = (rows.min(0), rows.max(0)) if rng.random() < 0.5 else (a, b)
            if not len(open_ := np.flatnonzero(q > p)):
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(p[f], q[f])
            feature[tree, node], value[tree, node] = f, cut
            right = rows[:, f] > cut
            mid_b, mid_a = b.copy(), a.copy()
            mid_b[f] = mid_a[f] = cut
            todo += [(2 * node + 1, level + 1, rows[~right], a, mid_b), (2 * node + 2, level + 1, rows[right], mid_a, b)]
    return Forest(feature, value, path)


def _shape(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Signed logarithms of the distances to the good rows' mean in their standard deviations."""
    z = (x - centre) / scale
    return np.sign(z) * np.log1p(np.abs(z))


def fit(labelled: pd.DataFrame, min_good_kept: float = 0.99) -> tuple[Forest, np.ndarray, np.ndarray] | None:
    """Forest grown on the labelled rows of good quality; the threshold is the path length that
    parts good from bad best (a lost share of the good counts three times) among those that keep
    ``min_good_kept`` of the good rows. None without rows of both kinds."""
    labelled = labelled[~base_failed(labelled)]
    good, bad = (labelled[labelled["quality"] == q][FEATURES].to_numpy(float) for q in (1, 0))
    if not len(good) or not len(bad):
        return None
    centre, scale = good.mean(0), good.std(0) + 1e-3
    g, b = (_shape(x, centre, scale) for x in (good, bad))
    found = grow_forest(g, np.minimum(g.min(0), b.min(0)), np.maximum(g.max(0), b.max(0)))
    g, b = found.lengths(g), found.lengths(b)
    cuts = np.quantile(g, np.linspace(0, 1 - min_good_kept, 60))
    score = [(b < c).mean() - 3 * (g < c).mean() for c in cuts]
    found.threshold = float(cuts[int(np.argmax(score))])
    return found, centre, scale


def verdicts(model: tuple | None, stats: pd.DataFrame) -> np.ndarray:
    """kept: the base rules hold and the path is not shorter than the threshold."""
    kept = ~base_failed(stats)
    if model is not None and len(stats):
        found, centre, scale = model
        kept &= found.lengths(_shape(stats[FEATURES].to_numpy(float), centre, scale)) >= found.threshold
    return kept


def statistics_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    schema = ", ".join(["id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = statistics(texts_of(batch.column(1)))
            columns = [pa.array(frame[c].to_numpy(np.int64 if c in COUNTS else float)) for c in COUNTS + FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *COUNTS, *FEATURES])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def fit_on(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_column: str = "doc_id"):
    """Fit on at most ``max_labelled`` labelled rows, the first by a hash of their id."""
    known = labels.select(F.col(id_column).cast("long").alias("id"), "quality").where("quality is not null")
    chosen = known.orderBy(F.xxhash64("id"), "quality").limit(max_labelled)
    return fit(stats.join(chosen, "id").select("quality", *COUNTS, *FEATURES).toPandas())


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed, kept) of each row.

    Statistics read whole texts in one narrow pass; nothing is shuffled but the labelled rows.
    Null and empty texts have no words and fail the base rule. Without labelled rows of both
    kinds the base rules alone decide. Repeated rows get a row each, null ids too; they only
    count in the fit if a label names them.
    """
    stats = materialize(statistics_table(docs, id_column, text_column))
    model = docs.sparkSession.sparkContext.broadcast(fit_on(stats, labels, max_labelled, id_column))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["id", *COUNTS]].assign(base_failed=base_failed(frame), kept=verdicts(model.value, frame))

    schema = ", ".join(["id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean"])
    return stats.mapInPandas(judge, schema).withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, all columns as they are."""
    chosen = labels.where("quality is not null").select(F.col(id_column).alias("labelled_id_")).orderBy(F.xxhash64(F.col("labelled_id_").cast("long"))).limit(max_labelled)
    few = docs.select(id_column, text_column).join(chosen, F.col(id_column) == F.col("labelled_id_"), "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(fit_on(statistics_table(few, id_column, text_column), labels, max_labelled, id_column))

    return filter_texts(docs, lambda texts: verdicts(model.value, statistics(texts)), text_column)
