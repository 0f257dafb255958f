"""Benchmark decontamination: item-sized windows, counts of shared shingles, exact check.

For every size (in words) that a benchmark item has, a window of that size slides over each text.
A window is as similar to an item as the weighted Jaccard similarity of their five-word shingles
(weight: number of occurrences). Similar ones have a number of shingles in common that follows from
the threshold; windows with fewer shingles of items of their size, and items with fewer in a
window, are left out, and the others compared exactly. So everything at the threshold is found.

A SimHash of each window (sum of the bits of its shingles) gives the ``bits`` of the result. With a
``radius`` only windows whose fingerprint is that near are reported; for those the item fingerprints
can be looked up by four 16-bit blocks (``within``): fingerprints at most 15 bits apart agree up to
3 bits in one block at least.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_texts
from tessera.llm.tokens import by_bytes, distinct_pieces, texts_of

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 15
#: Bounds of what is broadcast at once; a larger benchmark goes over the corpus in several blocks.
MAX_ITEMS, MAX_BYTES = 4096, 16 << 20

_BLOCKS, _BITS = 4, 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text and a 64-bit hash of each word: runs of letters and digits, lower case."""
    import xxhash

    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\p{M}]+", " ")
    offsets, at, words = distinct_pieces(pc.split_pattern(plain, " "))
    names = words.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    if "" in names:
        keep = at != names.index("")
        offsets, at = np.concatenate(([0], np.cumsum(keep)))[offsets], at[keep]
    return offsets, hashes[at] if len(at) else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each place on."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k:k + n]) * _ODD[k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _simhash(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits(2 * sums > counts[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


class BenchmarkIndex:
    """Items by size, the shingles of each size, and the block index of all fingerprints."""

    def __init__(self, items: list[tuple[int, str]], radius: int | None = RADIUS):
        self.radius = radius
        offsets, words = word_hashes(pa.array([t or "" for _, t in items], pa.large_string()))
        self.items, self.bags, prints, self.sizes = [], [], [], []
        for (item, _), low, high in zip(items, offsets[:-1], offsets[1:], strict=True):
            if high == low:
                continue  # no words: matches nothing
            bag = shingles(words[low:high], min(SHINGLE_WORDS, high - low))
            self.items.append(item)
            self.bags.append(bag)
            self.sizes.append(int(high - low))
            prints.append(_simhash(_bits(bag).sum(0, dtype=np.int64)[None], np.array([len(bag)]))[0])
        self.prints = np.array(prints, np.uint64)
        sizes = np.array(self.sizes, np.int64)
        self.classes = np.unique(sizes)
        self.known = {int(s): np.unique(np.concatenate([b for b, n in zip(self.bags, self.sizes, strict=True) if n == s])) for s in self.classes}
        self.all_known = np.unique(np.concatenate([*self.known.values(), np.zeros(0, np.uint64)]))
        #: Of each size: its shingles, and the items that hold each of them.
        self.holders = {}
        for n in self.classes.tolist():
            pairs = [(np.unique(b), i) for i, (b, size) in enumerate(zip(self.bags, self.sizes, strict=True)) if size == n]
            names, owner = np.concatenate([b for b, _ in pairs]), np.concatenate([np.full(len(b), i, np.int32) for b, i in pairs])
            order = np.argsort(names, kind="stable")
            self.holders[n] = names[order], owner[order]
        self.index = []
        if radius is None:
            return
        # Up to floor(radius / 4) bits from an item's block: keys (size class, block value).
        flips = [0]
        for n in range(1, radius // _BLOCKS + 1):
            flips += [sum(1 << b for b in c) for c in itertools.combinations(range(_BITS), n)]
        masks = np.array(flips, np.uint64)
        of_class = np.searchsorted(self.classes, sizes).astype(np.uint64)
        for block in range(_BLOCKS):
            keys = (of_class[:, None] << np.uint64(_BITS) | (self._block(self.prints, block)[:, None] ^ masks[None])).reshape(-1)
            owner = np.repeat(np.arange(len(self.items), dtype=np.int32), len(masks))
            order = np.argsort(keys, kind="stable")
            self.index.append((keys[order], owner[order]))

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> np.uint64(block * _BITS)) & np.uint64((1 << _BITS) - 1)

    def within(self, prints: np.ndarray, size_class: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item of its class) of at most ``radius`` different bits: all of them."""
        windows, found = [], []
        for block, (keys, owner) in enumerate(self.index):
            wanted = np.uint64(size_class << _BITS) | self._block(prints, block)
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            n = high - low
            windows.append(np.repeat(np.arange(len(prints)), n))
            found.append(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        w, i = np.concatenate(windows), np.concatenate(found)
        near = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        pairs = np.unique(w[near] * np.int64(len(self.items)) + i[near])
        return pairs // max(1, len(self.items)), pairs % max(1, len(self.items))

    def search(self, offsets: np.ndarray, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, bits, similarity): the best window of each pair."""
        best: dict[tuple[int, int], tuple] = {}
        by_shingle: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in self.classes.tolist():
            k = min(SHINGLE_WORDS, size)
            if k not in by_shingle:
                h = shingles(words, k)
                low = np.searchsorted(self.all_known, h)
                hit = np.flatnonzero(self.all_known[np.minimum(low, len(self.all_known) - 1)] == h)
                text = np.searchsorted(offsets, hit, "right") - 1
                inside = hit + k <= offsets[text + 1]
                by_shingle[k] = h, hit[inside]
            h, hits = by_shingle[k]
            own = hits[np.isin(h[hits], self.known[size])]
            if not len(own):
                continue
            text = np.searchsorted(offsets, own, "right") - 1
            first = np.maximum(own - (size - k), offsets[text])
            last = np.maximum(np.minimum(own, offsets[text + 1] - size), offsets[text])  # a shorter text is one window
            first = np.minimum(first, last)
            n = last - first + 1
            starts = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            text = np.searchsorted(offsets, starts, "right") - 1
            counts = np.minimum(size, offsets[text + 1] - starts) - k + 1
            least = threshold / (1 + threshold) * (counts + size - k + 1) - 1e-9  # shingles in common
            full = np.searchsorted(own, starts + counts) - np.searchsorted(own, starts) >= least
            starts, counts, text, least = starts[full], counts[full], text[full], least[full]
            for at in range(0, len(starts), 1 << 16):
                own_part = slice(at, at + (1 << 16))
                self._windows(h, starts[own_part], counts[own_part], text[own_part], least[own_part], offsets, size, k, threshold, best)
        return [(t, self.items[i], *rest) for (t, i), rest in sorted(best.items())]

    def _windows(self, h, starts, counts, text, least, offsets, size, k, threshold, best) -> None:
        names, owner = self.holders[size]
        for start, count, place, need in zip(starts.tolist(), counts.tolist(), text.tolist(), least.tolist(), strict=True):
            bag = h[start:start + count]
            low, high = np.searchsorted(names, bag, "left"), np.searchsorted(names, bag, "right")
            n = high - low
            items, shared = np.unique(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_counts=True)
            for i in items[shared >= need].tolist():
                alike = similarity(bag, self.bags[i])
                key = place, i
                if alike >= threshold and alike > best.get(key, (0,) * 4)[3]:
                    own = _simhash(_bits(bag).sum(0, dtype=np.int64)[None], np.array([count]))[0]
                    bits = int(np.bitwise_count(own ^ self.prints[i]))
                    if self.radius is None or bits <= self.radius:
                        best[key] = start - int(offsets[place]), count + k - 1, bits, alike


def _indexes(benchmark: DataFrame, item_column: str, text_column: str, radius: int | None, max_items: int) -> Iterator[BenchmarkIndex]:
    """Indexes of bounded blocks of the benchmark."""
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text")).where("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / max_items), math.ceil(size / MAX_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        yield BenchmarkIndex([tuple(r) for r in rows], radius)


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = MIN_SIMILARITY, radius: int | None = None,
                   max_items: int = MAX_ITEMS, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(id, item_id, word_start, n_words, bits, similarity): each text that holds a window at least
    ``threshold`` similar to an item, with its best window: all of them, or with a ``radius`` those
    of at most so many bits between the fingerprints.

    Narrow over the documents. Words are runs of letters and digits, lower-cased. Items of under
    five words are one shingle; items and texts without words match nothing; a text shorter than
    an item is one window. Repeated rows and items yield their own rows. Null texts: no rows.
    """
    found = None
    for index in _indexes(benchmark, item_column, text_column, radius, max_items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in by_bytes(texts_of(batch.column(1)), 4 << 20):
                    rows = sent.value.search(*word_hashes(part), threshold) if len(sent.value.items) else []
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    ids = batch.column(0).take(pa.array([at + t for t in cols[0]], pa.int64()))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))],
                        ["id", "item_id", "word_start", "n_words", "bits", "similarity"])
                    at += len(part)

        source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        rows = source.mapInArrow(run, "id long, item_id long, word_start long, n_words long, bits int, similarity double")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumnRenamed("id", id_column)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = MIN_SIMILARITY, radius: int | None = None,
                      max_items: int = MAX_ITEMS, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without a window like an item, all columns as they are."""
    for index in _indexes(benchmark, item_column, text_column, radius, max_items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(texts: pa.Array, sent=sent) -> np.ndarray:
            flags = np.ones(len(texts), bool)
            if len(sent.value.items):
                flags[[row[0] for row in sent.value.search(*word_hashes(texts), threshold)]] = False
            return flags

        docs = filter_texts(docs, clean, text_column)
    return docs
