"""SentencePiece encoding and decoding: N-best segmentations over the piece lattice.

A forward Viterbi pass gives the best score from a text's start to each place. A* then searches
backward from the end: the forward score is the exact best completion of a partial path, so the
first N complete paths that leave the queue are the N best, in order.

A place that no piece of the model reaches over cuts the lattice: the texts between such places
(units) are segmented alone. The forward pass gives each unit's best segmentation and what its second best
loses, about once per worker; of each text the units that lose least are searched backward, and their N best
lists are added up. Adding keeps the N best exact: a sum outside the N best of some units is outside
those of the text.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, release_memory
from tessera.llm.tokens import by_bytes, model, texts_of

#: Entries in a worker's table of units (some 200 bytes each); a full one is emptied.
CACHE_ENTRIES = 300_000
SPACE = "▁"


class PieceLattice:
    """The pieces of a SentencePiece model with their scores.

    Characters without a piece become bytes where the model has byte pieces (each with the byte
    piece's score less ``BYTE_PENALTY``), else the unknown piece.
    """

    BYTE_PENALTY = 10.0

    def __init__(self, path: str, n_best: int = 3):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        m = self.model
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        low = 0.0
        for i in range(m.vocab_size()):
            if m.is_byte(i):
                self.bytes[int(m.id_to_piece(i)[1:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.pieces[m.id_to_piece(i)] = i, m.get_score(i)
                low = min(low, m.get_score(i))
        self.unknown_score = low - self.BYTE_PENALTY
        #: A node: children by character, and (ids, score) if a piece ends there.
        self.trie: tuple[dict, tuple | None] = ({}, None)
        for piece, (i, score) in sorted(self.pieces.items(), key=lambda p: len(p[0])):
            children = self.trie[0]
            for char in piece[:-1]:
                children = children.setdefault(char, ({}, None))[0]
            children[piece[-1]] = children.get(piece[-1], ({}, None))[0], ((i,), score)
        self.spelling = [bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).encode("utf-8") for i in range(m.vocab_size())]
        #: Pairs of characters that some piece holds side by side; between others the lattice is cut.
        self.joined = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joined):
            raise ValueError("a piece reaches over the start of a word")
        size = [len(x) for x in self.spelling]
        self.spelled_size, self.spelled_start = np.array(size, np.int64), np.cumsum([0, *size])[:-1]
        self.spelled_bytes = np.frombuffer(b"".join(self.spelling), np.uint8)
        #: ``joined`` as a matrix: a class for each character on the left and on the right, 0 for those that join nothing.
        left, right = ({c: i for i, c in enumerate(sorted({pair[side] for pair in self.joined}), 1)} for side in (0, 1))
        self.left, self.right = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        for table, classes in ((self.left, left), (self.right, right)):
            table[[ord(c) for c in classes]] = list(classes.values())
        self.joins = np.zeros((len(left) + 1, len(right) + 1), bool)
        for a, b in self.joined:
            self.joins[left[a], right[b]] = True
        self._forget()

    def _forget(self) -> None:
        """Empty the table of units: a number for each; by number the best score, what the second best loses, and the
        best ids, one unit's after the other's."""
        self.units: dict[str, int] = {}
        self.best, self.loss, self.ends, self.ids = array("d"), array("d"), array("q", [0]), array("I")

    def _fallback(self, char: str) -> tuple[tuple[int, ...], float]:
        raw = char.encode("utf-8")
        if all(b in self.bytes for b in raw):
            return tuple(self.bytes[b] for b in raw), self.unknown_score * len(raw)
        return (self.model.unk_id(),), self.unknown_score

    def search(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of ``unit`` as (score, ids), best first; ties by the order of
        discovery, which depends on the unit alone."""
        n = len(unit)
        if n == 1:
            hit = self.pieces.get(unit)
            if hit:
                return [(hit[1], (hit[0],))]
            ids, score = self._fallback(unit)
            return [(score, ids)]
        # Forward: best score to each place, and the pieces that end there.
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        ending: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            so_far, (children, _) = best[start], self.trie
            for end in range(start, n):
                node = children.get(unit[end])
                if node is None:
                    break
                children, hit = node
                if hit is not None:
                    end += 1
                    ids, gain = hit
                    ending[end].append((start, ids, gain))
                    gain += so_far
                    if gain > best[end]:
                        best[end] = gain
            if unit[start] not in self.pieces:
                ids, score = self._fallback(unit[start])
                ending[start + 1].append((start, ids, score))
                best[start + 1] = max(best[start + 1], so_far + score)
        # Backward A*: priority = score of the suffix so far + best score of the rest. From a place
        # only the N pieces with the best continuation can lie on one of the N best paths.
        most = self.n_best
        for end in range(2, n + 1):
            if len(ending[end]) > most:
                ending[end] = sorted(ending[end], key=lambda e: -best[e[0]] - e[2])[:most]
        found: list[tuple[float, tuple[int, ...]]] = []
        queue = [(-best[n], n, 0.0, ())]
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, place, score, path = pop(queue)
            if not place:
                out: list[int] = []
                while path:
                    out += path[0]
                    path = path[1]
                found.append((score, tuple(out)))
                if len(found) == most:
                    break
                continue
            for start, ids, gain in ending[place]:
                gain += score
                push(queue, (-best[start] - gain, start, gain, (ids, path)))
        return found

    def forward(self, unit: str) -> tuple[float, float, list[int]]:
        """The best segmentation's score, what the second best loses (infinity: there is none) and the best one's ids:
        what ``search`` finds first, by the forward pass alone."""
        n, pieces, low = len(unit), self.pieces, float("-inf")
        if n == 1:
            (score, ids), = self.search(unit)
            return score, float("inf"), list(ids)
        best, second, back = [low] * (n + 1), [low] * (n + 1), [(0, ())] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            children, so_far = self.trie[0], best[start]
            reach = [(start + 1, self._fallback(unit[start]))] if unit[start] not in pieces else []
            for end in range(start, n):
                node = children.get(unit[end])
                if node is None:
                    break
                children, hit = node
                if hit is not None:
                    reach.append((end + 1, hit))
            for end, (ids, gain) in reach:
                score = so_far + gain
                if score > best[end]:  # of equal ones the earliest start stays, which is what the queue of ``search`` takes first
                    second[end] = max(best[end], second[start] + gain)
                    best[end], back[end] = score, (start, ids)
                elif score > second[end]:
                    second[end] = score
        out, place = [], n
        while place:
            place, ids = back[place]
            out.append(ids)
        return best[n], best[n] - second[n], [i for ids in reversed(out) for i in ids]

    def add(self, left: list, right: list) -> list:
        """The N best sums of two N best lists."""
        if len(right) == 1:
            s, ids = right[0]
            return [(a + s, b + ids) for a, b in left]
        if len(left) == 1:
            s, ids = left[0]
            return [(s + a, ids + b) for a, b in right]
        sums = sorted(((-(a + c), i, j) for i, (a, _) in enumerate(left) for j, (c, _) in enumerate(right)))[: self.n_best]
        return [(-s, left[i][1] + right[j][1]) for s, i, j in sums]

    def cut(self, word: str) -> list[str]:
        """Units of a stretch of text (spaces as ``SPACE``)."""
        joined, units, start = self.joined, [], 0
        for i, pair in enumerate(map(str.__add__, word, word[1:]), 1):
            if pair not in joined:
                units.append(word[start:i])
                start = i
        units.append(word[start:])
        return units

    def word(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """N best of a stretch of text, from its units."""
        out = None
        for unit in self.cut(word):
            own = self.search(unit)
            out = own if out is None else self.add(out, own)
        return out

    def encode(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text."""
        if not text:
            return [(0.0, [])]
        return [(s, list(ids)) for s, ids in self.word(SPACE + text.replace(" ", SPACE))]

    def _spelled(self, ids: list[int]) -> str:
        return b"".join([self.spelling[i] for i in ids]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together, spaces restored, and the space that encoding
        puts before a text taken away. A ``SPACE`` character in a text comes back as a space."""
        text = self._spelled(ids).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """``decode`` of each run of ids."""
        lens = self.spelled_size[ids]
        ends = np.concatenate(([0], np.cumsum(lens)))
        raw = self.spelled_bytes[np.repeat(self.spelled_start[ids] - ends[:-1], lens) + np.arange(ends[-1])]
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(raw))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_string())
        return pc.replace_substring_regex(pc.replace_substring(texts, SPACE, " "), r"\A ", "")

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit in the table; units that it lacks go through ``forward``."""
        if len(self.units) > CACHE_ENTRIES:
            self._forget()
        known = self.units
        for unit in units:
            if unit not in known:
                score, loss, ids = self.forward(unit)
                known[unit] = len(known)
                self.best.append(score)
                self.loss.append(loss)
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def cut_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Offsets of each whole text's units, each unit's index, the distinct units: ``cut`` of all texts at once."""
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", SPACE))
        marked = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), none, space), pc.replace_substring(texts, " ", SPACE), none)
        of_text = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset:marked.offset + len(marked) + 1] if len(marked) else np.zeros(1, np.int64)
        raw = bytes(memoryview(marked.buffers()[2])[of_text[0]:of_text[-1]]) if of_text[-1] > of_text[0] else b""
        of_text = of_text - of_text[0]
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # the byte that each character begins at
        begins = np.ones(len(chars), bool)
        if len(chars):
            begins[1:] = ~self.joins[self.left[chars[:-1]], self.right[chars[1:]]]
            begins[np.searchsorted(lead, of_text[:-1][np.diff(of_text) > 0])] = True
        starts = lead[begins]
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        return np.searchsorted(starts, of_text), units.indices.to_numpy(zero_copy_only=False), units.dictionary

    def segmentations(self, texts: pa.Array) -> list[list[tuple[float, np.ndarray]]]:
        """The N best (score, ids) of each text, best first.

        A text's N best differ from its best in the units that lose least by their second choice:
        with N - 1 such units there are N sums at least as good as any that changes another unit,
        so only their lists are found again and added up; the other units stay at their best.
        """
        offsets, at, names = self.cut_all(texts)
        number = self._numbers(names.to_pylist())
        best, loss, ends_at, flat = (np.frombuffer(x, x.typecode) for x in (self.best, self.loss, self.ends, self.ids)) if len(number) else (np.zeros(0),) * 4
        best, loss = best[number], loss[number]
        starts = ends_at[number].astype(np.int64)
        size = ends_at[number + 1].astype(np.int64) - starts
        found: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        out, least = [], self.n_best - 1
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if low == high:
                out.append([(0.0, np.zeros(0, np.uint32))])
                continue
            w = at[low:high]
            own_size = size[w]
            ends = np.cumsum(own_size)
            ids = flat[np.repeat(starts[w] - (ends - own_size), own_size) + np.arange(ends[-1])]
            places = np.arange(len(w))
            if len(w) > least:
                places = np.sort(np.argpartition(loss[w], least - 1)[:least]) if least else places[:0]
            changes = w[places].tolist()
            for k in changes:
                if k not in found:
                    found[k] = self.search(names[k].as_py())
            ways: list[tuple[float, tuple[int, ...]]] = [(float(best[w].sum() - best[changes].sum()) if changes else float(best[w].sum()), ())]
            for k in changes:
                ways = self.add(ways, [(s, (j,)) for j, (s, _) in enumerate(found[k])])
            spans = [(int(ends[p] - own_size[p]), int(ends[p])) for p in places.tolist()]
            texts_ids = []
            for score, choice in ways:
                if not any(choice):
                    texts_ids.append((score, ids))
                    continue
                parts, done = [], 0
                for k, j, (a, b) in zip(changes, choice, spans, strict=True):
                    parts += [ids[done:a], np.array(found[k][j][1], np.uint32)]
                    done = b
                texts_ids.append((score, np.concatenate([*parts, ids[done:]])))
            out.append(texts_ids)
        return out


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values one after the other, and where each array begins."""
    return np.concatenate([np.zeros(0, np.uint32), *arrays]), np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64)))


def _segmented(docs: DataFrame, model_path: str, n_best: int, id_column: str, text_column: str, columns: str,
               rows: Callable[[PieceLattice, pa.Array, list], list[pa.Array]]) -> DataFrame:
    """(id, columns) of each row: ``rows`` makes the columns of a slice of whole texts from its N best."""
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice: PieceLattice = model(PieceLattice, model_path, n_best)
        for batch in batches:
            done = 0
            for part in by_bytes(texts_of(batch.column(1)), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), *rows(lattice, part, lattice.segmentations(part))], names)
                done += len(part)
        release_memory()

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id long, {columns}").withColumnRenamed("id", id_column)


def segment_texts(docs: DataFrame, model_path: str, n_best: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, scores, ids) of each row: the N best segmentations as scores and arrays of piece ids, best
    first (fewer if a text has fewer).

    Whole texts of any length; null and empty ones: one segmentation without ids, score 0. Ties by the
    order of discovery, which depends on the text alone. Repeated rows and null ids get a row each,
    an empty table none; other columns do not matter. Narrow: no shuffle.
    """

    def rows(_: PieceLattice, part: pa.Array, found: list) -> list[pa.Array]:
        outer = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
        values, inner = _flat([ids for f in found for _, ids in f])
        ids = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values.view(np.int32))))
        return [pa.ListArray.from_arrays(outer, pa.array([s for f in found for s, _ in f], pa.float64())), ids]

    return _segmented(docs, model_path, n_best, id_column, text_column, "scores array<double>, ids array<array<int>>", rows)


def decode_ids(df: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids (array<int>). Null ids: null. Narrow."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice: PieceLattice = model(PieceLattice, model_path)
        for column in series:
            known = column[column.notna()]
            texts = lattice.decode_all(*_flat([np.asarray(i, np.uint32) for i in known]))
            yield pd.Series(texts.to_pylist(), index=known.index, dtype=object).reindex(column.index).where(column.notna(), None)

    return df.withColumn(text_column, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(ids_column))


def encode_texts(docs: DataFrame, model_path: str, n_best: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, scores, decoded_ok) of each row: digests of the same segmentations as
    segment_texts gives, made where they are found.

    ids_crc32: of the best segmentation's ids as little-endian 32-bit integers; scores: of the N
    best, best first; decoded_ok: decoding the best ids gives the text back. Odd input as in
    segment_texts. Narrow: no shuffle.
    """

    def rows(lattice: PieceLattice, part: pa.Array, found: list) -> list[pa.Array]:
        best = [f[0][1] for f in found]
        crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in best]
        lists = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
        scores = pa.ListArray.from_arrays(lists, pa.array([s for f in found for s, _ in f], pa.float64()))
        same = pc.equal(lattice.decode_all(*_flat(best)), part)
        return [pa.array([len(ids) for ids in best], pa.int64()), pa.array(crc, pa.int64()), scores, same]

    return _segmented(docs, model_path, n_best, id_column, text_column, "n_tokens long, ids_crc32 long, scores array<double>, decoded_ok boolean", rows)
