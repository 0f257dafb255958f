"""Exact piecewise encoding with public tokenizers.

A text is cut only where the tokenizer provably never joins two sides, so the ids (or counts) of
the pieces, one after the other, are those of the whole text. Pieces repeat a lot within a corpus:
Arrow finds the distinct ones of a batch, and each worker keeps a bounded table of those it has
seen, so that a piece goes through the library about once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries in a worker's table of pieces. A full table is emptied; results do not depend on it.
CACHE_ENTRIES = 700_000

#: Bytes of text that are split at once.
BATCH_BYTES = 24 << 20

#: Ids that are put together at once.
IDS_AT_ONCE = 1 << 20

#: What WordBpeEncoder takes for granted: normaliser and splitting pattern of the tokenizer file.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SUFFIX = re.compile(r"(.+?)([.,;:!?|]+)\Z", re.DOTALL)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array without nulls (null: empty), with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def by_bytes(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Slices of consecutive texts with about ``limit`` bytes each (one text at least)."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
        yield texts.slice(start, end - start)
        start = end


def distinct_pieces(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's pieces, each piece's index, the distinct pieces."""
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: as distinct_pieces."""
    offsets, at, words = distinct_pieces(pc.ascii_split_whitespace(texts))
    empty = pc.index(words, "").as_py()  # left by white space at the ends of a text
    if empty >= 0:
        keep = at != empty
        offsets, at = np.concatenate(([0], np.cumsum(keep)))[offsets], at[keep]
    return offsets, at, words


class WordBpeEncoder:
    """Ids of a ``tokenizers`` BPE model that drops white space, never merges over it and marks
    the end of a word in its last token.

    Cuts: white space (space, U+0009 to U+000D), and between a run of letters and the punctuation
    ``.,;:!?|`` that ends a white-space word. The file is read for the rules that make these cuts
    harmless; with other rules texts go through the library whole.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.cache_entries = cache_entries
        with open(path, encoding="utf-8") as file:  # on each worker, like the library itself
            said = json.load(file)
        splits = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.safe = (said["normalizer"] == NORMALIZER and splits[0].get("pattern") == {"Regex": WORD_SPLIT} and splits[0].get("invert") is True
                     and said["model"]["type"] == "BPE" and said["model"].get("end_of_word_suffix") == "</w>")
        self.ends = np.zeros(self.vocab_size + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        upper, lower = self.tokenizer.encode_batch(["ABC", "abc"], add_special_tokens=False)
        self.lowers = upper.ids == lower.ids
        self.atoms: dict[str, bytes] = {"": b""}

    def _encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, unknown: list[str]) -> None:
        """Runs of letters are single words to the model: many go through it as one text, whose
        ids are cut where a word ends."""
        letters = [a for a in unknown if a.isalpha()]
        groups = [letters[i:i + 256] for i in range(0, len(letters), 256)]
        for group, ids in zip(groups, self._encode_batch([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                unknown = [*unknown, *group]
                continue
            data, start = ids.tobytes(), 0
            for atom, end in zip(group, (ends * 4).tolist(), strict=True):
                self.atoms[atom] = data[start:end]
                start = end
        rest = [a for a in dict.fromkeys(unknown) if a not in self.atoms]
        for atom, ids in zip(rest, self._encode_batch(rest), strict=True):
            self.atoms[atom] = ids.tobytes()

    def _ids(self, atoms: list[str]) -> list[bytes]:
        if len(self.atoms) > self.cache_entries:
            self.atoms = {"": b""}
        known = self.atoms
        if unknown := [a for a in atoms if a not in known]:
            self._learn(list(dict.fromkeys(unknown)))
        return [self.atoms[a] for a in atoms]

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes in ids and the ids of distinct words. ASCII letters with or without punctuation
        behind them are cut by Arrow, other words in Python."""
        plain = pc.extract_regex(words, r"^(?P<core>[A-Za-z]+)(?P<tail>[.,;:!?|]*)$")
        other = np.flatnonzero(pc.is_null(plain).to_numpy(zero_copy_only=False))
        cores, tails = (pc.fill_null(pc.struct_field(plain, i), "") for i in (0, 1))
        if self.lowers:
            cores = pc.ascii_lower(cores)
        cores, tails = cores.dictionary_encode(), tails.dictionary_encode()
        core_at, tail_at = (x.indices.to_numpy(zero_copy_only=False) for x in (cores, tails))
        core_ids, tail_ids = (self._ids(x.dictionary.to_pylist()) for x in (cores, tails))
        coded = [core_ids[i] + tail_ids[j] for i, j in zip(core_at.tolist(), tail_at.tolist(), strict=True)]
        if len(other):
            rest = words.take(pa.array(other)).to_pylist()
            cut = [m.groups() if (m := _SUFFIX.match(w)) and m[1].isalpha() else (w, "") for w in rest]
            ids = self._ids([a for pair in cut for a in pair])
            for at, i, j in zip(other.tolist(), ids[::2], ids[1::2], strict=True):
                coded[at] = i + j
        return np.fromiter(map(len, coded), np.int64, len(coded)) // 4, np.frombuffer(b"".join(coded), "<u4")

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive slices of the texts: lengths in ids, and the ids of all as uint32."""
        for part in by_bytes(texts):
            if not self.safe:
                whole = self._encode_batch(part.to_pylist())
                yield np.array([len(i) for i in whole], np.int64), np.concatenate([*whole, np.zeros(0, "<u4")])
                continue
            offsets, at, words = split_words(part)
            sizes, ids = self._coded(words)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            ends = np.concatenate(([0], np.cumsum(sizes[at])))
            of_text = ends[offsets]
            first = 0
            while first < len(part):  # about a million ids at once
                last = max(first + 1, int(np.searchsorted(of_text, of_text[first] + IDS_AT_ONCE, "right")) - 1)
                own = slice(offsets[first], offsets[last])
                out = ids[:0]
                if of_text[last] > of_text[first]:
                    shift = starts[at[own]] - (ends[own] - of_text[first])
                    out = ids[np.repeat(shift, sizes[at[own]]) + np.arange(of_text[last] - of_text[first])]
                yield np.diff(of_text[first:last + 1]), out
                first = last


class PieceCounter:
    """Numbers of pieces that a SentencePiece model gives, texts cut before a space that follows
    another character. The model is searched once for pieces that reach over such a place; if it
    has one, or changes texts before it splits them, texts go through the library whole."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache_entries = cache_entries
        self.counts: dict[str, int] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and self._keeps_text()

    def _keeps_text(self) -> bool:
        """The model's normaliser is the identity, with a space put before the text, by its file."""
        from sentencepiece import sentencepiece_model_pb2

        said = sentencepiece_model_pb2.ModelProto()
        said.ParseFromString(self.model.serialized_model_proto())
        rules = said.normalizer_spec
        return not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix and rules.escape_whitespaces and not said.trainer_spec.treat_whitespace_as_suffix

    def _length(self, units: list[str]) -> None:
        new = list({u for u in units if u not in self.counts})
        if new:
            self.counts.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))

    def count(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For consecutive slices of the texts: numbers of pieces."""
        for part in by_bytes(texts):
            if not self.safe:
                yield np.asarray([len(i) for i in self.model.encode(part.to_pylist(), num_threads=1)], np.int64)
                continue
            if len(self.counts) > self.cache_entries:
                self.counts = {}
            offsets, at, units = distinct_pieces(pc.split_pattern(part, " "))
            names = units.to_pylist()
            self._length(names)
            each = np.fromiter((self.counts[u] for u in names), np.int64, len(names))[at]
            total = np.diff(np.concatenate(([0], np.cumsum(each)))[offsets])
            # Runs of spaces, the model's own sign for a space and empty texts are rare: these
            # texts are cut with the run of spaces left before the word that follows it. The first
            # space of a run is the one that the model puts before every unit.
            special = pc.or_(pc.match_substring_regex(part, "  |▁|^ | $"), pc.equal(pc.binary_length(part), 0))
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
                text = part[i].as_py().replace("▁", " ")
                cut = [u[1:] for u in re.findall(r" +[^ ]*", " " + text)] if text else []
                if text:
                    self._length(cut)
                total[i] = sum(self.counts[u] if u else 1 for u in cut)
            yield total


_MODELS: dict[tuple, object] = {}


def model(kind: type, path: str, *more):
    """One model per worker process, file and parameters."""
    if (kind, path, *more) not in _MODELS:
        _MODELS[(kind, path, *more)] = kind(path, *more)
    return _MODELS[(kind, path, *more)]
