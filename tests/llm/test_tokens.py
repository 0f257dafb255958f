"""Token counts, token files and the piece lattice."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import cases, empty, table
from tessera.llm import lattice, token_files
from tessera.llm.lattice import SPACE, PieceLattice, decode_ids, encode_texts, segment_texts
from tessera.llm.token_counts import count_tokens
from tessera.llm.tokens import PieceCounter, WordBpeEncoder

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b\n\nc ", "a▁b ▁c ▁▁ x", "<s>x</s> <|endoftext|> y<|endoftext|>,", "　x ﬁ", "İ Σας ΟΔΟΣ. é, don't DON'T. it's, x's.,", "a\x00b\x1cc d", "1,2 a1. ..., |x| … é…,", "   ", "a   ", "\n", "a ́b", "x▁ y", "▁", "a\x0bb\x0cc\rd\te", "日本語, ça ǅ."]


def test_pieces_give_the_ids_of_whole_texts():
    texts = pa.array(ODD + [t or "" for _, t in cases()], pa.large_string())
    encoder = WordBpeEncoder(WORDS, cache_entries=50)  # the table is emptied often
    mine = [ids.tolist() for sizes, flat in encoder.encode(texts) for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    assert mine == [e.ids for e in encoder.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
    assert encoder.safe
    encoder.safe = False
    assert mine == [ids.tolist() for sizes, flat in encoder.encode(texts) for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    counter = PieceCounter(PIECES, cache_entries=10)
    assert counter.safe
    assert [n for part in counter.count(texts) for n in part.tolist()] == [len(i) for i in counter.model.encode(texts.to_pylist())]
    counter.safe = False
    assert [n for part in counter.count(texts) for n in part.tolist()] == [len(i) for i in counter.model.encode(texts.to_pylist())]


def test_count_tokens(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in cases())
    assert Counter(map(tuple, count_tokens(table(spark, cases()), PIECES).collect())) == want
    assert count_tokens(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 70_001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == (len(ids) * width + 7) // 8
    assert (token_files.unpack(packed, width, 0, len(ids)) == ids).all()
    assert (token_files.unpack(packed, width, 12_345, 777) == ids[12_345:12_345 + 777]).all()
    assert len(token_files.unpack(packed, width, 5, 0)) == 0


def test_widths():
    assert [token_files.bit_width(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_token_files(spark, tmp_path):
    rows = cases()
    token_files.write_token_files(table(spark, rows), str(tmp_path / "a"), WORDS, block_tokens=300)
    got = token_files.read_digests(spark, str(tmp_path / "a")).orderBy("start").collect()
    tokenizer = WordBpeEncoder(WORDS).tokenizer
    ids = {(i, t): [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t in rows)
    at, last = 0, None
    for r in got:  # gapless, in ascending order, nulls first
        assert r["start"] == at and (last is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"]
    some = token_files.read_documents(spark, str(tmp_path / "a"), [33, 40]).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: ids[i, t] for i, t in rows if i in (33, 40)}
    token_files.write_token_files(empty(spark), str(tmp_path / "b"), WORDS)
    assert token_files.read_digests(spark, str(tmp_path / "b")).count() == 0


def all_paths(lattice, unit):
    out = []

    def go(at, score, ids):
        if at == len(unit):
            out.append((score, ids))
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in lattice.pieces:
                i, s = lattice.pieces[unit[at:end]]
                go(end, score + s, (*ids, i))
        if at < len(unit) and unit[at] not in lattice.pieces:
            ids_, s = lattice._fallback(unit[at])
            go(at + 1, score + s, ids + ids_)

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 3, 6])
def test_n_best_equals_enumeration(n):
    lattice, rng = PieceLattice(PIECES, n), random.Random(n)
    for unit in [SPACE, SPACE * 2 + "a"] + [SPACE + "".join(rng.choice("thebl,.é\x01日") for _ in range(8)) for _ in range(40)]:
        paths = all_paths(lattice, unit)
        for found in (lattice.search(unit), lattice.word(unit)):
            assert [s for s, _ in found] == pytest.approx([s for s, _ in paths[:n]]) and all(f in paths for f in found)
            assert len(set(found)) == len(found)


@pytest.mark.parametrize("n", [1, 3])
def test_units_of_all_texts_at_once_and_the_forward_pass(n):
    """Cuts, best and second best of a slice's units, and no unit searched anew by the words that hold it."""
    lattice, rng = PieceLattice(PIECES, n), random.Random(7)
    texts = ["", "a", " ", "é▁ \x01日", "😀😀 a", *("".join(rng.choice("the bl,.é\x01日 ") for _ in range(30)) for _ in range(40)), ""]
    offsets, at, names = lattice.cut_all(pa.array(["skipped", *texts], pa.large_string()).slice(1))
    names = names.to_pylist()
    assert [[names[i] for i in at[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [lattice.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    more = PieceLattice(PIECES, 2)
    for unit in names:
        found, (score, loss, ids) = more.search(unit), lattice.forward(unit)
        assert found[0] == (score, tuple(ids)) and loss == (score - found[1][0] if len(found) > 1 else float("inf"))
    seen = []
    forward = lattice.forward
    lattice.forward = lambda unit: seen.append(unit) or forward(unit)
    for _ in range(2):
        got = lattice.segmentations(pa.array(texts, pa.large_string()))
    assert sorted(seen) == sorted(names)
    for t, ways in zip(texts, got, strict=True):
        want = lattice.encode(t)
        assert [s for s, _ in ways] == pytest.approx([s for s, _ in want]) and tuple(ways[0][1]) == tuple(want[0][1])


def test_lattice_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(cases())]
    lattice = PieceLattice(PIECES, 3)
    got = {r["doc_id"]: r for r in encode_texts(table(spark, rows), PIECES).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        best = lattice.encode(t or "")
        assert got[i]["n_tokens"] == len(best[0][1]) and got[i]["ids_crc32"] == zlib.crc32(np.asarray(best[0][1], "<u4").tobytes())
        assert got[i]["scores"] == pytest.approx([s for s, _ in best])
        assert lattice.decode(best[0][1]) == (t or "").replace(SPACE, " ") and got[i]["decoded_ok"] == (SPACE not in (t or ""))
    assert encode_texts(empty(spark), PIECES).count() == 0


def test_segmentations_and_decoding(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(cases())]
    lattice = PieceLattice(PIECES, 3)
    found = segment_texts(table(spark, rows), PIECES)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = lattice.encode(t or "")
        assert got[i]["scores"] == pytest.approx([s for s, _ in want]) and got[i]["ids"][0] == want[0][1]
        score = {p: lattice.model.get_score(p) for ids in got[i]["ids"] for p in ids}
        assert len({tuple(ids) for ids in got[i]["ids"]}) == len(want)
        for ids, s in zip(got[i]["ids"], got[i]["scores"]):
            assert lattice.decode(ids) == (t or "").replace(SPACE, " ")
            if not any(lattice.model.is_byte(p) for p in ids):
                assert sum(score[p] for p in ids) == pytest.approx(s)
    for n in range(3):
        texts = {r["doc_id"]: r["decoded"] for r in decode_ids(found.select("doc_id", F.get("ids", F.lit(n)).alias("own")), PIECES, "own").collect()}
        assert texts == {i: (t or "").replace(SPACE, " ") if len(got[i]["ids"]) > n else None for i, t in rows}
    assert segment_texts(empty(spark), PIECES).count() == 0


def test_workers_hold_little_while_segmenting(spark, monkeypatch):
    """A batch of many texts is segmented a small slice at a time, and the table of units stays small."""
    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, run, schema: runs.append(run) or df.withColumnRenamed("doc_id", "id"))
    segment_texts(table(spark, [(1, "x")]), PIECES)
    texts = ["The quick brown fox, jumped over 12 lazy dogs. " * 2000] * 40  # 3.8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["id", "text"])
    list(runs[0](iter([batch.slice(0, 1)])))  # the model is read
    tracemalloc.start()
    rows = [part.num_rows for part in runs[0](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == 40 and len(rows) >= 4 and peak < 100 << 20
    assert lattice.CACHE_ENTRIES * 200 < 100 << 20
