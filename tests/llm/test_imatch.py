"""I-Match fingerprints against a plain reckoning with the same hashes."""

import hashlib
import math
import random
from collections import Counter

import regex
import xxhash

from tests.llm.helpers import cases, empty, prose, table
from tessera.llm import imatch
from tessera.llm.imatch import edit_and_fingerprint


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(values, bits):
    """Hash of a list or of several columns: each with the last one as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 8 * bits)).to_bytes(bits, "little") if isinstance(v, int) else v, seed)
    return seed


def plain_terms(text):
    return sorted({signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t})


def place(kept):
    return f"{chained(kept, 8) & 0xFFFFFFFF:08x}"  # of none: the seed


def plain_print(text, lexicon):
    every = plain_terms(text)
    kept, out = [t for t in every if t in lexicon], [place(every)]
    for s in range(1, imatch.SCALES + 1):
        start = min(s * (s - 1) // 2, 64 - s)
        for j in range(min(imatch.SUBSETS, 1 << (s - 1))):
            out.append(place([t for t in kept if (t % (1 << 64) >> start) % (1 << s) == j]))
    return out


def alike(a, b):
    equal = some = 0.0
    sizes = [1, *(min(imatch.SUBSETS, 1 << (s - 1)) for s in range(1, imatch.SCALES + 1))]
    for k, size in enumerate(sizes):
        own = [(x, y) for x, y in zip(a, b, strict=True)][sum(sizes[:k]):][:size]
        filled = sum((x, y) != ("0000002a", "0000002a") for x, y in own)
        equal += (1.05 - filled / size) * sum(x == y != "0000002a" for x, y in own)
        some += (1.05 - filled / size) * filled
    return equal / some if some else 1.0


def plain(rows, min_idf=3.0, max_idf=8.0):
    found = Counter(t for _, text in rows for t in plain_terms(text or ""))
    lexicon = {t for t, n in found.items() if len(rows) * math.exp(-max_idf) <= n <= len(rows) * math.exp(-min_idf)}

    def row_hash(i, text):
        parts = [] if i is None else [i]
        return tuple(signed(h) for h in (chained([*parts, text.encode()], 8), xxh_second(text, parts)))

    def xxh_second(text, parts):
        seed = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))
        return xxhash.xxh64_intdigest(parts[0].to_bytes(8, "little", signed=True), seed) if parts else seed

    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), row_hash(*r)))
    follow = {r: distinct[(k + 1) % len(distinct)] for k, r in enumerate(distinct)}
    out = Counter()
    for i, text in rows:
        text = text or ""
        following, half = follow[i, text][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, after = (plain_print(t, lexicon) for t in (text, edited, following))
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(new), round(alike(own, new), 9), round(alike(own, after), 9)] += 1
    return out


def got(df, **options):
    out = edit_and_fingerprint(df, **options)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in out.collect())


def ranges():
    return [(1000 + i // 2 * 2, prose(i % 37, 30 + i % 11)) for i in range(80)]


def test_equals_plain_reckoning(spark):
    rows = cases() + ranges() + [(7, "Ab-12 ab_x ÄÖ äö ９"), (8, "!!! ..."), (9, "")]
    assert got(table(spark, rows), min_idf=1.0, max_idf=4.0) == plain(rows, 1.0, 4.0)


def test_lexicon_that_is_joined_by_term(spark, monkeypatch):
    monkeypatch.setattr(imatch, "SENT_TERMS", 3)
    rows = cases() + ranges()[:30]
    assert got(table(spark, rows)) == plain(rows)


def test_small_tables(spark):
    assert not got(empty(spark))
    for rows in ([(5, None)], [(None, "only one text here")], [(1, "same text twice"), (1, "same text twice"), (2, "same text twice")]):
        assert got(table(spark, rows)) == plain(rows)


def test_copies_edits_and_strangers(spark):
    """Likeness: 1 for copies, high for a changed word, some for half a text, next to none for others."""
    texts = [prose(s, 300, vocabulary=4000) for s in range(60)]
    rng = random.Random(3)
    words = texts[0].split()
    words[rng.randrange(300)] = "changed"
    rows = [(2 * i + 100, t) for i, t in enumerate(texts)] + [(101, " ".join(words)), (219, texts[59])]
    found = {r["doc_id"]: r for r in edit_and_fingerprint(table(spark, rows), min_idf=0.5, max_idf=8.0).collect()}
    assert found[219]["near_next"] == 1 and found[219]["fingerprint"] == found[218]["fingerprint"]
    assert found[101]["near_next"] > 0.7
    others = [found[2 * i + 100] for i in range(1, 59)]
    assert sum(r["near_edited"] > r["near_next"] for r in others) >= 0.95 * len(others)
    assert sum(r["near_edited"] for r in others) > 4 * sum(r["near_next"] for r in others)
