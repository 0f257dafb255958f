"""The prefix trie against a plain one."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import prefix_trie
from tessera.llm.prefix_trie import graft_heads, number_turns, prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, k long, n long, depth string, conv string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d", "c", "p") for r in rows], SCHEMA)


def plain_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, plain_digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in by.items()}


def plain_heads(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_trie(turns):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(turns.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
                   for p, m in members.items())


def conversations():
    rows = []
    for c in [*range(-3, 40), *range(100, 140), 200, 205, 1000]:
        if c == 100:
            continue  # no such base
        for t in range(c * 7 % 23):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t < 9 else c % 2}" + "é" * (t % 4)))
    rows += [(c, 0, "user", "all alike") for c in range(300, 330)]
    rows += [(400, t, "user", "long " + str(t)) for t in range(700)] + [(401, t, "user", "long " + str(t if t < 650 else -t)) for t in range(700)]
    rows += [(500, None, "user", "first"), (500, 0, None, None), (500, 1, "user", ""), (501, None, "user", "first"), (501, 2, None, ""), (502, 3, "a", "b"), (502, 3, "a", "b"), (502, 3, "a", "c")]
    rows += [(None, 1, "user", "no id"), (600, 1, "1:a", "b"), (601, 1, "1", ":ab"), (777, 0, "user", "x"), (777, 1, "user", "y")]
    return rows


def built(spark, rows):
    turns = number_turns(frame(spark, rows))
    convs = turns.select("conv").distinct()
    return turns, convs


def test_trie_of_grafted_conversations(spark):
    rows = conversations()
    turns, convs = built(spark, rows)
    c = F.col("conv")
    grafted = graft_heads(turns, convs, F.crc32(c.cast("string").cast("binary")) % 6, c - c % 100, longest_head=5)
    assert Counter(map(tuple, trie(grafted, convs).collect())) == plain_trie(plain_heads(plain_turns(rows)))


def test_trie_of_plain_conversations(spark, monkeypatch):
    """Short blocks, short runs of blocks and small pieces of ids."""
    for name, value in (("BLOCK_TURNS", 3), ("BLOCKS_AT_ONCE", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations()
    turns, convs = built(spark, rows)
    assert Counter(map(tuple, trie(turns, convs).collect())) == plain_trie(plain_turns(rows))


def test_empty_and_turnless(spark):
    turns, convs = built(spark, [])
    assert trie(turns, convs).collect() == []
    some = spark.createDataFrame([(3,), (5,)], "conv long")
    assert Counter(map(tuple, trie(turns, some).collect())) == plain_trie({3: [], 5: []})
    turns, convs = built(spark, [(5, 0, "user", "hi"), (5, 1, "user", None)])
    assert Counter(map(tuple, trie(turns, some).collect())) == plain_trie({3: [], 5: [("user", "hi"), ("user", "")]})


def test_many_ids_at_one_end(spark):
    """More ids than one piece of text holds stream through one hash."""
    ids = list(range(-20, 30_000, 2))
    ends = spark.createDataFrame([(1, 5, 6, i) for i in ids] + [(2, 5, 6, 8)], "depth long, q1 long, q2 long, conv long")
    found = {r["depth"]: r["ends_sha256"] for r in prefix_trie.ends_hashes(ends).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"8").hexdigest()}
