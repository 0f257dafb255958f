"""Line dedup, SimHash components, decontamination."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import cases, empty, prose, table
from tessera.llm import decontamination, line_dedup, similar, simhash


def plain_dedup(rows, min_chars=10, min_docs=2):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(holders.get(key(x), ())) >= min_docs and i != min(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return Counter(out)


def test_line_dedup(spark):
    for chars, docs in ((10, 2), (1, 3)):
        got = line_dedup.dedup_lines(table(spark, cases()), chars, docs)
        assert Counter((r["doc_id"], r["ld_lines_"], r["ld_dropped_n_"], r["text"]) for r in got.collect()) == plain_dedup(cases(), chars, docs)
        assert set(table(spark, []).columns) <= set(got.columns)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_hot_line(spark):
    rows = [(i, f"a line that all documents hold\nown line number {i} of them") for i in range(300)]
    assert Counter((r["doc_id"], r["ld_lines_"], r["ld_dropped_n_"], r["text"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect()) == plain_dedup(rows)


def plain_print(text, k):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    words = [w.lower() for w in words]
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """prints: (id, fingerprint) rows."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints))


def test_near_duplicates(spark):
    rows = cases() + [(200 + i, prose(7, 300) + " " + " ".join(prose(7, 300).split()[: i % 9])) for i in range(40)]
    got = simhash.near_duplicates(table(spark, rows), 4, 4)
    assert Counter(map(tuple, got.collect())) == plain_components([(i, plain_print(t, 4)) for i, t in rows], 4)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_of_a_dense_space(spark, monkeypatch):
    """Chains, dense groups and many shards: components equal brute force for several radii."""
    monkeypatch.setattr(simhash, "SHARD_SIZE", 100)
    monkeypatch.setattr(simhash, "LEAF_SIZE", 16)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:
        p = int(c)
        for _ in range(60):  # a walk: each step within the radius of the last
            for b in rng.choice(64, 3, replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints += [int(centres[0]) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)] + [int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)]
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    for radius in (2, 3, 4):
        labels = {r["node"]: r["label"] for r in simhash.connected_labels(simhash.linked_pairs(distinct, radius)).collect()}
        groups = plain_components(list(enumerate(prints)), radius)
        want = {}
        for i, h, g in groups:
            want.setdefault(g, set()).add(int(h, 16))
        mine = {}
        for p, s in zip(prints, signed):
            mine.setdefault(labels.get(s, s), set()).add(p)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_keep_one(spark):
    kept = Counter(r["doc_id"] for r in simhash.keep_one_of_each(table(spark, cases())).collect())
    assert kept[10] == 1 and not kept[11] and kept[20] == 2 and kept[40] == 1
    assert simhash.keep_one_of_each(table(spark, cases())).columns == table(spark, []).columns


def plain_similar(rows, least=0.8, k=5):
    """(id, component) of each row by comparing all pairs."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for w in words]
    labels = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= least and labels[i] != labels[j]:
                labels = [labels[j] if x == labels[i] else x for x in labels]
    ids = {}
    for (d, _), x in zip(rows, labels):
        ids.setdefault(x, []).append(d)
    return Counter((d, min((i for i in ids[x] if i is not None), default=None)) for (d, _), x in zip(rows, labels))


def near_rows():
    """Copies of a text with 1 to 14 changed words, chains, one dense group and a common passage."""
    base, hot, rows = prose(500, 300).split(), prose(501, 12), []
    for changes in range(15):
        copy = list(base)
        for c in range(changes):
            copy[10 + 20 * c] = f"changed{changes}x{c}"
        rows.append((2000 + 500 * changes, prose(600 + changes, 9) + " " + " ".join(copy[20 * changes:])))
    other = prose(502, 120).split()
    rows += [(9000 + i, " ".join(other[i:i + 80])) for i in range(0, 40, 3)]
    rows += [(9100 + i, " ".join(other[:60] + [f"own{i}"] + other[60:])) for i in range(60)]
    rows += [(9300 + i, prose(700 + i, 20) + " " + hot) for i in range(30)]
    rows += [(9400 + i, " ".join(base[:150] + [f"e{i}x{j}" for j in range(i)])) for i in range(0, 45, 4)]
    return rows


def test_similar_groups(spark):
    rows = cases() + near_rows()
    got = similar.similar_groups(table(spark, rows))
    assert Counter(map(tuple, got.collect())) == plain_similar(rows)
    assert similar.similar_groups(empty(spark)).count() == 0


def test_pipeline_drops_near_copies_of_080(spark):
    import corpus_pipeline

    words = prose(800, 300).split()
    rows = [(1, " ".join(words))]
    for i, changes in enumerate((1, 3, 5, 6, 7, 9), 2):  # similarity 0.967 to 0.818 up to 6 changes
        rows.append((i, " ".join(f"n{i}x{j}" if j % 40 == 20 and j // 40 < changes else w for j, w in enumerate(words)) if changes < 8 else " ".join(f"n{i}x{j}" if j % 30 == 7 and j // 30 < changes else w for j, w in enumerate(words))))
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, table(spark, rows), "").collect()}
    assert kept == {d for d, c in plain_similar(rows) if d == c} and not kept & {2, 3, 4, 5}


def test_pipeline_links_by_fingerprints(spark):
    """Texts of one fingerprint whose sets of shingles are unlike: only SimHash links them."""
    import corpus_pipeline

    words = prose(900, 11).split()
    long = " ".join(words * 400)  # the same shingles again and again: repeats weigh, sets do not
    rows = [(1, long), (2, long + " " + prose(901, 30)), (3, prose(902, 60))]
    prints = simhash.fingerprints(pa.array([t for _, t in rows]), 5)
    bits = np.bitwise_count(prints ^ prints[0]).tolist()
    assert bits[1] <= 4 < bits[2] and similar.similar_groups(table(spark, rows)).select("component_id").distinct().count() == 3
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, table(spark, rows), "").collect()} == {2, 3}


ITEMS = [(1, prose(100, 30)), (2, prose(101, 17) + "!"), (3, "Three short words"), (4, None), (5, " ,. "), (6, prose(102, 55)), (6, prose(102, 55)), (7, prose(103, 30))]


def item_table(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain_words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def plain_contaminations(rows, items, threshold=0.8):
    out = set()
    for d, t in rows:
        words = plain_words(t)
        for i, text in items:
            item = plain_words(text)
            if not item or not words:
                continue
            k, best = min(5, len(item)), 0
            bag = lambda w: Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))  # noqa: B023, E731
            for at in range(max(1, len(words) - len(item) + 1)):
                a, b = bag(words[at:at + len(item)]), bag(item)
                if a:
                    both = sum((a & b).values())
                    best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= threshold:
                out.add((d, i, round(best, 9)))
    return out


def leaky_rows():
    one, six = ITEMS[0][1], ITEMS[5][1]
    changed = six.split()
    changed[0] = "elsewhere"
    return cases() + [
        (301, prose(8, 60) + " " + one + " " + prose(9, 40)), (302, one.upper().replace(" ", ", ")), (303, prose(10, 50) + "\n" + " ".join(changed)), (304, one[: len(one) // 2]),
        (305, "we have three short words here"), (306, one + " " + six + " " + ITEMS[1][1]), (306, prose(11, 70)), (307, " ".join(one.split()[:-2]))]


def test_contaminations(spark):
    rows = leaky_rows()
    got = decontamination.contaminations(table(spark, rows), item_table(spark)).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got} == plain_contaminations(rows, ITEMS)
    blocks = decontamination.contaminations(table(spark, rows), item_table(spark), max_items=3).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == {(r["doc_id"], r["item_id"]) for r in got}
    clean = decontamination.drop_contaminated(table(spark, rows), item_table(spark))
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == {(d, t) for d, t in rows if not plain_contaminations([(d, t)], ITEMS)}
    assert decontamination.contaminations(empty(spark), item_table(spark)).count() == 0
    assert decontamination.contaminations(table(spark, rows), item_table(spark).limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    index = decontamination.BenchmarkIndex([(i, prose(1000 + i, 20)) for i in range(60)])
    prints = np.concatenate([index.prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in range(0, 20)])
    w, i = index.within(prints, 0)
    every = np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= decontamination.RADIUS
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(every))))


def test_contaminations_reach_the_threshold():
    """Each item with words changed here and there: whatever is 0.8 similar is found, however far
    the fingerprint."""
    rng, far = np.random.default_rng(5), 0
    items = [(i, prose(3000 + i, 55 if i % 2 else 32)) for i in range(40)]
    index = decontamination.BenchmarkIndex(items, None)
    rows = []
    for i, text in items:
        for n in range(30):
            words = text.split()
            words[int(rng.integers(5, len(words) - 5))] = f"changed{n}x{i}"
            rows.append((len(rows), " ".join(words)))
    import pyarrow as pa

    found = index.search(*decontamination.word_hashes(pa.array([t for _, t in rows], pa.large_string())), 0.8)
    far = sum(r[4] > decontamination.RADIUS for r in found)
    want = {(d, i, s) for d, t in rows for _, i, s in plain_contaminations([(d, t)], [items[d // 30]])}
    assert {(r[0], r[1], round(r[5], 9)) for r in found} == want and far > 0


def test_fingerprints_of_long_texts_take_little_memory():
    """Hashes are taken apart to bits a few at a time, of long texts too."""
    import tracemalloc

    import pyarrow as pa

    from tessera.llm.simhash import fingerprints, shingle_hashes

    words = [f"w{i % 977}x{i % 89}" for i in range(60_000)]
    texts = [" ".join(words), "", "one", " ".join(words[:50])]
    tracemalloc.start()
    got = fingerprints(pa.array(texts, pa.large_string()), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    for text, value in zip(texts, got.tolist(), strict=True):
        own = shingle_hashes(text.encode().split(), 5)
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
