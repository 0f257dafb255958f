"""Hard negatives against a plain search over all rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import hard_negatives
from tessera.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, vector string, score string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "c") for r in rows], SCHEMA)


def plain(rows, every=10, positives=5, negatives=10, window=(30, 90), scale=256):
    good = [(i, int(b), [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, b, v in rows
            if i is not None and b is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, label, v in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i]
        for p, j, other in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted((n, k) for n, k, o in scored if o != label and window[0] * -p <= 100 * -n <= window[1] * -p)
            for rank, (n, k) in enumerate(inside[:negatives], 1):
                out[i, j, rank, k, -p, -n] += 1
    return out


def vectors(seed, count, size=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, size))
    out = []
    for i in range(count):
        v = middles[i % 5] * rng.choice([0.2, 1, 3]) + rng.normal(size=size) * rng.choice([0, 0.05, 1])
        out.append((i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in v]))
    return out


def odd():
    return vectors(1, 150) + vectors(1, 150)[20:24] + [
        (None, 1, [1.0] * 12), (300, None, [1.0] * 12), (310, 1, None), (320, 1, [None] + [1.0] * 11), (330, 1, [float("nan")] * 12), (340, 1, [float("inf")] * 12),
        (350, 1, []), (360, 2, [0.0] * 12), (370, 0, [0.5] * 3), (380, 0, [0.5] * 14)] + [(400 + i, i % 2, [0.25] * 12) for i in range(40)]


def mined(df, **options):
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


def test_equals_plain_search(spark):
    assert mined(frame(spark, odd())) == plain(odd())


def test_blocks_groups_and_other_parameters(spark, monkeypatch):
    """Many blocks of anchors and small groups; options are captured on the driver."""
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 1500)
    options = {"positives": 2, "negatives": 3, "window": (-50, 120), "scale": 16}
    assert mined(frame(spark, odd()), directions=3, **options) == plain(odd(), **options)
    assert mined(frame(spark, odd()), directions=0) == plain(odd())


def test_empty_and_single(spark):
    assert not mined(frame(spark, []))
    assert not mined(frame(spark, [(10, 1, [1.0, 2.0])]))
    assert not mined(frame(spark, [(10, None, None)]))


def test_bounds_hold_and_prune():
    """No pair's score leaves its bounds; rows of far bundles are not scored."""
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(4, 8)), 30, axis=0) + 1e-4 * rng.normal(size=(120, 8))])
    whole = np.floor(256 * raw).astype(np.int32)
    directions = hard_negatives.fit_directions(raw, 6)
    norms = np.linalg.norm(whole, axis=1)
    rows = hard_negatives.Rows.__new__(hard_negatives.Rows)
    rows.norm, rows.vector, rows.angle = norms, whole, hard_negatives.angles_to(directions, whole, norms)
    rows.cos, rows.sin = np.cos(rows.angle), np.sin(rows.angle)
    exact = whole.astype(np.int64) @ whole.T.astype(np.int64)
    least, most = hard_negatives.pair_bounds(rows, np.arange(180), rows, slice(0, 180))
    assert (least <= exact).all() and (exact <= most).all()
    assert (most[60:, 60:] - least[60:, 60:] < 0.2 * np.outer(norms[60:], norms[60:])).mean() > 0.2
    for at in range(0, 180, 30):
        low, high = hard_negatives.group_bounds(rows, slice(0, 180), rows, slice(at, at + 30))
        assert (low[:, None] <= exact[:, at:at + 30]).all() and (exact[:, at:at + 30] <= high[:, None]).all()


def test_scores_beyond_doubles():
    a = np.array([[1 << 24, 3, -(1 << 24)]], np.int32)
    b = np.array([[1 << 24, 1, 1 << 24], [(1 << 24) - 1, 7, 5]], np.int32)
    assert hard_negatives.whole_scores(a, b).tolist() == [[3, (1 << 24) * ((1 << 24) - 1) + 21 - 5 * (1 << 24)]]
