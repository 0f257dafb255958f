"""Unions of boxes: grids, halved cells and k-d rounds against counting unit cells."""

import time

import numpy as np

from tessera.operators import geometry
from tessera.operators.geometry import box_union

SCHEMA = "entity string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def counted(boxes, side):
    """Volume by unit cells of boxes with whole ends."""
    held = np.zeros((side,) * 3, bool)
    for b in boxes:
        held[b[0]:b[3], b[1]:b[4], b[2]:b[5]] = True
    return int(held.sum())


def drawn(rng, count, side, size):
    low = rng.integers(0, side, (count, 3))
    return np.concatenate([low, np.minimum(low + rng.integers(0, size, (count, 3)), side)], axis=1)


def slabs(rng, count, side):
    out = []
    for i in range(count):
        low, high = [0, 0, 0], [side] * 3
        low[i % 3] = int(rng.integers(0, side))
        high[i % 3] = min(side, low[i % 3] + 1)
        out.append([*low, *high])
    return np.array(out)


def entities(rng):
    one = np.array([[2, 2, 2, 7, 7, 7]])
    return {"few": drawn(rng, 5, 20, 9), "some": drawn(rng, 12, 20, 9), "more": drawn(rng, 300, 40, 9), "slabs": slabs(rng, 90, 60), "copies": np.repeat(one, 400, axis=0), "one": one,
            "flat": np.array([[1, 1, 1, 1, 5, 5]]), "cover": np.concatenate([drawn(rng, 200, 20, 9), [[0, 0, 0, 20, 20, 20]]])}


def check(spark, made):
    rows = [(k, *map(float, b)) for k, v in made.items() for b in v]
    got = {r["entity"]: r for r in box_union(spark.createDataFrame(rows, SCHEMA), "entity").collect()}
    assert set(got) == set(made)
    for k, v in made.items():
        real = v[(v[:, :3] < v[:, 3:]).all(axis=1)]
        assert got[k]["volume"] == counted(real, 64)
        extent = real[:, 3:].max(axis=0) - real[:, :3].min(axis=0) if len(real) else np.zeros(3)
        assert (got[k]["width"], got[k]["height"], got[k]["depth"]) == tuple(extent)


def test_lists_and_halved_cells(spark):
    check(spark, entities(np.random.default_rng(1)))


def test_cells_of_large_entities(spark, monkeypatch):
    """With few boxes to a cell most entities are parted over several rounds."""
    monkeypatch.setattr(geometry, "CELL_BOXES", 40)
    check(spark, entities(np.random.default_rng(2)))


def test_ten_thousand_boxes_in_one_entity(spark):
    rng = np.random.default_rng(3)
    made = {"large": drawn(rng, 10_000, 60, 6), "small": drawn(rng, 3, 60, 30)}
    began = time.time()
    check(spark, made)
    assert time.time() - began < 120


def test_empty_and_full(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert box_union(empty, "entity").collect() == []
    rows = [("a", 0.0, 0.0, 0.0, 1.0, 0.5, 1.0), ("a", 0.0, 0.5, 0.0, 1.0, 1.0, 1.0), ("b", 0.0, 0.0, 0.0, 1.0, 0.5, 1.0), ("c", None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    got = {r["entity"]: (r["volume"], r["full_cube"]) for r in box_union(spark.createDataFrame(rows, SCHEMA), "entity").collect()}
    assert got == {"a": (1.0, True), "b": (0.5, False), "c": (0.0, False)}
