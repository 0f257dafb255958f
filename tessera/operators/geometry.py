"""Geometry of axis-aligned boxes (entity, min_x, min_y, min_z, max_x, max_y, max_z)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder

AXES = ("x", "y", "z")
_ENDS = [f"{n}_{a}" for n in ("min", "max") for a in AXES]

#: Boxes of a cell that one row holds; cells of more are split first.
CELL_BOXES = 4096
#: Box-and-grid-cell tests that are made at once.
TESTS_AT_ONCE = 1 << 21


def grid_volumes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Volume of the union of the boxes of each entity, (entities, boxes, 3): the boxes' own ends cut the
    space to a grid, and a grid cell counts if its middle lies in any box."""
    size, middle = [], []
    for a in range(3):
        ends = np.sort(np.concatenate([low[:, :, a], high[:, :, a]], axis=1), axis=1)
        size.append(np.diff(ends, axis=1))
        middle.append((ends[:, 1:] + ends[:, :-1]) / 2)
    held = np.zeros((len(low), *(m.shape[1] for m in middle)), bool)
    for k in range(low.shape[1]):
        x, y, z = ((low[:, k, a, None] <= middle[a]) & (middle[a] < high[:, k, a, None]) for a in range(3))
        held |= x[:, :, None, None] & y[:, None, :, None] & z[:, None, None, :]
    return np.einsum("exyz,ex,ey,ez->e", held, *size)


def cell_volume(low: np.ndarray, high: np.ndarray) -> float:
    """Volume of the union of many boxes (boxes, 3): the space is halved at medians of the boxes' faces until a
    cell is covered by one box, is empty, or has few faces inside."""
    total, stack = 0.0, [(low, high, low.min(axis=0), high.max(axis=0))]
    while stack:
        low, high, start, end = stack.pop()
        low, high = np.maximum(low, start), np.minimum(high, end)
        some = (low < high).all(axis=1)
        low, high = low[some], high[some]
        if not len(low):
            continue
        if ((low <= start) & (high >= end)).all(axis=1).any():
            total += float(np.prod(end - start))
            continue
        low, high = (x for x in np.split(np.unique(np.concatenate([low, high], axis=1), axis=0), 2, axis=1))
        inside = [np.concatenate([low[low[:, a] > start[a], a], high[high[:, a] < end[a], a]]) for a in range(3)]
        if len(low) * np.prod([len(i) + 1.0 for i in inside]) <= TESTS_AT_ONCE / 16:
            total += float(grid_volumes(low[None], high[None])[0])
            continue
        a = int(np.argmax([len(i) for i in inside]))
        cut = np.partition(inside[a], len(inside[a]) // 2)[len(inside[a]) // 2]
        left, right = end.copy(), start.copy()
        left[a] = right[a] = cut
        stack += [(low, high, start, left), (low, high, right, end)]
    return total


def volumes(boxes: list[np.ndarray]) -> np.ndarray:
    """Union volume of each array (boxes, 6); arrays of a few boxes go through the grid together."""
    out, count = np.zeros(len(boxes)), np.array([len(b) for b in boxes], int)
    for k in np.unique(count):
        which = np.nonzero(count == k)[0]
        if k == 0:
            continue
        if k > 12:
            for i in which:
                out[i] = cell_volume(boxes[i][:, :3], boxes[i][:, 3:])
            continue
        step = max(1, int(TESTS_AT_ONCE // (2 * k - 1) ** 3))
        for at in range(0, len(which), step):
            some = np.stack([boxes[i] for i in which[at:at + step]])
            out[which[at:at + step]] = grid_volumes(some[:, :, :3], some[:, :, 3:])
    return out


def _box() -> Column:
    return F.struct(*(F.col(c).cast("double").alias(c) for c in _ENDS))


def _union_of_lists(lists: DataFrame, key: str) -> DataFrame:
    """(key, volume and the ends of the extent) of rows (key, list of boxes); no boxes: zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("list")
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            ends = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in _ENDS], axis=1) if len(flat) else np.zeros((0, 6))
            boxes = np.split(ends, offsets[1:-1] - offsets[0])
            extent = np.array([np.concatenate([b[:, :3].min(axis=0), b[:, 3:].max(axis=0)]) if len(b) else np.zeros(6) for b in boxes]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(volumes(boxes)), *(pa.array(extent[:, k]) for k in range(6))], [key, "volume", *_ENDS])

    return lists.select(key, "list").mapInArrow(run, f"`{key}` {dict(lists.dtypes)[key]}, volume double, " + ", ".join(f"{c} double" for c in _ENDS))


def _split_cells(cells: DataFrame, key: str) -> DataFrame:
    """Rows (key, cell, from_ and to_ of each axis, ends of a box) of cells that hold up to CELL_BOXES boxes.

    In each round a cell of more is cut at a median of the faces inside, along the axis that has most
    of them, and its boxes are cut to the halves that they reach. Of a cell that one box covers, that
    box stays alone. Each round is a written table.
    """
    spark, names = cells.sparkSession, cells.columns
    schema = cells.schema
    while True:
        path = shared_folder(spark, "box-cells")
        cells.write.parquet(path)
        cells = spark.read.schema(schema).parquet(path)
        covers, tests = F.lit(True), []
        for a in AXES:
            inner = lambda c, a=a: F.when((F.col(c) > F.col(f"from_{a}")) & (F.col(c) < F.col(f"to_{a}")), F.col(c))
            low, high = inner(f"min_{a}"), inner(f"max_{a}")
            covers = covers & (F.col(f"min_{a}") <= F.col(f"from_{a}")) & (F.col(f"max_{a}") >= F.col(f"to_{a}"))
            tests += [F.coalesce(F.percentile_approx(low, 0.5), F.percentile_approx(high, 0.5)).alias(f"cut_{a}"), (F.count(low) + F.count(high)).alias(f"faces_{a}")]
        stats = cells.groupBy(key, "cell").agg(F.count("*").alias("n_"), F.bool_or(covers).alias("full_"), *tests, *(F.min(f"{e}_{a}").alias(f"{e}_{a}") for e in ("from", "to") for a in AXES))
        most = F.greatest(*(F.col(f"faces_{a}") for a in AXES))
        axis = F.coalesce(*(F.when(F.col(f"faces_{a}") == most, a) for a in AXES))
        path = shared_folder(spark, "box-cells")
        stats.withColumn("axis_", axis).write.parquet(path)
        stats = spark.read.parquet(path)
        large = stats.where((F.col("n_") > CELL_BOXES) & ~F.col("full_"))
        covered = stats.where("full_").select(key, "cell", *(f"{e}_{a}" for e in ("from", "to") for a in AXES), *(F.col(f"{w}_{a}").alias(f"{n}_{a}") for n, w in (("min", "from"), ("max", "to")) for a in AXES)).select(*names)
        same = cells.join(stats.where((F.col("n_") <= CELL_BOXES) & ~F.col("full_")).select(key, "cell"), [key, "cell"], "left_semi").unionByName(covered)
        if not large.limit(1).count():
            return same
        split = cells.join(large.select(key, "cell", "axis_", *(f"cut_{a}" for a in AXES)), [key, "cell"])
        halves = []
        for side, end, keep in (("0", "to", "min"), ("1", "from", "max")):
            half = split
            for a in AXES:
                here, cut = F.col("axis_") == a, F.col(f"cut_{a}")
                reaches = F.col(f"min_{a}") < cut if side == "0" else F.col(f"max_{a}") > cut
                half = half.where(~here | reaches).withColumn(f"{end}_{a}", F.when(here, cut).otherwise(F.col(f"{end}_{a}")))
                other = "max" if keep == "min" else "min"
                bound = F.least(f"max_{a}", f"to_{a}") if other == "max" else F.greatest(f"min_{a}", f"from_{a}")
                half = half.withColumn(f"{other}_{a}", bound)
            halves.append(half.withColumn("cell", F.concat("cell", F.lit(side))).select(*names))
        cells = same.unionByName(halves[0]).unionByName(halves[1])


def box_union(boxes: DataFrame, key: str) -> DataFrame:
    """(key, volume, width, height, depth, full_cube): the exact volume and extent of the union of each
    entity's boxes. Boxes without volume count for nothing; entities left without boxes get zeros.

    The boxes of an entity are one row, and rows of few boxes are reckoned together. The space of an
    entity of more than CELL_BOXES boxes is parted into cells first (a k-d tree), which are rows of their
    own, so that its boxes are never in one task.
    """
    real = F.lit(True)
    for a in AXES:
        real = real & (F.col(f"max_{a}") > F.col(f"min_{a}"))
    many = boxes.where(real).groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > CELL_BOXES).select(key)
    listed = lambda rows: rows.groupBy(key).agg(F.collect_list(F.when(real, _box())).alias("list"))
    if not many.limit(1).count():
        found = _union_of_lists(listed(boxes), key)
    else:
        large = boxes.where(real).join(many, key, "left_semi").select(key, *(F.col(c).cast("double").alias(c) for c in _ENDS))
        extent = large.groupBy(key).agg(*((F.min if c.startswith("min") else F.max)(c).alias(c) for c in _ENDS))
        frame = extent.select(key, *(F.col(f"{n}_{a}").alias(f"{e}_{a}") for n, e in (("min", "from"), ("max", "to")) for a in AXES))
        cells = _split_cells(large.join(frame, key).withColumn("cell", F.lit("")), key)
        lists = cells.groupBy(key, "cell").agg(F.collect_list(_box()).alias("list"))
        volume = _union_of_lists(lists, key).groupBy(key).agg(F.sum("volume").alias("volume"))
        found = _union_of_lists(listed(boxes.join(many, key, "left_anti")), key).unionByName(extent.join(volume, key))
    found = found.withColumn("volume", F.bround("volume", 12))
    full = F.abs(F.col("volume") - 1) <= 1e-12
    for a in AXES:
        full = full & (F.abs(F.col(f"min_{a}")) <= 1e-12) & (F.abs(F.col(f"max_{a}") - 1) <= 1e-12)
    return found.select(key, "volume", *((F.col(f"max_{a}") - F.col(f"min_{a}")).alias(n) for a, n in zip(AXES, ("width", "height", "depth"), strict=True)), full.alias("full_cube"))


def geometry_classes(full_cube: Column, sheet: Column, height: Column) -> Column:
    """Sorted classes: full_cube, horizontal_sheet, and by height thin (up to 0.125) or
    partial_height (below 1)."""
    return F.array_sort(F.array_compact(F.array(
        F.when(full_cube, "full_cube"), F.when(sheet, "horizontal_sheet"),
        F.when(height <= 0.125, "thin").when(height < 1, "partial_height"))))


def machine_tags(full_cube: Column, sheet: Column, behavior: dict[str, Column]) -> Column:
    """``shape:`` tags of the geometry and ``behavior:`` tags of the facts that are true."""
    return F.array_compact(F.array(
        F.when(full_cube, "shape:full_cube"), F.when(sheet, "shape:horizontal_sheet"),
        *(F.when(c.cast("string") == "true", f"behavior:{n}") for n, c in behavior.items())))


def shape_signature(boxes: Column) -> Column:
    """SHA-256 of an array of box structs in sorted order."""
    return F.sha2(F.to_json(F.array_sort(boxes)), 256)
