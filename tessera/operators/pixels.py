"""Image features over pixel tables (image_id, x, y, r, g, b, a, mask_a)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import luma, rgb_to_lab, rgb_to_oklab, saturation


def color_stats(pixels: DataFrame) -> DataFrame:
    """One row for each image; averages over pixels under the mask, zeros if there are none. Sums
    are combined before the shuffle."""
    own = F.col("mask_a") > 0
    rgb = [F.col(c).cast("double") for c in "rgb"]
    looked = pixels.withColumns({"ok_": rgb_to_oklab(*rgb), "lab_": rgb_to_lab(*rgb), "luma_": luma(*rgb), "sat_": saturation(*rgb), "own_": own})
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(F.col("own_"), c)), 8), F.lit(0.0))
    return looked.groupBy("image_id").agg(
        F.bround(F.count_if("own_") / F.count("*"), 8).alias("mask_coverage"), F.bround(F.count_if(F.col("a") == 0) / F.count("*"), 8).alias("transparent_ratio"),
        F.array(*(mean(c / 255.0) for c in rgb)).alias("average_rgb"), F.array(*(mean(F.get("ok_", F.lit(i))) for i in range(3))).alias("oklab"),
        F.array(*(mean(F.get("lab_", F.lit(i))) for i in range(3))).alias("lab"), mean(F.col("luma_")).alias("brightness"), mean(F.col("sat_")).alias("saturation"))


def edge_stats(pixels: DataFrame) -> DataFrame:
    """Edge density and direction: pixels under the mask without a right or a lower neighbour."""
    own = pixels.where("mask_a > 0").select("image_id", "x", "y")
    right = own.select("image_id", (F.col("x") - 1).alias("x"), "y", F.lit(1).alias("right"))
    lower = own.select("image_id", "x", (F.col("y") - 1).alias("y"), F.lit(1).alias("lower"))
    seen = own.join(right, ["image_id", "x", "y"], "left").join(lower, ["image_id", "x", "y"], "left")
    counts = seen.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("right").isNull()).alias("h"), F.count_if(F.col("lower").isNull()).alias("v"))
    found = counts.select("image_id", F.bround((F.col("h") + F.col("v")) / F.greatest(F.lit(1), F.col("n") * 2), 8).alias("edge_density"),
                          F.bround(F.abs(F.col("h") - F.col("v")) / F.greatest(F.lit(1), F.col("h") + F.col("v")), 8).alias("directionality"))
    images = pixels.select("image_id").distinct()
    return images.join(found, "image_id", "left").select("image_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("edge_density", "directionality")))


def quality_stats(pixels: DataFrame) -> DataFrame:
    """Bounds and counts of visible pixels, quadrants, and the tests empty, too small, off canvas."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    seen = F.col("a") > 0
    right, low = F.col("x") >= F.floor(F.col("width") / 2), F.col("y") >= F.floor(F.col("height") / 2)
    stats = pixels.join(size, "image_id").groupBy("image_id").agg(
        F.first("width").alias("width"), F.first("height").alias("height"),
        F.min(F.when(seen, F.col("x"))).alias("left"), F.min(F.when(seen, F.col("y"))).alias("top"), F.max(F.when(seen, F.col("x"))).alias("right"), F.max(F.when(seen, F.col("y"))).alias("bottom"),
        F.count_if(seen).alias("object_pixels"), F.count_if(~seen).alias("background_pixels"),
        *(F.count_if(seen & (right if i % 2 else ~right) & (low if i // 2 else ~low)).alias(f"quadrant_{i}") for i in range(4)))
    return stats.withColumns({
        "empty": F.col("object_pixels") == 0,
        "too_small": F.col("object_pixels") < F.greatest(F.lit(1), F.floor(F.col("width") * F.col("height") / 256)),
        "off_canvas": F.coalesce((F.col("left") == 0) | (F.col("top") == 0) | (F.col("right") == F.col("width") - 1) | (F.col("bottom") == F.col("height") - 1), F.lit(False))})


# The two colours of the sign for a missing texture.
DARK, BRIGHT = (0, 0, 0, 255), (248, 0, 248, 255)


def checker_test(pixels: DataFrame) -> DataFrame:
    """(image_id, checker): the visible area is a filled even rectangle in four equal quarters of two
    colours: in each quarter all pixels have the quarter's colour, so it counts a quarter of the area."""
    box = quality_stats(pixels).select("image_id", "left", "top", (F.col("right") - F.col("left") + 1).alias("w"), (F.col("bottom") - F.col("top") + 1).alias("h"))
    even = box.where("w >= 2 and h >= 2 and w % 2 = 0 and h % 2 = 0")
    is_ = lambda colour: F.struct("r", "g", "b", "a") == F.struct(*(F.lit(v).cast("int") for v in colour))
    right, low = F.col("x") - F.col("left") >= F.col("w") / 2, F.col("y") - F.col("top") >= F.col("h") / 2
    typed = pixels.select("image_id", "x", "y", *(F.col(c).cast("int").alias(c) for c in "rgba"))
    counts = typed.where("a > 0").join(even, "image_id").groupBy("image_id").agg(
        F.count("*").alias("n"), F.first(F.col("w") * F.col("h")).alias("area"), F.count_if((right == low) & is_(DARK)).alias("dark"), F.count_if((right != low) & is_(BRIGHT)).alias("bright"))
    good = counts.select("image_id", ((F.col("n") == F.col("area")) & (F.col("dark") * 2 == F.col("area")) & (F.col("bright") * 2 == F.col("area"))).alias("checker"))
    return box.select("image_id").join(good, "image_id", "left").select("image_id", F.coalesce("checker", F.lit(False)).alias("checker"))


def _unfiltered(lines: np.ndarray, width: int) -> np.ndarray:
    """Pixels (height, width, 4) of PNG lines (filter byte first).

    Lines that depend on the one above or the pixel to the left alone are sums. Where a line also takes
    the mean or the Paeth guess of both, all lines are worked off along diagonals: the pixels of one
    diagonal depend on the two before it, not on each other.
    """
    kind, raw = lines[:, 0], lines[:, 1:].reshape(len(lines), width, 4)
    if kind.max(initial=0) > 4:
        raise ValueError("filter")
    if kind.max(initial=0) <= 2:
        out, above = np.empty_like(raw), np.zeros((width, 4), np.uint8)
        for y, row in enumerate(raw):
            above = out[y] = np.cumsum(row, axis=0, dtype=np.uint8) if kind[y] == 1 else row + above if kind[y] == 2 else row
        return out
    height = len(raw)
    steps = width + height - 1
    y = np.arange(height)
    # diagonal[d + 2, y + 1] is the pixel (d - y, y); the rows and the column before are zeros.
    diagonal = np.zeros((steps + 2, height + 1, 4), np.int16)
    skewed = np.zeros((steps, height, 4), np.int16)
    at = np.arange(width)[None, :] + y[:, None]
    skewed[at, y[:, None]] = raw
    left_only, up_only, mean, guess = (kind[:, None] == k for k in (1, 2, 3, 4))
    for d in range(steps):
        a, b, c = diagonal[d + 1, 1:], diagonal[d + 1, :-1], diagonal[d, :-1]
        pa, pb = np.abs(b - c), np.abs(a - c)
        pc_ = np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc_), a, np.where(pb <= pc_, b, c))
        add = np.where(guess, paeth, np.where(mean, (a + b) >> 1, np.where(left_only, a, np.where(up_only, b, 0))))
        low, high = max(0, d - width + 1), min(height, d + 1)  # lines that the diagonal crosses
        diagonal[d + 2, low + 1:high + 1] = (skewed[d, low:high] + add[low:high]) & 255
    return diagonal[at + 2, y[:, None] + 1].astype(np.uint8)


def _decoded(raw: bytes) -> tuple[int, int, bytes]:
    """Width, height and pixels of an 8-bit RGBA PNG that is not interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("signature")
    at, data, head = 8, [], None
    while at + 8 <= len(raw):
        n, name = struct.unpack(">I4s", raw[at:at + 8])
        body = raw[at + 8:at + 8 + n]
        if len(body) < n or zlib.crc32(name + body) != int.from_bytes(raw[at + 8 + n:at + 12 + n], "big"):
            raise ValueError("chunk")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        at += 12 + n
    if head is None or head[2:] != (8, 6, 0, 0, 0):
        raise ValueError("format")
    width, height, lines = head[0], head[1], zlib.decompress(b"".join(data))
    if len(lines) != height * (4 * width + 1):
        raise ValueError("size")
    return width, height, _unfiltered(np.frombuffer(lines, np.uint8).reshape(height, -1), width).tobytes()


def decode_images(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Pixels of PNG files (8-bit RGBA, not interlaced): (key, width, height, pixels, error), pixels
    as one binary of 4 bytes each. A file that cannot be decoded becomes a row with its error: signature,
    chunk, format, size, filter, or the text of the decompressor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time: a row is large
                try:
                    width, height, pixels, error = *_decoded(batch.column(1)[i].as_py() or b""), None
                except (ValueError, zlib.error, struct.error) as wrong:
                    width, height, pixels, error = None, None, None, str(wrong)[:100]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([pixels], pa.binary()), pa.array([error], pa.string())],
                                                 [key, "width", "height", "pixels", "error"])

    return files.select(F.col(key).cast("string").alias(key), content).mapInArrow(run, f"{key} string, width int, height int, pixels binary, error string")


def image_codes(decoded: DataFrame, kind: str, key: str = "path", side: int = 512) -> DataFrame:
    """(code, subject) of decoded images: PNG_SIGNATURE_INVALID, PNG_RGBA_REQUIRED, PNG_DECODE_FAILED, and
    for ``kind`` PREVIEW or MASK, _FORMAT_INVALID for another size and _OBJECT_EMPTY for no visible pixel."""
    failed = F.when(F.col("error") == "signature", "PNG_SIGNATURE_INVALID").when(F.col("error") == "format", "PNG_RGBA_REQUIRED").when(F.col("error").isNotNull(), "PNG_DECODE_FAILED")
    # A pixel is eight hexadecimal digits, the last two its alpha.
    seen = ~F.hex("pixels").rlike("^(?:[0-9A-F]{6}00)*+$")
    codes = F.array_compact(F.array(failed, F.when(F.col("error").isNull() & ((F.col("width") != side) | (F.col("height") != side)), f"{kind}_FORMAT_INVALID"), F.when(F.col("error").isNull() & ~seen, f"{kind}_OBJECT_EMPTY")))
    return decoded.select(F.explode(codes).alias("code"), F.col(key).alias("subject"))


def explode_pixels(images: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """The pixel table of decoded images and their masks of the same size."""
    joined = images.where("error is null").join(masks.where("error is null").select(key, F.col("pixels").alias("mask"), F.col("width").alias("mw"), F.col("height").alias("mh")), key).where("width = mw and height = mh")
    byte = lambda c, at: F.conv(F.hex(F.substring(c, at, F.lit(1))), 16, 10).cast("int")
    at = joined.select(key, "width", "pixels", "mask", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return at.select(key, (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
                     *(byte(F.col("pixels"), F.col("i") * 4 + 1 + k).alias(c) for k, c in enumerate("rgba")), byte(F.col("mask"), F.col("i") * 4 + 4).alias("mask_a"))
