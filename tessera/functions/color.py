"""Colour arithmetic and weighted scores as native double expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the search dimensions.
WEIGHTS = {"shape": 0.35, "color": 0.30, "use": 0.15, "name_synonym": 0.10, "style": 0.05, "behavior": 0.05}


def srgb_to_linear(channel: Column) -> Column:
    """``channel`` in 0..1."""
    return F.when(channel <= 0.04045, channel / 12.92).otherwise(F.pow((channel + 0.055) / 1.055, F.lit(2.4)))


def signed_cbrt(value: Column) -> Column:
    return F.signum(value) * F.pow(F.abs(value), F.lit(1.0 / 3.0))


def _linear(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(srgb_to_linear(x / 255.0) for x in (r, g, b))


def rgb_to_oklab(r: Column, g: Column, b: Column) -> Column:
    """Array (L, a, b), rounded to 8 places, from 0..255 channels."""
    r, g, b = _linear(r, g, b)
    # Published sRGB to OKLab matrices.
    long = signed_cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)
    middle = signed_cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
    short = signed_cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
    return F.array(
        F.bround(0.2104542553 * long + 0.7936177850 * middle - 0.0040720468 * short, 8),
        F.bround(1.9779984951 * long - 2.4285922050 * middle + 0.4505937099 * short, 8),
        F.bround(0.0259040371 * long + 0.7827717662 * middle - 0.8086757660 * short, 8))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """Array (L, a, b) for the D65 white, rounded to 8 places."""
    r, g, b = _linear(r, g, b)
    # sRGB to XYZ (D65) and its white.
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    delta = 6.0 / 29.0

    def f(t: Column) -> Column:
        return F.when(t > delta**3, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t / (3 * delta**2) + 4.0 / 29.0)

    return F.array(F.bround(116 * f(y) - 16, 8), F.bround(500 * (f(x) - f(y)), 8), F.bround(200 * (f(y) - f(z)), 8))


def luma(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high == 0, 0.0).otherwise((high - low) / high)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def color_similarity(lab: Column, oklab: Column, targets: Column) -> Column:
    """1 minus the least mixed distance to ``targets`` (array of structs lab, oklab), within 0..1;
    0 without a vector or a target."""
    nearest = F.array_min(F.transform(targets, lambda t: 0.5 * distance(lab, t["lab"]) / 181.0 + 0.5 * distance(oklab, t["oklab"]) / (3.0**0.5)))
    usable = (F.size(lab) == 3) & (F.size(oklab) == 3) & nearest.isNotNull()
    return F.when(usable, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - nearest)), 8)).otherwise(0.0)


def weighted_score(matches: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the dimensions that are present (not null), rounded to 8 places."""
    clipped = {k: F.when(m.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), m)), 8)) for k, m in matches.items()}
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    total = add(F.when(m.isNotNull(), weights[k]).otherwise(0.0) for k, m in matches.items())
    found = add(F.coalesce(m * weights[k], F.lit(0.0)) for k, m in clipped.items())
    return F.when(total == 0, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found / total)), 8))
