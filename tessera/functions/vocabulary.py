"""Words that search routes to dimensions, and the colours that it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Colour words with their Lab and Oklab vectors.
COLORS = {
    "red": ((53.24, 80.09, 67.20), (0.628, 0.225, 0.126)), "红": ((53.24, 80.09, 67.20), (0.628, 0.225, 0.126)), "红色": ((53.24, 80.09, 67.20), (0.628, 0.225, 0.126)),
    "yellow": ((80.0, 0.0, 93.0), (0.968, -0.071, 0.199)), "黄": ((80.0, 0.0, 93.0), (0.968, -0.071, 0.199)), "黄色": ((80.0, 0.0, 93.0), (0.968, -0.071, 0.199)),
    "blue": ((32.3, 79.2, -107.9), (0.452, -0.032, -0.312)), "蓝": ((32.3, 79.2, -107.9), (0.452, -0.032, -0.312)), "蓝色": ((32.3, 79.2, -107.9), (0.452, -0.032, -0.312)),
    "green": ((46.2, -51.7, 49.9), (0.866, -0.234, 0.179)), "绿": ((46.2, -51.7, 49.9), (0.866, -0.234, 0.179)), "绿色": ((46.2, -51.7, 49.9), (0.866, -0.234, 0.179)),
    "white": ((100.0, 0.0, 0.0), (1.0, 0.0, 0.0)), "black": ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0)),
    "gray": ((53.6, 0.0, 0.0), (0.6, 0.0, 0.0)), "grey": ((53.6, 0.0, 0.0), (0.6, 0.0, 0.0)),
}
# Words of the other dimensions.
TERMS = {
    "materials": ["stone", "wood", "brick", "glass", "metal", "石", "木", "砖", "玻璃"],
    "uses": ["roof", "eave", "wall", "floor", "trim", "屋檐", "屋顶", "墙", "地板"],
    "styles": ["modern", "classic", "simple", "rustic", "现代", "古典", "简单"],
    "shape_terms": [
        "button_like", "cross_plane", "fence_like", "full_cube", "horizontal_thin_sheet", "irregular",
        "liquid_surface", "pane_like", "partial_cube", "post_like", "rod_like", "slab_like", "stair_like",
        "vertical_thin_sheet", "wall_like", "carpet", "stair", "slab", "pane", "wall", "fence",
    ],
}


def vocabulary(spark: SparkSession, more: dict[str, list[str]] | None = None) -> DataFrame:
    """(token, dimension) of the fixed words, and of more ones by dimension."""
    terms = {"colors": list(COLORS)} | {k: list(v) for k, v in TERMS.items()}
    for dimension, words in (more or {}).items():
        terms[dimension] = terms.get(dimension, []) + words
    return spark.createDataFrame([(w, d) for d, words in terms.items() for w in dict.fromkeys(words)], "token string, dimension string")


def color_targets(spark: SparkSession) -> DataFrame:
    """(token, lab, oklab) of the colour words."""
    return spark.createDataFrame([(w, list(lab), list(oklab)) for w, (lab, oklab) in COLORS.items()], "token string, lab array<double>, oklab array<double>")
