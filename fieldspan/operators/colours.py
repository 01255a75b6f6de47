"""Colour ranges from samples of pixels, and clicks by team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import colour_range

# Least reach and upper end of hue, saturation and value; below this mean saturation any hue counts.
FLOORS, TOPS = {"h": 8, "s": 35, "v": 35}, {"h": 180, "s": 255, "v": 255}
GREY = 50.0


def ranges(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, h_low, h_high, s_low, s_high, v_low, v_high, from the medians of clicks."""
    got = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in FLOORS for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    out = {}
    for c in FLOORS:
        low, high = colour_range(F.col(f"{c}_mean"), F.col(f"{c}_sd"), FLOORS[c], 0, TOPS[c])
        if c == "h":
            low, high = F.when(F.col("s_mean") < GREY, 0.0).otherwise(low), F.when(F.col("s_mean") < GREY, float(TOPS["h"])).otherwise(high)
        out[f"{c}_low"], out[f"{c}_high"] = low, high
    return got.select(*keys, "n", *[v.cast("int").alias(k) for k, v in out.items()])


def click_medians(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(*[F.median(c).alias(c) for c in FLOORS])


def yolo_labels(boxes: DataFrame, width: str, height: str) -> DataFrame:
    """boxes with line: class and box, normalised, six places, ties to even."""
    cx, cy = (F.col("l") + F.col("r")) / 2.0 / F.col(width), (F.col("t") + F.col("b")) / 2.0 / F.col(height)
    w, h = (F.col("r") - F.col("l")) / F.col(width), (F.col("b") - F.col("t")) / F.col(height)
    return boxes.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", *[F.rint(x.cast("double") * 1e6) / 1e6 for x in (cx, cy, w, h)]))
