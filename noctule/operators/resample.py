"""Geometry: crop, rotate, resize, patches, panorama."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctule.session import stored

CHANNELS = ["r", "g", "b"]


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int,
         source_width: int, source_height: int) -> DataFrame:
    """Cut out a rectangle and count its coordinates from 0."""
    if x0 < 0 or y0 < 0 or width <= 0 or height <= 0 or x0 + width > source_width or y0 + height > source_height:
        raise ValueError("crop lies outside the frame")
    inside = pixels.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def rotate(pixels: DataFrame, angle: int, width: int, height: int) -> DataFrame:
    """Turn clockwise by 90, 180 or 270 degrees."""
    x, y = F.col("x"), F.col("y")
    turned = {90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}
    if angle not in turned:
        raise ValueError("angle must be 90, 180 or 270")
    return pixels.withColumns(dict(zip(("x", "y"), turned[angle])))


def mask_circle(pixels: DataFrame, cx: int, cy: int, radius: int) -> DataFrame:
    """Blacken everything outside a circle; radius 0 leaves all as it is."""
    if radius <= 0:
        return pixels
    dx, dy = F.col("x") - cx, F.col("y") - cy
    outside = dx * dx + dy * dy > radius * radius
    return pixels.withColumns({c: F.when(outside, 0.0).otherwise(F.col(c)) for c in CHANNELS})


def extract_patches(pixels: DataFrame, positions: list[tuple[int, int]], size: int,
                    width: int, height: int) -> DataFrame:
    """Square patches at fixed positions, coordinates counted from 0.

    The position list is part of the plan, so each pixel finds its patches
    without a join."""
    for x0, y0 in positions:
        if x0 < 0 or y0 < 0 or x0 + size > width or y0 + size > height:
            raise ValueError(f"patch at {(x0, y0)} lies outside the frame")
    table = F.array(*[F.struct(F.lit(i).alias("patch"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"))
                      for i, (x0, y0) in enumerate(positions)])
    hits = F.filter(table, lambda p: (F.col("x") >= p["x0"]) & (F.col("x") < p["x0"] + size)
                    & (F.col("y") >= p["y0"]) & (F.col("y") < p["y0"] + size))
    rows = pixels.select("*", F.explode(hits).alias("_p"))
    return rows.select(*[c for c in pixels.columns if c not in ("x", "y")], F.col("_p.patch").alias("patch"),
                       (F.col("x") - F.col("_p.x0")).alias("x"), (F.col("y") - F.col("_p.y0")).alias("y"))


def _targets(axis: str, source: int, target: int) -> Column:
    """Target cells a source cell adds to, with their linear weights.

    Target t reads source position g = t * (S-1) / (T-1): its whole part and
    the next cell, weighted by the fraction."""
    s = F.col(axis)
    step = (source - 1) / (target - 1) if target > 1 else 0.0
    if step == 0.0:
        cells = F.when(s == 0, F.sequence(F.lit(0), F.lit(target - 1))).otherwise(F.array().cast("array<int>"))
    else:
        first = F.greatest(F.floor((s - 1) / step).cast("int"), F.lit(0))
        last = F.least(F.ceil((s + 1) / step).cast("int"), F.lit(target - 1))
        cells = F.sequence(first, F.greatest(first, last))

    def weigh(t: Column) -> Column:
        g = t * step
        base = F.floor(g)
        upper = F.least(base + 1, F.lit(source - 1))
        part = g - base
        weight = (F.when(base == s, 1.0 - part).otherwise(0.0) + F.when(upper == s, part).otherwise(0.0))
        return F.struct(t.alias("t"), weight.alias("w"))

    return F.filter(F.transform(F.filter(cells, lambda t: t < target), weigh), lambda c: c["w"] > 0)


def resize_bilinear(pixels: DataFrame, keys: list[str], source: tuple[int, int], target: tuple[int, int],
                    values: list[str] = CHANNELS) -> DataFrame:
    """Bilinear resize with aligned corners.

    Each source pixel is scattered to the few target pixels it touches and
    summed there: one shuffle, no join with a target grid, and partial sums
    shrink a downscale before it is sent."""
    rows = pixels.select(*keys, "y", *values, F.explode(_targets("x", source[0], target[0])).alias("_x"))
    rows = rows.select(*keys, "_x", *values, F.explode(_targets("y", source[1], target[1])).alias("_y"))
    weight = F.col("_x.w") * F.col("_y.w")
    return rows.groupBy(*keys, F.col("_x.t").alias("x"), F.col("_y.t").alias("y")).agg(
        *[F.sum(F.col(v) * weight).alias(v) for v in values])


def downscale_nearest(pixels: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """Nearest-neighbour downscale; a map without shuffle."""
    out = pixels
    for axis, size in (("x", width), ("y", height)):
        new = max(int(size * scale), 1)
        s = F.col(axis)
        first = F.greatest(F.floor(s * scale).cast("int") - 1, F.lit(0))
        last = F.least(F.ceil((s + 1) * scale).cast("int") + 1, F.lit(new - 1))
        cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(cells, lambda t: F.least(F.floor(t / scale), F.lit(size - 1)) == s)
        out = out.withColumn("_t", F.explode(hits)).drop(axis).withColumnRenamed("_t", axis)
    return out


def panorama_cells(spark: SparkSession, width: int, height: int, frame: tuple[int, int],
                   center: tuple[float, float], start_degrees: float = 0.0,
                   equidistant: bool = False) -> DataFrame:
    """Source cells and weights of every panorama pixel: ``(x, y, sx, sy, w)``.

    Depends on the geometry only, so all frames share it."""
    fw, fh = frame
    radius = min(fw, fh) // 2
    grid = spark.range(width * height).select(
        (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    turn = 2.0 * math.pi
    theta = F.pmod((width - 1 - F.col("x")) / float(width) * turn + F.lit(math.fmod(math.radians(start_degrees), turn)),
                   F.lit(turn))
    phi = F.col("y") / float(height - 1) * (math.pi / 2)
    reach = radius * phi / (math.pi / 2)
    if not equidistant:
        reach = reach * F.sin(phi)
    sx, sy = center[0] + reach * F.cos(theta), center[1] + reach * F.sin(theta)
    grid = grid.select("x", "y", sx.alias("gx"), sy.alias("gy"))
    grid = grid.where((F.col("gx") >= 0) & (F.col("gx") < fw - 1) & (F.col("gy") >= 0) & (F.col("gy") < fh - 1))
    x0, y0 = F.floor("gx").cast("int"), F.floor("gy").cast("int")
    dx, dy = F.col("gx") - x0, F.col("gy") - y0
    corners = F.array(*[F.struct((x0 + i).alias("sx"), (y0 + j).alias("sy"),
                                 ((dx if i else 1.0 - dx) * (dy if j else 1.0 - dy)).alias("w"))
                        for i in (0, 1) for j in (0, 1)])
    return grid.select("x", "y", F.explode(corners).alias("_c")).select("x", "y", "_c.*").where("w > 0")


def panorama(pixels: DataFrame, keys: list[str], cells: DataFrame, values: list[str] = CHANNELS) -> DataFrame:
    """Project all-sky frames to a panorama strip."""
    source = pixels.withColumnsRenamed({"x": "sx", "y": "sy"})
    return source.join(cells, ["sx", "sy"]).groupBy(*keys, "x", "y").agg(
        *[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])


def subtract_dark(pixels: DataFrame, dark: DataFrame, keys: list[str], values: list[str] = CHANNELS) -> DataFrame:
    """Dark frame removed position by position, floored at 0.

    Pixels the dark frame does not cover are left out; ``same_size`` keeps
    the frames that match it."""
    d = dark.select(*keys, "x", "y", *[F.col(v).alias(f"_d_{v}") for v in values])
    joined = pixels.join(d, [*keys, "x", "y"])
    return joined.select(
        *[c for c in pixels.columns if c not in values],
        *[F.greatest(F.col(v) - F.col(f"_d_{v}"), F.lit(0) if _integral(pixels, v) else F.lit(0.0)).alias(v)
          for v in values])


def _integral(rows: DataFrame, column: str) -> bool:
    return dict(rows.dtypes)[column] in ("int", "bigint", "smallint")


def same_size(frames: DataFrame, series: str, order: str) -> DataFrame:
    """Frames as large as the first of their series."""
    first = stored(frames.groupBy(series).agg(F.min_by(F.struct("width", "height"), order).alias("_first")))
    return frames.join(first, series).where(
        (F.col("width") == F.col("_first.width")) & (F.col("height") == F.col("_first.height"))).drop("_first")
