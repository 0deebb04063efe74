"""Neighbourhood operators on pixel tables.

A frame is cut into square tiles; pixels near a tile border are also sent to
the tiles next to it (the halo).  Rows are shuffled once by (keys, tile) and
every row- or column-wise window then works inside a tile, because hashing by
(keys, tile) already clusters (keys, tile, row) and (keys, tile, column).  No
task ever holds more than one tile line at a time, whatever the frame size.
Neighbours are addressed by coordinate (range frames), so gaps in a sparse
frame do not shift anything.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noctule.functions import pixel as P
from noctule.session import stored

TILE = 256


def tiled(pixels: DataFrame, keys: list[str], halo: int, tile: int = TILE) -> DataFrame:
    """Pixels with their tile ``_tx, _ty``, border pixels repeated in each
    tile that needs them, shuffled by tile."""

    def tiles(axis: str) -> Column:
        lo = F.floor((F.col(axis) - halo) / tile)
        hi = F.floor((F.col(axis) + halo) / tile)
        return F.explode(F.sequence(lo, hi))

    spread = pixels.withColumn("_tx", tiles("x")).withColumn("_ty", tiles("y"))
    return spread.repartition(*keys, "_tx", "_ty")


def own(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Drop the halo copies."""
    mine = (F.col("_tx") == F.floor(F.col("x") / tile)) & (F.col("_ty") == F.floor(F.col("y") / tile))
    return rows.where(mine).drop("_tx", "_ty")


def _line(keys: list[str], along: str):
    across = "y" if along == "x" else "x"
    return W.partitionBy(*keys, "_tx", "_ty", across).orderBy(along)


def _at(value: Column, line, offset: int) -> Column:
    """Value ``offset`` cells further along the line; NULL when absent."""
    return F.max(value).over(line.rangeBetween(offset, offset))


def laplacian(pixels: DataFrame, keys: list[str], value: str, mode: str = "interior",
              out: str = "lap", tile: int = TILE) -> DataFrame:
    """Four-neighbour Laplacian.

    ``interior``: rows lacking a neighbour are dropped; ``border``: the centre
    is weighted by the neighbours present; ``zero``: missing ones count 0 and
    the magnitude is returned."""
    v = F.col(value)
    rows = tiled(pixels, keys, 1, tile)
    along_x, along_y = _line(keys, "x"), _line(keys, "y")
    rows = rows.select("*", _at(v, along_x, -1).alias("_w"), _at(v, along_x, 1).alias("_e"))
    rows = rows.select("*", _at(v, along_y, -1).alias("_n"), _at(v, along_y, 1).alias("_s"))
    near = ["_w", "_e", "_n", "_s"]
    rows = own(rows, tile)
    if mode == "interior":
        result = 4.0 * v - (F.col("_w") + F.col("_e") + F.col("_n") + F.col("_s"))
        return rows.withColumn(out, result).drop(*near).where(F.col(out).isNotNull())
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in near), F.lit(0.0))
    if mode == "border":
        count = sum((F.col(c).isNotNull().cast("int") for c in near), F.lit(0))
        return rows.withColumn(out, v * count - total).drop(*near)
    return rows.withColumn(out, F.abs(4.0 * v - total)).drop(*near)


def focus(pixels: DataFrame, cx: int, cy: int, radius: int, key: str = "frame_id",
          tile: int = TILE) -> DataFrame:
    """Variance of the Laplacian of the channel mean within a circle; a frame
    without inner pixels has no row."""
    gray = pixels.select(key, "x", "y", ((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("_g"))
    # one pixel beyond the circle is all the operator looks at
    near = gray.where(P.in_circle(F.col("x"), F.col("y"), cx, cy, radius + 1))
    lap = laplacian(near, [key], "_g", tile=tile).where(
        P.in_circle(F.col("x"), F.col("y"), cx, cy, radius))
    return lap.groupBy(key).agg(F.count(F.lit(1)).alias("n_pixels"), F.var_pop("lap").alias("focus"))


def box_sums(pixels: DataFrame, keys: list[str], values: dict[str, Column], radius: int,
             tile: int = TILE) -> DataFrame:
    """Sums over the (2r+1)-square around each pixel, in two 1-D passes.
    ``values`` maps output names to the summed expressions."""
    rows = tiled(pixels, keys, radius, tile)
    for axis in ("x", "y"):
        line = _line(keys, axis).rangeBetween(-radius, radius)
        terms = values if axis == "x" else {n: F.col(n) for n in values}
        rows = rows.withColumns({n: F.sum(e).over(line) for n, e in terms.items()})
    return own(rows, tile)


def mean(pixels: DataFrame, keys: list[str], value: str, radius: int = 1, amount: float = 1.0,
         out: str = "mean", tile: int = TILE) -> DataFrame:
    """Box mean over the pixels present, blended with the original."""
    v = F.col(value)
    sums = box_sums(pixels, keys, {"_s": v, "_c": F.when(v.isNotNull(), 1).otherwise(0)}, radius, tile)
    blurred = F.try_divide(F.col("_s"), F.col("_c"))
    return sums.withColumn(out, v * (1.0 - amount) + blurred * amount).drop("_s", "_c")


def local_contrast(pixels: DataFrame, keys: list[str], value: str, masked: Column | None = None,
                   out: str = "contrast", tile: int = TILE) -> DataFrame:
    """|v - mean of the 3x3 neighbourhood|, scaled by the maximum per key.

    Masked pixels get 0 and are left out of their neighbours' means."""
    masked = F.lit(False) if masked is None else masked
    used = pixels.withColumn("_u", F.when(~masked, F.col(value)))
    dev = mean(used, keys, "_u", 1, out="_m", tile=tile)
    dev = dev.withColumn("_d", F.coalesce(F.abs(F.col("_u") - F.col("_m")), F.lit(0.0))).drop("_m", "_u")
    tops = dev.groupBy(*keys).agg(F.greatest(F.max("_d"), F.lit(1e-12)).alias("_top"))
    return dev.join(stored(tops), keys).withColumn(out, P.clamp(F.col("_d") / F.col("_top"))).drop("_d", "_top")


def convolve(pixels: DataFrame, keys: list[str], value: str, kernel: dict[int, float],
             out: str = "blur", tile: int = TILE) -> DataFrame:
    """Separable convolution; beyond the frame the edge pixel is repeated.

    ``kernel`` maps offsets to weights and is applied along x, then y."""
    reach = max(abs(k) for k in kernel)
    rows = tiled(pixels, keys, reach, tile)
    source = F.col(value)
    for axis in ("x", "y"):
        line = _line(keys, axis)
        whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumns({"_first": F.first(source).over(whole), "_last": F.last(source).over(whole)})
        total = F.lit(0.0)
        for offset, weight in kernel.items():
            edge = F.col("_first") if offset < 0 else F.col("_last")
            cell = source if offset == 0 else F.coalesce(_at(source, line, offset), edge)
            total = total + cell * weight
        rows = rows.withColumn("_pass", total)
        # the next pass reads the result of this one
        rows = rows.drop("_first", "_last").withColumnRenamed("_pass", f"_{axis}")
        source = F.col(f"_{axis}")
    return own(rows, tile).withColumnRenamed("_y", out).drop("_x")


def gaussian(sigma: float) -> dict[int, float]:
    radius = math.ceil(3.0 * sigma)
    raw = {i: math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-radius, radius + 1)}
    total = sum(raw.values())
    return {i: w / total for i, w in raw.items()}


# Cubic B-spline taps of the à-trous wavelet.
B3_SPLINE = {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16}


def atrous(level: int) -> dict[int, float]:
    """B3 taps spread by ``2**level``."""
    return {k * 2**level: w for k, w in B3_SPLINE.items()}


def median(pixels: DataFrame, keys: list[str], value: str, radius: int, blend: float = 1.0,
           out: str = "median", tile: int = TILE) -> DataFrame:
    """Median over the (2r+1)-square with repeated edges, blended with the
    original.  Both passes gather at most 2r+1 cells per row."""
    rows = tiled(pixels, keys, radius, tile)
    rows = _gather(rows, keys, "x", radius, F.col(value), "_row")
    rows = _gather(rows, keys, "y", radius, F.col("_row"), "_square")
    middle = F.array_sort(F.flatten("_square"))[((2 * radius + 1) ** 2) // 2]
    result = F.col(value) * (1.0 - blend) + middle * blend
    return own(rows.withColumn(out, result), tile).drop("_row", "_square")


def _gather(rows: DataFrame, keys: list[str], axis: str, radius: int, value: Column, out: str) -> DataFrame:
    """The 2r+1 cells around each pixel along one axis, edges repeated."""
    line = _line(keys, axis)
    rows = rows.withColumns({
        "_cells": F.collect_list(value).over(line.rangeBetween(-radius, radius)),
        "_before": F.count(F.lit(1)).over(line.rangeBetween(-radius, 0)),
        "_after": F.count(F.lit(1)).over(line.rangeBetween(0, radius)),
    })
    padded = F.concat(
        F.array_repeat(F.element_at("_cells", 1), (radius + 1 - F.col("_before")).cast("int")),
        F.col("_cells"),
        F.array_repeat(F.element_at("_cells", -1), (radius + 1 - F.col("_after")).cast("int")))
    return rows.withColumn(out, padded).drop("_cells", "_before", "_after")


#: Up to this radius a square's cells are sorted per pixel, beyond it a histogram slides along the rows.
SORTED = 1


def slid_median(tile: np.ndarray, there: np.ndarray, radius: int) -> np.ndarray:
    """Upper middle of the cells present in the (2r+1)-square around each inner cell of a tile with a border of ``radius``.

    All rows slide along together.  A cell is its value's rank; each row's
    window is a histogram of ranks and one of groups of them, and a step takes
    one column in and one out, so its cost grows with the radius only.
    """
    height, width = tile.shape[0] - 2 * radius, tile.shape[1] - 2 * radius
    levels, rank = np.unique(tile[there], return_inverse=True)
    ranks = np.zeros(tile.shape, "i8")
    ranks[there] = rank
    group = max(1, int(len(levels) ** 0.5))
    fine = np.zeros((height, -(-len(levels) // group) * group), "i4")
    coarse = np.zeros((height, fine.shape[1] // group), "i4")
    rows = np.arange(height)[:, None] + np.arange(2 * radius + 1)
    line = np.broadcast_to(np.arange(height)[:, None], rows.shape)

    def put(column: int, sign: int) -> None:
        seen, at = there[rows, column], ranks[rows, column]
        np.add.at(fine, (line[seen], at[seen]), sign)
        np.add.at(coarse, (line[seen], at[seen] // group), sign)

    out = np.full((height, width), np.nan)
    for column in range(2 * radius):
        put(column, 1)
    each = np.arange(height)
    for x in range(width):
        put(x + 2 * radius, 1)
        upto = coarse.cumsum(1)
        wanted = upto[:, -1:] // 2 + 1
        block = (upto >= wanted).argmax(1)
        before = np.where(block > 0, upto[each, block - 1], 0)[:, None]
        inside = fine.reshape(height, -1, group)[each, block].cumsum(1)
        found = block * group + (inside + before >= wanted).argmax(1)
        out[:, x] = np.where(upto[:, -1] > 0, levels[np.minimum(found, len(levels) - 1)], np.nan)
        put(x, -1)
    return out


def wide_median(pixels: DataFrame, keys: list[str], value: str, radius: int, blend: float = 1.0,
                out: str = "median", tile: int = TILE) -> DataFrame:
    """``median`` for any radius: a task holds one tile with its border, whatever the frame.

    Edges are repeated at the frame's least and greatest coordinates; cells
    missing inside a frame, and values that are NULL, do not count."""
    ends = pixels.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    names = [*keys, "x", "y", out]
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*keys, "x", "y"]] + [f"`{out}` double"])

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        x, y, v = (cells.column(c).to_numpy() for c in ("x", "y", "_v"))
        tx, ty, x0, x1, y0, y1 = (cells.column(c)[0].as_py() for c in ("_tx", "_ty", "_x0", "_x1", "_y0", "_y1"))
        left, top = max(tx * tile, x0), max(ty * tile, y0)
        right, low = min(tx * tile + tile - 1, x1), min(ty * tile + tile - 1, y1)
        mine = (x >= left) & (x <= right) & (y >= top) & (y <= low)
        if not mine.any():  # a tile beyond the frame that only got a border
            return pa.table([*(cells.column(k).slice(0, 0) for k in [*keys, "x", "y"]), pa.array([], pa.float64())], names=names)
        # the frame as far as the windows of this tile reach, then its edges repeated
        a, b, c, d = max(left - radius, x0), min(right + radius, x1), max(top - radius, y0), min(low + radius, y1)
        frame = np.full((d - c + 1, b - a + 1), np.nan)
        frame[y - c, x - a] = v
        border = ((c - top + radius, low + radius - d), (a - left + radius, right + radius - b))
        whole = np.pad(frame, border, mode="edge")
        middle = slid_median(whole, ~np.isnan(whole), radius)
        result = v[mine] * (1.0 - blend) + middle[y[mine] - top, x[mine] - left] * blend
        own = cells.select([*keys, "x", "y"]).filter(pa.array(mine))
        return own.append_column(out, pa.array(result, from_pandas=True))

    slim = pixels.select(*keys, "x", "y", F.col(value).cast("double").alias("_v")).join(stored(ends, "ends"), keys)
    medians = tiled(slim, keys, radius, tile).groupBy(*keys, "_tx", "_ty").applyInArrow(run, schema)
    return pixels.join(medians, [*keys, "x", "y"])


def multiscale_median(pixels: DataFrame, keys: list[str], value: str, scales: int, blend: float,
                      out: str = "median", tile: int = TILE) -> DataFrame:
    """Medians of radius 1, 2, … applied one after another."""
    rows = pixels.withColumn(out, F.col(value))
    for radius in range(1, scales + 1):
        filtered = median if radius <= SORTED else wide_median
        rows = filtered(rows.withColumnRenamed(out, "_in"), keys, "_in", radius, blend, out, tile).drop("_in")
    return rows


def template_score(pixels: DataFrame, keys: list[str], size: int, sigma: float, width: int, height: int,
                   circle: tuple[int, int, int] | None = None, tile: int = TILE) -> DataFrame:
    """Normalised cross-correlation of luminance with a Gaussian star.

    The template is a product of two 1-D bells, so its correlation is two 1-D
    passes next to the plain and squared sums.  Only positions whose square
    lies within the frame are scored."""
    half = size // 2
    bell = [math.exp(-((i - half) ** 2) / (2.0 * sigma * sigma)) for i in range(size)]
    norm = sum(bell)
    bell = [w / norm for w in bell]
    n = size * size
    t_sum, t_square = 1.0, sum(w * w for w in bell) ** 2
    t_dev = math.sqrt(t_square - t_sum * t_sum / n)
    span = (-half, size - 1 - half)

    rows = pixels
    if circle is not None:
        cx, cy, radius = circle
        # keep every pixel a scored square can touch
        rows = rows.where(F.col("x").between(cx - radius - half, cx + radius + half)
                          & F.col("y").between(cy - radius - half, cy + radius + half))
    luma = P.luma(F.col("r"), F.col("g"), F.col("b"))
    rows = tiled(rows.select(*keys, "x", "y", luma.alias("_i")), keys, half, tile)
    for axis in ("x", "y"):
        line = _line(keys, axis)
        window = line.rangeBetween(*span)
        i, q, t = (F.col("_i"), F.col("_i") * F.col("_i"), F.col("_i")) if axis == "x" else (
            F.col("_si"), F.col("_sq"), F.col("_st"))
        weighted = F.lit(0.0)
        for k, w in enumerate(bell):
            weighted = weighted + F.coalesce(_at(t, line, k - half), F.lit(0.0)) * w
        rows = rows.select(*keys, "_tx", "_ty", "x", "y", "_i",
                           F.sum(i).over(window).alias("_si"), F.sum(q).over(window).alias("_sq"),
                           weighted.alias("_st"))
    rows = own(rows, tile).where(F.col("x").between(half, width - half - 1)
                                 & F.col("y").between(half, height - half - 1))
    if circle is not None:
        rows = rows.where(P.in_circle(F.col("x"), F.col("y"), *circle))
    mean_i = F.col("_si") / n
    spread = F.sqrt(F.greatest(F.col("_sq") - mean_i * F.col("_si"), F.lit(0.0))) * t_dev
    score = F.when(spread > 1e-5, F.try_divide(F.col("_st") - mean_i * t_sum, spread)).otherwise(0.0)
    return rows.select(*keys, "x", "y", score.alias("score"))


def thin(candidates: DataFrame, keys: list[str], distance: int = 8, limit: int | None = None) -> DataFrame:
    """Candidates ``(x, y, score)`` without a better one closer than
    ``distance``; better is a higher score, then lower y, then lower x.

    Joined by cells of the distance: a cell holds at most distance² positions
    of a frame, so the pairs per candidate are bounded by geometry."""
    best = candidates.groupBy(*keys, "x", "y").agg(F.max("score").alias("score"))
    cells = best.select("*", F.floor(F.col("x") / distance).alias("_cx"), F.floor(F.col("y") / distance).alias("_cy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    rivals = best.select(
        *keys, F.col("x").alias("_rx"), F.col("y").alias("_ry"), F.col("score").alias("_rs"),
        F.explode(around).alias("_dx")).select("*", F.explode(around).alias("_dy"))
    rivals = rivals.select(*keys, "_rx", "_ry", "_rs",
                           (F.floor(F.col("_rx") / distance) + F.col("_dx")).alias("_cx"),
                           (F.floor(F.col("_ry") / distance) + F.col("_dy")).alias("_cy"))
    dx, dy = F.col("c.x") - F.col("v._rx"), F.col("c.y") - F.col("v._ry")
    better = (F.col("v._rs") > F.col("c.score")) | ((F.col("v._rs") == F.col("c.score")) & (
        (F.col("v._ry") < F.col("c.y")) | ((F.col("v._ry") == F.col("c.y")) & (F.col("v._rx") < F.col("c.x")))))
    same = [F.col(f"c.{k}") == F.col(f"v.{k}") for k in [*keys, "_cx", "_cy"]]
    on = same[0]
    for term in same[1:]:
        on = on & term
    kept = cells.alias("c").join(rivals.alias("v"), on & (dx * dx + dy * dy < distance * distance) & better,
                                 "left_anti").drop("_cx", "_cy")
    if limit is None:
        return kept
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "y", "x")
    return kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


def near_rivals(candidates: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Pairs (better, worse) of candidates closer than ``distance``, as structs of (y, x); bounded by geometry."""
    size = F.floor(F.col("x") / distance), F.floor(F.col("y") / distance)
    around = F.sequence(F.lit(-1), F.lit(1))
    here = candidates.select(*keys, F.struct("y", "x").alias("worse"), F.col("score").alias("_s"), size[0].alias("_cx"), size[1].alias("_cy"))
    there = candidates.select(*keys, F.struct("y", "x").alias("better"), F.col("score").alias("_b"), F.explode(around).alias("_i"), size[0].alias("_px"), size[1].alias("_py"))
    there = there.select("*", F.explode(around).alias("_j")).select(*keys, "better", "_b", (F.col("_px") + F.col("_i")).alias("_cx"), (F.col("_py") + F.col("_j")).alias("_cy"))
    dx, dy = F.col("worse.x") - F.col("better.x"), F.col("worse.y") - F.col("better.y")
    above = (F.col("_b") > F.col("_s")) | ((F.col("_b") == F.col("_s")) & (F.col("better") < F.col("worse")))
    met = here.join(there, [*keys, "_cx", "_cy"]).where((dx * dx + dy * dy < distance * distance) & above)
    return met.select(*keys, "better", "worse")


def thin_greedy(candidates: DataFrame, keys: list[str], distance: int = 8, limit: int | None = None) -> DataFrame:
    """Candidates ``(x, y, score)`` as accepted one by one, best first, each
    unless one accepted before is closer than ``distance``.

    In rounds: a candidate without a better undecided one near it is accepted,
    and those near it fall.  Unlike in ``thin``, a candidate near one that has
    fallen may stand.  Only pairs of undecided candidates are kept."""
    best = stored(candidates.groupBy(*keys, "x", "y").agg(F.max("score").alias("score")), "candidates")
    pairs = stored(near_rivals(best, keys, distance), "rivals")
    fallen = None
    while not pairs.isEmpty():
        accepted = pairs.select(*keys, "better").join(pairs.select(*keys, F.col("worse").alias("better")), [*keys, "better"], "left_anti").distinct()
        falls = stored(pairs.join(accepted, [*keys, "better"]).select(*keys, "worse").distinct(), "fallen")
        fallen = falls if fallen is None else fallen.unionByName(falls)
        pairs = pairs.join(falls, [*keys, "worse"], "left_anti").join(falls.withColumnRenamed("worse", "better"), [*keys, "better"], "left_anti")
        pairs = stored(pairs, "rivals")
    kept = best
    if fallen is not None:
        kept = best.withColumn("worse", F.struct("y", "x")).join(fallen, [*keys, "worse"], "left_anti").drop("worse")
    if limit is None:
        return kept
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "y", "x")
    return kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).drop("_rank")


#: Levels that come out of one exchange: sums of a block of 8 x 8 by cells of 2 x 2.
DEPTH = 3


def tile_pyramid(pixels: DataFrame, keys: list[str], values: list[str], width: int, height: int,
                 levels: int = 4) -> DataFrame:
    """2x2 mean pyramid, level 0 being the input.

    One aggregate by blocks gives the sums and counts of three levels: what is
    shuffled is a block's partial sums, never pixels.  Further levels come from
    the sums of the third, 64 times fewer.  An odd last row or column is cut
    off at each level."""
    out = pixels.where((F.col("x") < width) & (F.col("y") < height)).select(
        *keys, F.lit(0).alias("level"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *values)
    source = pixels.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"),
                           *[F.struct(F.col(v).cast("double").alias("s"), F.col(v).isNotNull().cast("long").alias("n")).alias(v) for v in values])
    for done in range(0, levels - 1, DEPTH):
        deep = min(DEPTH, levels - 1 - done)
        source = _blocks(source, keys, values, deep)
        for level in range(1, deep + 1):
            at = (F.col("x") < width >> (done + level)) & (F.col("y") < height >> (done + level))
            cells = source.where(F.col("level") == level).where(at)
            out = out.unionByName(cells.select(*keys, F.lit(done + level).alias("level"), "x", "y", *[F.try_divide(F.col(f"{v}.s"), F.col(f"{v}.n")).alias(v) for v in values]))
        source = source.where(F.col("level") == deep).drop("level")
        if done + deep < levels - 1:
            source = stored(source, "pyramid")
    return out


def _blocks(source: DataFrame, keys: list[str], values: list[str], deep: int) -> DataFrame:
    """Sums and counts ``{s, n}`` of the next ``deep`` levels, by level and cell."""
    side = 2 ** (deep - 1)
    cell = F.floor(F.pmod("y", F.lit(2 * side)) / 2) * side + F.floor(F.pmod("x", F.lit(2 * side)) / 2)
    sums = [F.sum(F.when(F.col("_c") == i, F.col(f"{v}.{part}"))).alias(f"_{part}{k}_{i}") for k, v in enumerate(values) for i in range(side * side) for part in "sn"]
    block = source.select("*", F.floor(F.col("x") / (2 * side)).alias("_bx"), F.floor(F.col("y") / (2 * side)).alias("_by"), cell.alias("_c")).groupBy(*keys, "_bx", "_by").agg(*sums)
    cells = []
    for level in range(1, deep + 1):
        wide = side >> (level - 1)
        step = side // wide
        for cy in range(wide):
            for cx in range(wide):
                own = [(cy * step + i) * side + cx * step + j for i in range(step) for j in range(step)]
                total = lambda k, part: sum((F.coalesce(F.col(f"_{part}{k}_{i}"), F.lit(0)) for i in own[1:]), F.coalesce(F.col(f"_{part}{k}_{own[0]}"), F.lit(0)))  # noqa: E731, B023
                cells.append(F.struct(F.lit(level).alias("level"), (F.col("_bx") * wide + cx).alias("x"), (F.col("_by") * wide + cy).alias("y"),
                                      *[F.struct(total(k, "s").cast("double").alias("s"), total(k, "n").cast("long").alias("n")).alias(v) for k, v in enumerate(values)]))
    whole = block.select(*keys, F.inline(F.array(*cells)))
    seen = [F.col(f"{v}.n") for v in values]
    return whole.where(F.greatest(*seen, F.lit(0)) > 0)
