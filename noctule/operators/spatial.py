"""Grid lookups by position: nearest point and box statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.session import stored

#: A cell is four times as wide as those below it; the list of the widest has at most (ROOTS + 1) squared entries.
FAN, ROOTS = 4, 16
#: Cells are divided until none holds more points, DEPTH times at most (points that close are one place to a double).
LEAF, DEPTH, AT_ONCE = 32, 24, 5


def _images(grid: DataFrame, wrap: bool) -> DataFrame:
    """With ``wrap`` each point also stands one turn east and west."""
    grid = grid.select("pos", "val", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    # equal positions: the first in document order wins
    grid = grid.groupBy("lon", "lat").agg(F.min_by("val", "pos").alias("val"), F.min("pos").alias("pos"))
    if wrap:
        turns = F.explode(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)))
        grid = grid.select("pos", "val", "lat", "lon", turns.alias("_turn"))
        grid = grid.select("pos", "val", "lat", (F.col("lon") + F.col("_turn")).alias("lon"))
    return grid


def cell_sizes(points: DataFrame) -> list[float]:
    """Widths of the cells of an index over ``points (lon, lat)``, widest first; they follow from the points alone."""
    extent = points.agg(F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"))).first()[0] or 0.0
    sizes = [1.0]
    while extent > sizes[0] * ROOTS:
        sizes[0] *= FAN
    most = LEAF + 1
    while len(sizes) < DEPTH and most > LEAF:
        # a few widths at a time: one pass tells how far to go
        tried = [sizes[-1] / FAN ** k for k in range(AT_ONCE)]
        each = points.select("lon", "lat", F.explode(F.array(*map(F.lit, tried))).alias("_w"))
        full = each.groupBy("_w", F.floor(F.col("lon") / F.col("_w")), F.floor(F.col("lat") / F.col("_w"))).count().groupBy("_w").agg(F.max("count").alias("most"))
        found = {r["_w"]: r["most"] for r in full.toLocalIterator()}
        enough = next((k for k, w in enumerate(tried) if found.get(w, 0) <= LEAF), AT_ONCE - 1)
        most = found.get(tried[enough], 0)
        sizes += tried[1:enough + 1]
        if enough == 0:
            break
    return sizes


def _cell(lon: str, lat: str, size: float) -> list[Column]:
    return [F.floor(F.col(lon) / size).alias("_cx"), F.floor(F.col(lat) / size).alias("_cy")]


def _reach(c: Column, far: bool) -> Column:
    """Squared distance from a site to the nearest place a cell's points can have, or to the farthest."""
    total = F.lit(0.0)
    for lo, hi, place in (("x0", "x1", F.col("lon")), ("y0", "y1", F.col("lat"))):
        d = F.greatest(F.abs(place - c[lo]), F.abs(place - c[hi])) if far else F.greatest(c[lo] - place, place - c[hi], F.lit(0.0))
        total = total + d * d
    return total


def _bounded(sites: DataFrame) -> DataFrame:
    """One row per site and cell of its list ``_cells`` that can hold its closest point: none is nearer than another's farthest."""
    bound = sites.withColumn("_r", F.array_min(F.transform("_cells", lambda c: _reach(c, True))))
    kept = F.filter("_cells", lambda c: _reach(c, False) <= F.col("_r"))
    return bound.select("site", "lon", "lat", F.explode(kept).alias("_c")).select("site", "lon", "lat", "_c._cx", "_c._cy")


def nearest_point(sites: DataFrame, grid: DataFrame, wrap_lon: bool = False) -> DataFrame:
    """``sites (site, lon, lat)`` with the value of the closest grid point
    ``(pos, lon, lat, val)`` by plain distance in degrees.

    Points are indexed by cells of several widths, the narrowest of which hold
    ``LEAF`` points at most, however dense or irregular the grid is.  A point
    within the narrowest width of a site lies in the 3x3 narrowest cells around
    it, so an equi join settles every site that has one.  The others go down
    from the widest cells by branch and bound: of each width they keep only
    the cells that can hold their closest point, and meet points last."""
    points = stored(_images(grid, wrap_lon), "grid")
    sizes = cell_sizes(points)
    leaf = sizes[-1]
    around = F.sequence(F.lit(-1), F.lit(1))
    point = F.struct(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "pos", "val")
    low = points.groupBy(*_cell("lon", "lat", leaf)).agg(F.collect_list(point).alias("_points")).where("_cx is not null and _cy is not null")
    low = stored(low, "low")
    spread = low.select("*", F.explode(around).alias("_i")).select("*", F.explode(around).alias("_j"))
    spread = spread.groupBy((F.col("_cx") + F.col("_i")).alias("_cx"), (F.col("_cy") + F.col("_j")).alias("_cy")).agg(F.flatten(F.collect_list("_points")).alias("_points"))
    located = sites.select("site", "lon", "lat").distinct().select("*", *_cell("lon", "lat", leaf))
    # a row per cell and its neighbours: a site meets one row and gives one
    near = stored(_closest(located.join(stored(spread, "spread"), ["_cx", "_cy"], "left")), "near")
    settled = F.coalesce(F.col("_best._d") <= leaf * leaf, F.lit(False))

    cells = [points.groupBy(*_cell("lon", "lat", size)).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")) for size in sizes]
    box = F.struct("_cx", "_cy", "x0", "x1", "y0", "y1")
    roots = cells[0].agg(F.collect_list(box)).scalar()
    far = _bounded(near.where(~settled).select("site", "lon", "lat").withColumn("_cells", roots))
    for level in cells[1:]:
        below = level.select(F.floor(F.col("_cx") / FAN).alias("_px"), F.floor(F.col("_cy") / FAN).alias("_py"), box.alias("_b"))
        met = far.join(below, (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py")))
        far = _bounded(met.groupBy("site", "lon", "lat").agg(F.collect_list("_b").alias("_cells")))
    of_cells = _closest(far.join(low, ["_cx", "_cy"]))
    found = near.where(settled).unionByName(of_cells.groupBy("site", "lon", "lat").agg(F.min("_best").alias("_best")))
    return found.select("site", "lon", "lat", F.col("_best.val").alias("val"), F.sqrt("_best._d").alias("distance"))


def _closest(met: DataFrame) -> DataFrame:
    """Closest of the ``_points`` that a row's site has met; pairs stay within the row."""
    def measured(p: Column) -> Column:
        dx, dy = p["_lon"] - F.col("lon"), p["_lat"] - F.col("lat")
        d = dx * dx + dy * dy
        return F.when(d.isNotNull(), F.struct(d.alias("_d"), p["pos"].alias("pos"), p["val"].alias("val")))
    return met.select("site", "lon", "lat", F.array_min(F.transform("_points", measured)).alias("_best"))


def box_statistics(sites: DataFrame, grid: DataFrame, half: float = 2.5, wrap_lon: bool = False) -> DataFrame:
    """Maximum and mean of the grid values within ``half`` degrees of a site
    on both axes; sites with an empty box have no row."""
    turns = [0.0, 360.0, -360.0] if wrap_lon else [0.0]
    points = grid.select("val", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("lon"))
    points = points.select("val", "_lat", "lon", F.explode(F.array(*map(F.lit, turns))).alias("_turn"))
    points = points.select("val", "_lat", (F.col("lon") + F.col("_turn")).alias("_lon"))
    around = F.sequence(F.lit(-1), F.lit(1))
    cells = points.select("*", F.explode(around).alias("_i")).select("*", F.explode(around).alias("_j"))
    cells = cells.select("val", "_lon", "_lat", (F.floor(F.col("_lon") / half) + F.col("_i")).alias("_cx"),
                         (F.floor(F.col("_lat") / half) + F.col("_j")).alias("_cy"))
    located = sites.select("site", "lon", "lat", F.floor(F.col("lon") / half).alias("_cx"),
                           F.floor(F.col("lat") / half).alias("_cy"))
    inside = located.join(cells, ["_cx", "_cy"]).where(
        (F.abs(F.col("_lat") - F.col("lat")) <= half) & (F.abs(F.col("_lon") - F.col("lon")) <= half))
    return inside.groupBy("site", "lon", "lat").agg(
        F.max("val").alias("max_val"), F.avg("val").alias("avg_val"), F.count(F.lit(1)).alias("n_points"))
