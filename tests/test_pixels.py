import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noctule.functions import pixel as P
from noctule.operators import bracket, focal, photometry, ranks, resample, spatial, stack


def frame(spark, image, frame_id=0, name="v"):
    h, w = image.shape
    data = [(frame_id, x, y, float(image[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(data, f"frame_id int, x int, y int, {name} double")


def image_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def rgb(spark, values, frame_id=0, width=None):
    """Pixels in a row (or rows of ``width``) from (r, g, b) triples."""
    width = width or len(values)
    return spark.createDataFrame([(frame_id, i % width, i // width, *map(float, v)) for i, v in enumerate(values)],
                                 "frame_id int, x int, y int, r double, g double, b double")


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).random((13, 11))


# --- ranks ------------------------------------------------------------------

def test_ranks_are_exact_on_skewed_groups(spark):
    rng = np.random.default_rng(0)
    data = pd.concat([
        pd.DataFrame({"k": 1, "v": rng.random(4000)}), pd.DataFrame({"k": 2, "v": 0.5}, index=range(999)),
        pd.DataFrame({"k": 3, "v": rng.normal(0, 50, 501)}), pd.DataFrame({"k": 4, "v": 0.25 + rng.random(300) * 1e-9}),
        pd.DataFrame({"k": 5, "v": [7.0]})])
    out = ranks.rank_values(spark.createDataFrame(data), ["k"], "v", {
        "lo": lambda n: F.floor((n - 1) * 0.1) + 1, "hi": lambda n: n}).collect()
    for r in out:
        values = np.sort(data[data.k == r.k].v.values)
        assert r.n == len(values) and r.lo == values[int((len(values) - 1) * 0.1)] and r.hi == values[-1]
    medians = {r.k: r.median for r in ranks.median(spark.createDataFrame(data), ["k"], "v").collect()}
    assert medians == pytest.approx({k: g.v.median() for k, g in data.groupby("k")}, abs=0)
    low = {r.k: r.mean for r in ranks.lowest_mean(spark.createDataFrame(data), ["k"], "v", 0.1).collect()}
    for k, g in data.groupby("k"):
        assert low[k] == pytest.approx(np.sort(g.v.values)[:max(1, int(len(g) * 0.1))].mean())


# --- statistics -------------------------------------------------------------

def test_median_brightness_of_black_and_small_frames(spark):
    black = rgb(spark, [(0, 0, 0)] * 3, 1)
    one = rgb(spark, [(0, 0, 0), (0.5, 1.0, 2.0)], 2)
    out = {r.frame_id: tuple(r)[1:] for r in photometry.median_brightness(black.unionByName(one)).collect()}
    assert out[1] == (0.0, 0.0, 0.0)
    # ranks below the first pixel: the first bin that has reached 0 pixels of 0
    assert out[2] == pytest.approx((512 / 1023, 1.0, 1.0))


def test_noise_of_even_and_odd_counts(spark):
    medians = spark.createDataFrame([(1, 0.5), (2, 0.5)], "frame_id int, median_g double")
    odd = rgb(spark, [(0, g, 0) for g in (0.1, 0.4, 0.8)], 1)
    even = rgb(spark, [(0, g, 0) for g in (0.1, 0.4, 0.8, 0.7, 0.0)], 2)
    out = photometry.noise_sigma(odd.unionByName(even), medians, 0, 0, 100)
    got = {r.frame_id: (r.n_pixels, r.sigma_noise) for r in out.collect()}
    assert got[1] == (3, pytest.approx(1.4826 * 0.3)) and got[2] == (4, pytest.approx(1.4826 * 0.25))


def test_overexposure_needs_one_pixel_at_least(spark):
    out = photometry.overexposure(rgb(spark, [(1, 0, 0), (0, 0, 0)]), 1.0, 1e-5).first()
    assert (out.clipped, out.overexposed) == (1, 1)
    assert photometry.overexposure(rgb(spark, [(0.9, 0, 0)]), 1.0, 1e-5).first().overexposed == 0


def test_clipped_mean_is_null_when_a_channel_is_empty(spark):
    out = photometry.clipped_mean(rgb(spark, [(0.5, 0.5, 1.0)]), 0.1, 0.9).first()
    assert out.mean_r is None


def test_gray_scales_default_to_one(spark):
    out = photometry.gray_scales(rgb(spark, [(1, 1, 1), (0.5, 0.25, 0.125)]), 0, 0, 0, 0).first()
    assert (out.scale_r, out.scale_b) == (1.0, 1.0)


def reference_black_quantiles(levels):
    hist = np.bincount((levels * 2047).astype(int), minlength=2048)
    low, high = int(len(levels) * 0.01), int(len(levels) * 0.99)
    cumulative, p01, p99 = 0, 0.0, 1.0
    for b in range(2048):
        cumulative += hist[b]
        if cumulative >= low and p01 == 0.0:
            p01 = b / 2047
        if cumulative >= high:
            p99 = b / 2047
            break
    return p01, p99


@pytest.mark.parametrize("case", ["dark", "spread", "tiny", "zero"])
def test_black_point_quantiles(spark, case):
    rng = np.random.default_rng(3)
    levels = {"dark": rng.random(500) * 0.001, "spread": 0.02 + 0.2 * rng.random(700), "tiny": np.array([0.3, 0.4]),
              "zero": np.concatenate([np.full(300, 1e-5), rng.random(40)])}[case]
    out = photometry.black_point_statistics(rgb(spark, [(v, v, v) for v in levels]), 0.005, 0.02, 0.2).first()
    assert (out.p01, out.p99) == pytest.approx(reference_black_quantiles(levels))


def test_stretch_of_two_values_and_of_flat_frames(spark):
    flat = rgb(spark, [(0.5, 0.5, 0.5)], 1)
    two = rgb(spark, [(0.25, 0.75, -1.0)], 2)
    out = {r.frame_id: (r.r, r.g, r.b) for r in photometry.autostretch(flat.unionByName(two), 0.01, 0.99).collect()}
    assert out == {1: (0.5, 0.5, 0.5), 2: (0.0, 1.0, 0.0)}


def test_luma_median_of_histograms(spark):
    table = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (2, 9, 1), (3, 4, 2), (3, 8, 1), (4, 7, 4)],
                                  "frame_id int, bin int, n long")
    out = {r.frame_id: (r.min, r.max, r.median) for r in photometry.luma_statistics(table).collect()}
    assert out == {1: (5, 5, 5.0), 2: (5, 9, 7.0), 3: (4, 8, 4.0), 4: (7, 7, 7.0)}


def test_hue_round_trip(spark):
    table = rgb(spark, [(0.2, 0.4, 0.6), (0.6, 0.4, 0.2), (0.4, 0.6, 0.2), (0, 0, 0), (0.3, 0.3, 0.3), (1, 0, 0.5)])
    out = table.select("r", "g", "b", *[c.alias(f"o{i}") for i, c in enumerate(
        P.rgb_from_hsv(*P.hsv(F.col("r"), F.col("g"), F.col("b"))))]).collect()
    for r in out:
        assert (r.o0, r.o1, r.o2) == pytest.approx((r.r, r.g, r.b))


def test_sky_brightness_needs_stars(spark):
    table = spark.createDataFrame([(0, 1.0), (10, 4.0), (10, 0.0)], "n int, e double")
    out = table.select(photometry.sqm(F.col("n"), 21.2, 1.5).alias("a"),
                       photometry.sqm_corrected(F.col("n"), F.col("e"), F.lit(0.0), 21.2, 1.5).alias("b")).collect()
    assert out[0].a is None and out[0].b is None and out[1].a == pytest.approx(19.7)
    assert out[1].b == pytest.approx(21.2 - 1.5 * np.log10(5)) and out[2].b is None


# --- neighbourhoods ---------------------------------------------------------

@pytest.mark.parametrize("tile", [4, 256])
def test_focal_operators_against_numpy(spark, image, tile):
    table, shape, keys = frame(spark, image), image.shape, ["frame_id"]
    pad = np.pad(image, 2, mode="edge")
    kernel = focal.gaussian(0.6)
    want = sum(wy * wx * pad[2 + dy:2 + dy + 13, 2 + dx:2 + dx + 11]
               for dy, wy in kernel.items() for dx, wx in kernel.items())
    assert image_of(focal.convolve(table, keys, "v", kernel, tile=tile), "blur", shape) == pytest.approx(want)
    want = np.median([pad[1 + dy:14 + dy, 1 + dx:12 + dx] for dy in range(3) for dx in range(3)], axis=0)
    assert image_of(focal.median(table, keys, "v", 1, tile=tile), "median", shape) == pytest.approx(want)
    holes = np.pad(image, 1, constant_values=np.nan)
    want = np.nanmean([holes[dy:dy + 13, dx:dx + 11] for dy in range(3) for dx in range(3)], axis=0)
    assert image_of(focal.mean(table, keys, "v", 1, tile=tile), "mean", shape) == pytest.approx(want)
    lap = 4 * image[1:-1, 1:-1] - image[:-2, 1:-1] - image[2:, 1:-1] - image[1:-1, :-2] - image[1:-1, 2:]
    got = image_of(focal.laplacian(table, keys, "v", tile=tile), "lap", shape)[1:-1, 1:-1]
    assert got == pytest.approx(lap)
    gray = rgb(spark, [(v, v, v) for v in image.ravel()], width=11)
    inside = [(x - 5) ** 2 + (y - 6) ** 2 <= 16 for y in range(1, 12) for x in range(1, 10)]
    out = focal.focus(gray, 5, 6, 4, tile=tile).first()
    assert out.n_pixels == sum(inside) and out.focus == pytest.approx(lap.ravel()[inside].var())


def test_multiscale_median_repeats(spark, image):
    out = image_of(focal.multiscale_median(frame(spark, image), ["frame_id"], "v", 2, 1.0, tile=4), "median", image.shape)
    want = image
    for r in (1, 2):
        pad = np.pad(want, r, mode="edge")
        want = np.median([pad[dy:dy + 13, dx:dx + 11] for dy in range(2 * r + 1) for dx in range(2 * r + 1)], axis=0)
    assert out == pytest.approx(want)


def test_template_finds_a_star_in_the_circle(spark):
    yy, xx = np.mgrid[0:20, 0:20]
    sky = 0.1 + np.exp(-((xx - 8) ** 2 + (yy - 11) ** 2) / 2)
    table = rgb(spark, [(v, v, v) for v in sky.ravel()], width=20)
    scores = focal.template_score(table, ["frame_id"], 5, 1.0, 20, 20, circle=(9, 10, 6), tile=6)
    best = scores.orderBy(F.desc("score")).first()
    assert (best.x, best.y) == (8, 11) and best.score == pytest.approx(1.0)
    assert focal.thin(scores.where("score > 0.5"), ["frame_id"]).count() == 1


def test_thinning_against_brute_force(spark):
    rng = np.random.default_rng(5)
    points = {(int(x), int(y)): float(s) for x, y, s in zip(rng.integers(0, 40, 120), rng.integers(0, 40, 120),
                                                           rng.integers(0, 6, 120))}
    table = spark.createDataFrame([(0, x, y, s) for (x, y), s in points.items()], "frame_id int, x int, y int, score double")
    rank = lambda p: (-points[p], p[1], p[0])
    want = {p for p in points if not any(q != p and (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 < 64 and rank(q) < rank(p)
                                         for q in points)}
    assert {(r.x, r.y) for r in focal.thin(table, ["frame_id"]).collect()} == want


def test_pyramid_cuts_odd_edges(spark, image):
    out = focal.tile_pyramid(frame(spark, image), ["frame_id"], ["v"], 11, 13, 3).where("level = 2")
    assert image_of(out, "v", (3, 2)) == pytest.approx(image[:12, :8].reshape(3, 4, 2, 4).mean(axis=(1, 3)))


# --- geometry ---------------------------------------------------------------

@pytest.mark.parametrize("target", [(7, 5), (23, 31), (1, 1), (11, 13)])
def test_bilinear_against_numpy(spark, image, target):
    tw, th = target
    gx = np.arange(tw) * ((11 - 1) / (tw - 1) if tw > 1 else 0.0)
    gy = np.arange(th) * ((13 - 1) / (th - 1) if th > 1 else 0.0)
    x0, y0 = np.minimum(gx.astype(int), 10), np.minimum(gy.astype(int), 12)
    x1, y1 = np.minimum(x0 + 1, 10), np.minimum(y0 + 1, 12)
    wx, wy = gx - x0, (gy - y0)[:, None]
    top = image[y0][:, x0] * (1 - wx) + image[y0][:, x1] * wx
    low = image[y1][:, x0] * (1 - wx) + image[y1][:, x1] * wx
    out = resample.resize_bilinear(frame(spark, image), ["frame_id"], (11, 13), target, ["v"])
    assert image_of(out, "v", (th, tw)) == pytest.approx(top * (1 - wy) + low * wy)


def test_geometry_rejects_what_lies_outside(spark, image):
    table = frame(spark, image)
    with pytest.raises(ValueError):
        resample.crop(table, 5, 5, 10, 3, 11, 13)
    with pytest.raises(ValueError):
        resample.rotate(table, 45, 11, 13)
    with pytest.raises(ValueError):
        resample.extract_patches(table, [(8, 0)], 4, 11, 13)
    assert image_of(resample.rotate(table, 90, 11, 13), "v", (11, 13)) == pytest.approx(np.rot90(image, -1))


def test_panorama_option(spark):
    cells = resample.panorama_cells(spark, 8, 4, (20, 20), (10.0, 10.0), equidistant=True)
    edge = cells.where("y = 2 and x = 7")  # theta 0, phi 60 degrees: two thirds of the radius
    assert sum(r.w * r.sx for r in edge.collect()) == pytest.approx(10 + 10 * 2 / 3)


# --- stacks and brackets ----------------------------------------------------

@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    cube = rng.integers(0, 256, (23, 3, 2))
    data = [(0, s, x, y, 0, int(cube[s, y, x])) for s in range(23) for y in range(3) for x in range(2)]
    return cube, spark.createDataFrame(data, "series int, seq long, x int, y int, c int, v int")


def test_running_stacks_in_segments(series):
    cube, table = series
    for mode, fold in (("avg", lambda a: a.mean(0)), ("max", lambda a: a.max(0)), ("min", lambda a: a.min(0))):
        out = stack.running_stack(table, mode, segment=4)
        for s in (0, 3, 4, 22):
            want = np.floor(fold(cube[:s + 1]) + 0.5)
            assert (image_of(out.where(F.col("seq") == s), "v", (3, 2)) == want).all()


def test_motion_against_the_sequential_rule(series):
    cube, table = series
    background, total = cube[0].astype(float), np.zeros((3, 2))
    for f in cube:
        background = np.minimum(background, f)
        d = np.abs(f - background)
        total += np.where(d >= 30, d, 0)
    want = np.floor(total * 255 / total.max() + 0.5)
    assert (image_of(stack.stack(table, "motion", 30.0, segment=5), "v", (3, 2)) == want).all()
    assert (image_of(stack.stack(table, "motion", 300.0, segment=5), "v", (3, 2)) == 0).all()


def test_diff_and_sum(series):
    cube, table = series
    assert (image_of(stack.stack(table, "diff"), "v", (3, 2)) == np.abs(cube[-1] - cube[0])).all()
    assert (image_of(stack.stack(table, "sum"), "v", (3, 2)) == np.minimum(cube.sum(0), 255)).all()


def bracket_inputs(spark, images, medians):
    data = [(0, k, i, 0, *map(float, px)) for k, im in enumerate(images) for i, px in enumerate(im)]
    pixels = spark.createDataFrame(data, "bracket int, k int, x int, y int, r double, g double, b double")
    frames = spark.createDataFrame([(0, k, 8.0 / 2**k, m, m, m) for k, m in enumerate(medians)],
                                   "bracket int, k int, exposure double, median_r double, median_g double, median_b double")
    return pixels, frames


def test_weights_add_up_and_masked_pixels_get_none(spark):
    pixels, frames = bracket_inputs(spark, [[(0.5, 0.5, 0.5), (0, 0, 0), (1, 1, 1)], [(0.25, 0.25, 0.25), (0.2, 0.2, 0.2), (0.6, 0.6, 0.6)]],
                                    [0.4, 0.2])
    out = bracket.weights(pixels, frames).groupBy("x").agg(F.sum("w").alias("w"), F.min_by("w", "k").alias("first")).collect()
    got = {r.x: (r.w, r.first) for r in out}
    assert all(w == pytest.approx(1.0) for w, _ in got.values()) and got[1][1] == 0.0


def test_merge_modes_on_a_single_exposure(spark):
    pixels, frames = bracket_inputs(spark, [[(0.3, 0.4, 0.5), (0, 0, 0)]], [0.4])
    for mode in (0, 1, 2):
        out = {r.x: (r.r, r.g, r.b) for r in bracket.merge(pixels, frames, mode=mode).collect()}
        assert out[0] == pytest.approx((0.3, 0.4, 0.5)) and out[1] == (0.0, 0.0, 0.0)
    bad = frames.withColumn("median_r", F.lit(0.0))
    assert bracket.merge(pixels, bad).count() == 0


def test_peak_luminance_is_found_per_bracket(spark):
    pixels, frames = bracket_inputs(spark, [[(0.9, 0.9, 0.9)], [(0.8, 0.8, 0.8)]], [0.4, 0.2])
    out = bracket.linearize(pixels, frames, bracket.Settings(y_max=0)).first()
    assert out.y_max == pytest.approx(0.8 * 2 * 2 * 1.1)


# --- grid -------------------------------------------------------------------

def grid_table(spark, points):
    return spark.createDataFrame([(i, float(x), float(y), v) for i, (x, y, v) in enumerate(points)],
                                 "pos long, lon double, lat double, val int")


def test_nearest_point_near_far_and_tied(spark):
    rng = np.random.default_rng(4)
    points = [(x, y, int(rng.integers(0, 99))) for x, y in rng.integers(-60, 60, (80, 2))] + [(10, 10, 7), (10, 10, 8), (12, 10, 9)]
    places = [(0, 10.0, 10.0), (1, 11.0, 10.0)] + [(i + 2, float(a), float(b)) for i, (a, b) in enumerate(rng.random((60, 2)) * 300 - 100)]
    table = spark.createDataFrame(places, "site int, lon double, lat double").where("lat between -90 and 90 and lon between -180 and 360")
    out = {r.site: (r.val, r.distance) for r in spatial.nearest_point(table, grid_table(spark, points)).collect()}
    assert out[0][0] == 7 and out[1][0] == 7
    kept = [tuple(r) for r in table.collect()]
    assert len(out) == len(kept)
    for site, lon, lat in kept:
        assert out[site][1] == pytest.approx(min(np.hypot(x - lon, y - lat) for x, y, _ in points))


def test_seam_and_empty_boxes(spark):
    grid = grid_table(spark, [(359, 50, 5), (2, 50, 9), (100, 0, 1)])
    sites = spark.createDataFrame([(1, 0.5, 50.0), (2, 200.0, 0.0)], "site int, lon double, lat double")
    plain = {r.site: (r.max_val, r.n_points) for r in spatial.box_statistics(sites, grid).collect()}
    wrapped = {r.site: (r.max_val, r.avg_val) for r in spatial.box_statistics(sites, grid, wrap_lon=True).collect()}
    assert plain == {1: (9, 1)} and wrapped == {1: (9, 7.0)}
    assert {r.site: r.val for r in spatial.nearest_point(sites.where("site = 1").withColumn("lon", F.lit(0.4)), grid, wrap_lon=True).collect()} == {1: 5}


def test_brackets_beyond_the_depth_are_refused_or_merged(spark):
    rows = spark.createDataFrame([(1, 0, 0, k, 0.1 * (k + 1), 0.2, 0.2, 0.2, 0.2, False) for k in range(7)],
                                 "bracket int, x int, y int, k int, raw_w double, lin_y double, lin_r double, lin_g double, lin_b double, masked boolean")
    wide = bracket.side_by_side(rows, depth=7).first()
    assert wide["raw_w_6"] == pytest.approx(0.7)
    with pytest.raises(Exception, match="more than 5 exposures"):
        bracket.side_by_side(rows).collect()


@pytest.mark.parametrize("radius, tile", [(2, 8), (5, 256), (24, 16), (9, 7)])
def test_wide_medians_equal_sorting(spark, radius, tile):
    rng = np.random.default_rng(radius)
    frame = rng.integers(0, 40, (19, 23)) / 8.0
    rows = [(1, x, y, float(frame[y, x])) for y in range(19) for x in range(23)] + [(2, 100, -7, 3.5)]
    out = focal.wide_median(spark.createDataFrame(rows, "frame_id int, x int, y int, v double"), ["frame_id"], "v", radius, tile=tile).collect()
    padded = np.pad(frame, radius, mode="edge")
    want = {(1, x, y): np.sort(padded[y:y + 2 * radius + 1, x:x + 2 * radius + 1], None)[(2 * radius + 1) ** 2 // 2] for y in range(19) for x in range(23)}
    assert {(r.frame_id, r.x, r.y): r["median"] for r in out} == want | {(2, 100, -7): 3.5}


def test_wide_medians_leave_gaps_out(spark):
    rows = [(1, x, y, None if (x, y) == (2, 2) else float(10 * y + x)) for y in range(5) for x in range(5) if (x, y) != (1, 1)]
    out = {(r.x, r.y): r["median"] for r in focal.wide_median(spark.createDataFrame(rows, "frame_id int, x int, y int, v double"), ["frame_id"], "v", 2, tile=4).collect()}
    assert len(out) == 24 and out[2, 2] is None
    cells = sorted(10 * min(max(y, 0), 4) + min(max(x, 0), 4) for y in range(1, 6) for x in range(1, 6)
                   if (min(x, 4), min(y, 4)) not in ((1, 1), (2, 2)))
    assert out[3, 3] == cells[len(cells) // 2]


def test_slid_medians_take_time_that_grows_with_the_radius():
    frame = np.random.default_rng(0).random((128 + 96, 128 + 96))
    took = {}
    for radius in (6, 12, 24, 48):
        part = frame[:128 + 2 * radius, :128 + 2 * radius]
        laps = []
        for _ in range(3):
            begin = time.process_time()
            got = focal.slid_median(part, np.ones(part.shape, bool), radius)
            laps.append(time.process_time() - begin)
        took[radius] = min(laps)
        assert got[5, 7] == np.sort(part[5:6 + 2 * radius, 7:8 + 2 * radius], None)[(2 * radius + 1) ** 2 // 2]
    assert took[48] < 6 * took[12], took  # sorting would take sixteen times as long


def greedy(points, distance):
    kept = []
    for x, y, s in sorted(points, key=lambda p: (-p[2], p[1], p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= distance ** 2 for a, b, _ in kept):
            kept.append((x, y, s))
    return sorted(kept)


@pytest.mark.parametrize("levels", [1, 5, 1000])
def test_greedy_thinning_equals_one_by_one(spark, levels):
    rng = np.random.default_rng(levels)
    points = {(int(x), int(y)): float(rng.integers(levels)) for x, y in rng.integers(0, 60, (300, 2))}
    points = [(x, y, s) for (x, y), s in points.items()]
    rows = [(1, *p) for p in points] + [(2, *p) for p in points[:3]] + [(1, *points[0][:2], -5.0)]
    table = spark.createDataFrame(rows, "frame_id int, x int, y int, score double")
    out = focal.thin_greedy(table, ["frame_id"], 8).collect()
    assert sorted((r.x, r.y, r.score) for r in out if r.frame_id == 1) == greedy(points, 8)
    assert sorted((r.x, r.y, r.score) for r in out if r.frame_id == 2) == greedy(points[:3], 8)
    top = sorted(greedy(points, 8), key=lambda p: (-p[2], p[1], p[0]))[:2]
    assert {(r.x, r.y) for r in focal.thin_greedy(table.where("frame_id = 1"), ["frame_id"], 8, 2).collect()} == {p[:2] for p in top}
    assert focal.thin_greedy(table.where("false"), ["frame_id"]).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 4, 6])
def test_a_pyramid_is_one_cascade(spark, levels):
    rng = np.random.default_rng(3)
    frame = rng.random((43, 37))
    rows = [(1, x, y, float(frame[y, x]), None if x == 3 else 1.0) for y in range(43) for x in range(37)]
    out = focal.tile_pyramid(spark.createDataFrame(rows, "f int, x int, y int, v double, w double"), ["f"], ["v", "w"], 37, 43, levels)
    got = {(r.level, r.x, r.y): r.v for r in out.collect()}
    want = {(k, x, y): frame[y << k:(y + 1) << k, x << k:(x + 1) << k].mean() for k in range(levels) for y in range(43 >> k) for x in range(37 >> k)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pyramid_shuffles_sums_of_blocks_once(spark):
    rows = spark.range(64 * 64).select(F.lit(1).alias("f"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"), F.lit(0.5).alias("v"))
    plan = focal.tile_pyramid(rows, ["f"], ["v"], 64, 64)._jdf.queryExecution().executedPlan().toString()
    assert all("_bx" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning(f") <= 3  # the same one for each level, reused


# --- ranks and grids at volume -------------------------------------------------

def test_ranks_of_any_size_with_a_hot_group(spark):
    rng = np.random.default_rng(7)
    parts = {1: rng.random(30_000) * 1e6, 2: np.exp(rng.normal(0, 12, 9_000)) * rng.choice([-1, 1], 9_000), 3: np.full(20_000, 123456.789),
             4: 1e6 + rng.random(20_000) * 1e-6, 5: np.r_[np.zeros(8_000), 1e-300, -1e-300, 5e5], 6: np.array([-2.0, -1.0])}
    data = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    out = ranks.rank_values(spark.createDataFrame(data), ["k"], "v", {"a": lambda n: F.lit(1), "m": lambda n: F.floor((n + 1) / 2), "z": lambda n: n}).collect()
    assert {r.k: (r.n, r.a, r.m, r.z) for r in out} == {k: (len(v), *(np.sort(v)[i] for i in (0, (len(v) + 1) // 2 - 1, len(v) - 1))) for k, v in parts.items()}


def test_no_window_of_ranks_sees_more_than_a_rounds_bins(spark, monkeypatch):
    seen = []
    locate = ranks._locate

    def watched(counts, line, order):
        seen.append(counts.groupBy(*line).count().agg(F.max("count")).first()[0])
        return locate(counts, line, order)

    monkeypatch.setattr(ranks, "_locate", watched)
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "v": rng.random(60_000) * 1e6}))
    ranks.median(rows, ["k"], "v").collect()
    assert max(seen) <= ranks.BINS


@pytest.mark.parametrize("step, wrap", [(0.1, False), (0.1, True), (None, False)])
def test_nearest_point_on_dense_and_irregular_grids(spark, monkeypatch, step, wrap):
    rng = np.random.default_rng(11)
    if step:  # 90 x 40 degrees without a quarter of the points
        points = [(10 + step * i, step * j, int(i + j)) for i in range(300) for j in range(100) if rng.random() < 0.75]
    else:  # a cluster, lone points and one place far off
        points = [(float(a), float(b), i) for i, (a, b) in enumerate(np.r_[rng.normal(20, 0.001, (2000, 2)), rng.random((40, 2)) * 90, [[179.0, -80.0]]])]
    sites = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.r_[rng.random((60, 2)) * [360, 180] - [0, 90], [[20.0, 20.0], [-700.0, 500.0], [14.95, 3.33]]])]
    pairs = []
    closest = spatial._closest

    def watched(rows):
        pairs.append(rows.groupBy("site").count().agg(F.max("count")).first()[0] or 0)
        return closest(rows)

    monkeypatch.setattr(spatial, "_closest", watched)
    out = {r.site: r.distance for r in spatial.nearest_point(spark.createDataFrame(sites, "site int, lon double, lat double"), grid_table(spark, points), wrap_lon=wrap).collect()}
    places = np.array([p[:2] for p in points])
    if wrap:
        places = np.concatenate([places + [t, 0] for t in (0, 360, -360)])
    assert out == {s: pytest.approx(np.hypot(places[:, 0] - x, places[:, 1] - y).min()) for s, x, y in sites}
    assert max(pairs) <= 9 * spatial.LEAF  # whatever the number of points


def test_a_site_meets_its_neighbourhood_in_one_row(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = [(float(a), float(b), i) for i, (a, b) in enumerate(rng.random((3000, 2)) * 20)]
    sites = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((80, 2)) * 20)]
    met = []
    closest = spatial._closest

    def watched(rows):
        met.append(rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_points")).alias("p")).agg(F.max("n"), F.max("p")).first())
        return closest(rows)

    monkeypatch.setattr(spatial, "_closest", watched)
    rows = spark.createDataFrame(sites + sites[:9], "site int, lon double, lat double")
    out = spatial.nearest_point(rows, grid_table(spark, points)).collect()
    places = np.array([p[:2] for p in points])
    assert len(out) == len(sites) and {r.site: r.distance for r in out} == {s: pytest.approx(np.hypot(places[:, 0] - x, places[:, 1] - y).min()) for s, x, y in sites}
    assert met[0][0] == 1 and all((p or 0) <= 9 * spatial.LEAF for _, p in met)
