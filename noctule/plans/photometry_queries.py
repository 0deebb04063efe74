"""Queries over pixel tables: frame statistics, corrections, pixel functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from noctule.functions import pixel as P
from noctule.operators import photometry as ph
from noctule.operators import resample
from noctule.plans import bindings as b
from noctule.plans.registry import query, r6, s6

W, H = b.FRAME_WIDTH, b.FRAME_HEIGHT
LUMA = "(2126e-4 * r + 7152e-4 * g + 722e-4 * b)"
SAT = "(CASE WHEN greatest(r, g, b) <= 1e-6 THEN 0e0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END)"
BLACK = "(r = 0 AND g = 0 AND b = 0)"


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def _out(rows, columns="rgb"):
    return rows.select("frame_id", "x", "y", *[r6(c) for c in columns])


def _apply_sql(body, channels="rgb"):
    """`body` holds {c} for the channel and reads table `j`."""
    return "SELECT frame_id, x, y, " + ", ".join(s6(body.replace("{c}", c), c) for c in channels) + " FROM j"


# --- filters ----------------------------------------------------------------

@query("mask_circle", f"""
WITH {b.PIXELS}
SELECT frame_id, x, y, {s6('CASE WHEN (x-8)*(x-8)+(y-16)*(y-16) > 49 THEN 0e0 ELSE r END', 'r')},
  {s6('CASE WHEN (x-8)*(x-8)+(y-16)*(y-16) > 49 THEN 0e0 ELSE g END', 'g')},
  {s6('CASE WHEN (x-8)*(x-8)+(y-16)*(y-16) > 49 THEN 0e0 ELSE b END', 'b')} FROM pixels""")
def mask_circle(spark, root):
    return _out(resample.mask_circle(b.pixels(spark, root), 8, 16, 7))


@query("center_region", f"""
WITH {b.PIXELS}
SELECT frame_id, x, y, CAST(x >= 4 AND x < 12 AND y >= 9 AND y < 23 AS INT) AS sub,
  CAST(x >= 6 AND x < 10 AND y >= 12 AND y < 20 AS INT) AS central FROM pixels""")
def center_region(spark, root):
    return b.pixels(spark, root).select("frame_id", "x", "y", ph.subframe(W, H, 40.0).cast("int").alias("sub"),
                                        ph.center(W, H, 0.25).cast("int").alias("central"))


@query("crop", f"""
WITH {b.PIXELS} SELECT frame_id, x - 3 AS x, y - 5 AS y, {s6('r', 'r')}, {s6('g', 'g')}, {s6('b', 'b')} FROM pixels
WHERE x BETWEEN 3 AND 10 AND y BETWEEN 5 AND 24""")
def crop(spark, root):
    return _out(resample.crop(b.pixels(spark, root), 3, 5, 8, 20, W, H))


@query("mask_modes", f"""
WITH {b.PIXELS}
SELECT frame_id, x, y, 0 AS none, CAST(a <= 1e-12 AS INT) AS alpha, CAST({BLACK} AS INT) AS rgb,
  CAST((a <= 1e-12 OR {BLACK}) AS INT) AS either, CAST(r <= 1e-1 AND g <= 1e-1 AND b <= 1e-1 AS INT) AS dark FROM pixels""")
def mask_modes(spark, root):
    modes = [P.is_masked(m, *_rgb(), F.col("a")).cast("int").alias(m) for m in ("none", "alpha", "rgb", "either")]
    return b.pixels(spark, root).select("frame_id", "x", "y", *modes,
                                        P.is_black(*_rgb(), 0.1).cast("int").alias("dark"))


@query("valid_pixels", f"""
WITH {b.PIXELS}
SELECT frame_id, x, y, CAST(least(r, g, b) > 1e-2 AND greatest(r, g, b) < 5e-1 AS INT) AS unclipped,
  CAST(r >= 2e-1 AND r < 6e-1 AS INT) AS banded, CAST(1 AS INT) AS finite FROM pixels WHERE least(r, g, b) >= 0 AND greatest(r, g, b) <= 1""")
def valid_pixels(spark, root):
    rows = b.pixels(spark, root).where(P.in_range(*_rgb()))
    return rows.select("frame_id", "x", "y", P.all_between(0.01, 0.5, *_rgb()).cast("int").alias("unclipped"),
                       ((F.col("r") >= 0.2) & (F.col("r") < 0.6)).cast("int").alias("banded"),
                       reduce(lambda p, q: p & q, [P.is_finite(c) for c in _rgb()]).cast("int").alias("finite"))


@query("same_size_frames", """
WITH f AS (SELECT label AS series, vec_id AS seq, 16 + vec_id % 3 AS width, 32 AS height FROM embeddings),
w AS (SELECT *, first_value(width) OVER (PARTITION BY series ORDER BY seq) AS w0 FROM f)
SELECT series, seq, width, height FROM w WHERE width = w0""")
def same_size_frames(spark, root):
    frames = b.table(spark, root, "embeddings").select(
        F.col("label").alias("series"), F.col("vec_id").alias("seq"), (16 + F.col("vec_id") % 3).alias("width"),
        F.lit(32).alias("height"))
    return resample.same_size(frames, "series", "seq")


@query("patch_extract", f"""
WITH {b.PIXELS}, p AS (SELECT * FROM (VALUES (0, 1, 2), (1, 4, 4), (2, 10, 20)) t(patch, x0, y0))
SELECT frame_id, CAST(patch AS INT) AS patch, CAST(x - x0 AS INT) AS x, CAST(y - y0 AS INT) AS y, {s6('r', 'r')}
FROM pixels, p WHERE x >= x0 AND x < x0 + 6 AND y >= y0 AND y < y0 + 6""")
def patch_extract(spark, root):
    rows = b.pixels(spark, root).select("frame_id", "x", "y", "r")
    return resample.extract_patches(rows, [(1, 2), (4, 4), (10, 20)], 6, W, H).withColumn("r", r6("r"))


# --- statistics -------------------------------------------------------------

def _median_sql(source, where="TRUE"):
    return f"""
levels AS (
  SELECT frame_id, c, CAST(floor(least(greatest(v, 0e0), 1e0) * 1023 + 5e-1) AS INT) AS bin
  FROM (SELECT frame_id, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS v FROM {source} WHERE NOT {BLACK} AND {where})),
counts AS (SELECT frame_id, c, bin, count(*) AS n FROM levels GROUP BY ALL),
cdf AS (SELECT *, sum(n) OVER (PARTITION BY frame_id, c ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY frame_id, c) AS total FROM counts),
med0 AS (SELECT frame_id, c, min(bin) / 1023e0 AS m FROM cdf
         WHERE upto >= floor((floor(total * 2e-2) + floor(total * 98e-2)) / 2) GROUP BY 1, 2),
medians AS (
  SELECT frame_id, coalesce(max(m) FILTER (c = 'r'), 0e0) AS median_r, coalesce(max(m) FILTER (c = 'g'), 0e0) AS median_g,
         coalesce(max(m) FILTER (c = 'b'), 0e0) AS median_b
  FROM (SELECT DISTINCT frame_id FROM {source}) LEFT JOIN med0 USING (frame_id) GROUP BY 1)
"""


_MEDIANS = f"SELECT frame_id, {s6('median_r', 'median_r')}, {s6('median_g', 'median_g')}, {s6('median_b', 'median_b')} FROM medians"


def _medians_out(rows):
    return rows.select("frame_id", *[r6(f"median_{c}") for c in "rgb"])


@query("median_brightness", f"""
WITH {b.PIXELS}, {_median_sql('pixels', 'x >= 2 AND x < 14 AND y >= 4 AND y < 28')} {_MEDIANS}""")
def median_brightness(spark, root):
    return _medians_out(ph.median_brightness(b.pixels(spark, root), W, H, 0.75))


@query("median_brightness_volume", f"WITH {b.VOLUME}, {_median_sql('pixels')} {_MEDIANS}")
def median_brightness_volume(spark, root):
    return _medians_out(ph.median_brightness(b.volume(spark, root)))


@query("noise_mad", f"""
WITH {b.PIXELS}, {_median_sql('pixels')},
d AS (SELECT frame_id, abs(g - median_g) AS d FROM pixels JOIN medians USING (frame_id)
      WHERE (x-8)*(x-8)+(y-16)*(y-16) <= 100 AND g > 0)
SELECT frame_id, count(*) AS n_pixels, {s6('quantile_cont(d, 0.5) * CAST(1.4826 AS DOUBLE)', 'sigma_noise')} FROM d GROUP BY 1""")
def noise_mad(spark, root):
    rows = b.pixels(spark, root)
    return ph.noise_sigma(rows, ph.median_brightness(rows), 8, 16, 10).withColumn("sigma_noise", r6("sigma_noise"))


@query("overexposed", f"""
WITH {b.PIXELS}, s AS (SELECT frame_id, count(*) FILTER (r >= 85e-2 OR g >= 85e-2 OR b >= 85e-2) AS clipped, count(*) AS n_pixels FROM pixels GROUP BY 1)
SELECT frame_id, clipped, n_pixels, CAST(clipped >= greatest(floor(n_pixels * 1e-2), 1) AS INT) AS overexposed FROM s""")
def overexposed(spark, root):
    return ph.overexposure(b.pixels(spark, root), 0.85, 0.01)


@query("clipped_mean", f"""
WITH {b.PIXELS}, s AS (SELECT frame_id, avg(r) FILTER (r >= 5e-2 AND r < 8e-1) AS mr, avg(g) FILTER (g >= 5e-2 AND g < 8e-1) AS mg,
  avg(b) FILTER (b >= 5e-2 AND b < 8e-1) AS mb FROM pixels GROUP BY 1)
SELECT frame_id, {', '.join(s6(f'CASE WHEN mr IS NOT NULL AND mg IS NOT NULL AND mb IS NOT NULL THEN m{c} END', f'mean_{c}') for c in 'rgb')} FROM s""")
def clipped_mean(spark, root):
    rows = ph.clipped_mean(b.pixels(spark, root), 0.05, 0.8)
    return rows.select("frame_id", *[r6(f"mean_{c}") for c in "rgb"])


_GRAY = "x BETWEEN 2 AND 12 AND y BETWEEN 4 AND 25 AND least(r, g, b) > 1e-2 AND greatest(r, g, b) < 99e-2"


@query("gray_scale", f"""
WITH {b.PIXELS}
SELECT frame_id, {s6(f'coalesce(sum(g) FILTER ({_GRAY}) / sum(r) FILTER ({_GRAY}), 1e0)', 'scale_r')},
  {s6(f'coalesce(sum(g) FILTER ({_GRAY}) / sum(b) FILTER ({_GRAY}), 1e0)', 'scale_b')} FROM pixels GROUP BY 1""")
def gray_scale(spark, root):
    rows = ph.gray_scales(b.pixels(spark, root), 2, 4, 12, 25)
    return rows.select("frame_id", r6("scale_r"), r6("scale_b"))


@query("auto_color", f"""
WITH {b.PIXELS},
s0 AS (SELECT frame_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, greatest(stddev_pop(r), stddev_pop(g), stddev_pop(b)) AS sd
       FROM pixels WHERE x >= 1 AND x < 15 AND y >= 3 AND y < 29 AND greatest(r, g, b) < 1 GROUP BY 1),
s AS (SELECT *, greatest(mr, mg, mb) AS t FROM s0),
j AS (SELECT * FROM pixels JOIN s USING (frame_id))
{_apply_sql('least(greatest(least({c}, t + 3 * sd) * (t / m{c}), 0e0), 1e0)')}""")
def auto_color(spark, root):
    return _out(ph.auto_color(b.pixels(spark, root), W, H, 80.0))


FEATURES = f"""
px AS (SELECT frame_id, x, y, r, g, b, {LUMA} AS l, {SAT} AS s FROM pixels),
features AS (
  SELECT frame_id, sum(l) / count(*) AS mean_y,
    count(*) FILTER (l > 85e-2) / CAST(count(*) AS DOUBLE) AS bright_share,
    count(*) FILTER (l > 1e-1 AND l < 4e-1 AND s > 5e-1) / CAST(count(*) AS DOUBLE) AS blue_share,
    count(*) FILTER (l > 45e-2 AND s < 35e-2) / CAST(count(*) AS DOUBLE) AS day_cloud_share,
    count(*) FILTER (l < 4e-1 AND s > 55e-2) / CAST(count(*) AS DOUBLE) AS aurora_share,
    count(*) FILTER (l > 15e-2 AND l < 65e-2 AND s < 25e-2) / CAST(count(*) AS DOUBLE) AS night_cloud_share,
    stddev_pop(l) AS std_y
  FROM px GROUP BY 1),
scenes AS (
  SELECT *, CASE WHEN mean_y > 18e-2 AND day_cloud_share > 25e-2 THEN 'DAY_CLOUDY' WHEN mean_y > 18e-2 THEN 'DAY_CLEAR'
    WHEN mean_y >= 5e-2 THEN 'TWILIGHT' WHEN bright_share > 5e-4 THEN 'NIGHT_MOON' WHEN aurora_share > 1e-2 THEN 'NIGHT_AURORA'
    WHEN night_cloud_share > 2e-1 THEN 'NIGHT_CLOUDY' ELSE 'NIGHT_CLEAR' END AS scene
  FROM features)
"""
_FEATURE_COLUMNS = ["mean_y", "std_y", "bright_share", "blue_share", "day_cloud_share", "aurora_share", "night_cloud_share"]


@query("scene_features", f"WITH {b.PIXELS}, {FEATURES} SELECT frame_id, {', '.join(s6(c, c) for c in _FEATURE_COLUMNS)} FROM features")
def scene_features(spark, root):
    rows = ph.scene_features(b.pixels(spark, root))
    return rows.select("frame_id", *[r6(c) for c in _FEATURE_COLUMNS])


@query("scene_class", f"""
WITH {b.PIXELS}, {FEATURES},
gpu AS (SELECT frame_id, sum(l) / count(*) AS m, count(*) FILTER (l > 85e-2) / CAST(count(*) AS DOUBLE) AS br,
  count(*) FILTER (s > 4e-1 AND l < 85e-2) / CAST(count(*) AS DOUBLE) AS au,
  count(*) FILTER (l > 15e-2 AND l < 65e-2) / CAST(count(*) AS DOUBLE) AS cl FROM px GROUP BY 1)
SELECT frame_id, scene, CASE WHEN m > 25e-2 AND cl > 25e-2 THEN 'DAY_CLOUDY' WHEN m > 25e-2 THEN 'DAY_CLEAR'
  WHEN m >= 2e-2 THEN 'TWILIGHT' WHEN br > 2e-4 THEN 'NIGHT_MOON' WHEN au > 1e-2 THEN 'NIGHT_AURORA'
  WHEN cl > 2e-1 THEN 'NIGHT_CLOUDY' ELSE 'NIGHT_CLEAR' END AS scene_gpu
FROM scenes JOIN gpu USING (frame_id)""")
def scene_class(spark, root):
    rows = b.pixels(spark, root)
    cpu = ph.scene_class(ph.scene_features(rows))
    gpu = ph.scene_class(ph.scene_features(rows, "gpu"), "gpu").select("frame_id", F.col("scene").alias("scene_gpu"))
    return cpu.join(gpu, "frame_id").select("frame_id", "scene", "scene_gpu")


_AMBIENCE_ROWS = ", ".join(
    f"('{scene}', {', '.join(f'{int(round(v * 100))}e-2' for v in values)})" for scene, values in ph.AMBIENCE.items())


_AMBIENT = f"""{b.PIXELS}, {FEATURES},
p AS (SELECT * FROM (VALUES {_AMBIENCE_ROWS}) t(scene, pct, lclip, sclip, sig, mix)),
used AS (
  SELECT px.frame_id, r, g, b, l, sig, mix FROM px JOIN scenes USING (frame_id) JOIN p USING (scene)
  WHERE x >= floor((1e0 - pct / 1e2) * 5e-1 * 16) AND x < 16 - floor((1e0 - pct / 1e2) * 5e-1 * 16)
    AND y >= floor((1e0 - pct / 1e2) * 5e-1 * 32) AND y < 32 - floor((1e0 - pct / 1e2) * 5e-1 * 32)
    AND l <= lclip AND (CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0e0 END) <= sclip),
band AS (SELECT frame_id, count(*) AS n, avg(l) AS m, sqrt(greatest(avg(l * l) - avg(l) * avg(l), 0e0)) AS sd FROM used GROUP BY 1 HAVING count(*) >= 100),
sums AS (
  SELECT frame_id, n, mix, count(*) FILTER (sd <= 0 OR abs(l - m) <= sig * sd) AS n_band,
    avg(r) AS ar, avg(g) AS ag, avg(b) AS ab,
    avg(r) FILTER (sd <= 0 OR abs(l - m) <= sig * sd) AS br, avg(g) FILTER (sd <= 0 OR abs(l - m) <= sig * sd) AS bg,
    avg(b) FILTER (sd <= 0 OR abs(l - m) <= sig * sd) AS bb
  FROM used JOIN band USING (frame_id) GROUP BY 1, 2, 3),
amb AS (SELECT frame_id, n, n_band, mix, CASE WHEN n_band < 50 THEN ar ELSE br END AS r, CASE WHEN n_band < 50 THEN ag ELSE bg END AS g,
  CASE WHEN n_band < 50 THEN ab ELSE bb END AS b FROM sums)"""


@query("ambience_scales", f"""
WITH {_AMBIENT}
SELECT frame_id, n, n_band, {', '.join(s6(f'1 + (least(greatest({LUMA} / {c}, 25e-2), 4e0) - 1) * mix', f'scale_{c}') for c in 'rgb')}, 1 AS applied FROM amb""")
def ambience_scales(spark, root):
    rows = b.pixels(spark, root)
    scales = ph.ambience_scales(rows, ph.scene_class(ph.scene_features(rows)), W, H)
    return scales.select("frame_id", "n", "n_band", *[r6(f"scale_{c}") for c in "rgb"], "applied")


_GAINS = ", ".join(f"1 + (least(greatest({LUMA} / {c}, 25e-2), 4e0) - 1) * mix AS s{c}" for c in "rgb")


@query("ambience", f"""
WITH {_AMBIENT}, gains AS (SELECT frame_id, {_GAINS} FROM amb)
SELECT p.frame_id, p.x, p.y, {', '.join(s6(f"CASE WHEN q.frame_id IS NULL OR abs(sr - 1) < 1e-3 AND abs(sg - 1) < 1e-3 AND abs(sb - 1) < 1e-3 THEN p.{c} ELSE least(greatest(p.{c} * s{c}, 0e0), 1e0) END", c) for c in 'rgb')}
FROM pixels p LEFT JOIN gains q ON q.frame_id = p.frame_id""")
def ambience(spark, root):
    rows = b.pixels(spark, root)
    out = ph.ambience(rows, ph.ambience_scales(rows, ph.scene_class(ph.scene_features(rows)), W, H))
    return out.select("frame_id", "x", "y", *[r6(c) for c in "rgb"])


# --- levels -----------------------------------------------------------------

def _black_sql():
    return f"""
lit AS (SELECT frame_id, least(greatest({LUMA}, 0e0), 1e0) AS l FROM pixels WHERE NOT (r <= 1e-6 AND g <= 1e-6 AND b <= 1e-6)),
h AS (SELECT frame_id, CAST(floor(l * 2047) AS INT) AS bin, count(*) AS n FROM lit GROUP BY 1, 2),
allbins AS (SELECT f.frame_id, CAST(t.bin AS INT) AS bin, coalesce(h.n, 0) AS n
            FROM (SELECT DISTINCT frame_id FROM lit) f CROSS JOIN range(2048) t(bin) LEFT JOIN h ON h.frame_id = f.frame_id AND h.bin = t.bin),
cdf AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY frame_id) AS total FROM allbins),
q99 AS (SELECT frame_id, min(bin) AS p99 FROM cdf WHERE upto >= floor(total * 99e-2) GROUP BY 1),
q01 AS (SELECT frame_id, min(bin) AS p01 FROM cdf JOIN q99 USING (frame_id) WHERE upto >= floor(total * 1e-2) AND bin >= 1 AND bin <= p99 GROUP BY 1),
st AS (SELECT frame_id, count(*) AS n_pixels, avg(l) AS mean_y, min(l) AS min_y, max(l) AS max_y FROM lit GROUP BY 1),
stats AS (SELECT st.*, CASE WHEN p99 = 0 THEN 0e0 ELSE coalesce(p01, 0) / 2047e0 END AS p01, p99 / 2047e0 AS p99 FROM st JOIN q99 USING (frame_id) LEFT JOIN q01 USING (frame_id)),
shifts AS (SELECT *, CASE WHEN mean_y > 2e-1 THEN 5e-3 WHEN p01 > 2e-2 AND p99 - p01 > 5e-2 THEN 2e-2 WHEN p01 > 5e-3 THEN 125e-4 ELSE 0e0 END AS shift FROM stats)
"""


@query("black_point", f"""
WITH {b.PIXELS}, {_black_sql()},
j AS (SELECT p.*, shift, min_y + shift * (max_y - min_y) AS black, (max_y - min_y) * (1 - shift) AS den FROM pixels p LEFT JOIN shifts USING (frame_id))
{_apply_sql('CASE WHEN shift > 0 AND NOT (r <= 1e-6 AND g <= 1e-6 AND b <= 1e-6) THEN least(greatest(({c} - black) / den, 0e0), 1e0) ELSE {c} END')}""")
def black_point(spark, root):
    return _out(ph.black_point(b.pixels(spark, root), 0.005, 0.02, 0.2))


@query("black_point_volume", f"""
WITH {b.VOLUME}, {_black_sql()}
SELECT frame_id, n_pixels, {', '.join(s6(c, c) for c in ('mean_y', 'min_y', 'max_y', 'p01', 'p99', 'shift'))} FROM shifts""")
def black_point_volume(spark, root):
    rows = ph.black_point_statistics(b.volume(spark, root), 0.005, 0.02, 0.2)
    return rows.select("frame_id", "n_pixels", *[r6(c) for c in ("mean_y", "min_y", "max_y", "p01", "p99", "shift")])


_STRETCH = """
pool AS (SELECT frame_id, unnest([r, g, b]) AS v FROM pixels),
rk AS (SELECT frame_id, v, row_number() OVER (PARTITION BY frame_id ORDER BY v) AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM pool WHERE v >= 0),
lv AS (SELECT frame_id, max(n) AS n, max(v) FILTER (i = floor((n - 1) * 5e-2) + 1) AS black, max(v) FILTER (i = floor((n - 1) * 95e-2) + 1) AS white FROM rk GROUP BY 1)
"""


@query("autostretch", f"""
WITH {b.PIXELS}, {_STRETCH}, j AS (SELECT * FROM pixels JOIN lv USING (frame_id))
{_apply_sql('CASE WHEN white - black < 1e-6 THEN {c} ELSE least(greatest(({c} - black) / (white - black), 0e0), 1e0) END')}""")
def autostretch(spark, root):
    return _out(ph.autostretch(b.pixels(spark, root), 0.05, 0.95))


@query("stretch_levels_volume", f"""
WITH {b.VOLUME}, {_STRETCH} SELECT frame_id, n, {s6('black', 'black')}, {s6('white', 'white')} FROM lv WHERE n >= 2 AND white - black >= 1e-6""")
def stretch_levels_volume(spark, root):
    rows = ph.stretch_levels(b.volume(spark, root), 0.05, 0.95)
    return rows.select("frame_id", "n", r6("black"), r6("white"))


@query("normalize_range", f"""
WITH {b.PIXELS}, s AS (SELECT frame_id, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM pixels GROUP BY 1),
j AS (SELECT * FROM pixels JOIN s USING (frame_id))
{_apply_sql('1e-1 + ({c} - lo) / (hi - lo) * 8e-1')}""")
def normalize_range(spark, root):
    return _out(ph.normalize_range(b.pixels(spark, root), 0.1, 0.9))


@query("normalize8", f"""
WITH {b.PIXELS}, s AS (SELECT frame_id, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM pixels GROUP BY 1)
SELECT frame_id, x, y, {', '.join(f'CAST(floor(least(({c} - lo) * (255e0 / (hi - lo)), 255e0)) AS INT) AS {c}' for c in 'rgb')}
FROM pixels JOIN s USING (frame_id)""")
def normalize8(spark, root):
    return ph.normalize8(b.pixels(spark, root))


@query("tonemap16", f"""
WITH {b.PIXELS}, s AS (SELECT frame_id, {', '.join(f'min({c} * 4) AS lo{c}, max({c} * 4) AS hi{c}' for c in 'rgb')} FROM pixels GROUP BY 1),
j AS (SELECT * FROM pixels JOIN s USING (frame_id))
{_apply_sql('({c} * 4 - lo{c}) / greatest(hi{c} - lo{c}, 1e0) * 65535')}""")
def tonemap16(spark, root):
    rows = b.pixels(spark, root).select("frame_id", "x", "y", *[(F.col(c) * 4.0).alias(c) for c in "rgb"])
    return _out(ph.tonemap16(rows))


@query("haze_level", f"""
WITH {b.PIXELS},
k AS (SELECT frame_id, {LUMA} AS l FROM pixels WHERE NOT {BLACK}),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY l) AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM k)
SELECT frame_id, max(n) AS n_pixels, {s6('avg(l)', 'haze')} FROM rk WHERE i <= greatest(floor(n * 1e-1), 1) GROUP BY 1""")
def haze_level(spark, root):
    return ph.haze_level(b.pixels(spark, root), 0.1).withColumn("haze", r6("haze"))


def _pixels8(spark, root):
    return b.pixels(spark, root).select("frame_id", "x", "y", *[P.quantize(F.col(c), 255).alias(c) for c in "rgb"])


def _histogram(stride: int) -> str:
    return f"""
p8 AS (SELECT frame_id, x, y, {', '.join(f'CAST(floor(least(greatest({c}, 0e0), 1e0) * 255 + 5e-1) AS INT) AS {c}' for c in 'rgb')} FROM pixels),
hist AS (SELECT frame_id, CAST(floor({LUMA} + 5e-1) AS INT) AS bin, count(*) AS n FROM p8
         WHERE (y * 16 + x) % {stride} = 0 AND NOT {BLACK} GROUP BY 1, 2)
"""


HISTOGRAM = _histogram(1)


@query("luma_histogram", f"WITH {b.PIXELS}, {HISTOGRAM} SELECT * FROM hist")
def luma_histogram(spark, root):
    return ph.luma_histogram(_pixels8(spark, root), W)


@query("luma_histogram_sparse", f"WITH {b.PIXELS}, {_histogram(4)} SELECT * FROM hist")
def luma_histogram_sparse(spark, root):
    return ph.luma_histogram(_pixels8(spark, root), W, stride=4)


@query("luma_stats", f"""
WITH {b.PIXELS}, {HISTOGRAM},
v AS (SELECT frame_id, bin FROM hist, range(100000) t(i) WHERE i < n)
SELECT frame_id, min(bin) AS min, max(bin) AS max, {s6('avg(bin)', 'mean')}, {s6('quantile_cont(bin, 0.5)', 'median')}, count(*) AS n_pixels
FROM v GROUP BY 1""")
def luma_stats(spark, root):
    rows = ph.luma_statistics(ph.luma_histogram(_pixels8(spark, root), W))
    return rows.select("frame_id", "min", "max", r6("mean"), r6("median"), "n_pixels")


@query("sqm_basic", f"""
WITH {b.OBS} SELECT event_id, {s6('CASE WHEN stars >= 1 THEN 212e-1 - 15e-1 * log10(stars) END', 'sqm')} FROM obs""")
def sqm_basic(spark, root):
    return b.obs(spark, root).select("event_id", r6(ph.sqm(F.col("stars"), 21.2, 1.5), "sqm"))


@query("sqm_corrected", f"""
WITH {b.OBS} SELECT event_id,
  {s6('CASE WHEN stars >= 1 THEN 212e-1 - 15e-1 * log10(stars / (sqrt(exposure) * pow(2e0, gain * 1e-1 / 12))) END', 'sqm')} FROM obs""")
def sqm_corrected(spark, root):
    value = ph.sqm_corrected(F.col("stars"), F.col("exposure"), F.col("gain") * 0.1, 21.2, 1.5)
    return b.obs(spark, root).select("event_id", r6(value, "sqm"))


@query("is_monochrome", f"""
WITH {b.PIXELS}, m AS (SELECT frame_id, r, CASE WHEN frame_id % 2 = 0 THEN r ELSE g END AS g, CASE WHEN frame_id % 2 = 0 THEN r ELSE b END AS b FROM pixels)
SELECT frame_id, CAST(bool_and(r = g AND g = b) AS INT) AS monochrome FROM m GROUP BY 1""")
def is_monochrome(spark, root):
    even = F.col("frame_id") % 2 == 0
    rows = b.pixels(spark, root).select("frame_id", "r", F.when(even, F.col("r")).otherwise(F.col("g")).alias("g"),
                                        F.when(even, F.col("r")).otherwise(F.col("b")).alias("b"))
    return ph.monochrome(rows)


# --- joins and geometry -----------------------------------------------------

@query("dark_subtract", f"""
WITH {b.FRAMES8}, d AS (SELECT series, x, y, v AS dv FROM frames8 QUALIFY seq = min(seq) OVER (PARTITION BY series))
SELECT f.series, f.seq, f.x, f.y, CAST(greatest(v - dv, 0) AS INT) AS v FROM frames8 f JOIN d USING (series, x, y)""")
def dark_subtract(spark, root):
    frames = b.frames8(spark, root).drop("c")
    dark = frames.groupBy("series", "x", "y").agg(F.min_by("v", "seq").alias("v"))
    return resample.subtract_dark(frames, dark, ["series"], ["v"])


_BILINEAR = """
tx AS (SELECT CAST(t AS INT) AS tx, t * 15e0 / 9 AS gx FROM range(10) r(t)),
ty AS (SELECT CAST(t AS INT) AS ty, t * 31e0 / 43 AS gy FROM range(44) r(t)),
cells AS (
  SELECT tx, ty, least(floor(gx) + i, 15) AS sx, least(floor(gy) + j, 31) AS sy,
         (CASE WHEN i = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN j = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS w
  FROM tx, ty, range(2) a(i), range(2) c(j))
"""


@query("resample_bilinear", f"""
WITH {b.PIXELS}, {_BILINEAR}
SELECT frame_id, tx AS x, ty AS y, {', '.join(s6(f'sum({c} * w)', c) for c in 'rgb')}
FROM pixels JOIN cells ON x = sx AND y = sy WHERE w > 0 GROUP BY 1, 2, 3""")
def resample_bilinear(spark, root):
    return _out(resample.resize_bilinear(b.pixels(spark, root), ["frame_id"], (W, H), (10, 44)))


@query("resample_nearest", f"""
WITH {b.PIXELS}, t AS (SELECT CAST(i AS INT) AS tx, CAST(j AS INT) AS ty, floor(i / 4e-1) AS sx, floor(j / 4e-1) AS sy FROM range(6) a(i), range(12) c(j))
SELECT frame_id, tx AS x, ty AS y, {', '.join(f'CAST(floor(least(greatest({c} * 255, 0e0), 255e0)) AS INT) AS {c}' for c in 'rgb')}
FROM pixels JOIN t ON x = sx AND y = sy""")
def resample_nearest(spark, root):
    rows = resample.downscale_nearest(b.pixels(spark, root).drop("a"), W, H, 0.4)
    return rows.select("frame_id", "x", "y", *[F.floor(P.clamp(F.col(c) * 255.0, 0.0, 255.0)).cast("int").alias(c) for c in "rgb"])


@query("panorama_bins", f"""
WITH {b.PIXELS},
t AS (SELECT CAST(i AS INT) AS tx, CAST(j AS INT) AS ty, ((40 - 1 - i) / 4e1 * 2 * pi() + 260 * pi() / 180) % (2 * pi()) AS th, j / 9e0 * pi() / 2 AS ph
      FROM range(40) a(i), range(10) c(j)),
s AS (SELECT tx, ty, 8 + 8 * ph / (pi() / 2) * sin(ph) * cos(th) AS gx, 16 + 8 * ph / (pi() / 2) * sin(ph) * sin(th) AS gy FROM t),
c AS (SELECT tx, ty, floor(gx) + i AS sx, floor(gy) + j AS sy,
        (CASE WHEN i = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN j = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) AS w
      FROM s, range(2) a(i), range(2) d(j) WHERE gx >= 0 AND gx < 15 AND gy >= 0 AND gy < 31)
SELECT frame_id, tx AS x, ty AS y, {', '.join(s6(f'sum({c} * w)', c) for c in 'rgb')} FROM pixels JOIN c ON x = sx AND y = sy WHERE w > 0 GROUP BY 1, 2, 3""")
def panorama_bins(spark, root):
    cells = resample.panorama_cells(spark, 40, 10, (W, H), (8.0, 16.0), 260.0)
    return _out(resample.panorama(b.pixels(spark, root), ["frame_id"], cells))


@query("rotate", f"""
WITH {b.PIXELS}
SELECT frame_id, 31 - y AS x, x AS y, 90 AS angle, {s6('r', 'r')} FROM pixels UNION ALL
SELECT frame_id, 15 - x, 31 - y, 180, round(r, 6) + 0e0 FROM pixels UNION ALL SELECT frame_id, y, 15 - x, 270, round(r, 6) + 0e0 FROM pixels""")
def rotate(spark, root):
    rows = b.pixels(spark, root).select("frame_id", "x", "y", r6("r"))
    turned = [resample.rotate(rows, a, W, H).withColumn("angle", F.lit(a)) for a in (90, 180, 270)]
    return turned[0].unionByName(turned[1]).unionByName(turned[2])


# --- pixel functions --------------------------------------------------------

def _smooth(lo, hi, x):
    t = f"(({x} - {lo}) / ({hi} - {lo}))"
    return f"CASE WHEN {x} <= {lo} THEN 0e0 WHEN {x} >= {hi} THEN 1e0 ELSE {t} * {t} * (3 - 2 * {t}) END"


@query("px_basic", f"""
WITH {b.PIXELS} SELECT frame_id, x, y, {s6('least(greatest(r * 3 - 1, 0e0), 1e0)', 'clamped')}, {s6(LUMA, 'luma')}, {s6(SAT, 'saturation')},
  {s6(_smooth('2e-1', '6e-1', 'g'), 'smooth')} FROM pixels""")
def px_basic(spark, root):
    return b.pixels(spark, root).select(
        "frame_id", "x", "y", r6(P.clamp(F.col("r") * 3.0 - 1.0), "clamped"), r6(P.luma(*_rgb()), "luma"),
        r6(P.saturation(*_rgb()), "saturation"), r6(P.smoothstep(0.2, 0.6, F.col("g")), "smooth"))


@query("adjust_saturation", f"""
WITH {b.PIXELS},
a AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM pixels),
h AS (SELECT *, CASE WHEN v = lo THEN 0e0 WHEN v = r THEN (g - b) / (v - lo) + (CASE WHEN g < b THEN 6 ELSE 0 END)
        WHEN v = g THEN (b - r) / (v - lo) + 2 ELSE (r - g) / (v - lo) + 4 END AS h6,
        CASE WHEN v = 0 THEN 0e0 ELSE least((v - lo) / v * 14e-1, 1e0) END AS s FROM a),
i AS (SELECT *, h6 - floor(h6) AS f, CAST(floor(h6) AS INT) % 6 AS sx FROM h),
p AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM i)
SELECT frame_id, x, y, {s6('CASE sx WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END', 'r')},
  {s6('CASE sx WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END', 'g')},
  {s6('CASE sx WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END', 'b')} FROM p""")
def adjust_saturation(spark, root):
    out = P.adjust_saturation(*_rgb(), 1.4)
    return b.pixels(spark, root).select("frame_id", "x", "y", *[r6(c, n) for c, n in zip(out, "rgb")])


@query("rgb_ycc", f"""
WITH {b.PIXELS},
c AS (SELECT *, {LUMA} AS l, -114572e-6 * r - 385428e-6 * g + 5e-1 * b AS u, 5e-1 * r - 454153e-6 * g - 45847e-6 * b AS v FROM pixels)
SELECT frame_id, x, y, {s6('l', 'luma')}, {s6('u', 'cb')}, {s6('v', 'cr')}, {s6('l + 1402e-3 * v', 'r')},
  {s6('l - 344136e-6 * u - 714136e-6 * v', 'g')}, {s6('l + 1772e-3 * u', 'b')}, {s6('least(greatest(l + 113983e-5 * v, 0e0), 1e0)', 'yuv_r')} FROM c""")
def rgb_ycc(spark, root):
    ycc = P.chroma(*_rgb())
    return b.pixels(spark, root).select(
        "frame_id", "x", "y", *[r6(c, n) for c, n in zip(ycc, ("luma", "cb", "cr"))],
        *[r6(c, n) for c, n in zip(P.rgb_from_ycc(*ycc), "rgb")], r6(P.rgb_from_yuv(*ycc)[0], "yuv_r"))


@query("gamma", f"""
WITH {b.PIXELS} SELECT frame_id, x, y, {', '.join(s6(f'pow({c}, greatest(9e-1 - 7e-2 * (1 - 1 / (1 + frame_id % 3 * 3e-1)), 1e-1))', c) for c in 'rgb')} FROM pixels""")
def gamma(spark, root):
    exponent = P.adaptive_gamma(0.9, 1 + F.col("frame_id") % 3)
    return b.pixels(spark, root).select("frame_id", "x", "y", *[r6(P.gamma(F.col(c), exponent), c) for c in "rgb"])


@query("white_balance", f"""
WITH {b.PIXELS}, s AS (SELECT frame_id, greatest(max(r) * 16e-1, max(g), max(b) * 12e-1) AS peak FROM pixels GROUP BY 1),
q AS (SELECT frame_id, x, y, CASE WHEN peak > 11e-1 THEN 1 / peak ELSE 1e0 END AS att, r, g, b FROM pixels JOIN s USING (frame_id)),
w AS (SELECT frame_id, x, y, r * 16e-1 * att AS r, g * att AS g, b * 12e-1 * att AS b FROM q),
j AS (SELECT *, CASE WHEN greatest(r, g, b) > 1 THEN 1 - (1 - 1 / greatest(r, g, b)) * 5e-1 ELSE 1e0 END AS k FROM w)
{_apply_sql('least(greatest({c} * k, 0e0), 1e0)')}""")
def white_balance(spark, root):
    return _out(ph.white_balance(b.pixels(spark, root), 1.6, 1.0, 1.2, 0.5))


@query("white_balance16", f"""
WITH {b.PIXELS} SELECT frame_id, x, y, CAST(least(floor(CAST(floor(r * 65535 + 5e-1) AS INT) * 14e-1), 65535) AS INT) AS r,
  CAST(least(floor(CAST(floor(b * 65535 + 5e-1) AS INT) * 19e-1), 65535) AS INT) AS b FROM pixels""")
def white_balance16(spark, root):
    return b.pixels(spark, root).select(
        "frame_id", "x", "y", P.white_balance16(P.quantize(F.col("r"), 65535), 1.4).alias("r"),
        P.white_balance16(P.quantize(F.col("b"), 65535), 1.9).alias("b"))


def _scnr(neutral):
    return f"CASE WHEN g > {neutral} THEN greatest(g - 5e-1 * (g - {neutral}), 0e0) ELSE g END"


@query("scnr", f"""
WITH {b.PIXELS} SELECT frame_id, x, y, {s6(_scnr('0e0'), 'g_none')}, {s6(_scnr('(r + b) / 2'), 'g_average')},
  {s6(_scnr('greatest(r, b)'), 'g_maximum')} FROM pixels""")
def scnr(spark, root):
    return b.pixels(spark, root).select("frame_id", "x", "y", *[
        r6(P.reduce_green(*_rgb(), 0.5, m), f"g_{m}") for m in ("none", "average", "maximum")])


@query("tone_curves", f"""
WITH {b.PIXELS} SELECT frame_id, x, y, {s6('least(greatest((r - 3e-1) / 4e-1 + 5e-1, 0e0), 1e0)', 'midtones')},
  {s6('(r - g) / (1 + 2 * abs(r - g))', 'compressed')}, {s6('least(greatest((1 - 2e-1 * (1 - r)) * (1 - 3e-1 * r), 0e0), 1e0)', 'protected')},
  {s6('exp(-(r - 5e-1) * (r - 5e-1) / (2 * 125e-3 * 125e-3))', 'bell')},
  {s6('CASE WHEN r <= 8e-1 THEN 1e0 ELSE 5e-1 * (1 + cos(pi() * least((r - 8e-1) / 2e-1, 1e0))) END', 'rolloff')} FROM pixels""")
def tone_curves(spark, root):
    r, g = F.col("r"), F.col("g")
    return b.pixels(spark, root).select(
        "frame_id", "x", "y", r6(P.midtones_transfer(r, 0.3), "midtones"), r6(P.compress(r - g, 2.0), "compressed"),
        r6(P.protection(r, 0.2, 0.3), "protected"), r6(P.midtone_bell(r, 0.5), "bell"), r6(P.highlight_rolloff(r), "rolloff"))


@query("quantize", f"""
WITH {b.PIXELS} SELECT frame_id, x, y, CAST(floor(least(greatest(r * 2 - 5e-1, 0e0), 1e0) * 255 + 5e-1) AS INT) AS r8,
  CAST(floor(g * 65535 + 5e-1) AS INT) AS g16 FROM pixels""")
def quantize(spark, root):
    return b.pixels(spark, root).select("frame_id", "x", "y", P.quantize(F.col("r") * 2.0 - 0.5, 255).alias("r8"),
                                        P.quantize(F.col("g"), 65535).alias("g16"))
