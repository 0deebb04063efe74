"""Queries over frame series, exposure brackets and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from noctule.functions import pixel as P
from noctule.operators import bracket, focal, photometry, stack, timeline
from noctule.plans import bindings as b
from noctule.plans.photometry_queries import LUMA, _median_sql
from noctule.plans.registry import ORACLE, query, r6, s6

W, H = b.FRAME_WIDTH, b.FRAME_HEIGHT


def _byte(e):
    return f"CAST(floor(least(greatest({e}, 0e0), 255e0) + 5e-1) AS INT) AS v"


def _stack_sql(e):
    return f"WITH {b.FRAMES8} SELECT series, x, y, c, count(*) AS n_frames, {_byte(e)} FROM frames8 GROUP BY ALL"


_RUNNING = """
run AS (SELECT *, min(v) OVER (PARTITION BY series, x, y, c ORDER BY seq) AS bg FROM frames8),
acc AS (SELECT series, x, y, c, count(*) AS n_frames, sum(CASE WHEN abs(v - bg) >= 40 THEN CAST(abs(v - bg) AS DOUBLE) ELSE 0e0 END) AS a
        FROM run GROUP BY ALL)
"""

_STACKS = {
    "avg": _stack_sql("avg(v)"), "max": _stack_sql("max(v)"), "min": _stack_sql("min(v)"),
    "sum": _stack_sql("sum(v)"), "median": _stack_sql("quantile_cont(v, 0.5)"), "sigma": _stack_sql("avg(v)"),
    "sigma_reject": f"""
WITH {b.FRAMES8}, s AS (SELECT series, x, y, c, avg(v) AS m, stddev_pop(v) AS sd FROM frames8 GROUP BY ALL)
SELECT series, x, y, c, count(*) AS n_frames, {_byte('coalesce(avg(v) FILTER (abs(v - m) <= 15e-1 * sd), max(m))')}
FROM frames8 JOIN s USING (series, x, y, c) GROUP BY ALL""",
    "diff": _stack_sql("abs(arg_max(v, seq) - arg_min(v, seq))"),
    "motion": f"""
WITH {b.FRAMES8}, {_RUNNING}
SELECT series, x, y, c, n_frames,
  {_byte('CASE WHEN max(a) OVER (PARTITION BY series) > 0 THEN a * (255e0 / max(a) OVER (PARTITION BY series)) ELSE 0e0 END')} FROM acc""",
}
_THRESHOLDS = {"motion": 40.0, "sigma_reject": 1.5}


def _register(mode):
    @query(f"stack_{mode}", _STACKS[mode])
    def run(spark, root):
        return stack.stack(b.frames8(spark, root), mode, _THRESHOLDS.get(mode, 3.0))


for _mode in _STACKS:
    _register(_mode)


@query("stack_motion_segmented", _STACKS["motion"])
def stack_motion_segmented(spark, root):
    return stack.stack(b.frames8(spark, root), "motion", 40.0, segment=7)


_STEPS = (75, 90, 100, 120)


@query("stack_motion_thresholds", f"""
WITH {b.FRAMES8}, run AS (SELECT *, min(v) OVER (PARTITION BY series, x, y, c ORDER BY seq) AS bg FROM frames8),
acc AS (SELECT CAST(t AS INT) AS threshold, series, x, y, c, count(*) AS n_frames, sum(CASE WHEN abs(v - bg) >= t THEN CAST(abs(v - bg) AS DOUBLE) ELSE 0e0 END) AS a
        FROM run, unnest([{', '.join(map(str, _STEPS))}]) s(t) GROUP BY ALL)
SELECT threshold, series, x, y, c, n_frames,
  {_byte('CASE WHEN max(a) OVER p > 0 THEN a * (255e0 / max(a) OVER p) ELSE 0e0 END')} FROM acc WINDOW p AS (PARTITION BY threshold, series)""")
def stack_motion_thresholds(spark, root):
    out = None
    for step in _STEPS:
        one = stack.stack(b.frames8(spark, root), "motion", float(step)).withColumn("threshold", F.lit(step))
        out = one if out is None else out.unionByName(one)
    return out


@query("running_stack", f"""
WITH {b.FRAMES8}, w AS (SELECT series, x, y, c, seq, CAST(sum(v) OVER p AS DOUBLE) / count(*) OVER p AS s FROM frames8
  WINDOW p AS (PARTITION BY series, x, y, c ORDER BY seq))
SELECT series, x, y, c, seq, {_byte('s')} FROM w""")
def running_stack(spark, root):
    return stack.running_stack(b.frames8(spark, root), "avg")


@query("running_stack_segmented", ORACLE["running_stack"])
def running_stack_segmented(spark, root):
    return stack.running_stack(b.frames8(spark, root), "avg", segment=7)


# --- brackets ---------------------------------------------------------------

def _bracket_frames(pixels):
    """Exposure and channel medians of each exposure of each bracket."""
    frames = pixels.select((F.col("bracket") * 3 + F.col("k")).alias("frame_id"), "x", "y", "r", "g", "b")
    medians = photometry.median_brightness(frames)
    return medians.select(F.floor(F.col("frame_id") / 3).alias("bracket"), (F.col("frame_id") % 3).cast("int").alias("k"),
                          (8.0 / F.pow(F.lit(2.0), F.col("frame_id") % 3)).alias("exposure"),
                          "median_r", "median_g", "median_b")


def _weights_sql(contrast, y_max="1e0"):
    """Weights in SQL, from scratch on the bracket pixels; without ``y_max`` it is found by bracket."""
    ladder = ("CASE WHEN y_max >= 1 THEN CASE WHEN bright < 1e-1 THEN 2e-1 WHEN bright < 15e-2 THEN 3e-1 WHEN bright < 25e-2 THEN 4e-1 "
              "WHEN bright < 35e-2 THEN 5e-1 ELSE 55e-2 END ELSE CASE WHEN bright < 7e-2 THEN 15e-2 WHEN bright < 1e-1 THEN 2e-1 "
              "WHEN bright < 15e-2 THEN 25e-2 WHEN bright < 25e-2 THEN 3e-1 ELSE 4e-1 END END")
    top = "CASE WHEN max(l) FILTER (greatest(r, g, b) < 99998e-5 * 95e-2) > 0 THEN max(l) FILTER (greatest(r, g, b) < 99998e-5 * 95e-2) ELSE max(l) END"
    found = f"""SELECT bracket, CASE WHEN top > 0 THEN CASE WHEN top * 11e-1 < 5e-1 THEN 1e0 WHEN top * 11e-1 > 5e0 THEN 3e0 ELSE top * 11e-1 END ELSE 1e0 END AS y_max
      FROM (SELECT bracket, {top} AS top FROM ly WHERE NOT masked GROUP BY 1)""" if y_max is None else f"SELECT DISTINCT bracket, {y_max} AS y_max FROM ly"
    return f"""
bframes AS (SELECT bracket * 3 + k AS frame_id, x, y, r, g, b FROM bpixels),
{_median_sql('bframes')},
fr AS (SELECT frame_id // 3 AS bracket, CAST(frame_id % 3 AS INT) AS k, 8e0 / pow(2e0, frame_id % 3) AS exposure, median_r, median_g, median_b FROM medians),
gn AS (SELECT f.bracket, f.k, z.exposure / f.exposure AS gain, z.median_r / f.median_r AS gr, z.median_g / f.median_g AS gg, z.median_b / f.median_b AS gb,
         f.median_g AS mg, z.median_g AS mg0 FROM fr f JOIN fr z ON z.bracket = f.bracket AND z.k = 0),
br AS (SELECT bracket, avg(2126e-4 * median_r + 7152e-4 * median_g + 722e-4 * median_b) AS bright,
         bool_and(median_r > 0 AND median_g > 0 AND median_b > 0) AS ok FROM fr GROUP BY 1),
li AS (SELECT p.bracket, p.k, x, y, p.r, p.g, p.b, gain, mg, mg0, bright, p.r * gain * gr AS lr, p.g * gain * gg AS lg, p.b * gain * gb AS lb,
         (p.r <= 1e-6 AND p.g <= 1e-6 AND p.b <= 1e-6 OR p.a <= 1e-6) AS masked
       FROM bpixels p JOIN gn USING (bracket, k) JOIN br USING (bracket) WHERE ok),
ly AS (SELECT *, CASE WHEN masked THEN 0e0 ELSE 2126e-4 * lr + 7152e-4 * lg + 722e-4 * lb END AS l FROM li),
dv AS (SELECT a.bracket, a.k, a.x, a.y, CASE WHEN any_value(a.masked) THEN 0e0 ELSE abs(any_value(a.l) - avg(n.l)) END AS d
       FROM ly a LEFT JOIN ly n ON n.bracket = a.bracket AND n.k = a.k AND abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 AND NOT n.masked GROUP BY 1, 2, 3, 4),
cn AS (SELECT bracket, k, x, y, d / greatest(max(d) OVER (PARTITION BY bracket, k), 1e-12) AS cw FROM dv),
ym AS ({found}),
t AS (SELECT *, {ladder} AS center, least((2126e-4 * r + 7152e-4 * g + 722e-4 * b) * gain / y_max, 1e0) AS yn,
        greatest(r, g, b) * gain AS peak, greatest(r, g, b) AS src FROM (SELECT ly.*, cw, coalesce(y_max, 1e0) AS y_max FROM ly JOIN cn USING (bracket, k, x, y) LEFT JOIN ym USING (bracket))),
u AS (SELECT *, least(greatest(1 - (src - 99998e-5 * 95e-2) / (99998e-5 - 99998e-5 * 95e-2), 0e0), 1e0) AS ct,
        CASE WHEN k = 1 THEN (l - mg0 * 35e-2) / (mg0 * 35e-2 * 12e-1 - mg0 * 35e-2)
             WHEN k = 2 THEN (l - greatest(mg * 4, 4e-1) * 6e-1) / (greatest(mg * 4, 4e-1) - greatest(mg * 4, 4e-1) * 6e-1) END AS mt FROM t),
rw AS (SELECT *, CASE WHEN masked THEN 0e0 ELSE
        least(greatest(
          exp(-5e-1 * (yn - center) * (yn - center) / (8e-1 * 8e-1))
          * (CASE WHEN peak >= 99998e-5 * 9e-1 THEN 1 - 7e-1 * least((peak - 99998e-5 * 9e-1) / (99998e-5 * (1 - 9e-1)), 1e0) ELSE 1e0 END)
          * (CASE WHEN yn < 1e-1 THEN (yn / 1e-1) * (yn / 1e-1) ELSE 1e0 END)
          * (4e-1 + 6e-1 * (CASE WHEN src >= 99998e-5 * 95e-2 THEN ct * ct * (3 - 2 * ct) ELSE 1e0 END))
          * (1 - {contrast} + {contrast} * cw), 0e0), 1e0)
        * (CASE WHEN k = 0 OR mt >= 1 THEN 1e0 WHEN mt <= 0 THEN 0e0 ELSE mt * mt * (3 - 2 * mt) END) END AS raw_w FROM u),
wt AS (SELECT *, CASE WHEN sum(raw_w) OVER s > 1e-12 THEN raw_w / sum(raw_w) OVER s WHEN raw_w <= 0 THEN 0e0
         ELSE CAST(row_number() OVER (PARTITION BY bracket, x, y ORDER BY raw_w DESC, k) = 1 AS INT) * 1e0 END AS w FROM rw
       WINDOW s AS (PARTITION BY bracket, x, y)),
ch AS (SELECT *, CASE WHEN sum(w) OVER s > 1e-12 THEN w * 7e-1 + CASE WHEN k = 0 THEN 3e-1 ELSE 0e0 END ELSE w END AS lean, sum(w) OVER s AS ws FROM wt
       WINDOW s AS (PARTITION BY bracket, x, y)),
cw AS (SELECT *, CASE WHEN ws > 1e-12 THEN lean / sum(lean) OVER s ELSE lean END AS cwt FROM ch WINDOW s AS (PARTITION BY bracket, x, y))
"""


_MATCH = f"""
sc AS (SELECT *, CASE WHEN yf <= 1e-6 OR {LUMA} <= 1e-6 THEN 1e0 ELSE least(greatest(yf / {LUMA}, 1e-1), 10e0) END AS s FROM col)
SELECT bracket, x, y, {', '.join(s6(f'coalesce({c} * s, 0e0)', c) for c in 'rgb')} FROM sc"""


@query("bracket_weights", f"""
WITH {b.BRACKET}, {_weights_sql('6e-1')} SELECT bracket, k, x, y, {s6('raw_w', 'raw_w')}, {s6('w', 'w')} FROM wt""")
def bracket_weights(spark, root):
    rows = b.bracket_pixels(spark, root)
    out = bracket.weights(rows, _bracket_frames(rows), bracket.Settings(contrast=0.6))
    return out.select("bracket", "k", "x", "y", r6("raw_w"), r6("w"))


@query("weight_stats", f"""
WITH {b.BRACKET}, {_weights_sql('0e0')}
SELECT bracket, k, {s6('min(raw_w)', 'min_w')}, {s6('max(raw_w)', 'max_w')}, {s6('sum(raw_w)', 'sum_w')}, {s6('avg(raw_w)', 'avg_w')} FROM wt GROUP BY 1, 2""")
def weight_stats(spark, root):
    rows = b.bracket_pixels(spark, root)
    out = photometry.weight_statistics(bracket.weights(rows, _bracket_frames(rows)), ["bracket", "k"], "raw_w")
    return out.select("bracket", "k", *[r6(c) for c in ("min_w", "max_w", "sum_w", "avg_w")])


def _merged(spark, root, mode, settings=bracket.Settings()):
    rows = b.bracket_pixels(spark, root)
    out = bracket.merge(rows, _bracket_frames(rows), settings, mode)
    return out.select("bracket", "x", "y", *[r6(c) for c in "rgb"])


def _mean_sql(weights="cw"):
    """Colour as the mean under the weights ``cwt`` of a table."""
    return f"""
m AS (SELECT bracket, x, y, sum(w * l) AS yf, sum(cwt) FILTER (NOT masked AND cwt > 0) AS t, {', '.join(
    f'sum(l{c} * cwt) FILTER (NOT masked AND cwt > 0) AS {c}' for c in 'rgb')} FROM {weights} GROUP BY 1, 2, 3),
col AS (SELECT bracket, x, y, yf, {', '.join(f'CASE WHEN t > 1e-6 THEN {c} / t END AS {c}' for c in 'rgb')} FROM m), {_MATCH}"""


@query("bracket_merge", f"""
WITH {b.BRACKET}, {_weights_sql('0e0')}, {_mean_sql()}""")
def bracket_merge(spark, root):
    return _merged(spark, root, 1)


@query("bracket_merge_contrast", f"WITH {b.BRACKET}, {_weights_sql('6e-1')}, {_mean_sql()}")
def bracket_merge_contrast(spark, root):
    return _merged(spark, root, 1, bracket.Settings(contrast=0.6))


@query("bracket_merge_found_range", f"WITH {b.BRACKET}, {_weights_sql('0e0', None)}, {_mean_sql()}")
def bracket_merge_found_range(spark, root):
    return _merged(spark, root, 1, bracket.Settings(y_max=0.0))


@query("bracket_merge_smooth", f"""
WITH {b.BRACKET}, {_weights_sql('0e0')},
near AS (SELECT a.bracket, a.k, a.x, a.y, avg(n.cwt) AS cwt FROM cw a JOIN cw n
         ON n.bracket = a.bracket AND n.k = a.k AND abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 GROUP BY 1, 2, 3, 4),
sm AS (SELECT cw.* EXCLUDE (cwt), near.cwt FROM cw JOIN near USING (bracket, k, x, y)), {_mean_sql('sm')}""")
def bracket_merge_smooth(spark, root):
    return _merged(spark, root, 2)


@query("bracket_best", f"""
WITH {b.BRACKET}, {_weights_sql('0e0')},
m AS (SELECT *, sum(w * l) OVER (PARTITION BY bracket, x, y) AS yf,
        row_number() OVER (PARTITION BY bracket, x, y ORDER BY (cwt > 0 OR NOT masked) DESC, cwt DESC, k) AS rn FROM cw),
col AS (SELECT bracket, x, y, yf, CASE WHEN cwt > 0 OR NOT masked THEN lr END AS r, CASE WHEN cwt > 0 OR NOT masked THEN lg END AS g,
        CASE WHEN cwt > 0 OR NOT masked THEN lb END AS b FROM m WHERE rn = 1), {_MATCH}""")
def bracket_best(spark, root):
    return _merged(spark, root, 0)


# --- neighbourhoods ---------------------------------------------------------

def _luma_pixels(spark, root):
    return b.pixels(spark, root).select("frame_id", "x", "y", P.luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))


GRAY = f"lp AS (SELECT frame_id, x, y, {LUMA} AS l FROM pixels)"


@query("focal_laplacian", f"""
WITH {b.PIXELS}, {GRAY},
n AS (SELECT a.frame_id, a.x, a.y, any_value(a.l) AS l, count(*) AS k, sum(n.l) AS s FROM lp a
      JOIN lp n ON n.frame_id = a.frame_id AND abs(n.x - a.x) + abs(n.y - a.y) = 1 GROUP BY 1, 2, 3)
SELECT frame_id, x, y, {s6('CASE WHEN k = 4 THEN 4 * l - s END', 'interior')}, {s6('k * l - s', 'border')}, {s6('abs(4 * l - s)', 'zero')} FROM n""")
def focal_laplacian(spark, root):
    rows = _luma_pixels(spark, root)
    key = ["frame_id"]
    inner = focal.laplacian(rows, key, "l", "interior", "interior", tile=8).drop("l")
    edge = focal.laplacian(rows, key, "l", "border", "border", tile=8).drop("l")
    zero = focal.laplacian(rows, key, "l", "zero", "zero", tile=8).drop("l")
    out = edge.join(zero, ["frame_id", "x", "y"]).join(inner, ["frame_id", "x", "y"], "left")
    return out.select("frame_id", "x", "y", r6("interior"), r6("border"), r6("zero"))


@query("focus_laplacian", f"""
WITH {b.PIXELS}, gr AS (SELECT frame_id, x, y, (r + g + b) / 3 AS l FROM pixels),
n AS (SELECT a.frame_id, a.x, a.y, 4 * any_value(a.l) - sum(n.l) AS lap FROM gr a
      JOIN gr n ON n.frame_id = a.frame_id AND abs(n.x - a.x) + abs(n.y - a.y) = 1 GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT frame_id, count(*) AS n_pixels, {s6('var_pop(lap)', 'focus')} FROM n WHERE (x-8)*(x-8)+(y-15)*(y-15) <= 64 GROUP BY 1""")
def focus_laplacian(spark, root):
    return focal.focus(b.pixels(spark, root), 8, 15, 8, tile=8).withColumn("focus", r6("focus"))


@query("focal_mean", f"""
WITH {b.PIXELS}, {GRAY}
SELECT a.frame_id, a.x, a.y, {s6('any_value(a.l) * 4e-1 + avg(n.l) * 6e-1', 'mean')} FROM lp a
JOIN lp n ON n.frame_id = a.frame_id AND abs(n.x - a.x) <= 2 AND abs(n.y - a.y) <= 2 GROUP BY 1, 2, 3""")
def focal_mean(spark, root):
    out = focal.mean(_luma_pixels(spark, root), ["frame_id"], "l", 2, 0.6, tile=8)
    return out.select("frame_id", "x", "y", r6("mean"))


@query("local_contrast", f"""
WITH {b.PIXELS}, {GRAY},
d AS (SELECT a.frame_id, a.x, a.y, abs(any_value(a.l) - avg(n.l)) AS d FROM lp a
  JOIN lp n ON n.frame_id = a.frame_id AND abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 GROUP BY 1, 2, 3)
SELECT frame_id, x, y, {s6('d / greatest(max(d) OVER (PARTITION BY frame_id), 1e-12)', 'contrast')} FROM d""")
def local_contrast(spark, root):
    out = focal.local_contrast(_luma_pixels(spark, root), ["frame_id"], "l", tile=8)
    return out.select("frame_id", "x", "y", r6("contrast"))


def _kernel_sql(kernel):
    rows = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in kernel.items())
    height = "(SELECT max(y) FROM lp m WHERE m.frame_id = a.frame_id)"
    return f"""
kern AS (SELECT * FROM (VALUES {rows}) t(o, w)),
sz AS (SELECT frame_id, max(x) AS mx, max(y) AS my FROM lp GROUP BY 1),
px1 AS (SELECT a.frame_id, a.x, a.y, sum(n.l * w) AS l FROM lp a JOIN sz USING (frame_id), kern, lp n
        WHERE n.frame_id = a.frame_id AND n.y = a.y AND n.x = least(greatest(a.x + o, 0), mx) GROUP BY 1, 2, 3),
px2 AS (SELECT a.frame_id, a.x, a.y, sum(n.l * w) AS l FROM px1 a JOIN sz USING (frame_id), kern, px1 n
        WHERE n.frame_id = a.frame_id AND n.x = a.x AND n.y = least(greatest(a.y + o, 0), my) GROUP BY 1, 2, 3)
SELECT frame_id, x, y, {s6('l', 'blur')} FROM px2"""


@query("focal_gauss", f"WITH {b.PIXELS}, {GRAY}, {_kernel_sql(focal.gaussian(1.2))}")
def focal_gauss(spark, root):
    out = focal.convolve(_luma_pixels(spark, root), ["frame_id"], "l", focal.gaussian(1.2), tile=8)
    return out.select("frame_id", "x", "y", r6("blur"))


@query("focal_atrous", f"WITH {b.PIXELS}, {GRAY}, {_kernel_sql(focal.atrous(1))}")
def focal_atrous(spark, root):
    out = focal.convolve(_luma_pixels(spark, root), ["frame_id"], "l", focal.atrous(1), tile=8)
    return out.select("frame_id", "x", "y", r6("blur"))


@query("focal_median", f"""
WITH {b.PIXELS}, {GRAY}, sz AS (SELECT frame_id, max(x) AS mx, max(y) AS my FROM lp GROUP BY 1),
v AS (SELECT a.frame_id, a.x, a.y, a.l, list_sort(list(n.l)) AS s FROM lp a JOIN sz USING (frame_id), range(-1, 2) i(dx), range(-1, 2) j(dy), lp n
      WHERE n.frame_id = a.frame_id AND n.x = least(greatest(a.x + dx, 0), mx) AND n.y = least(greatest(a.y + dy, 0), my) GROUP BY 1, 2, 3, 4)
SELECT frame_id, x, y, {s6('l * 3e-1 + s[5] * 7e-1', 'median')} FROM v""")
def focal_median(spark, root):
    out = focal.median(_luma_pixels(spark, root), ["frame_id"], "l", 1, 0.7, tile=8)
    return out.select("frame_id", "x", "y", r6("median"))


def _median_scale(source: str, radius: int, base: str = "lp") -> str:
    side = 2 * radius + 1
    return f"""n{radius} AS MATERIALIZED (SELECT a.frame_id, a.x, a.y, least(greatest(a.x + k % {side} - {radius}, 0), mx) AS nx, least(greatest(a.y + k // {side} - {radius}, 0), my) AS ny
      FROM (SELECT frame_id, x, y, unnest(range({side * side})) AS k FROM {base}) a JOIN sz ON sz.frame_id = a.frame_id),
m{radius} AS MATERIALIZED (SELECT n.frame_id, n.x, n.y, list_sort(list(v.l))[{side * side // 2 + 1}] AS m FROM n{radius} n JOIN {source} v
      ON v.frame_id = n.frame_id AND v.x = n.nx AND v.y = n.ny GROUP BY 1, 2, 3),
s{radius} AS MATERIALIZED (SELECT v.frame_id, v.x, v.y, v.l * 3e-1 + m.m * 7e-1 AS l FROM {source} v JOIN m{radius} m ON m.frame_id = v.frame_id AND m.x = v.x AND m.y = v.y)"""


@query("focal_median_scales", f"""
WITH {b.PIXELS}, {GRAY}, sz AS MATERIALIZED (SELECT frame_id, max(x) AS mx, max(y) AS my FROM lp GROUP BY 1),
{_median_scale('lp', 1)}, {_median_scale('s1', 2)}, {_median_scale('s2', 3)}
SELECT frame_id, x, y, {s6('l', 'median')} FROM s3""")
def focal_median_scales(spark, root):
    out = focal.multiscale_median(_luma_pixels(spark, root), ["frame_id"], "l", 3, 0.7, tile=8)
    return out.select("frame_id", "x", "y", r6("median"))


@query("bracket_night_median", f"""
WITH {b.BRACKET}, lp AS MATERIALIZED (SELECT bracket * 3 + k AS frame_id, x, y, g AS l FROM bpixels), sz AS MATERIALIZED (SELECT frame_id, max(x) AS mx, max(y) AS my FROM lp GROUP BY 1),
{_median_scale('lp', 1)}, {_median_scale('s1', 2)}, {_median_scale('s2', 3)}
SELECT lp.frame_id // 3 AS bracket, CAST(lp.frame_id % 3 AS INT) AS k, lp.x, lp.y,
       round(CASE WHEN (lp.frame_id // 3) % 3 = 0 OR lp.frame_id % 3 = 0 OR (lp.frame_id // 3) % 4 = 0 AND lp.frame_id % 3 = 2 THEN lp.l WHEN lp.frame_id % 3 = 1 THEN s2.l ELSE s3.l END, 6) + 0e0 AS g
FROM lp JOIN s2 USING (frame_id, x, y) JOIN s3 USING (frame_id, x, y)""")
def bracket_night_median(spark, root):
    rows = b.bracket_pixels(spark, root)
    # by night two brackets of three; of every fourth bracket the last exposure is a second long
    exposure = F.when(F.col("bracket") % 4 == 0, 4.0).otherwise(8.0) / F.pow(F.lit(2.0), "k")
    frames = rows.select("bracket", "k").distinct().withColumns({"exposure": exposure, "gain": F.lit(20.0), "night_mode": (F.col("bracket") % 3 != 0).cast("int")})
    out = bracket.night_median(rows.select("bracket", "k", "x", "y", "g"), frames, "g", 1, 0.7)
    return out.select("bracket", "k", "x", "y", r6("g"))


_SIZE, _SIGMA, _SCORE_LIMIT = 5, 1.0, 0.3

SCORE = f"""
tp0 AS (SELECT i - 2 AS dx, j - 2 AS dy, exp(-((i - 2) * (i - 2) + (j - 2) * (j - 2)) / 2e0) AS t FROM range(5) a(i), range(5) c(j)),
tp AS (SELECT dx, dy, t / (SELECT sum(t) FROM tp0) AS t FROM tp0),
sm AS (SELECT a.frame_id, a.x, a.y, sum(n.l) AS si, sum(n.l * n.l) AS sq, sum(n.l * t) AS st, count(*) AS k
       FROM lp a, tp, lp n WHERE n.frame_id = a.frame_id AND n.x = a.x + dx AND n.y = a.y + dy
         AND a.x BETWEEN 2 AND 13 AND a.y BETWEEN 2 AND 29 GROUP BY 1, 2, 3),
ts AS (SELECT sum(t) AS t1, sum(t * t) AS t2 FROM tp),
score AS (SELECT frame_id, x, y, CASE WHEN sqrt(greatest(sq - si / 25 * si, 0e0)) * sqrt(t2 - t1 / 25 * t1) > 1e-5
    THEN (st - si / 25 * t1) / (sqrt(sq - si / 25 * si) * sqrt(t2 - t1 / 25 * t1)) ELSE 0e0 END AS score FROM sm, ts)
"""


def _scores(spark, root):
    # the last frame may be shorter than the others
    return focal.template_score(b.pixels(spark, root), ["frame_id"], _SIZE, _SIGMA, W, H, tile=8)


@query("template_score", f"WITH {b.PIXELS}, {GRAY}, {SCORE} SELECT frame_id, x, y, {s6('score', 'score')} FROM score")
def template_score(spark, root):
    return _scores(spark, root).withColumn("score", r6("score"))


@query("thin_min_distance", f"""
WITH {b.PIXELS}, {GRAY}, {SCORE},
cd AS (SELECT frame_id, x, y, round(score, 6) + 0e0 AS score FROM score WHERE score >= 3e-1),
kept AS (SELECT * FROM cd a WHERE NOT EXISTS (SELECT 1 FROM cd v WHERE v.frame_id = a.frame_id
  AND (v.x - a.x) * (v.x - a.x) + (v.y - a.y) * (v.y - a.y) < 64
  AND (v.score > a.score OR (v.score = a.score AND (v.y < a.y OR (v.y = a.y AND v.x < a.x))))))
SELECT frame_id, x, y, score FROM kept QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, y, x) <= 5""")
def thin_min_distance(spark, root):
    candidates = _scores(spark, root).where(F.col("score") >= _SCORE_LIMIT).withColumn("score", r6("score"))
    return focal.thin(candidates, ["frame_id"], 8, 5)


@query("thin_greedy", f"""
WITH RECURSIVE {b.PIXELS}, {GRAY}, {SCORE},
cd AS (SELECT frame_id, x, y, round(score, 6) + 0e0 AS score FROM score WHERE score >= 3e-1),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, y, x) AS i FROM cd),
t AS (SELECT frame_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x INT, y INT)[]) AS kept, FALSE AS hit FROM o WHERE i = 1
 UNION ALL
 SELECT frame_id, i, CASE WHEN free THEN list_append(kept, {{'x': x, 'y': y}}) ELSE kept END, free FROM (
  SELECT o.frame_id, o.i, t.kept, o.x, o.y, len(list_filter(t.kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) < 64)) = 0 AS free
  FROM t JOIN o ON o.frame_id = t.frame_id AND o.i = t.i + 1))
SELECT o.frame_id, o.x, o.y, o.score FROM t JOIN o ON o.frame_id = t.frame_id AND o.i = t.i WHERE hit""")
def thin_greedy(spark, root):
    candidates = _scores(spark, root).where(F.col("score") >= _SCORE_LIMIT).withColumn("score", r6("score"))
    return focal.thin_greedy(candidates, ["frame_id"], 8)


@query("tile_pyramid", f"""
WITH {b.PIXELS}, {GRAY}
SELECT frame_id, CAST(lv AS INT) AS level, CAST(x // (1 << lv) AS BIGINT) AS x, CAST(y // (1 << lv) AS BIGINT) AS y, {s6('avg(l)', 'l')}
FROM lp, range(4) t(lv) GROUP BY 1, 2, 3, 4""")
def tile_pyramid(spark, root):
    return focal.tile_pyramid(_luma_pixels(spark, root), ["frame_id"], ["l"], W, H).withColumn("l", r6("l"))


# --- stack per night -----------------------------------------------------------

_NIGHTS = f"""{b.OBS},
w AS (SELECT station, timestamp, night_mode, lag(night_mode) OVER l AS was, lag(timestamp) OVER l AS past FROM obs
      WINDOW l AS (PARTITION BY station ORDER BY timestamp, event_id)),
ends AS (SELECT DISTINCT station, CAST(floor((past - 43200) / 86400) AS BIGINT) AS night FROM w WHERE was = 1 AND night_mode = 0),
series AS (SELECT o.station, e.night, floor(brightness * 255) AS v FROM obs o JOIN ends e
           ON o.station = e.station AND CAST(floor((o.timestamp - 43200) / 86400) AS BIGINT) = e.night WHERE night_mode = 1)"""


def _night_frames(spark, root):
    """One-pixel frames of the nights that have ended, a series per station and night."""
    rows = b.obs(spark, root).select("station", "event_id", "timestamp", "night_mode", "brightness")
    night = timeline.night_series(rows, ["station"], "timestamp", tie=["event_id"])
    return night.select(F.concat_ws("/", "station", "night").alias("series"), F.col("timestamp").alias("seq"),
                        *[F.lit(0).alias(c) for c in "xyc"], F.floor(F.col("brightness") * 255).cast("int").alias("v"))


def _night(mode: str, sql: str) -> None:
    @query(f"stack_night_{mode}", f"""
WITH {_NIGHTS} SELECT station || '/' || night AS series, count(*) AS n_frames, CAST(floor({sql} + 5e-1) AS INT) AS v
FROM series GROUP BY station, night""")
    def stack_night(spark, root):
        return stack.stack(_night_frames(spark, root), mode).select("series", "n_frames", "v")


_night("avg", "avg(v)")
_night("max", "max(v)")
_night("median", "quantile_cont(v, 0.5)")
