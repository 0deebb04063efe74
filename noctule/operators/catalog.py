"""Sky objects over observations: visible objects, active showers, rise and
set.  The catalogues are part of the plan (array literals), so attaching them
to observations is a row-local explode, not a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.functions import sky
from noctule.session import stored

# The twenty brightest stars, (name, right ascension, declination) in degrees.
BRIGHT_STARS = [
    ("Sirius", 101.2875, -16.7161),
    ("Canopus", 95.9879, -52.6957),
    ("Arcturus", 213.9153, 19.1824),
    ("Alpha Centauri", 219.9021, -60.8356),
    ("Vega", 279.2347, 38.7837),
    ("Capella", 79.1723, 45.9979),
    ("Rigel", 78.6345, -8.2056),
    ("Procyon", 114.8255, 5.2249),
    ("Achernar", 24.4286, -57.2368),
    ("Betelgeuse", 88.7929, 7.4071),
    ("Hadar (Beta Cen)", 210.9558, -60.3730),
    ("Altair", 297.6958, 8.8683),
    ("Acrux", 186.6496, -63.0991),
    ("Aldebaran", 68.9800, 16.5093),
    ("Antares", 247.3519, -26.4320),
    ("Spica", 201.2983, -11.1613),
    ("Pollux", 116.3289, 28.0262),
    ("Fomalhaut", 344.4128, -29.6222),
    ("Deneb", 310.3579, 45.2803),
    ("Regulus", 152.0929, 11.9672),
]

# Meteor showers, code: (name, first month/day, last month/day,
# radiant right ascension/declination at the start and at the end).
METEOR_SHOWERS = {
    "QUA": ("Quadrantids", (12, 30), (1, 10), (228, 50), (234, 48)),
    "DLM": ("December Leonis Minorids", (12, 5), (2, 5), (149, 37), (234, 48)),
    "ACE": ("Alpha-Centaurids", (1, 28), (2, 21), (200, -57), (225, -63)),
    "GNO": ("Gamma-Normids", (2, 25), (3, 22), (225, -51), (245, -49)),
    "LYR": ("Lyrids", (4, 16), (4, 25), (263, 34), (269, 34)),
    "PPU": ("Pi-Puppids", (4, 15), (4, 28), (106, -44), (111, -45)),
    "ETA": ("Eta-Aquariids", (4, 19), (5, 28), (323, -7), (353, 7)),
    "ELY": ("Eta-Lyrids", (5, 3), (5, 14), (283, 44), (293, 45)),
    "JBO": ("June Bootids", (6, 22), (7, 2), (223, 48), (225, 47)),
    "CAP": ("Alpha-Capricornids", (7, 3), (8, 15), (285, -16), (318, -6)),
    "SDA": ("South Delta-Aquariids", (7, 12), (8, 23), (325, -19), (356, -11)),
    "PER": ("Perseids", (7, 17), (8, 24), (6, 50), (63, 58)),
    "PAU": ("Piscis Austrinids", (7, 15), (8, 10), (330, -34), (352, -26)),
    "KCG": ("Kappa-Cygnids", (8, 3), (8, 25), (283, 58), (289, 60)),
    "AUR": ("Alpha-Aurigids", (8, 28), (9, 5), (85, 40), (102, 38)),
    "SPE": ("September Eta-Perseids", (9, 5), (9, 21), (43, 40), (59, 41)),
    "STA": ("Southern Taurids", (9, 10), (11, 20), (12, 3), (64, 16)),
    "ORI": ("Orionids", (10, 2), (11, 7), (85, 14), (105, 17)),
    "DAU": ("Delta-Aurigids", (10, 10), (10, 18), (82, 45), (92, 41)),
    "DRA": ("Draconids", (10, 6), (10, 10), (262, 54), (262, 54)),
    "EGE": ("Eta-Geminids", (10, 14), (10, 27), (99, 27), (109, 27)),
    "LMI": ("Leo Minorids", (10, 19), (10, 27), (158, 39), (168, 35)),
    "NTA": ("Northern Taurids", (10, 20), (12, 10), (38, 18), (74, 24)),
    "LEO": ("Leonids", (11, 6), (11, 30), (147, 24), (159, 19)),
    "AMO": ("Alpha-Monocerotids", (11, 15), (11, 25), (117, 1), (117, 1)),
    "PHO": ("Phoenicids", (11, 28), (12, 9), (14, -52), (22, -53)),
    "PUP": ("Puppid/Velids", (12, 1), (12, 15), (120, -45), (128, -45)),
    "MON": ("Monocerotids", (11, 27), (12, 17), (100, 8), (100, 8)),
    "GEM": ("Geminids", (12, 7), (12, 17), (103, 33), (118, 32)),
    "HYD": ("Sigma-Hydrids", (12, 3), (12, 15), (122, 3), (130, 1)),
    "COM": ("Comae Berenicids", (12, 12), (12, 23), (174, 19), (180, 16)),
    "URS": ("Ursids", (12, 17), (12, 26), (217, 76), (217, 74)),
}


def star_array() -> Column:
    return F.array(*[F.struct(F.lit("star").alias("kind"), F.lit(n).alias("name"), F.lit(ra).alias("ra"),
                              F.lit(dec).alias("dec")) for n, ra, dec in BRIGHT_STARS])


def shower_array() -> Column:
    """Showers with month-day numbers (month * 100 + day) and mean radiant."""
    return F.array(*[F.struct(
        F.lit(code).alias("code"), F.lit(name).alias("name"),
        F.lit(s[0] * 100 + s[1]).alias("first"), F.lit(e[0] * 100 + e[1]).alias("last"),
        F.lit((p[0] + q[0]) / 2).alias("ra"), F.lit((p[1] + q[1]) / 2).alias("dec"))
        for code, (name, s, e, p, q) in METEOR_SHOWERS.items()])


def project(objects: DataFrame, lat, lst: str = "_lst") -> DataFrame:
    """Adds azimuth and altitude and keeps what stands above the horizon.

    ``lst`` is the sidereal time of each row's observation, ``_sin`` and
    ``_cos`` are those of its object's declination; the horizon test is on the
    sine of the altitude and comes before any angle is worked out."""
    rows = objects.withColumn("_h", sky.hour_angle(F.col(lst), F.col("ra")))
    rows = rows.withColumn("_s", sky.altitude_sine(F.col("_h"), (F.col("_sin"), F.col("_cos")), lat)).where("_s >= 0")
    rows = rows.withColumn("altitude", sky.altitude_of(F.col("_s")))
    return rows.withColumn("azimuth", sky.azimuth_at(F.col("_h"), F.col("dec"), F.col("altitude"), lat)).drop("_h", "_s", "_sin", "_cos", lst)


def with_sines(objects: DataFrame) -> DataFrame:
    sine, cosine = sky.sin_cos(F.col("dec"))
    return objects.withColumns({"_sin": sine, "_cos": cosine})


def visible_stars(observations: DataFrame, keep: list[str], lat, lon, time: str = "timestamp") -> DataFrame:
    # sidereal time once per observation, not per star
    rows = observations.select(*keep, sky.sidereal_time(F.col(time), lon).alias("_lst"))
    rows = rows.select("*", F.explode(star_array()).alias("_o")).select(*keep, "_lst", "_o.*")
    return project(with_sines(rows), lat)


#: Into so many shares a day's observations go; the day's objects are copied into each.
SHARES = 64


def visible_objects(observations: DataFrame, objects: DataFrame, keep: list[str], lat, lon,
                    time: str = "timestamp", day: str = "day") -> DataFrame:
    """Objects with positions per day, such as comets, seen at each
    observation of that day: an equi join, hence no cross product.

    Pairs by far outnumber the rows of both sides and days are few, so a day's
    observations are dealt into shares by hash: the pairs are spread over
    ``spark.sql.shuffle.partitions`` tasks however the input is laid out.
    Objects of days without an observation are left out before they are copied."""
    rows = observations.select(*keep, day, sky.sidereal_time(F.col(time), lon).alias("_lst"), F.pmod(F.hash(*keep), F.lit(SHARES)).alias("_share"))
    rows = rows.repartition(int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions")), day, "_share")
    seen = objects if observations.isStreaming else objects.join(observations.select(day).distinct(), day, "left_semi")
    shared = with_sines(seen).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return project(rows.join(shared, [day, "_share"]).drop("_share"), lat)


def active_showers(dates: DataFrame, keep: list[str], date: str = "day",
                   strict_reference: bool = False) -> DataFrame:
    """Showers active on a date, with their mean radiant.

    A shower over New Year is active on both sides of it; the reference's own
    rule misses the days before, which ``strict_reference`` reproduces."""
    number = F.month(date) * 100 + F.dayofmonth(date)

    def active(s: Column) -> Column:
        within = (s["first"] <= number) & (number <= s["last"])
        over_new_year = number <= s["last"] if strict_reference else (s["first"] <= number) | (number <= s["last"])
        return F.when(s["first"] <= s["last"], within).otherwise(over_new_year)

    rows = dates.select(*keep, F.explode(F.filter(shower_array(), active)).alias("_s"))
    return rows.select(*keep, "_s.code", "_s.name", "_s.ra", "_s.dec")


def all_objects(comets: DataFrame, times: DataFrame, time: str = "timestamp") -> DataFrame:
    """One catalogue ``(kind, name, ra, dec)`` per time: stars, active
    showers' radiants, sun and moon, and the given comets (same ``time``)."""
    epoch = F.col(time)
    stars = times.select(time, F.explode(star_array()).alias("_o")).select(time, "_o.*")
    showers = active_showers(times.withColumn("_d", F.to_date(F.timestamp_seconds(epoch))), [time], "_d")
    showers = showers.select(time, F.lit("shower").alias("kind"), "name", "ra", "dec")
    bodies = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(kind).alias("name"), ra.alias("ra"), dec.alias("dec"))
                       for kind, (ra, dec) in (("sun", sky.sun_position(epoch)), ("moon", sky.moon_position(epoch)))])
    bodies = times.select(time, F.explode(bodies).alias("_o")).select(time, "_o.*")
    comets = comets.select(time, F.lit("comet").alias("kind"), "name", "ra", "dec")
    return stars.unionByName(showers).unionByName(bodies).unionByName(comets)


STEP = 300


def rise_set(days: DataFrame, body: str, lat, lon, start: str = "day_start", threshold: float = 0.0,
             refine: bool = False, names: tuple[str, str] = ("rise", "set"), span: int = 86400) -> DataFrame:
    """First rise and set of sun or moon from a day's start on.

    ``lat`` and ``lon`` are degrees or names of columns of ``days``.  Each
    distinct start and place is sampled once, every five minutes, however many
    rows share it; the samples sit in one partition, so the aggregate that
    finds the crossings reduces them before the shuffle.  ``threshold`` -6
    gives civil dawn and dusk; a day without one has NULL."""
    position = {"sun": sky.sun_altitude, "moon": sky.moon_altitude}[body]
    place = [start, *[c for c in (lat, lon) if isinstance(c, str)]]
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    t = F.col("_t")
    samples = days.select(*place).distinct().select("*", F.explode(F.sequence(
        F.col(start) + STEP, F.col(start) + span - STEP, F.lit(STEP))).alias("_t"))
    samples = samples.select(*place, "_t", (position(t - STEP, lat, lon) - threshold).alias("_before"),
                             (position(t, lat, lon) - threshold).alias("_now"))
    tests = ((F.col("_before") < 0) & (F.col("_now") >= 0), (F.col("_before") > 0) & (F.col("_now") <= 0))
    hits = samples.groupBy(*place).agg(*[F.min(F.when(test, t)).alias(n) for n, test in zip(names, tests)])
    if refine:
        at = sky.bound_altitude(body, lat, lon)
        hits = hits.withColumns({n: sky.refine_crossing(F.col(n), at, rising, threshold)
                                 for n, rising in zip(names, (True, False))})
    return days.join(stored(hits, "rise-set"), place, "left")
