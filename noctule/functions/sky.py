"""Celestial positions as Column expressions.

Sidereal time and the coordinate rotations are the usual closed forms.  Sun
and moon use the low-precision series of the Astronomical Almanac (about
0.01 deg for the sun, 0.3 deg for the moon), which keeps them inside the JVM.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

J2000 = 2451545.0
SYNODIC_MONTH = 29.530588853


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _wrap(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def julian_date(epoch: Column) -> Column:
    return epoch / 86400.0 + 2440587.5


def sidereal_time(epoch: Column, lon) -> Column:
    """Local mean sidereal time in degrees."""
    d = julian_date(epoch) - J2000
    t = d / 36525.0
    gmst = 280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    return _wrap(_wrap(gmst) + _c(lon))


def obliquity(epoch: Column) -> Column:
    """Mean obliquity of the ecliptic in degrees."""
    t = (julian_date(epoch) - J2000) / 36525.0
    seconds = 21.448 - 46.8150 * t - 0.00059 * t * t + 0.001813 * t * t * t
    return 23.0 + 26.0 / 60.0 + seconds / 3600.0


def hour_angle(lst: Column, ra: Column) -> Column:
    return _wrap(lst - ra)


def sin_cos(angle: Column) -> tuple[Column, Column]:
    """Sine and cosine of degrees."""
    return _sin(angle), _cos(angle)


def altitude_sine(h: Column, dec: tuple[Column, Column], lat) -> Column:
    """From an hour angle in degrees and ``sin_cos`` of the declination; above the horizon it is not negative."""
    phi = _c(lat)
    return dec[0] * _sin(phi) + dec[1] * _cos(phi) * _cos(h)


def altitude_of(sine: Column) -> Column:
    return F.degrees(F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0))))


def altitude_at(h: Column, dec: Column, lat) -> Column:
    """From an hour angle, all in degrees."""
    return altitude_of(altitude_sine(h, sin_cos(dec), lat))


def azimuth_at(h: Column, dec: Column, alt: Column, lat) -> Column:
    """Clockwise from north, from hour angle and altitude."""
    phi = _c(lat)
    c = F.try_divide(_sin(dec) - _sin(alt) * _sin(phi), _cos(alt) * _cos(phi))
    az = F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))
    return F.when(_sin(h) > 0, 360.0 - az).otherwise(az)


def altitude(ra: Column, dec: Column, lat, lon, epoch: Column) -> Column:
    return altitude_at(hour_angle(sidereal_time(epoch, lon), ra), dec, lat)


def azimuth(ra: Column, dec: Column, lat, lon, epoch: Column) -> Column:
    return azimuth_at(hour_angle(sidereal_time(epoch, lon), ra), dec, altitude(ra, dec, lat, lon, epoch), lat)


def declination_of(az: Column, alt: Column, lat) -> Column:
    phi = _c(lat)
    s = _sin(alt) * _sin(phi) + _cos(alt) * _cos(phi) * _cos(az)
    return F.degrees(F.asin(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0))))


def right_ascension_of(az: Column, alt: Column, lat, lon, epoch: Column) -> Column:
    phi = _c(lat)
    dec = declination_of(az, alt, lat)
    sin_h = F.try_divide(-_sin(az) * _cos(alt), _cos(dec))
    cos_h = F.try_divide(_sin(alt) - _sin(phi) * _sin(dec), _cos(phi) * _cos(dec))
    h = F.degrees(F.atan2(sin_h, F.least(F.greatest(cos_h, F.lit(-1.0)), F.lit(1.0))))
    return _wrap(sidereal_time(epoch, lon) - h)


def image_position(az: Column, alt: Column, cx: float, cy: float, radius: float,
                   rotation: float = 0.0, projection: str = "linear") -> tuple[Column, Column]:
    """Pixel position on an all-sky frame; east is left of north."""
    if projection == "sinus":
        r = radius * F.sin(F.radians(90.0 - alt))
    else:
        r = radius * (90.0 - alt) / 90.0
    angle = F.radians(F.pmod(360.0 - az, F.lit(360.0)) + rotation)
    return cx + F.sin(angle) * r, cy - F.cos(angle) * r


def equatorial(lon: Column, lat: Column, eps: Column) -> tuple[Column, Column]:
    """Ecliptic to right ascension and declination, degrees."""
    tan_lat = F.tan(F.radians(lat))
    ra = F.degrees(F.atan2(_sin(lon) * _cos(eps) - tan_lat * _sin(eps), _cos(lon)))
    dec = F.degrees(F.asin(_sin(lat) * _cos(eps) + _cos(lat) * _sin(eps) * _sin(lon)))
    return _wrap(ra), dec


# Almanac series, angles in degrees.  Sun: d = days from J2000.
SUN_MEAN_LONGITUDE = (280.460, 0.9856474)
SUN_MEAN_ANOMALY = (357.528, 0.9856003)
SUN_EQUATION = (1.915, 0.020)

# Moon: T = centuries from J2000, (amplitude, phase at J2000, rate per century).
MOON_LONGITUDE = (218.32, 481267.881)
MOON_LONGITUDE_TERMS = [
    (6.29, 135.0, 477198.87),
    (-1.27, 259.3, -413335.36),
    (0.66, 235.7, 890534.22),
    (0.21, 269.9, 954397.74),
    (-0.19, 357.5, 35999.05),
    (-0.11, 186.5, 966404.03),
]
MOON_LATITUDE_TERMS = [
    (5.13, 93.3, 483202.02),
    (0.28, 228.2, 960400.89),
    (-0.28, 318.3, 6003.15),
    (-0.17, 217.6, -407332.21),
]


def sun_longitude(epoch: Column) -> Column:
    d = julian_date(epoch) - J2000
    anomaly = SUN_MEAN_ANOMALY[0] + SUN_MEAN_ANOMALY[1] * d
    return _wrap(SUN_MEAN_LONGITUDE[0] + SUN_MEAN_LONGITUDE[1] * d
                 + SUN_EQUATION[0] * _sin(anomaly) + SUN_EQUATION[1] * _sin(2.0 * anomaly))


def sun_position(epoch: Column) -> tuple[Column, Column]:
    return equatorial(sun_longitude(epoch), F.lit(0.0), obliquity(epoch))


def _series(epoch: Column, terms) -> Column:
    t = (julian_date(epoch) - J2000) / 36525.0
    total = F.lit(0.0)
    for amplitude, phase, rate in terms:
        total = total + amplitude * _sin(phase + rate * t)
    return total


def moon_longitude(epoch: Column) -> Column:
    t = (julian_date(epoch) - J2000) / 36525.0
    return _wrap(MOON_LONGITUDE[0] + MOON_LONGITUDE[1] * t + _series(epoch, MOON_LONGITUDE_TERMS))


def moon_latitude(epoch: Column) -> Column:
    return _series(epoch, MOON_LATITUDE_TERMS)


def moon_position(epoch: Column) -> tuple[Column, Column]:
    return equatorial(moon_longitude(epoch), moon_latitude(epoch), obliquity(epoch))


def sun_altitude(epoch: Column, lat, lon) -> Column:
    ra, dec = sun_position(epoch)
    return altitude(ra, dec, lat, lon, epoch)


def moon_altitude(epoch: Column, lat, lon) -> Column:
    ra, dec = moon_position(epoch)
    return altitude(ra, dec, lat, lon, epoch)


def sun_below(epoch: Column, lat, lon, degrees: float, max_latitude: float | None) -> Column:
    """1 when the sun is lower than ``-degrees``; always 0 beyond
    ``max_latitude`` (None switches that shortcut off)."""
    below = (sun_altitude(epoch, lat, lon) < -degrees).cast("int")
    if max_latitude is None:
        return below
    return F.when(F.abs(_c(lat)) > max_latitude, 0).otherwise(below)


def is_night(epoch: Column, lat, lon) -> Column:
    return sun_below(epoch, lat, lon, 6.0, 60.0)


def is_astronomical_night(epoch: Column, lat, lon) -> Column:
    return sun_below(epoch, lat, lon, 18.0, 54.0)


def moon_elongation(epoch: Column) -> Column:
    """Moon minus sun in ecliptic longitude, 0..360."""
    return _wrap(moon_longitude(epoch) - sun_longitude(epoch))


def moon_age(epoch: Column) -> Column:
    return moon_elongation(epoch) / 360.0 * SYNODIC_MONTH


def moon_illumination(epoch: Column) -> Column:
    """Lit part of the disk in percent."""
    separation = F.acos(_cos(moon_latitude(epoch)) * _cos(moon_elongation(epoch)))
    return (1.0 - F.cos(separation)) / 2.0 * 100.0


# Lunar age in days (exclusive bound) -> phase name.
MOON_PHASES = [
    (1.84566, "New moon"),
    (5.53699, "Waxing crescent moon"),
    (9.22831, "First quarter moon"),
    (12.91963, "Waxing gibbous moon"),
    (16.61096, "Full moon"),
    (20.30228, "Waning gibbous moon"),
    (23.99361, "Last quarter moon"),
    (None, "Waning crescent moon"),
]


def moon_phase(age: Column) -> Column:
    out = F.lit(MOON_PHASES[-1][1])
    for bound, name in reversed(MOON_PHASES[:-1]):
        out = F.when(age < bound, name).otherwise(out)
    return out


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.  Lambda bodies are not
    covered by the common-subexpression step of generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound_altitude(body: str, lat, lon) -> Callable[[Column], Column]:
    """Altitude of sun or moon for use inside a lambda."""

    def ecliptic(t: Column) -> Column:
        lon_, lat_ = (sun_longitude(t), F.lit(0.0)) if body == "sun" else (moon_longitude(t), moon_latitude(t))
        return F.struct(lon_.alias("l"), lat_.alias("b"), obliquity(t).alias("e"))

    def place(p: Column) -> Column:
        ra, dec = equatorial(p["l"], p["b"], p["e"])
        return F.struct(ra.alias("ra"), dec.alias("dec"))

    def at(t: Column) -> Column:
        return _bind(ecliptic(t), lambda p: _bind(place(p), lambda q: altitude(q["ra"], q["dec"], lat, lon, t)))

    return at


def refine_crossing(hit: Column, altitude_at: Callable[[Column], Column], rising: bool, threshold: float = 0.0,
                    step: int = 300, rounds: int = 20) -> Column:
    """Halve the step before ``hit`` ``rounds`` times; midpoint of what is left."""

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2.0
        level = altitude_at(mid) - threshold
        past = level >= 0 if rising else level <= 0
        return _bind(past, lambda p: F.struct(F.when(p, state["lo"]).otherwise(mid).alias("lo"),
                                              F.when(p, mid).otherwise(state["hi"]).alias("hi")))

    initial = F.struct((hit - step).cast("double").alias("lo"), hit.cast("double").alias("hi"))
    return F.when(hit.isNotNull(), F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), initial, halve, lambda s: (s["lo"] + s["hi"]) / 2.0))


def local_day_start(epoch: Column, offset: Column) -> Column:
    """Epoch of local midnight for a stored zone offset."""
    return (F.floor((epoch + offset) / 86400) * 86400 - offset).cast("long")


def seconds_until(event: Column, now: Column) -> Column:
    """Seconds to the next occurrence, a day later when already past."""
    return F.when(event >= now, event - now).otherwise(event + 86400 - now)
