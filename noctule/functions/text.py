"""Text forms of times, angles and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"


def stamp_to_epoch(text: Column) -> Column:
    """``YYYYMMDDhhmmss`` to epoch seconds; NULL when it is not a timestamp."""
    return F.when(text.rlike("^[0-9]{14}$"), F.unix_seconds(F.try_to_timestamp(text, F.lit(STAMP))))


def epoch_to_stamp(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), STAMP)


def epoch_to_local(epoch: Column, offset: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch + offset), "yyyy-MM-dd HH:mm:ss")


def epoch_to_day(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def day_number(epoch: Column) -> Column:
    """Whole UTC days since 1970."""
    return F.floor(epoch / 86400)


def local_hour(epoch: Column, offset: Column) -> Column:
    return F.floor(F.pmod(epoch + offset, F.lit(86400)) / 3600).cast("int")


def clock(seconds: Column) -> Column:
    """Duration or time of day as ``HH:MM``."""
    return F.concat(
        F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.floor(F.pmod(seconds, F.lit(3600.0)) / 60).cast("string"), 2, "0"),
    )


def parse_coordinate(text: Column) -> Column:
    """Signed degrees from a number with an optional N/S/E/W suffix.

    The number is the longest leading numeral; anything else than one of the
    four letters right after it makes the text invalid.
    """
    pattern = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*(.?)"
    number = F.regexp_extract(text, pattern, 1)
    hemisphere = F.upper(F.regexp_extract(text, pattern, 2))
    value = F.nullif(number, F.lit("")).try_cast("double")
    return F.when(hemisphere.isin("", "N", "E"), value).when(hemisphere.isin("S", "W"), -value)


def _pad2(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _sexagesimal(value: Column, carry: bool) -> tuple[Column, Column, Column]:
    """Whole units, minutes and rounded seconds; without ``carry`` seconds can read 60."""
    if carry:
        seconds = F.floor(value * 3600.0 + 0.5).cast("long")
        return F.floor(seconds / 3600).cast("long"), F.floor(seconds / 60).cast("long") % 60, seconds % 60
    units = F.floor(value)
    minutes = (value - units) * 60.0
    return units, F.floor(minutes), F.floor((minutes - F.floor(minutes)) * 60.0 + 0.5)


def ra_text(ra: Column, carry: bool = True) -> Column:
    """Right ascension in degrees as ``hh:mm:ss``; 24 hours read 00."""
    h, m, s = _sexagesimal(ra / 15.0, carry)
    h = h % 24 if carry else h
    return F.concat_ws(":", _pad2(h), _pad2(m), _pad2(s))


def dec_text(dec: Column, carry: bool = True) -> Column:
    """Declination in degrees as ``±dd°mm′ss″``."""
    d, m, s = _sexagesimal(F.abs(dec), carry)
    sign = F.when(dec < 0, "-").otherwise("+")
    return F.concat(sign, _pad2(d), F.lit("°"), _pad2(m), F.lit("′"), _pad2(s), F.lit("″"))
