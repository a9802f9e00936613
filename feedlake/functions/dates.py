"""Feed dates with an offset, as UTC timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names of RFC 822 dates and their offset from UTC in minutes.
ZONES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
         "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}

_OFFSET = r"[+-]\d{2}:?\d{2}"
_ISO = rf"^\s*(\d{{4}}-\d{{1,2}}-\d{{1,2}}[Tt ]\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?)\s*(Z|z|{_OFFSET})\s*$"
_RSS = (rf"^\s*(?:[A-Za-z]+,)?\s*(\d{{1,2}} [A-Za-z]{{3}} \d{{4}} \d{{2}}:\d{{2}}(?::\d{{2}})?)"
        rf"\s*({_OFFSET}|{'|'.join(ZONES)})?\s*$")


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of ``+0900``, ``+09:00`` or a zone name; '' is 0, an unknown name NULL."""
    size = (F.substring(zone, 2, 2).try_cast("int") * 60
            + F.substring(F.regexp_replace(zone, ":", ""), 4, 2).try_cast("int"))
    named = F.when(zone == "", F.lit(0))
    for name, minutes in ZONES.items():
        named = named.when(F.upper(zone) == name, F.lit(minutes))
    return F.when(zone.startswith("+"), size).when(zone.startswith("-"), -size).otherwise(named)


def _shift(wall: Column, zone: Column, wall_clock: bool) -> Column:
    return wall if wall_clock else F.timestamp_add("MINUTE", -offset_minutes(zone), wall)


def iso_utc(s: Column, wall_clock: bool = False) -> Column:
    """An ISO date and time as UTC; a value without offset is taken as UTC, one that does not parse is NULL.

    ``wall_clock=True`` ignores the offset, as the warehouse's NTZ conversion does.
    """
    wall = F.regexp_extract(s, _ISO, 1)
    zoned = _shift(wall.try_cast("timestamp_ntz"), F.regexp_extract(s, _ISO, 2), wall_clock)
    return F.when(wall != "", zoned).otherwise(s.try_cast("timestamp_ntz"))


def rss_utc(s: Column, reference: bool = False) -> Column:
    """An RFC 822 date (``Mon, 01 Jan 2024 10:00:00 +0900``) as UTC; day name, seconds and zone may be missing.

    ``reference=True`` answers NULL for a date with a zone, as the warehouse's
    format string does. A value that does not parse is NULL.
    """
    wall, zone = F.regexp_extract(s, _RSS, 1), F.regexp_extract(s, _RSS, 2)
    # the day name is left out: Spark's try_to_timestamp raises on 'EEE'
    ts = F.try_to_timestamp(F.nullif(wall, F.lit("")), F.lit("d MMM yyyy HH:mm[:ss]")).cast("timestamp_ntz")
    return F.when(zone == "", ts) if reference else _shift(ts, zone, False)
