"""Column expressions of the engine: times, rounding, ids, distances.  No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
# Fixed value: the radius of the earth in metres.
EARTH_RADIUS_M = 6_371_000.0


def int_div(a: Column, b: Column | int) -> Column:
    """Exact integer quotient."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def parse_time(c: str | Column) -> Column:
    """``[-]H+:MM:SS`` to INT seconds; null for anything else and for more seconds than an INT holds (hours may exceed 23)."""
    t = F.trim(c)
    part = lambda start: F.substring(t, start, 2).try_cast("int")
    hours = F.abs(F.substring_index(t, ":", 1).try_cast("bigint"))
    sec = F.try_add(F.try_multiply(hours, F.lit(3600)), part(-5) * 60 + part(-2)).try_cast("int")
    return F.when(t.rlike("^-?[0-9]+:[0-9]{2}:[0-9]{2}$"), F.when(t.startswith("-"), -sec).otherwise(sec))


def format_time(c: str | Column) -> Column:
    """Seconds to ``[-]HH:MM:SS``, rounded half to even; the sign is that of the unrounded value."""
    x = F.col(c) if isinstance(c, str) else c
    a = F.bround(F.abs(x.cast("double"))).cast("long")
    body = F.format_string("%02d:%02d:%02d", int_div(a, 3600), int_div(F.pmod(a, F.lit(3600)), 60), F.pmod(a, F.lit(60)))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body))


def format_short(c: str | Column) -> Column:
    """Seconds to ``M:SS`` or ``H:MM:SS``; the sign is that of the rounded value."""
    x = F.col(c) if isinstance(c, str) else c
    r = F.bround(x.cast("double")).cast("long")
    a = F.abs(r)
    h, m, s = int_div(a, 3600), int_div(F.pmod(a, F.lit(3600)), 60), F.pmod(a, F.lit(60))
    body = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.concat(F.when(r < 0, F.lit("-")).otherwise(F.lit("")), body))


def wrapped_diff(start: Column, end: Column) -> Column:
    """Seconds from start to end; negative differences gain whole days until they are not."""
    d = end - start
    return F.when(d < 0, F.pmod(d, F.lit(DAY))).otherwise(d)


def near_diff(start: Column, end: Column) -> Column:
    """Seconds from start to end taken within half a day: in [-43200, 43200)."""
    return F.pmod(end - start + F.lit(DAY // 2), F.lit(DAY)) - F.lit(DAY // 2)


def hour_bucket(seconds: Column) -> Column:
    """The hour of day; negative seconds wrap to the day before."""
    return int_div(F.pmod(seconds, F.lit(DAY)), 3600).cast("int")


def half_up_mean(c: str | Column) -> Column:
    """Exact integer mean, halves up, 0 for no values (values must not be negative)."""
    x = F.col(c) if isinstance(c, str) else c
    n = F.count(x)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(int_div(F.sum(x.cast("long")) * 2 + n, n * 2))


def sample_stdev(c: str | Column) -> Column:
    """Sample deviation, 0 for one value, null for none."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))


def dotted_key(c: str | Column) -> list[Column]:
    """The first three dotted parts as numbers, anything but digits as 0, to sort naturally."""
    parts = F.split(c, r"\.")
    part = lambda i: F.coalesce(F.when(F.get(parts, F.lit(i)).rlike("^[0-9]+$"), F.get(parts, F.lit(i)).try_cast("bigint")), F.lit(0))
    return [part(i) for i in range(3)]


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a locally flat earth."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * F.lit(EARTH_RADIUS_M)
    dy = F.radians(lat2 - lat1) * F.lit(EARTH_RADIUS_M)
    return F.sqrt(dx * dx + dy * dy)
