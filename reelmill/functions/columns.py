"""Small column expressions used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up decimal rounding as ``floor(x * 10^d + 0.5) / 10^d``.

    Values that are later ordered on must round alike in every engine; ``round`` and ``bround``
    differ between engines on binary halves, this form does not.
    """
    scale = float(10**digits)
    return F.floor(value * scale + F.lit(0.5)) / F.lit(scale)


def clamp(value: Column, low: float, high: float) -> Column:
    """The value within bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def nonzero(value: Column) -> Column:
    """The value, with 0 read as missing (``x or y`` on numbers)."""
    return F.when(value != 0, value)


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds: sums of these are exact in any order."""
    return F.floor(seconds * F.lit(1000.0) + F.lit(0.5)).cast("long")


def units(value: Column, digits: int = 8) -> Column:
    """The value in whole units of 10^-digits, half-up: sums of these don't depend on the order of addition."""
    return F.floor(value * F.lit(float(10**digits)) + F.lit(0.5)).cast("long")


def sum_units(value: Column, digits: int = 8) -> Column:
    """Aggregate: the sum of units. High and low bits are added up as longs, which stay far from their bounds."""
    whole = units(value, digits)
    high, low = F.sum(F.shiftright(whole, 20)), F.sum(whole.bitwiseAND(F.lit((1 << 20) - 1)))
    return (high.cast("decimal(19,0)") * F.lit(1 << 20) + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def mean_of_units(total: Column, count: Column, digits: int, unit_digits: int = 8) -> Column:
    """``total / count`` of units, rounded half-up to ``digits`` decimals on integers; null without rows."""
    step = F.nullif(count, F.lit(0)).cast("decimal(20,0)") * F.lit(10 ** (unit_digits - digits))
    whole = total * 2 + step
    return F.call_function("div", whole - F.pmod(whole, step * 2), step * 2) / F.lit(float(10**digits))


def exact_mean(value: Column, digits: int = 8, unit_digits: int = 8) -> Column:
    """Aggregate: the mean as :func:`mean_of_units`, the same however the rows arrive."""
    return mean_of_units(sum_units(value, unit_digits), F.count(value), digits, unit_digits)


def event_time() -> Column:
    """The ``timestamp`` column (epoch seconds) as a timestamp."""
    return F.timestamp_micros((F.col("timestamp") * F.lit(1e6)).cast("long"))


def suffix_of(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_of(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")
