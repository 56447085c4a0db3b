"""Times of day and lengths of stay, kept as BIGINT microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE


def whole_hours(us: Column) -> Column:
    """The hour part of a time of day or of a non-negative length."""
    return ((us - us % MICROS_PER_HOUR) / F.lit(float(MICROS_PER_HOUR))).cast("bigint")


def minutes_past_hour(us: Column) -> Column:
    rest = us % MICROS_PER_HOUR
    return ((rest - rest % MICROS_PER_MINUTE) / F.lit(float(MICROS_PER_MINUTE))).cast("bigint")


def hours(us: Column) -> Column:
    """Length in hours as DOUBLE; divide once, after any summing."""
    return us / F.lit(float(MICROS_PER_HOUR))


def total_length(us: Column) -> Column:
    """Sum of lengths as a decimal. The sums run on whole numbers, split at the second so
    that no number of rows makes them overflow."""
    rest = us % MICROS_PER_SECOND
    seconds = ((us - rest) / F.lit(float(MICROS_PER_SECOND))).cast("bigint")
    micros = F.lit(MICROS_PER_SECOND).cast("decimal(7,0)")
    return F.sum(seconds).cast("decimal(20,0)") * micros + F.sum(rest)


def stay_text(us: Column) -> Column:
    """A length such as ``1h 05min``."""
    minutes = F.lpad(minutes_past_hour(us).cast("string"), 2, "0")
    return F.concat(whole_hours(us).cast("string"), F.lit("h "), minutes, F.lit("min"))


def clock_text(us: Column) -> Column:
    """A time of day such as ``09:30``."""
    return F.concat_ws(
        ":",
        F.lpad(whole_hours(us).cast("string"), 2, "0"),
        F.lpad(minutes_past_hour(us).cast("string"), 2, "0"),
    )
