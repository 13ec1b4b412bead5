"""Time expressions on epoch microseconds. They never depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logvigil.config import HOUR, MINUTE

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ntz: str) -> Column:
    """Epoch microseconds of a timestamp_ntz column that holds UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {ntz})")


def utc(us: str) -> Column:
    """UTC timestamp_ntz of an epoch-microsecond column."""
    return F.expr(f"timestampadd(MICROSECOND, {us}, {EPOCH_NTZ})")


def cell_of(us: str, width: int) -> str:
    """SQL for the index of the time cell holding an instant; floors before 1970 too."""
    return f"(({us}) - pmod({us}, {width}L)) div {width}L"


def floor_div(us: Column, width: int) -> Column:
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("bigint")


def hour_of_day(us: Column) -> Column:
    return floor_div(F.pmod(us, F.lit(24 * HOUR)), HOUR)


def clock(us: Column) -> Column:
    """HH:MM in UTC."""
    minute_of_hour = floor_div(F.pmod(us, F.lit(HOUR)), MINUTE)
    return F.format_string("%02d:%02d", hour_of_day(us), minute_of_hour)


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes between two instants, half-even, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround((end - start) / F.lit(float(MINUTE))).cast("bigint"))


def iso(us: Column) -> Column:
    """ISO-8601 with a trailing Z; a fraction only where there is one."""
    day_seconds = floor_div(us, 1_000_000)
    fraction = F.pmod(us, F.lit(1_000_000))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), floor_div(us, 24 * HOUR).cast("int")), "yyyy-MM-dd")

    def padded(number: Column, digits: int) -> Column:
        return F.lpad(number.cast("string"), digits, "0")

    return F.concat(
        date, F.lit("T"), padded(hour_of_day(us), 2), F.lit(":"), padded(floor_div(F.pmod(us, F.lit(HOUR)), MINUTE), 2), F.lit(":"),
        padded(F.pmod(day_seconds, F.lit(60)), 2), F.when(fraction > 0, F.concat(F.lit("."), padded(fraction, 6))).otherwise(F.lit("")), F.lit("Z"))
