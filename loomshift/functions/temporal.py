"""Temporal values as the load rounds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to_scale(value: Column, scale: int) -> Column:
    """Half up to 10^-scale seconds; truncated where rounding would pass the last instant of year 9999."""
    unit = 10 ** (6 - min(6, scale))
    micros = F.unix_micros(value.cast("timestamp"))
    rounded = F.floor((micros + unit // 2) / unit).cast("long") if unit == 1 else ((micros + F.lit(unit // 2)) - F.pmod(micros + F.lit(unit // 2), F.lit(unit)))
    last = 253402300800 * 1_000_000
    return F.timestamp_micros(F.when(rounded >= last, micros - F.pmod(micros, F.lit(unit))).otherwise(rounded))


def to_minute(value: Column) -> Column:
    """The fraction of a second goes first; from thirty seconds on the minute rises."""
    return F.date_trunc("minute", F.date_trunc("second", value) + F.expr("interval 30 seconds"))


def from_ticks(day: Column, ticks: Column) -> Column:
    """An instant from a day and its 1/300 s ticks, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.floor(ticks.cast("long") * 10000 / 3).cast("long"))
