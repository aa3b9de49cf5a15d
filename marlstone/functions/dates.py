"""Dates and clocks. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start: Column, end: Column) -> Column:
    """Whole days, never below 0; null without a start."""
    return F.when(start.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)))


def hour_in(zone: str, at: Column) -> Column:
    return F.hour(F.from_utc_timestamp(at, zone))


def inside_window(zone: str, first: int, last: int, at: Column) -> Column:
    """Whether the hour lies in [first, last), which may wrap midnight."""
    hour = hour_in(zone, at)
    return (hour >= first) & (hour < last) if first <= last else (hour >= first) | (hour < last)


def stamp_in(zone: str, at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm:ss")


def month_bounds(at: Column) -> tuple[Column, Column]:
    """(first day, first day of the next month)."""
    first = F.date_trunc("month", at)
    return first, F.date_trunc("month", F.add_months(first, 1))


def period_start(at: Column, anchor_day: int) -> Column:
    """The last anchor day (1 to 28) that is not after the date."""
    if not 1 <= anchor_day <= 28:
        raise ValueError("the anchor day must be 1 to 28")
    month = F.trunc(F.when(F.dayofmonth(at) >= anchor_day, F.to_date(at)).otherwise(F.add_months(F.to_date(at), -1)), "month")
    return F.date_add(month, anchor_day - 1)


def age_label(minutes: Column) -> Column:
    """Minutes, or hours from two hours on."""
    whole = lambda x: F.floor(x + 0.5).cast("string")
    return F.when(minutes >= 120, F.concat(whole(minutes / 60), F.lit(" h"))).otherwise(F.concat(whole(minutes), F.lit(" min")))


def day_slice(items: Column, per_day: int, at: Column) -> Column:
    """The day's share of a list that is walked round, ``per_day`` at a time."""
    n = F.size(items)
    first = F.pmod((F.dayofyear(at) - 1) * per_day, n)
    return F.when(n <= per_day, items).otherwise(F.slice(F.concat(items, items), first + 1, per_day))
