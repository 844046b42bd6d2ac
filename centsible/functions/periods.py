"""Calendar periods. The session time zone is UTC, so dates are UTC dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from centsible.schemas import DAILY, MONTHLY, WEEKLY

_TRUNC_UNIT = {WEEKLY: "week", MONTHLY: "month"}  # weeks start on Monday


def period_start(day: Column, period_type: str) -> Column:
    """First day of the period a date falls into."""
    if period_type == DAILY:
        return day
    return F.trunc(day, _TRUNC_UNIT[period_type])


def bucket_ordinal(day: Column, window_start: date, period_type: str) -> Column:
    """Position of a bucket counted from the bucket that holds ``window_start``."""
    first = period_start(F.lit(window_start), period_type)
    if period_type == MONTHLY:
        return (F.months_between(day, first)).cast("int")
    days = F.datediff(day, first)
    return days if period_type == DAILY else (days / 7).cast("int")


def previous_window(start: date, end: date) -> tuple[date, date]:
    """The window of equal length that ends the day before ``start``."""
    length = (end - start).days + 1
    return start - timedelta(days=length), start - timedelta(days=1)
