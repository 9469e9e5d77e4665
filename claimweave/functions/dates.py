"""Date predicates and arithmetic over DATE columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: str | dt.date | Column) -> Column:
    """A date literal from an ISO string or date; columns pass through."""
    if isinstance(value, Column):
        return value
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def as_of_day(as_of: str | dt.date | Column | None) -> Column:
    """The run date: explicit, or today."""
    return F.current_date() if as_of is None else day(as_of)


def to_day(text: Column, fmt: str = "yyyyMMdd") -> Column:
    """Text to DATE; malformed and all-zero text becomes NULL."""
    return F.try_to_date(text, fmt)


def since(col: Column, start) -> Column:
    return col >= day(start)


def in_period(col: Column, start, end) -> Column:
    """Inclusive period filter."""
    return col.between(day(start), day(end))


def months_after(col: Column, n: int) -> Column:
    return F.add_months(col, n)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)
