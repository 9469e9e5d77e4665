"""Exact report arithmetic: percentages, averages and fixed-picture stores.

Sums arrive as decimals or longs and are divided as integers, so a result never
depends on partition order or on floating-point rounding. Values become double
only once they have their final two decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for cents of 10^15 rows of nine-digit amounts, with room for the
# factor of 20000 used when rounding.
WIDE = "decimal(30,2)"


def _div(num: Column, den: Column) -> Column:
    return F.call_function("div", num, den)


def safe_divide(num: Column, den: Column) -> Column:
    """``num / den``, NULL unless the divisor is positive."""
    return F.when(den > 0, num / den)


def pct(num: Column, den: Column, store: str = "truncate", empty: Column | None = None) -> Column:
    """``num`` as a percentage of ``den`` with two decimals, as double.

    ``store='truncate'`` drops further digits, ``'round'`` rounds half up. The
    result is ``empty`` (NULL by default) unless ``den`` is positive. Both
    inputs must be non-negative for rounding.
    """
    n, d = num.cast(WIDE), den.cast(WIDE)
    if store == "truncate":
        cents = _div(n * 10000, d)
    elif store == "round":
        cents = _div(n * 20000 + d, d * 2)
    else:
        raise ValueError(f"store must be 'truncate' or 'round', not {store!r}")
    value = F.when(d > 0, cents.cast("double") / 100)
    return value if empty is None else F.coalesce(value, empty)


def safe_avg(total: Column, n: Column, scale: int = 2, store: str = "truncate") -> Column:
    """``total / n`` with ``scale`` decimals, as double; NULL when ``n`` is not positive.

    Cut toward zero, or with ``store='round'`` rounded half away from zero.
    """
    unit = 10 ** scale
    t, d = total.cast(WIDE), n.cast(WIDE)
    if store == "round":
        steps = _div(t * (2 * unit) + F.when(t < 0, -d).otherwise(d), d * 2)
    elif store == "truncate":
        steps = _div(t * unit, d)
    else:
        raise ValueError(f"store must be 'truncate' or 'round', not {store!r}")
    return F.when(n > 0, steps.cast("double") / unit)


def store(value: Column, scale: int = 2) -> Column:
    """Cut a decimal to ``scale`` digits, toward zero."""
    digits = F.lit(scale)
    return F.when(value < 0, -F.floor(-value, digits)).otherwise(F.floor(value, digits))


def money(column: Column) -> Column:
    """A decimal total as it leaves a report: double."""
    return column.cast("double")


def count(column: Column) -> Column:
    """A count as it leaves a report: long, zero on empty input."""
    return F.coalesce(column, F.lit(0)).cast("long")
