"""Column builders for classification ladders, point scores and code sets."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "==": operator.eq,
}


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def all_of(*rules: Column) -> Column:
    """Conjunction of eligibility rules."""
    return reduce(operator.and_, rules)


def ladder(col: Column, rungs: Sequence[tuple[str, object, object]], default=None) -> Column:
    """First matching rung wins: ``[(op, bound, label), ...]`` else ``default``."""
    out = None
    for op, bound, label in rungs:
        test = _OPS[op](col, F.lit(bound))
        out = F.when(test, _value(label)) if out is None else out.when(test, _value(label))
    return out.otherwise(_value(default))


def case_of(col: Column, mapping: Mapping[Iterable[str] | str, object], default=None) -> Column:
    """Value by code; a key is one code or a tuple of codes sharing a value."""
    out = None
    for codes, value in mapping.items():
        codes = (codes,) if isinstance(codes, str) else tuple(codes)
        test = in_code_set(col, codes)
        out = F.when(test, _value(value)) if out is None else out.when(test, _value(value))
    return out.otherwise(_value(default))


def in_code_set(col: Column, codes: Iterable[str]) -> Column:
    return col.isin(*codes)


def points(rules: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the points whose rule holds; points may be negative."""
    return reduce(operator.add, (F.when(rule, F.lit(p)).otherwise(F.lit(0)) for rule, p in rules))


def band_factor(gender: Column, age: Column, table: Mapping[str | None, Sequence[tuple[int, object]]],
                default: Mapping[str | None, object]) -> Column:
    """Factor by gender and descending minimum age.

    ``table[g]`` lists ``(minimum age, factor)`` from old to young and
    ``default[g]`` holds the factor below all of them; the key ``None`` covers
    every other gender.
    """
    def branch(g):
        return ladder(age, [(">=", low, F.lit(f)) for low, f in table[g]], F.lit(default[g]))

    out = None
    for g in table:
        if g is not None:
            out = F.when(gender == g, branch(g)) if out is None else out.when(gender == g, branch(g))
    rest = branch(None)
    return rest if out is None else out.otherwise(rest)


def present(col: Column) -> Column:
    """Neither NULL nor blank."""
    return col.isNotNull() & (F.rtrim(col) != "")


def sum_if(rule: Column, col: Column) -> Column:
    """Sum of ``col`` where ``rule`` holds, zero when none does."""
    return F.coalesce(F.sum(F.when(rule, col)), F.lit(0))


def unpadded_equals(a: Column, b: Column) -> Column:
    """Equality of blank-padded text."""
    return F.rtrim(a) == F.rtrim(b)
