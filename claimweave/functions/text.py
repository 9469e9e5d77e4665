"""Text helpers that count, strip and format whole texts in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex flags: (?d) only \n ends a line, (?U) Unicode classes and case.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The first non-blank of a line, then the rest of that line: one hit per
# non-empty line, in linear time.
_NON_EMPTY_LINE = r"(?U)[^\s\x1c-\x1f][^\n]*"


def strip(text: Column) -> Column:
    """Remove surrounding white space of any kind; linear, whatever blanks lie inside."""
    return F.btrim(text, F.lit(_BLANKS))


def line_count(text: Column) -> Column:
    """Pieces between line feeds; the empty text has one line."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def non_empty_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_NON_EMPTY_LINE)).cast("long")


def head_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines, with a note of how many were left out."""
    shown = F.substring_index(text, "\n", n)
    left = (line_count(text) - n).cast("string")
    note = F.concat(shown, F.lit("\n\n... ("), left, F.lit(" more lines)"))
    return F.when(line_count(text) <= n, text).otherwise(note)


def file_size(size: Column) -> Column:
    """``1536`` -> ``1.5 KB``: one decimal, ties to even, in integer arithmetic."""
    size = size.cast("long")

    def scaled(unit: int, suffix: str) -> Column:
        whole = F.call_function("div", size * 10, F.lit(unit))
        rest = (size * 10) % unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
        tenths = whole + F.when(up, 1).otherwise(0)
        return F.concat(
            F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."),
            (tenths % 10).cast("string"), F.lit(suffix),
        )

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, scaled(1024, " KB"))
        .otherwise(scaled(1024 * 1024, " MB"))
    )
