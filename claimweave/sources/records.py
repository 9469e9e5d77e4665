"""Fixed-width records: decoding and encoding, and text records by line.

Decoding is a projection of native expressions over one binary column, so the
scan stays splittable. Files cut by length are read by ``record_files``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.sources.layouts import Field, Layout

# Sign nibbles of a packed decimal.
_PLUS, _MINUS = "ACEF", "BD"


def _all_digits(raw: Column, n: int) -> Column:
    """Whether ``raw`` is exactly ``n`` digits.

    A cast to a whole number allows only a sign and surrounding blanks besides
    digits; the first and last character rule those out more cheaply than a
    pattern would.
    """
    if n > 18:
        return raw.rlike(f"^[0-9]{{{n}}}$")
    edges = (raw >= "0") & (raw < ":") & (F.substring(raw, n, 1) >= "0")
    return edges & raw.try_cast("bigint").isNotNull()


def _decode(field: Field, raw: Column, packed: bool) -> tuple[Column, Column]:
    """The typed value and whether the piece was malformed."""
    if field.kind == "text":
        return F.rtrim(raw), F.lit(False)

    digits, sign = field.digits, F.lit("")
    if packed and field.kind == "packed":
        # Hexadecimal: a digit per nibble, the last one being the sign.
        digits = 2 * field.width(True) - 1
        last = F.substring(raw, digits + 1, 1)
        clean = F.substring(raw, 1, digits).try_cast("bigint").isNotNull() & last.isin(*_PLUS, *_MINUS)
        if digits > 18:
            clean = raw.rlike(f"^[0-9]{{{digits}}}[{_PLUS}{_MINUS}]$")
        sign = F.when(last.isin(*_MINUS), "-").otherwise("")
    else:
        clean = _all_digits(raw, digits)

    if field.kind == "date":
        iso = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
        value = F.when(clean, iso.try_cast("date"))
        # Eight zeros mean "not set".
        return value, value.isNull() & (raw != "0" * digits)
    if field.scale:
        whole = digits - field.scale
        raw = F.concat(
            sign, F.substring(raw, 1, whole), F.lit("."), F.substring(raw, whole + 1, field.scale))
    elif packed and field.kind == "packed":
        raw = F.concat(sign, F.substring(raw, 1, digits))
    value = F.when(clean, raw.try_cast(field.type))
    return value, value.isNull()


def decode_records(df: DataFrame, column: str, layout: Layout, packed: bool,
                   bad: str | None = None) -> DataFrame:
    """Split a binary record column into the typed fields of ``layout``.

    Text is right-trimmed. Malformed numbers, dates and nibbles become NULL;
    with ``bad`` set, a column of that name lists the fields that were so.
    """
    # Bytes are cut by offset, which is far cheaper than cutting text; only text
    # fields need decoding. Cutting and parsing are separate projections, so
    # that each piece is cut once.
    pieces = []
    for field, at in layout.slots(packed):
        piece = F.substring(column, at + 1, field.width(packed))
        if field.kind == "text":
            piece = F.decode(piece, "ISO-8859-1")
        elif packed and field.kind == "packed":
            piece = F.hex(piece)
        else:
            piece = piece.cast("string")
        pieces.append(piece.alias(field.name))
    df = df.select(*pieces)
    values, flags = [], []
    for field in layout.fields:
        value, malformed = _decode(field, F.col(field.name), packed)
        values.append(value.alias(field.name))
        if field.kind != "text":
            flags.append(F.when(malformed, F.lit(field.name)))
    if bad:
        values.append(F.array_compact(F.array(*flags)).alias(bad))
    return df.select(*values)


def read_fixed(spark: SparkSession, path: str, layout: Layout, bad: str | None = None) -> DataFrame:
    """Line-sequential records with all fields in display form.

    Offsets count bytes, so the column is taken as binary before slicing.
    """
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("record"))
    return decode_records(lines, "record", layout, packed=False, bad=bad)


def encode_records(df: DataFrame, layout: Layout, packed: bool, column: str = "record") -> DataFrame:
    """The inverse of :func:`decode_records`, used to derive record inputs from tables.

    Nothing is shortened: a text longer than its field or outside Latin-1 (which encoding refuses), a number with
    more digits, and a negative number in display form (which has no sign) raise. A
    NULL number is written as blanks, which decode as malformed; a NULL date as zeros,
    which decode as not set; a NULL text as blanks.
    """
    def fitting(field, value, fits):
        raised = F.raise_error(F.concat(F.lit(f"{field.name} does not hold "), value.cast("string")))
        return F.when(value.isNull() | fits, value).otherwise(raised.cast(field.type))

    # Neighbouring display fields are encoded as one text.
    parts, run = [], []

    def close_run():
        if run:
            parts.append(F.encode(F.concat(*run), "ISO-8859-1"))
            run.clear()

    for field in layout.fields:
        value = F.col(field.name)
        if field.kind == "text":
            value = fitting(field, value, F.length(value) <= field.digits)
            run.append(F.rpad(F.coalesce(value, F.lit("")), field.digits, " "))
            continue
        if field.kind == "date":
            ymd = F.year(value) * 10000 + F.month(value) * 100 + F.day(value)
            digits = F.coalesce(ymd, F.lit(0)).cast("string")
        elif field.scale or field.kind == "packed":
            limit = F.lit(Decimal(10 ** (field.digits - field.scale)))
            fits = (F.abs(value) < limit) & (value.cast(field.type) == value)
            value = fitting(field, value, fits if packed and field.kind == "packed" else fits & (value >= 0))
            unscaled = F.abs(value.cast(field.type)) * F.lit(10 ** field.scale)
            digits = unscaled.cast("long" if field.digits <= 18 else f"decimal({field.digits},0)").cast("string")
        else:
            value = fitting(field, value, (value >= 0) & (F.length(value.cast("string")) <= field.digits))
            digits = value.cast("string")
        if packed and field.kind == "packed":
            close_run()
            sign = F.when(value < 0, "D").otherwise("C")
            nibbles = F.concat(F.lpad(digits, 2 * field.width(True) - 1, "0"), sign)
            parts.append(F.unhex(F.coalesce(nibbles, F.lit("20" * field.width(True)))))
        else:
            run.append(F.coalesce(F.lpad(digits, field.digits, "0"), F.lit(" " * field.digits)))
    close_run()
    return df.select(F.concat(*parts).alias(column))
