"""Class statistics and frequencies."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def means(df: DataFrame, by: str | Sequence[str], value: str, digits: int | None = 6) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum per class."""
    by = [by] if isinstance(by, str) else list(by)
    x = F.col(value).cast("double")

    def rounded(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return df.groupBy(*by).agg(
        rounded(F.avg(x)).alias("avg"),
        rounded(F.stddev_samp(x)).alias("stddev"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def exact_moments(df: DataFrame, by: str | Sequence[str], value: str, scale: int = 2) -> DataFrame:
    """Count, mean, sample variance and deviation, minimum and maximum per class, the same to
    the last bit however the rows are dealt.

    Values are counted in units of ``scale`` decimal places (rounded there if they have
    more); NULL values do not count, and a class of under two has no variance. Sums
    of the units and of their squares are whole numbers of up to 38 digits; what does not
    fit raises. With the sum ``S = n q + r`` the squares about the mean are
    ``Q - q (S + r) - r r / n``, so that no term grows beyond the sum of squares ``Q``; only
    the end result becomes a double.
    """
    by = [by] if isinstance(by, str) else list(by)
    unit = 10 ** scale
    x = F.col(value).cast(f"decimal(18,{scale})")
    units = (x * F.lit(unit)).cast("decimal(18,0)")
    sums = df.groupBy(*by).agg(F.count(x).alias("_n"), F.sum(units).alias("_s"), F.sum(units * units).alias("_q"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    some = sums.withColumn("_d", F.nullif("_n", F.lit(0).cast("long")))  # NULL where nothing is to divide by
    parts = some.withColumns({"_m": F.expr("_s div _d"), "_r": (F.col("_s") % F.col("_d")).cast("decimal(18,0)")})
    rest = parts.withColumns({"_rr": F.col("_r") * F.col("_r"), "_a": F.col("_q") - F.col("_m") * (F.col("_s") + F.col("_r"))})
    square = (F.col("_a") - F.expr("_rr div _d")).cast("double") - (F.col("_rr") % F.col("_d")).cast("double") / F.col("_d").cast("double")
    variance = F.when(F.col("_n") > 1, square / ((F.col("_n") - 1).cast("double") * F.lit(float(unit * unit))))
    return rest.select(
        *by, F.col("_n").alias("n"), (F.col("_s").cast("double") / (F.col("_d").cast("double") * F.lit(float(unit)))).alias("avg"),
        variance.alias("variance"), F.sqrt(variance).alias("stddev"), F.col("_lo").cast("double").alias("min"), F.col("_hi").cast("double").alias("max"))


def freq(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """One-way frequency."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def freq2(df: DataFrame, a: str, b: str, name: str = "n", values: Sequence | None = None) -> DataFrame:
    """Two-way frequency: long form, or wide over the given ``values`` of ``b``."""
    if values is None:
        return df.groupBy(a, b).agg(F.count(F.lit(1)).alias(name))
    cells = [F.count_if(F.col(b) == F.lit(v)).alias(f"{name}_{v}") for v in values]
    return df.groupBy(a).agg(*cells)


def band_counts(df: DataFrame, bands: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Independent counters, all in one pass."""
    return df.groupBy(*by).agg(*[F.count_if(rule).alias(name) for name, rule in bands.items()])


def distinct_members(df: DataFrame, by: str, key: str, rule: Column) -> DataFrame:
    """Distinct keys per class, and distinct keys with a row satisfying ``rule``.

    Reducing to one row per class and key first needs one shuffle of combined
    rows, where two distinct counts would expand every row twice.
    """
    once = df.groupBy(by, key).agg(F.max(F.when(rule, 1).otherwise(0)).alias("_hit"))
    return once.groupBy(by).agg(
        F.count(key).alias("denominator"),
        F.count_if((F.col("_hit") == 1) & F.col(key).isNotNull()).alias("numerator"),
    )


def percentiles(df: DataFrame, by: str, value: str, points: Sequence[float | str],
                accuracy: int = 10000) -> DataFrame:
    """Exact percentiles, as of ``exact_percentiles``, and the variance per class."""
    variance = F.round(F.var_samp(F.col(value).cast("double")), 6).alias("variance")
    return exact_percentiles(df, by, value, points, accuracy, [variance])


def exact_percentiles(df: DataFrame, by: str, value: str, points: Sequence[float | str], accuracy: int = 10000, more: Sequence[Column] = ()) -> DataFrame:
    """Percentiles ``p25`` and so on per class: the smallest value with at least that share of the
    class's values at or below it. NULL values do not count; a class without values has NULLs.

    A sketch brackets every point: its ranks are off by one in ``accuracy`` at most, so the
    values four such steps to both sides hold the point between them. A second pass counts
    the rows below each bracket and the values inside, combined on the map side, and picks
    the value at the exact rank. Only the distinct values inside a bracket, about
    eight in ``accuracy`` of a class, are ever sorted together, whatever shares a class.
    ``more`` are further aggregates of a class, named, which follow the percentiles.
    """
    points = [Decimal(str(p)) for p in points]
    margin = Decimal(4) / accuracy
    ends = [min(max(p + side, Decimal(0)), Decimal(1)) for p in points for side in (-margin, margin)]
    x = F.col(value)
    sketch = df.groupBy(F.col(by).alias("_k")).agg(F.percentile_approx(x, F.array(*[F.lit(float(e)) for e in ends]), F.lit(accuracy)).alias("_b"), F.count(x).alias("_n"))
    brackets = sketch.select("_k", F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.col("_b")[2 * i].alias("lo"), F.col("_b")[2 * i + 1].alias("hi"),
            F.greatest(F.lit(1), F.ceil(F.col("_n").cast("decimal(20,0)") * F.lit(p))).cast("long").alias("rank"))
        for i, p in enumerate(points)
    ]).alias("_points"))
    rows = df.where(x.isNotNull()).select(F.col(by).alias("_g"), x.alias("_x")).join(brackets, F.col("_g").eqNullSafe(F.col("_k")))
    rows = rows.select("_k", "_x", F.explode("_points").alias("_p")).where(F.col("_x") <= F.col("_p.hi"))
    below = F.when(F.col("_x") >= F.col("_p.lo"), F.col("_x"))  # NULL: below the bracket
    counted = rows.groupBy("_k", F.col("_p.i").alias("_i"), F.col("_p.rank").alias("_rank"), below.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy("_k", "_i").orderBy(F.col("_v").asc_nulls_first()))
    found = counted.withColumn("_to", up_to).where((F.col("_to") >= F.col("_rank")) & F.col("_v").isNotNull())
    # A rank below the bracket would be a broken promise of the sketch, not a result.
    safe = F.when(F.col("_to") - F.col("_c") >= F.col("_rank"), None).otherwise(F.col("_v"))
    found = found.groupBy("_k").agg(*[F.min(F.when(F.col("_i") == i, safe)).alias(f"_{i}") for i in range(len(points))])
    found = found.withColumnRenamed("_k", "_f")
    # One struct, so that no name of the caller's can clash.
    extra = F.struct(*more) if more else F.lit(None)
    classes = df.groupBy(F.col(by).alias("_k")).agg(extra.alias("_more"))
    joined = classes.join(found, F.col("_k").eqNullSafe(F.col("_f")), "left")
    return joined.select(F.col("_k").alias(by), *[F.col(f"_{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(points)], *(["_more.*"] if more else []))
