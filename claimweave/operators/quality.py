"""Data-quality checks: every row rule of a table in one scan.

A check result is a row ``(check, column, violations)``; rules are counted by
one aggregation, key checks by one grouping each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimweave.functions.dates import as_of_day
from claimweave.operators.relational import orphans
from claimweave.sources.tables import shared_folder, swap_table


@dataclass(frozen=True)
class Check:
    """``broken`` holds for a violating row; NULL does not count."""

    name: str
    column: str
    broken: Column


def not_null(column: str) -> Check:
    return Check("not_null", column, F.col(column).isNull())


def non_negative(column: str) -> Check:
    return Check("non_negative", column, F.col(column) < 0)


def at_most(column: str, limit) -> Check:
    return Check("at_most", column, F.col(column) > F.lit(limit))


def not_above(column: str, other: str) -> Check:
    """For a numerator against its denominator, or a start against its end."""
    return Check(f"not_above_{other}", column, F.col(column) > F.col(other))


def within(column: str, low, high) -> Check:
    return Check("within", column, ~F.col(column).between(low, high))


def absent_when(column: str, rule: Column, label: str) -> Check:
    """``column`` must be NULL where ``rule`` holds."""
    return Check(f"absent_when_{label}", column, rule & F.col(column).isNotNull())


def not_future(column: str, as_of=None) -> Check:
    return Check("not_future", column, F.col(column) > as_of_day(as_of))


def not_older(column: str, months: int = 60, as_of=None) -> Check:
    return Check("not_older", column, F.col(column) < F.add_months(as_of_day(as_of), -months))


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All row checks in one pass over ``df``."""
    counted = df.agg(*[F.count_if(c.broken).alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(c.name).alias("check"), F.lit(c.column).alias("column"),
            F.col(f"c{i}").alias("violations"),
        )
        for i, c in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*rows)))


def _result(name: str, column: str, violations: Column) -> list[Column]:
    return [F.lit(name).alias("check"), F.lit(column).alias("column"), violations.alias("violations")]


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """The number of keys with more than one row."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.count_if(F.col("_n") > 1).alias("_v")).select(
        *_result("unique", key, F.col("_v")))


def missing_parents(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """The number of child rows whose key has no parent."""
    lost = orphans(child, parent, key, parent_key)
    return lost.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("_v")).select(
        *_result("has_parent", key, F.col("_v")))


def all_checks(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count of every column that has any."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows))).filter("nulls > 0")


def summary(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Minimum, maximum, mean and deviation of each column, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [
            F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.round(F.avg(x), digits).alias(f"avg{i}"),
            F.round(F.stddev_samp(x), digits).alias(f"sd{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.col(f"avg{i}").alias("avg"), F.col(f"sd{i}").alias("stddev"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def reconcile(source: DataFrame, result: DataFrame, amounts: Mapping[str, tuple[str, str]],
              tol: float = 0.01) -> DataFrame:
    """Row counts and amount totals on both sides, with their difference.

    ``amounts`` maps a label to the (source, result) column pair. Both sides
    are reduced to one row each and stacked.
    """
    def side(df: DataFrame, which: int) -> DataFrame:
        sums = [F.sum(pair[which]).cast("decimal(38,4)").alias(f"a{i}")
                for i, pair in enumerate(amounts.values())]
        return df.agg(F.count(F.lit(1)).cast("decimal(38,4)").alias("rows"), *sums).withColumn(
            "_side", F.lit(which))

    both = side(source, 0).unionByName(side(result, 1))
    columns = {"row_count": "rows", **{label: f"a{i}" for i, label in enumerate(amounts)}}
    wide = both.agg(*[
        F.sum(F.when(F.col("_side") == which, F.coalesce(F.col(c), F.lit(0)))).alias(f"{c}_{which}")
        for c in columns.values() for which in (0, 1)
    ])
    rows = []
    for label, c in columns.items():
        gap = F.abs(F.col(f"{c}_0") - F.col(f"{c}_1"))
        limit = F.lit(0) if label == "row_count" else F.lit(str(tol)).cast("decimal(10,4)")
        matched = gap <= limit if label == "row_count" else gap < limit
        rows.append(F.struct(
            F.lit(label).alias("measure"),
            F.col(f"{c}_0").cast("double").alias("source_total"),
            F.col(f"{c}_1").cast("double").alias("result_total"),
            gap.cast("double").alias("difference"),
            matched.alias("matched"),
        ))
    return wide.select(F.inline(F.array(*rows)))


def reconcile_by(source: DataFrame, result: DataFrame, keys: Sequence[str], amounts: Mapping[str, tuple[str, str]],
                 tol: float = 0.01) -> DataFrame:
    """The keys on which two tables disagree: one row a key with both row counts and totals.

    A key is listed if its rows differ in number or a total by ``tol`` or more; a key that
    one side lacks has 0 rows there, NULL keys are a key like others and NULL amounts
    count as 0. Both sides are reduced to their keys before they meet, so a hot key
    is one row a task.
    """
    labels = {label: f"a{i}" for i, label in enumerate(amounts)}

    def side(df: DataFrame, which: int) -> DataFrame:
        named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
        sums = [F.coalesce(F.sum(pair[which]), F.lit(0)).cast("decimal(38,4)").alias(f"a{i}") for i, pair in enumerate(amounts.values())]
        return df.groupBy(*named).agg(F.count(F.lit(1)).alias("rows"), *sums).withColumn("_side", F.lit(which))

    both = side(source, 0).unionByName(side(result, 1))
    wide = both.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(*[
        F.coalesce(F.sum(F.when(F.col("_side") == which, F.col(c))), F.lit(0)).alias(f"{c}_{which}")
        for c in ("rows", *labels.values()) for which in (0, 1)
    ])
    differ = F.col("rows_0") != F.col("rows_1")
    for c in labels.values():
        differ |= F.abs(F.col(f"{c}_0") - F.col(f"{c}_1")) >= F.lit(str(tol)).cast("decimal(10,4)")
    return wide.where(differ).select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("rows_0").alias("source_rows"), F.col("rows_1").alias("result_rows"),
        *[F.col(f"{c}_{which}").cast("double").alias(f"{name}_{label}") for label, c in labels.items() for which, name in ((0, "source"), (1, "result"))])


class QualityError(ValueError):
    """A critical check failed."""


def enforce(results: DataFrame, critical: Sequence[str] | None = None) -> None:
    """Raise when a critical check has violations or a total does not match.

    Reads one row per check, however large the checked table is.
    """
    if "violations" in results.columns:
        failed = results.filter("violations > 0").select(F.col("check").alias("name"), "column", "violations")
    else:
        failed = results.filter("not matched").select(
            F.col("measure").alias("name"), F.lit("").alias("column"), F.col("difference").alias("violations"))
    if critical is not None:
        failed = failed.filter(F.col("name").isin(*critical))
    rows = failed.collect()
    if rows:
        raise QualityError("; ".join(f"{r.name} {r.column}: {r.violations}".replace(" :", ":") for r in rows))


def load_checked(df: DataFrame, name: str, critical: Mapping[str, Column], totals: Mapping[str, Column] | None = None) -> dict[str, object]:
    """Replaces a table's rows unless a check fails: violations are counted by the write itself.

    ``critical`` maps a check to the rule that marks a violating row (NULL counts as none),
    ``totals`` a name to any further aggregate. The rows go to a new folder in one scan;
    only without violations does the table point there. Otherwise ``QualityError`` is
    raised and readers keep the old rows. Returns the counts and totals, with ``rows``.
    """
    spark, seen = df.sparkSession, Observation()
    marks = [F.count_if(rule).alias(check) for check, rule in critical.items()]
    path = shared_folder(spark)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *marks, *[total.alias(c) for c, total in (totals or {}).items()]).write.parquet(path)
    found = seen.get
    failed = [f"{check}: {found[check]}" for check in critical if found[check]]
    if failed:
        raise QualityError("; ".join(failed))
    swap_table(spark, name, path)
    return found
