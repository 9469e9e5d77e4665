"""Screening measures: file-form counts, member-based rates and age-group compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.expr import all_of, in_code_set
from claimweave.functions.pic import count, pct
from claimweave.operators.stats import distinct_members, freq2

# Qualifying procedure codes and eligibility.
CODES = ("77065", "77066", "77067")
BANDS = (("age_50_59", 50, 59), ("age_60_69", 60, 69), ("age_70_74", 70, 74))


# Sections and labels of the screening report.
SCREENING_REPORT = (
    ("", "DENOMINATOR (ELIGIBLE WOMEN)", "denominator"),
    ("", "NUMERATOR (HAD MAMMOGRAM)", "numerator"),
    ("", "COMPLIANCE RATE", "compliance_rate"),
    ("AGE GROUP BREAKDOWN", "50-59", "age_50_59"),
    ("AGE GROUP BREAKDOWN", "60-69", "age_60_69"),
    ("AGE GROUP BREAKDOWN", "70-74", "age_70_74"),
)


def eligible(sex: str, age: tuple[int, int], status: str, months: int):
    return all_of(
        F.col("gender") == sex,
        F.col("age").between(*age),
        F.col("enrollment_status") == status,
        F.col("enrollment_months") == months,
    )


def screening_summary(members: DataFrame, claims: DataFrame, *, codes=CODES, sex="F", age=(50, 74),
                      status="ACTIVE", months=12, bands=BANDS) -> DataFrame:
    """Eligible members against qualifying claims of anybody; the rate may pass 100.

    Both inputs are filtered, narrowed and stacked, so one aggregation gives
    the row without a join.
    """
    people = members.filter(eligible(sex, age, status, months)).select(
        F.lit(1).alias("den"), F.lit(0).alias("num"), "age")
    hits = claims.filter(in_code_set(F.col("procedure_code"), codes)).select(
        F.lit(0).alias("den"), F.lit(1).alias("num"), F.lit(None).cast("int").alias("age"))
    totals = people.unionByName(hits).agg(
        count(F.sum("den")).alias("denominator"),
        count(F.sum("num")).alias("numerator"),
        *[F.count_if(F.col("age").between(lo, hi)).alias(name) for name, lo, hi in bands],
    )
    return totals.select(
        "denominator", "numerator",
        pct(F.col("numerator"), F.col("denominator"), empty=F.lit(0.0)).alias("compliance_rate"),
        *[name for name, _, _ in bands],
    )


def screening_member_rate(members: DataFrame, claims: DataFrame, *, codes=CODES, sex="F", age=(50, 74),
                          status="ACTIVE", months=12) -> DataFrame:
    """Distinct eligible members, and those with a qualifying claim.

    Claims are reduced to distinct members before they are joined.
    """
    people = members.filter(eligible(sex, age, status, months)).select("member_id").distinct()
    hits = claims.filter(in_code_set(F.col("procedure_code"), codes)).select("member_id").distinct()
    flagged = people.join(hits.withColumn("hit", F.lit(1)), "member_id", "left")
    totals = flagged.agg(F.count("member_id").alias("denominator"), F.count("hit").alias("numerator"))
    return totals.withColumn(
        "compliance_rate", pct(F.col("numerator"), F.col("denominator"), empty=F.lit(0.0))
    )


def measure_by_age_group(measures: DataFrame, *, measure="BCS", age=(50, 74), year=2023) -> DataFrame:
    kept = measures.filter(all_of(
        F.col("measure_id") == measure,
        F.col("age").between(*age),
        F.col("measure_year") == year,
        F.col("exclusion") == 0,
    ))
    totals = kept.groupBy("age_group").agg(
        F.sum("denominator").alias("denominator"), F.sum("numerator").alias("numerator"))
    return totals.withColumn(
        "compliance_pct", pct(F.col("numerator"), F.col("denominator"), store="round")
    ).orderBy("age_group")


def measure_distinct_members(measures: DataFrame, *, measure="BCS") -> DataFrame:
    kept = measures.filter(F.col("measure_id") == measure)
    return distinct_members(kept, "age_group", "member_id", F.col("numerator") == 1).orderBy("age_group")


def measure_crosstab(measures: DataFrame, *, measure="BCS") -> DataFrame:
    kept = measures.filter(F.col("measure_id") == measure)
    return freq2(kept.withColumn("compliant", F.col("numerator")), "age_group", "compliant")
