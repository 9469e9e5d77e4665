"""Membership: churn scores, churn summary, plan families and enrollment trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.expr import case_of, ladder, points
from claimweave.functions.pic import pct
from claimweave.operators.relational import running_total
from claimweave.operators.stats import freq

# Plan families, termination statuses and churn bounds.
FAMILIES = {
    ("MEDICARE", "MEDICARE-ADVANTAGE"): "MEDICARE",
    ("COMMERCIAL", "INDIVIDUAL", "GROUP"): "COMMERCIAL",
}
TERMED = ("TERMINATED", "SUSPENDED")
CHURN_RUNGS = [(">=", 70, "CRITICAL"), (">=", 50, "HIGH"), (">=", 30, "MEDIUM")]


# Sections and labels of the churn report.
CHURN_REPORT = (
    ("MEMBER STATISTICS", "Total Members", "total"),
    ("MEMBER STATISTICS", "Active", "active"),
    ("MEMBER STATISTICS", "Terminated", "termed"),
    ("MEMBER STATISTICS", "High Churn Risk", "high_risk"),
    ("PLAN TYPE DISTRIBUTION", "Medicare/MA", "medicare"),
    ("PLAN TYPE DISTRIBUTION", "Commercial", "commercial"),
    ("KEY METRICS", "Churn Rate", "churn_rate"),
    ("KEY METRICS", "Retention Rate", "retention_rate"),
    ("CHURN RISK FACTORS", "High Premium Threshold", "premium_threshold"),
    ("CHURN RISK FACTORS", "Low Utilization Threshold", "claims_threshold"),
    ("CHURN RISK FACTORS", "High Cost Threshold", "cost_threshold"),
)


def churn_score(premium=500, min_claims=2, cost=50000, young=30, pts=(30, 25, -20, 20)):
    return points([
        (F.col("premium_amount") > premium, pts[0]),
        (F.col("claims_last_year") < min_claims, pts[1]),
        (F.col("total_cost_last_yr") > cost, pts[2]),
        (F.col("age") < young, pts[3]),
    ])


def member_churn_scores(members: DataFrame, **rules) -> DataFrame:
    """Signed churn score and category per member; ``rules`` go to :func:`churn_score`."""
    scored = members.select("member_id", churn_score(**rules).alias("churn_score"))
    return scored.withColumn("risk_category", ladder(F.col("churn_score"), CHURN_RUNGS, "LOW"))


def plan_family():
    return case_of(F.col("plan_type"), FAMILIES)


def churn_summary(members: DataFrame, **rules) -> DataFrame:
    """Status, risk and plan counts of all members in one pass."""
    status, family = F.col("enrollment_status"), plan_family()
    totals = members.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "ACTIVE").alias("active"),
        F.count_if(status.isin(*TERMED)).alias("termed"),
        F.count_if(churn_score(**rules) >= 50).alias("high_risk"),
        F.count_if(family == "MEDICARE").alias("medicare"),
        F.count_if(family == "COMMERCIAL").alias("commercial"),
    )
    return totals.withColumns({
        "churn_rate": pct(F.col("termed"), F.col("total")),
        "retention_rate": pct(F.col("active"), F.col("total")),
    })


def with_thresholds(summary: DataFrame, premium=500, min_claims=2, cost=50000) -> DataFrame:
    """The summary row with the thresholds its report quotes."""
    return summary.withColumns({
        "premium_threshold": F.lit(premium), "claims_threshold": F.lit(min_claims), "cost_threshold": F.lit(cost)})


def plan_family_counts(members: DataFrame) -> DataFrame:
    return freq(members.select(plan_family().alias("plan_family")), "plan_family", "members")


def enrollment_trends(members: DataFrame, *, status="ACTIVE") -> DataFrame:
    """New and cumulative enrollments per plan and month."""
    dated = members.filter(F.col("enrollment_status") == status).select(
        F.year("enrollment_date").alias("enrollment_year"),
        F.month("enrollment_date").alias("enrollment_month"),
        "plan_id", "member_id",
    )
    return running_total(
        dated, "plan_id", ("enrollment_year", "enrollment_month"),
        F.count("member_id"), "new_enrollments", "cumulative_enrollments",
    ).orderBy("enrollment_year", "enrollment_month", "plan_id")
