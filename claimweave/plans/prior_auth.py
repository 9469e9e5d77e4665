"""Prior authorisation: turnaround per request and the summary row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.dates import as_of_day, days_between
from claimweave.functions.expr import ladder
from claimweave.functions.pic import pct, safe_avg


# Sections and labels of the turnaround report.
TURNAROUND_REPORT = (
    ("REQUEST VOLUME", "Total Requests", "total_requests"),
    ("REQUEST VOLUME", "Approved", "approved"),
    ("REQUEST VOLUME", "Denied", "denied"),
    ("REQUEST VOLUME", "Pending", "pending"),
    ("TURNAROUND TIME DISTRIBUTION", "Fast (0-3 days)", "fast"),
    ("TURNAROUND TIME DISTRIBUTION", "Standard (4-7 days)", "standard"),
    ("TURNAROUND TIME DISTRIBUTION", "Slow (8-14 days)", "slow"),
    ("TURNAROUND TIME DISTRIBUTION", "Overdue (>14 days)", "overdue"),
    ("TURNAROUND STATISTICS", "Average Turnaround", "avg_days"),
    ("TURNAROUND STATISTICS", "Minimum", "min_days"),
    ("TURNAROUND STATISTICS", "Maximum", "max_days"),
    ("KEY METRICS", "Approval Rate", "approval_rate"),
    ("KEY METRICS", "Denial Rate", "denial_rate"),
    ("KEY METRICS", "Fast Turnaround %", "fast_pct"),
    ("KEY METRICS", "SLA Compliance (<=7 days)", "sla_compliance"),
)


def turnaround(as_of):
    """Days from request to decision, or to ``as_of`` while there is none."""
    return days_between(F.col("request_date"), F.coalesce(F.col("approval_date"), as_of_day(as_of)))


def category(days, bounds=(3, 7, 14)):
    fast, standard, slow = bounds
    return ladder(days, [("<=", fast, "FAST"), ("<=", standard, "STANDARD"), ("<=", slow, "SLOW")], "OVERDUE")


def prior_auth_detail(prior_auth: DataFrame, *, as_of, bounds=(3, 7, 14)) -> DataFrame:
    timed = prior_auth.select("auth_id", "auth_status", turnaround(as_of).alias("turnaround_days"))
    return timed.withColumn("category", category(F.col("turnaround_days"), bounds))


def prior_auth_summary_report(prior_auth: DataFrame, *, as_of, bounds=(3, 7, 14), sla=7) -> DataFrame:
    """All counts and times in one pass.

    Withdrawn requests leave the request total but stay in the times and bands.
    """
    timed = prior_auth.select("auth_status", turnaround(as_of).alias("days"))
    timed = timed.withColumn("band", category(F.col("days"), bounds))
    status, band, days = F.col("auth_status"), F.col("band"), F.col("days")
    totals = timed.agg(
        F.count_if(F.coalesce(status != "WITHDRAWN", F.lit(True))).alias("total_requests"),
        F.count_if(status == "APPROVED").alias("approved"),
        F.count_if(status == "DENIED").alias("denied"),
        F.count_if(status == "PENDING").alias("pending"),
        F.count_if(band == "FAST").alias("fast"),
        F.count_if(band == "STANDARD").alias("standard"),
        F.count_if(band == "SLOW").alias("slow"),
        F.count_if(band == "OVERDUE").alias("overdue"),
        F.count_if(days <= sla).alias("in_sla"),
        F.sum(days.cast("long")).alias("sum_days"),
        F.min(days).alias("min_days"),
        F.max(days).alias("max_days"),
    )
    n = F.col("total_requests")
    return totals.select(
        "total_requests", "approved", "denied", "pending", "fast", "standard", "slow", "overdue",
        safe_avg(F.col("sum_days"), n).alias("avg_days"),
        F.col("min_days").cast("long").alias("min_days"),
        F.col("max_days").cast("long").alias("max_days"),
        pct(F.col("approved"), n).alias("approval_rate"),
        pct(F.col("denied"), n).alias("denial_rate"),
        pct(F.col("fast"), n).alias("fast_pct"),
        pct(F.col("in_sla"), n).alias("sla_compliance"),
    )
