"""Claims cost: the one-row summary, risk levels, cost flags and denials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.dates import since as on_or_after
from claimweave.functions.expr import ladder, sum_if
from claimweave.functions.pic import money, pct, safe_avg


# Sections and labels of the cost report.
COST_REPORT = (
    ("CLAIMS VOLUME", "Total Claims", "total_claims"),
    ("CLAIMS VOLUME", "Approved", "approved_claims"),
    ("CLAIMS VOLUME", "Denied", "denied_claims"),
    ("CLAIMS VOLUME", "High-Cost (>$50K)", "high_cost_claims"),
    ("FINANCIAL SUMMARY", "Total Billed", "total_billed"),
    ("FINANCIAL SUMMARY", "Total Paid", "total_paid"),
    ("FINANCIAL SUMMARY", "Total Denied", "total_denied"),
    ("FINANCIAL SUMMARY", "Average Claim", "avg_claim"),
    ("FINANCIAL SUMMARY", "Average Paid", "avg_paid"),
    ("PERFORMANCE METRICS", "Approval Rate", "approval_rate"),
    ("PERFORMANCE METRICS", "Denial Rate", "denial_rate"),
    ("PERFORMANCE METRICS", "Paid Percentage", "paid_pct"),
)


def claims_cost_summary(claims: DataFrame, *, high_cost=50000, paid_statuses=("APPROVED", "PARTIAL"),
                        denied="DENIED", partial="PARTIAL") -> DataFrame:
    """Volumes, amounts and rates of all claims in one pass.

    Statuses outside the lists count only in the totals.
    """
    status = F.col("claim_status")
    paid = status.isin(*paid_statuses)
    totals = claims.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(paid).alias("approved_claims"),
        F.count_if(status == denied).alias("denied_claims"),
        F.count_if(F.col("claim_amount") > high_cost).alias("high_cost_claims"),
        F.coalesce(F.sum("claim_amount"), F.lit(0)).alias("billed"),
        sum_if(paid, F.col("paid_amount")).alias("paid"),
        sum_if(status.isin(denied, partial), F.col("denied_amount")).alias("denied"),
    )
    n, approved = F.col("total_claims"), F.col("approved_claims")
    return totals.select(
        "total_claims", "approved_claims", "denied_claims", "high_cost_claims",
        money(F.col("billed")).alias("total_billed"),
        money(F.col("paid")).alias("total_paid"),
        money(F.col("denied")).alias("total_denied"),
        safe_avg(F.col("billed"), n).alias("avg_claim"),
        safe_avg(F.col("paid"), approved).alias("avg_paid"),
        pct(approved, n).alias("approval_rate"),
        pct(F.col("denied_claims"), n).alias("denial_rate"),
        pct(F.col("paid"), F.col("billed")).alias("paid_pct"),
    )


def risk_level(amount, bounds=(100000, 50000, 10000)):
    critical, high, medium = bounds
    return ladder(amount, [(">", critical, "CRITICAL"), (">", high, "HIGH"), (">", medium, "MEDIUM")], "LOW")


def claims_risk_levels(claims: DataFrame, *, bounds=(100000, 50000, 10000)) -> DataFrame:
    return (
        claims.groupBy(risk_level(F.col("claim_amount"), bounds).alias("risk_level"))
        .agg(F.count(F.lit(1)).alias("claims"), money(F.sum("claim_amount")).alias("total_amount"))
    )


def claims_cost_flags(claims: DataFrame, *, bounds=(1000, 10000)) -> DataFrame:
    low, standard = bounds
    flag = ladder(
        F.col("claim_amount"), [("<", low, "LOW_COST"), ("<", standard, "STANDARD_COST")], "VERY_HIGH_COST")
    return claims.groupBy(flag.alias("cost_flag")).agg(F.count(F.lit(1)).alias("claims"))


def denied_claims_report(claims: DataFrame, providers: DataFrame, *, since, status="Denied") -> DataFrame:
    """Denied claims by provider and procedure, largest counts first.

    Claims shrink to one row per provider and procedure before the join; the
    second grouping only adds up rows should a provider be listed twice.
    """
    denied = claims.filter((F.col("claim_status") == status) & on_or_after(F.col("service_date"), since))
    grain = denied.groupBy("provider_id", "procedure_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("billed_amount").alias("billed"))
    names = providers.select("provider_id", "provider_name")
    return (
        grain.join(names, "provider_id")
        .groupBy("provider_id", "provider_name", "procedure_code")
        .agg(
            F.sum("n").alias("denied_claim_count"),
            money(F.sum("billed")).alias("total_billed_amount"),
        )
        .orderBy(F.desc("denied_claim_count"), "provider_id", "procedure_code")
    )
