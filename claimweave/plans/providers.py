"""Providers: performance tiers and the claims dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.dates import since as on_or_after
from claimweave.functions.expr import ladder
from claimweave.functions.pic import money, pct, safe_avg
from claimweave.operators.relational import master_detail, rank_within

# Component points and tiers.
QUALITY = [(">=", 90, 40), (">=", 80, 30), (">=", 70, 20)]
APPROVAL = [(">=", 95, 30), (">=", 90, 25), (">=", 85, 20)]
COST = [("<", 200, 30), ("<", 500, 20), ("<", 1000, 15)]
LOWEST = 10
TIERS = [(">=", 90, "TIER 1"), (">=", 75, "TIER 2"), (">=", 60, "TIER 3")]


# Sections and labels of the report of one provider.
PERFORMANCE_REPORT = (
    ("", "PROVIDER NAME", "provider_name"),
    ("", "SPECIALTY", "specialty"),
    ("CLAIMS METRICS", "Total Claims", "claims"),
    ("CLAIMS METRICS", "Approved Claims", "approved"),
    ("CLAIMS METRICS", "Approval Rate", "approval_rate"),
    ("FINANCIAL METRICS", "Total Charges", "total_charges"),
    ("FINANCIAL METRICS", "Total Paid", "total_paid"),
    ("FINANCIAL METRICS", "Average Claim", "avg_claim"),
    ("QUALITY METRICS", "Average Quality Score", "avg_quality"),
    ("QUALITY METRICS", "Efficiency Score", "efficiency_score"),
    ("QUALITY METRICS", "Performance Tier", "tier"),
)


def provider_performance(providers: DataFrame, provider_claims: DataFrame, *, quality=QUALITY,
                         approval=APPROVAL, cost=COST, tiers=TIERS,
                         paid_statuses=("APPROVED", "PARTIAL")) -> DataFrame:
    """Every provider with claim metrics, efficiency score and tier.

    Without claims the averages are NULL and each component takes its lowest points.
    """
    metrics = master_detail(
        providers.select("provider_id", "provider_name", "specialty"), provider_claims, "provider_id",
        [
            F.count(F.lit(1)).alias("claims"),
            F.count_if(F.col("claim_status").isin(*paid_statuses)).alias("approved"),
            F.sum("claim_amount").alias("charges"),
            F.sum("paid_amount").alias("paid"),
            F.sum(F.col("quality_score").cast("long")).alias("quality"),
        ],
        zero=("claims", "approved", "charges", "paid"),
    )
    n = F.col("claims")
    rated = metrics.select(
        "provider_id", "provider_name", "specialty", "claims", "approved",
        pct(F.col("approved"), n).alias("approval_rate"),
        money(F.col("charges")).alias("total_charges"),
        money(F.col("paid")).alias("total_paid"),
        safe_avg(F.col("charges"), n).alias("avg_claim"),
        safe_avg(F.col("quality"), n).alias("avg_quality"),
    )
    score = (
        ladder(F.col("avg_quality"), quality, LOWEST)
        + ladder(F.col("approval_rate"), approval, LOWEST)
        + ladder(F.col("avg_claim"), cost, LOWEST)
    )
    return rated.withColumn("efficiency_score", score).withColumn(
        "tier", ladder(F.col("efficiency_score"), tiers, "NEEDS IMPROVEMENT"))


def provider_dashboard(claims: DataFrame, providers: DataFrame, *, since, paid="Paid", denied="Denied",
                       k: int | None = 20) -> DataFrame:
    """Claim metrics per provider with the rank by paid amount in the specialty.

    Claims shrink to one row per provider before the join. With ``k`` the top
    rows are taken first: whoever ranks above one of them in its specialty has
    a larger total and is among them, so ranking the ``k`` rows is exact.
    """
    recent = claims.filter(on_or_after(F.col("service_date"), since))
    grain = recent.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("claim_status") == paid).alias("n_paid"),
        F.count_if(F.col("claim_status") == denied).alias("n_denied"),
        F.count("paid_amount").alias("n_amounts"),
        F.sum("paid_amount").alias("amount"),
    )
    metrics = (
        grain.join(providers.select("provider_id", "provider_name", "specialty"), "provider_id")
        .groupBy("provider_id", "provider_name", "specialty")
        .agg(
            F.sum("n").alias("total_claims"),
            F.sum("n_paid").alias("paid_claims"),
            F.sum("n_denied").alias("denied_claims"),
            F.sum("n_amounts").alias("n_amounts"),
            F.sum("amount").alias("amount"),
        )
    )
    largest = [F.col("amount").desc_nulls_last(), F.col("provider_id")]
    if k is None:
        ranked = rank_within(metrics, "specialty", "amount", "specialty_rank")
    else:
        by_specialty = Window.partitionBy("specialty").orderBy(F.col("amount").desc_nulls_last())
        ranked = metrics.orderBy(*largest).limit(k).withColumn(
            "specialty_rank", F.rank().over(by_specialty).cast("long"))
    return ranked.orderBy(*largest).select(
        "provider_id", "provider_name", "specialty", "total_claims", "paid_claims", "denied_claims",
        money(F.col("amount")).alias("total_paid_amount"),
        safe_avg(F.col("amount"), F.col("n_amounts"), 6, "round").alias("avg_paid_amount"),
        pct(F.col("paid_claims"), F.col("total_claims"), store="round").alias("pay_rate_pct"),
        "specialty_rank",
    )
