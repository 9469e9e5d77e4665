"""Outputs that the payer catalog lists by name only; the definitions are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.expr import ladder
from claimweave.functions.pic import money, pct
from claimweave.operators.relational import running_total, top_k
from claimweave.operators.stats import freq2
from claimweave.plans.members import plan_family
from claimweave.plans.screening import measure_by_age_group

AGE_BANDS = [("<", 30, "under 30"), ("<", 50, "30-49"), ("<", 65, "50-64")]


def colorectal_summary(measures: DataFrame) -> DataFrame:
    return measure_by_age_group(measures, measure="COL")


def diabetes_summary(measures: DataFrame) -> DataFrame:
    return measure_by_age_group(measures, measure="CDC")


def hcc_detail(diagnoses: DataFrame) -> DataFrame:
    return freq2(diagnoses, "member_id", "hcc_code", "diagnoses")


def risk_stratification(hierarchy_scores: DataFrame) -> DataFrame:
    return hierarchy_scores.groupBy("risk_category").agg(F.count(F.lit(1)).alias("members"))


def high_cost_members(claims: DataFrame, k: int = 100) -> DataFrame:
    totals = claims.groupBy("member_id").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").alias("total"))
    top = top_k(totals, [F.desc("total"), F.col("member_id")], k)
    return top.select("member_id", "claims", money(F.col("total")).alias("total_amount"))


def utilization_trends(claims: DataFrame) -> DataFrame:
    """Claims per type and month with a running total."""
    dated = claims.select(
        "claim_type", F.year("service_date").alias("year"), F.month("service_date").alias("month"))
    return running_total(
        dated, "claim_type", ("year", "month"), F.count(F.lit(1)), "claims", "cumulative_claims")


def cost_trends(claims: DataFrame) -> DataFrame:
    dated = claims.select(
        F.year("service_date").alias("year"), F.month("service_date").alias("month"),
        "claim_amount", "paid_amount")
    return dated.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("claims"),
        money(F.sum("claim_amount")).alias("billed"),
        money(F.sum("paid_amount")).alias("paid"),
    )


def network_analysis(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Claims and amounts by network status; claims shrink to provider rows first."""
    grain = claims.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("claim_amount").alias("billed"), F.sum("paid_amount").alias("paid"))
    return grain.join(providers.select("provider_id", "network_status"), "provider_id").groupBy(
        "network_status"
    ).agg(
        F.count(F.lit(1)).alias("providers"),
        F.sum("n").alias("claims"),
        money(F.sum("billed")).alias("total_billed"),
        money(F.sum("paid")).alias("total_paid"),
    )


def quality_metrics(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Quality-score statistics by specialty from exact moments per provider."""
    x = F.col("quality_score").cast("decimal(12,0)")
    grain = claims.groupBy("provider_id").agg(
        F.count("quality_score").alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"),
        F.min("quality_score").alias("lo"), F.max("quality_score").alias("hi"),
    )
    sums = grain.join(providers.select("provider_id", "specialty"), "provider_id").groupBy("specialty").agg(
        F.sum("n").alias("n"), F.sum("s1").cast("double").alias("s1"), F.sum("s2").cast("double").alias("s2"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    n = F.col("n").cast("double")
    mean = F.col("s1") / n
    variance = (F.col("s2") - F.col("s1") * mean) / (n - 1)
    return sums.filter("n > 0").select(
        "specialty",
        F.round(mean, 6).alias("avg"),
        F.when(n > 1, F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 6)).alias("stddev"),
        F.col("lo").cast("double").alias("min"),
        F.col("hi").cast("double").alias("max"),
    )


def member_segmentation(members: DataFrame) -> DataFrame:
    segments = members.select(
        ladder(F.col("age"), AGE_BANDS, "65 and over").alias("age_band"), plan_family().alias("plan_family"))
    return freq2(segments, "age_band", "plan_family", "members")


def approval_rates(prior_auth: DataFrame, by: str = "reviewer_id") -> DataFrame:
    """Requests, decisions and rates per reviewer, withdrawn requests left out."""
    status = F.col("auth_status")
    totals = prior_auth.filter(status != "WITHDRAWN").groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(status == "APPROVED").alias("approved"),
        F.count_if(status == "DENIED").alias("denied"),
    )
    return totals.withColumns({
        "approval_rate": pct(F.col("approved"), F.col("requests")),
        "denial_rate": pct(F.col("denied"), F.col("requests")),
    })


def denial_analysis(prior_auth: DataFrame, by: str = "reviewer_id") -> DataFrame:
    denied = prior_auth.filter(F.col("auth_status") == "DENIED")
    return denied.groupBy(by).agg(
        F.count(F.lit(1)).alias("denied"), money(F.sum("auth_amount")).alias("denied_amount"))
