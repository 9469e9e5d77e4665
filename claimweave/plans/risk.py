"""Risk adjustment: member scores, hierarchies, slot scores and plan statistics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.expr import band_factor, ladder
from claimweave.operators.relational import master_detail
from claimweave.operators.stats import means

# Age and sex factors, condition weights and disability factors.
AGE_FACTORS = {
    "M": [(85, Decimal("1.5000")), (75, Decimal("1.3000")), (65, Decimal("1.1000")), (55, Decimal("0.9000"))],
    None: [(85, Decimal("1.4500")), (75, Decimal("1.2500")), (65, Decimal("1.0500")), (55, Decimal("0.8500"))],
}
YOUNG_FACTORS = {"M": Decimal("0.8000"), None: Decimal("0.7500")}
CONDITIONS = {
    "has_diabetes": (("HCC17", "HCC18", "HCC19"), Decimal("0.3180")),
    "has_chf": (("HCC85",), Decimal("0.4190")),
    "has_copd": (("HCC111", "HCC112"), Decimal("0.3280")),
}
DISABLED = (Decimal("0.5000"), Decimal("0.3000"))
BASE = Decimal("1.0000")
SLOT_WEIGHTS = {
    "HCC17": 0.302,
    "HCC18": 0.302,
    "HCC19": 0.368,
    "HCC85": 0.323,
    "HCC86": 0.189,
    "HCC87": 0.271,
    "HCC88": 0.195,
    "HCC111": 0.484,
    "HCC112": 0.341,
}


# Sections and labels of the score report.
RAF_REPORT = (
    ("", "MEMBERS SCORED", "members_scored"),
    ("", "HIGH RAF (>3.0)", "high_raf_count"),
    ("HCC WEIGHTS APPLIED", "HCC 17-19 (Diabetes)", "weight_diabetes"),
    ("HCC WEIGHTS APPLIED", "HCC 85 (CHF)", "weight_chf"),
    ("HCC WEIGHTS APPLIED", "HCC 111-112 (COPD)", "weight_copd"),
)


# The line of one member.
MEMBER_REPORT = (("", "RAF SCORE", "total_raf_score"),)


def member_raf_scores(members: DataFrame, diagnoses: DataFrame, *, factors=AGE_FACTORS, young=YOUNG_FACTORS,
                      weights=CONDITIONS, disabled=DISABLED, base=BASE, dedupe=None, keep=()) -> DataFrame:
    """Score of every member from demographics and diagnoses.

    A condition's weight counts once per diagnosis row, or once per member with
    ``dedupe='category'``. ``keep`` carries further member columns along.
    """
    if dedupe not in (None, "category"):
        raise ValueError(f"dedupe must be None or 'category', not {dedupe!r}")
    counts = [F.count_if(F.col("hcc_code").isin(*codes)).alias(flag) for flag, (codes, _) in weights.items()]
    people = members.select("member_id", "age", "gender", "disabled_flag", "original_entitled", *keep)
    scored = master_detail(people, diagnoses, "member_id", counts, zero=list(weights))

    hcc = F.lit(Decimal("0.0000"))
    for flag, (_, weight) in weights.items():
        n = F.least(F.col(flag), F.lit(1)) if dedupe else F.col(flag)
        hcc = hcc + n.cast("decimal(18,0)") * F.lit(weight)
    entitled, other = disabled
    parts = scored.select(
        "member_id", *keep,
        band_factor(F.col("gender"), F.col("age"), factors, young).alias("age_sex"),
        F.when(F.col("disabled_flag") == "Y",
               F.when(F.col("original_entitled") == "Y", F.lit(entitled)).otherwise(F.lit(other)))
        .otherwise(F.lit(Decimal("0.0000"))).alias("disabled"),
        hcc.alias("hcc"),
        *[(F.col(flag) > 0).alias(flag) for flag in weights],
    )
    total = F.lit(base) + F.col("age_sex") + F.col("disabled") + F.col("hcc")
    return parts.select(
        "member_id", *keep,
        F.col("age_sex").cast("double").alias("age_sex_factor"),
        F.col("disabled").cast("double").alias("disabled_factor"),
        F.col("hcc").cast("double").alias("hcc_factor"),
        total.cast("double").alias("total_raf_score"),
        *weights,
    )


def raf_report(raf_scores: DataFrame, *, high=3.0) -> DataFrame:
    return raf_scores.agg(
        F.count(F.lit(1)).alias("members_scored"),
        F.count_if(F.col("total_raf_score") > high).alias("high_raf_count"),
    )


def applied_weights(raf: DataFrame, weights=CONDITIONS) -> DataFrame:
    """The report row with the weights that were applied."""
    return raf.withColumns({
        flag.replace("has_", "weight_"): F.lit(float(weight)) for flag, (_, weight) in weights.items()
    })


def raf_means_by_plan(raf_scores: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Score statistics per plan type; ``members`` only where the scores lack the plan."""
    if members is not None:
        raf_scores = raf_scores.join(members.select("member_id", "plan_type"), "member_id")
    return means(raf_scores, "plan_type", "total_raf_score")


def hcc_hierarchy_scores(risk_scores: DataFrame, *, year=2023, bounds=(1.0, 2.0)) -> DataFrame:
    """Member totals over unflagged rows plus each disease group's leading row.

    The leader is first by score (high to low), code and flag. It only matters
    where it is flagged, so a group reduces to sums over its unflagged rows and
    its least ``(-score, code, flag)``: aggregations, however large the group.
    """
    rows = risk_scores.filter(F.col("risk_year") == year)
    score, code, flagged = F.col("risk_score"), F.col("hcc_code"), F.col("hierarchical_flag")
    exempt = flagged == 0
    groups = rows.groupBy("member_id", "disease_group").agg(
        F.sum(F.when(exempt, score)).alias("free_sum"),
        F.max(F.when(exempt, score)).alias("free_max"),
        F.count(F.when(exempt, code)).alias("free_n"),
        F.min(F.struct(
            score.isNull().alias("none"), (-score).alias("low"),
            code.isNull().alias("no_code"), code.alias("code"),
            flagged.isNull().alias("no_flag"), flagged.alias("flag"),
        )).alias("top"),
    )
    top = F.col("top")
    leads = top["no_flag"] | (top["flag"] != 0)
    lead_score = F.when(leads, -top["low"])
    totals = groups.select(
        "member_id",
        F.coalesce(F.col("free_sum") + lead_score, F.col("free_sum"), lead_score).alias("total"),
        F.greatest("free_max", lead_score).alias("best"),
        (F.col("free_n") + F.when(leads & ~top["no_code"], 1).otherwise(0)).alias("n"),
    ).groupBy("member_id").agg(
        F.sum("total").alias("total"), F.max("best").alias("best"), F.sum("n").alias("hcc_count"))
    low, medium = bounds
    category = ladder(F.col("total"), [("<", low, "Low Risk"), ("<", medium, "Medium Risk")], "High Risk")
    return totals.select(
        "member_id",
        F.col("total").cast("double").alias("total_risk_score"),
        F.col("best").cast("double").alias("max_hcc_score"),
        "hcc_count",
        category.alias("risk_category"),
    )


def hcc_array_scores(diagnoses: DataFrame, *, weights=SLOT_WEIGHTS, slots: int | None = None) -> DataFrame:
    """Weight of the distinct codes per member, in code order.

    Codes are made distinct before any array is built, so an array holds at most the
    codes of the code list. ``slots`` is for the file form with that many places:
    later codes are then left out, and ``codes_left_out`` counts them.
    """
    codes = diagnoses.filter(F.col("hcc_code").isNotNull()).select("member_id", "hcc_code").distinct()
    arrays = codes.groupBy("member_id").agg(F.sort_array(F.collect_list("hcc_code")).alias("hcc_slots"))
    if slots is not None:
        left = F.greatest(F.size("hcc_slots") - slots, F.lit(0)).cast("long")
        arrays = arrays.withColumn("codes_left_out", left).withColumn("hcc_slots", F.slice("hcc_slots", 1, slots))
    weight_of = F.create_map(*[
        F.lit(x) for code, w in weights.items() for x in (code, Decimal(str(w)).quantize(Decimal("0.001")))
    ])
    scores = F.transform("hcc_slots", lambda c: F.coalesce(weight_of[c], F.lit(Decimal("0.000"))))
    total = F.aggregate(scores, F.lit(0).cast("decimal(12,3)"),
                        lambda a, x: (a + x).cast("decimal(12,3)"))
    return arrays.withColumn("hcc_score_sum", total.cast("double"))
