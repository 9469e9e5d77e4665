"""Demo payer tables at any size, made on the executors.

Every value is a function of the row number and the seed, so a table is the
same however it is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.expr import band_factor

# Value lists, repeated entries being weights, and default sizes.
MEASURES = ("BCS", "COL", "CBP", "CDC", "HBD", "CIS", "W15", "W30")
AGE_GROUPS = ("50-54", "55-59", "60-64", "65-69", "70-74", "75-79", "80-84")
PLAN_TYPES = ("MEDICARE", "MEDICARE-ADVANTAGE", "COMMERCIAL", "INDIVIDUAL", "GROUP")
ENTITLEMENTS = ("Age", "Age", "Disability", "ESRD")
CLAIM_STATUSES = ("Paid", "Paid", "Paid", "Denied", "Pending", "APPROVED", "PARTIAL")
CLAIM_TYPES = ("Professional", "Institutional", "Pharmacy")
PROCEDURES = ("99213", "99214", "99215", "81000", "85025", "80053", "99232", "99233", "70450", "73060")
DIAGNOSES = ("E11.9", "I10", "J44.9", "K21.9", "M19.90", "F41.9", "E78.5")
AUTH_PROCEDURES = ("99213", "99214", "99215", "77067", "70450", "73060")
AUTH_DIAGNOSES = ("E11.9", "I10", "J44.9", "K21.9", "M19.90")
AUTH_STATUSES = ("APPROVED", "APPROVED", "APPROVED", "DENIED", "PENDING")
REVIEWERS = ("REV001", "REV002", "REV003", "REV004", "REV005")
SPECIALTIES = ("Internal Medicine", "Family Practice", "Cardiology", "Endocrinology", "Orthopedics",
               "Radiology", "Pediatrics", "Psychiatry", "Dermatology")
PROVIDER_TYPES = ("PCP", "Specialist", "Hospital", "Lab", "Imaging Center")
CITIES = ("New York", "Los Angeles", "Chicago", "Houston", "Phoenix")
STATES = ("NY", "CA", "IL", "TX", "AZ")
NETWORKS = ("In Network", "In Network", "Out of Network")
DISEASE_GROUPS = ("Diabetes", "Heart Disease", "COPD", "Cancer", "Kidney Disease")
HCC = (
    ("HCC17", Decimal("0.302"), "Diabetes with Acute Complications"),
    ("HCC18", Decimal("0.318"), "Diabetes with Chronic Complications"),
    ("HCC19", Decimal("0.368"), "Diabetes without Complication"),
    ("HCC85", Decimal("0.323"), "Congestive Heart Failure"),
    ("HCC86", Decimal("0.189"), "Acute Myocardial Infarction"),
    ("HCC87", Decimal("0.271"), "Unstable Angina"),
    ("HCC88", Decimal("0.195"), "Angina Pectoris"),
    ("HCC111", Decimal("0.484"), "Chronic Obstructive Pulmonary Disease"),
    ("HCC112", Decimal("0.341"), "Fibrosis of Lung"),
)
AGE_FACTORS = {
    "M": [(85, Decimal("1.4500")), (75, Decimal("1.2500")), (65, Decimal("1.0500")), (55, Decimal("0.8500"))],
    None: [(85, Decimal("1.3800")), (75, Decimal("1.1900")), (65, Decimal("1.0000")), (55, Decimal("0.8100"))],
}
YOUNG_FACTORS = {"M": Decimal("0.7500"), None: Decimal("0.7200")}
ROWS = {
    "hedis_measures": 5000,
    "members": 10000,
    "claims": 8000,
    "providers": 100,
    "risk_scores": 6000,
    "diagnoses": 8000,
    "prior_auth_summary": 5000,
}


class _Draw:
    """Seeded draws; each call site names its column, so columns are independent."""

    def __init__(self, table: str, seed: int, members: int, providers: int):
        self.table, self.seed = table, seed
        self.members, self.providers = members, providers

    def whole(self, name: str, low: int, high: int) -> Column:
        """Uniform integer between both bounds, inclusive."""
        bits = F.xxhash64(F.col("id"), F.lit(self.seed), F.lit(f"{self.table}.{name}"))
        return (F.pmod(bits, F.lit(high - low + 1)) + low).cast("int")

    def pick(self, name: str, values: Sequence) -> Column:
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, self.whole(name, 1, len(values)))

    def amount(self, name: str, low: int, high: int) -> Column:
        return (self.whole(name, low * 100, high * 100) / F.lit(100)).cast("decimal(11,2)")

    def member(self) -> Column:
        return _tag("M", self.whole("member", 100000, 100000 + self.members - 1))

    def provider(self) -> Column:
        # One id more than the provider table holds, so some claims are orphans.
        return _tag("PRV", self.whole("provider", 1000, 1000 + self.providers))

    def date(self, name: str, start: str, days: int) -> Column:
        return F.date_add(F.to_date(F.lit(start)), self.whole(name, 0, days - 1))


def _tag(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _share(amount: Column, per_mille: Column) -> Column:
    return F.round(amount * per_mille / 1000, 2).cast("decimal(11,2)")


def _hedis_measures(d: _Draw) -> list[Column]:
    return [
        d.pick("measure_id", MEASURES).alias("measure_id"),
        _tag("M", F.col("id") + 100000).alias("member_id"),
        d.whole("age", 50, 84).alias("age"),
        d.pick("age_group", AGE_GROUPS).alias("age_group"),
        d.whole("year", 2022, 2023).alias("measure_year"),
        d.whole("numerator", 0, 1).alias("numerator"),
        F.lit(1).alias("denominator"),
        d.pick("exclusion", (0, 0, 0, 1)).alias("exclusion"),
        d.date("service_date", "2023-01-01", 365).alias("service_date"),
    ]


def _members(d: _Draw) -> list[Column]:
    born, gender = d.whole("born", 1940, 2000), d.pick("gender", ("M", "F"))
    age = F.lit(2023) - born
    enrolled = d.date("enrolled", "2020-01-01", 1096)
    ended = d.whole("ended", 1, 4) == 1
    status = F.when(ended, "TERMINATED").otherwise("ACTIVE")
    return [
        _tag("M", F.col("id") + 100000).alias("member_id"),
        _tag("FirstName", F.col("id")).alias("first_name"),
        _tag("LastName", F.col("id")).alias("last_name"),
        F.make_date(born, d.whole("month", 1, 12), d.whole("day", 1, 28)).alias("date_of_birth"),
        age.alias("age"),
        gender.alias("gender"),
        band_factor(gender, age, AGE_FACTORS, YOUNG_FACTORS).alias("age_sex_factor"),
        d.whole("zip", 10000, 99999).cast("string").alias("zip_code"),
        enrolled.alias("enrollment_date"),
        F.when(ended, F.date_add(enrolled, d.whole("stay", 30, 1095))).alias("termination_date"),
        status.alias("enrollment_status"),
        d.whole("months", 1, 36).alias("enrollment_months"),
        _tag("PLAN", d.whole("plan", 1, 5)).alias("plan_id"),
        d.pick("plan_type", PLAN_TYPES).alias("plan_type"),
        d.amount("premium", 100, 800).alias("premium_amount"),
        d.whole("claims", 0, 50).alias("claims_last_year"),
        d.amount("cost", 0, 100000).alias("total_cost_last_yr"),
        status.alias("member_status"),
        d.pick("disabled", (0, 0, 0, 1)).alias("disabled_flag"),
        d.pick("entitled", ENTITLEMENTS).alias("original_entitled"),
    ]


def _claims(d: _Draw) -> list[Column]:
    billed, status = d.amount("billed", 50, 5000), d.pick("status", CLAIM_STATUSES)
    served = d.date("served", "2023-01-01", 365)
    part = _share(billed, d.whole("part", 300, 700))
    paid = (
        F.when(status.isin("Paid", "APPROVED"), _share(billed, d.whole("paid", 800, 1000)))
        .when(status == "PARTIAL", part).otherwise(F.lit(0)).cast("decimal(11,2)")
    )
    denied = (
        F.when(status == "PARTIAL", billed - part).when(status == "Denied", billed)
        .otherwise(F.lit(0)).cast("decimal(11,2)")
    )
    return [
        _tag("CLM", F.col("id") + 200000).alias("claim_id"),
        d.member().alias("member_id"),
        d.provider().alias("provider_id"),
        served.alias("service_date"),
        F.date_add(served, d.whole("delay", 10, 45)).alias("paid_date"),
        d.pick("procedure", PROCEDURES).alias("procedure_code"),
        d.pick("diagnosis", DIAGNOSES).alias("diagnosis_code"),
        billed.alias("billed_amount"),
        billed.alias("claim_amount"),
        paid.alias("paid_amount"),
        denied.alias("denied_amount"),
        status.alias("claim_status"),
        d.pick("type", CLAIM_TYPES).alias("claim_type"),
        d.whole("quality", 70, 100).alias("quality_score"),
    ]


def _providers(d: _Draw) -> list[Column]:
    return [
        _tag("PRV", F.col("id") + 1000).alias("provider_id"),
        _tag("Dr. Provider ", F.col("id")).alias("provider_name"),
        d.pick("type", PROVIDER_TYPES).alias("provider_type"),
        d.pick("specialty", SPECIALTIES).alias("specialty"),
        (F.col("id") + 1000000000).cast("string").alias("npi"),
        F.concat(d.whole("street", 100, 9999).cast("string"), F.lit(" Main St")).alias("address"),
        d.pick("city", CITIES).alias("city"),
        d.pick("state", STATES).alias("state"),
        d.whole("zip", 10000, 99999).cast("string").alias("zip_code"),
        d.pick("network", NETWORKS).alias("network_status"),
        d.amount("rate", 80, 120).alias("contract_rate"),
    ]


def _risk_scores(d: _Draw) -> list[Column]:
    return [
        d.member().alias("member_id"),
        d.whole("year", 2022, 2023).alias("risk_year"),
        _tag("HCC", d.whole("hcc", 1, 189)).alias("hcc_code"),
        (d.whole("score", 500, 3500) / F.lit(1000)).cast("decimal(6,3)").alias("risk_score"),
        d.pick("group", DISEASE_GROUPS).alias("disease_group"),
        d.whole("flag", 0, 1).alias("hierarchical_flag"),
    ]


def _diagnoses(d: _Draw) -> list[Column]:
    kind = d.whole("hcc", 1, len(HCC))

    def part(i: int) -> Column:
        return F.element_at(F.array(*[F.lit(row[i]) for row in HCC]), kind)

    code = part(0)
    return [
        d.member().alias("member_id"),
        d.date("served", "2023-01-01", 365).alias("service_date"),
        code.alias("hcc_code"),
        part(1).alias("hcc_weight"),
        part(2).alias("diagnosis_description"),
        code.isin("HCC17", "HCC18", "HCC19").cast("int").alias("has_diabetes"),
        (code == "HCC85").cast("int").alias("has_chf"),
    ]


def _prior_auth_summary(d: _Draw) -> list[Column]:
    asked, status = d.date("asked", "2023-01-01", 335), d.pick("status", AUTH_STATUSES)
    wait = F.when(status == "APPROVED", d.whole("approve", 1, 10)).when(
        status == "DENIED", d.whole("deny", 1, 14))
    return [
        _tag("AUTH", F.col("id") + 300000).alias("auth_id"),
        d.member().alias("member_id"),
        d.provider().alias("provider_id"),
        asked.alias("request_date"),
        F.date_add(asked, wait).alias("approval_date"),
        status.alias("auth_status"),
        d.pick("procedure", AUTH_PROCEDURES).alias("procedure_code"),
        d.pick("diagnosis", AUTH_DIAGNOSES).alias("diagnosis_code"),
        d.amount("amount", 100, 50000).alias("auth_amount"),
        d.pick("reviewer", REVIEWERS).alias("reviewer_id"),
    ]


_TABLES = {
    "hedis_measures": _hedis_measures,
    "members": _members,
    "claims": _claims,
    "providers": _providers,
    "risk_scores": _risk_scores,
    "diagnoses": _diagnoses,
    "prior_auth_summary": _prior_auth_summary,
}


def synth(spark: SparkSession, table: str, n: int | None = None, seed: int = 1,
          partitions: int | None = None, members: int = ROWS["members"],
          providers: int = ROWS["providers"]) -> DataFrame:
    """``n`` rows of a demo table (its default size if not given).

    Foreign keys range over ``members`` and ``providers``; enlarge both with ``n``.
    """
    rows = spark.range(0, ROWS[table] if n is None else n, 1, partitions)
    return rows.select(*_TABLES[table](_Draw(table, seed, members, providers)))
