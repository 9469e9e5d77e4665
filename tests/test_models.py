"""The reports against record-at-a-time models of the batch programs."""

import datetime as dt
import random
from decimal import Decimal as D
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from claimweave.plans import claims as claims_plan
from claimweave.plans import members as members_plan
from claimweave.plans import prior_auth, providers, risk, screening

SEEDS = (1, 2)


def cut(x: Fraction, digits: int = 2) -> float:
    """Store into an unsigned picture: drop further digits."""
    return (x.numerator * 10 ** digits // x.denominator) / 10 ** digits


def money(rng, top):
    return D(rng.randrange(0, top * 100)) / 100


@pytest.mark.parametrize("seed", SEEDS)
def test_screening(spark, seed):
    rng = random.Random(seed)
    people = [(i, rng.choice("MF"), rng.choice([49, 50, 59, 60, 69, 70, 74, 75]),
               rng.choice(["ACTIVE", "TERMINATED"]), rng.choice([11, 12])) for i in range(300)]
    claims = [(rng.randrange(0, 330), rng.choice(["77065", "77066", "77067", "99213"])) for _ in range(400)]
    den, bands, eligible = 0, {"age_50_59": 0, "age_60_69": 0, "age_70_74": 0}, set()
    for member, sex, age, status, months in people:
        if sex == "F" and 50 <= age <= 74 and status == "ACTIVE" and months == 12:
            den += 1
            eligible.add(member)
            bands["age_50_59" if age <= 59 else "age_60_69" if age <= 69 else "age_70_74"] += 1
    hits = [m for m, code in claims if code != "99213"]
    mdf = spark.createDataFrame(
        people, "member_id long, gender string, age int, enrollment_status string, enrollment_months int")
    cdf = spark.createDataFrame(claims, "member_id long, procedure_code string")

    row = screening.screening_summary(mdf, cdf).first().asDict()
    assert row == {"denominator": den, "numerator": len(hits),
                   "compliance_rate": cut(Fraction(len(hits) * 100, den)), **bands}

    found = len(eligible & set(hits))
    row = screening.screening_member_rate(mdf, cdf).first().asDict()
    assert row == {"denominator": den, "numerator": found, "compliance_rate": cut(Fraction(found * 100, den))}


@pytest.mark.parametrize("seed", SEEDS)
def test_claims_cost(spark, seed):
    rng = random.Random(seed)
    rows = [(money(rng, 120000), money(rng, 90000), money(rng, 9000),
             rng.choice(["APPROVED", "DENIED", "PARTIAL", "Paid", "Denied"])) for _ in range(500)]
    n = approved = denied = high = 0
    billed = paid = refused = D(0)
    for amount, p, d, status in rows:
        n += 1
        billed += amount
        if status in ("APPROVED", "PARTIAL"):
            approved += 1
            paid += p
        if status == "DENIED":
            denied += 1
        if status in ("DENIED", "PARTIAL"):
            refused += d
        high += amount > 50000
    df = spark.createDataFrame(rows, "claim_amount decimal(9,2), paid_amount decimal(9,2), "
                                     "denied_amount decimal(9,2), claim_status string")
    assert claims_plan.claims_cost_summary(df).first().asDict() == {
        "total_claims": n, "approved_claims": approved, "denied_claims": denied, "high_cost_claims": high,
        "total_billed": float(billed), "total_paid": float(paid), "total_denied": float(refused),
        "avg_claim": cut(Fraction(billed) / n), "avg_paid": cut(Fraction(paid) / approved),
        "approval_rate": cut(Fraction(approved * 100, n)), "denial_rate": cut(Fraction(denied * 100, n)),
        "paid_pct": cut(Fraction(paid) / Fraction(billed) * 100),
    }


@pytest.mark.parametrize("seed", SEEDS)
def test_churn(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([29, 30, 60]), rng.choice(["ACTIVE", "TERMINATED", "SUSPENDED", "OTHER"]),
             rng.choice(["MEDICARE", "MEDICARE-ADVANTAGE", "COMMERCIAL", "INDIVIDUAL", "GROUP", "NONE"]),
             rng.choice([D("500.00"), D("500.01")]), rng.choice([1, 2]), rng.choice([D("50000.00"), D("50000.01")]))
            for i in range(300)]
    want, totals = {}, dict.fromkeys(("total", "active", "termed", "high_risk", "medicare", "commercial"), 0)
    for i, age, status, plan, premium, used, cost in rows:
        totals["total"] += 1
        totals["active"] += status == "ACTIVE"
        totals["termed"] += status in ("TERMINATED", "SUSPENDED")
        totals["medicare"] += plan.startswith("MEDICARE")
        totals["commercial"] += plan in ("COMMERCIAL", "INDIVIDUAL", "GROUP")
        score = 0
        if premium > 500:
            score += 30
        if used < 2:
            score += 25
        if cost > 50000:
            score -= 20
        if age < 30:
            score += 20
        name = "CRITICAL" if score >= 70 else "HIGH" if score >= 50 else "MEDIUM" if score >= 30 else "LOW"
        totals["high_risk"] += score >= 50
        want[i] = (score, name)
    df = spark.createDataFrame(rows, "member_id long, age int, enrollment_status string, plan_type string, "
                                     "premium_amount decimal(9,2), claims_last_year int, total_cost_last_yr decimal(11,2)")
    got = {r.member_id: (r.churn_score, r.risk_category) for r in members_plan.member_churn_scores(df).collect()}
    assert got == want
    assert {-20, 75} <= {score for score, _ in want.values()}
    assert members_plan.churn_summary(df).first().asDict() == {
        **totals,
        "churn_rate": cut(Fraction(totals["termed"] * 100, totals["total"])),
        "retention_rate": cut(Fraction(totals["active"] * 100, totals["total"])),
    }


@pytest.mark.parametrize("dedupe", [None, "category"])
def test_risk_scores(spark, dedupe):
    rng = random.Random(7)
    people = [(i, rng.choice([54, 55, 64, 65, 74, 75, 84, 85]), rng.choice("MFX"), rng.choice("YN"), rng.choice("YN"))
              for i in range(200)]
    codes = ["HCC17", "HCC18", "HCC19", "HCC85", "HCC111", "HCC112", "HCC86"]
    found = [(rng.randrange(0, 150), rng.choice(codes)) for _ in range(600)]
    steps = {"M": (15000, 13000, 11000, 9000, 8000), "other": (14500, 12500, 10500, 8500, 7500)}
    want = {}
    for i, age, sex, disabled, entitled in people:
        band = 0 if age >= 85 else 1 if age >= 75 else 2 if age >= 65 else 3 if age >= 55 else 4
        factor = steps["M" if sex == "M" else "other"][band]
        extra = (5000 if entitled == "Y" else 3000) if disabled == "Y" else 0
        hcc, seen = 0, set()
        for member, code in found:
            if member != i:
                continue
            kind, weight = (("d", 3180) if code in ("HCC17", "HCC18", "HCC19") else ("f", 4190) if code == "HCC85"
                            else ("p", 3280) if code in ("HCC111", "HCC112") else (None, 0))
            if kind and not (dedupe and kind in seen):
                hcc += weight
            seen.add(kind)
        want[i] = ((10000 + factor + extra + hcc) / 10000, factor / 10000, extra / 10000, hcc / 10000,
                   "d" in seen, "f" in seen, "p" in seen)
    mdf = spark.createDataFrame(
        people, "member_id long, age int, gender string, disabled_flag string, original_entitled string")
    ddf = spark.createDataFrame(found, "member_id long, hcc_code string")
    scores = risk.member_raf_scores(mdf, ddf, dedupe=dedupe)
    got = {r.member_id: (r.total_raf_score, r.age_sex_factor, r.disabled_factor, r.hcc_factor,
                         r.has_diabetes, r.has_chf, r.has_copd) for r in scores.collect()}
    assert got == want
    report = risk.raf_report(scores).first()
    assert report.high_raf_count == sum(v[0] > 3.0 for v in want.values())


@pytest.mark.parametrize("seed", SEEDS)
def test_hierarchy(spark, seed):
    """Groups with ties, flagged and unflagged leaders against a sort per group."""
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 40), rng.choice([2022, 2023]), rng.choice(["HCC1", "HCC2", "HCC3", None]),
             D(rng.choice([300, 500, 500, 700])) / 1000, rng.choice("AB"), rng.choice([0, 1, 1])) for _ in range(500)]
    groups = {}
    for member, year, code, score, group, flag in rows:
        if year == 2023:
            groups.setdefault((member, group), []).append((score, code, flag))
    totals = {}
    for (member, _), items in groups.items():
        items.sort(key=lambda r: (-r[0], r[1] is None, r[1] or "", r[2]))
        for place, (score, code, flag) in enumerate(items):
            if flag == 0 or place == 0:
                totals.setdefault(member, []).append((score, code))
    want = {}
    for member, kept in totals.items():
        total = sum(s for s, _ in kept)
        name = "Low Risk" if total < 1 else "Medium Risk" if total < 2 else "High Risk"
        want[member] = (float(total), float(max(s for s, _ in kept)), sum(c is not None for _, c in kept), name)
    df = spark.createDataFrame(rows, "member_id long, risk_year int, hcc_code string, risk_score decimal(12,6), "
                                     "disease_group string, hierarchical_flag int")
    got = {r.member_id: tuple(r)[1:] for r in risk.hcc_hierarchy_scores(df.repartition(7)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_provider_performance(spark, seed):
    rng = random.Random(seed)
    people = [(i, f"P{i}", "Cardiology") for i in range(40)]
    rows = []
    for i in range(38):
        level, quality = rng.choice([150, 199, 200, 499, 500, 999, 1000, 1500]), rng.choice([65, 70, 79, 80, 90, 95])
        yes = rng.choice([50, 85, 90, 95, 100])
        for k in range(20):
            rows.append((i, D(level), D(level), "APPROVED" if k * 5 < yes else "DENIED", quality))
    want = {}
    for i, name, specialty in people:
        mine = [r for r in rows if r[0] == i]
        n = len(mine)
        ok = sum(r[3] == "APPROVED" for r in mine)
        quality = cut(Fraction(sum(r[4] for r in mine), n)) if n else None
        rate = cut(Fraction(ok * 100, n)) if n else None
        avg = cut(Fraction(sum(r[1] for r in mine)) / n) if n else None
        score = 10 if not n else 40 if quality >= 90 else 30 if quality >= 80 else 20 if quality >= 70 else 10
        score += 10 if not n else 30 if rate >= 95 else 25 if rate >= 90 else 20 if rate >= 85 else 10
        score += 10 if not n else 30 if avg < 200 else 20 if avg < 500 else 15 if avg < 1000 else 10
        tier = ("TIER 1" if score >= 90 else "TIER 2" if score >= 75 else "TIER 3" if score >= 60
                else "NEEDS IMPROVEMENT")
        want[i] = (n, ok, rate, avg, quality, score, tier)
    pdf = spark.createDataFrame(people, "provider_id long, provider_name string, specialty string")
    cdf = spark.createDataFrame(rows, "provider_id long, claim_amount decimal(9,2), paid_amount decimal(9,2), "
                                      "claim_status string, quality_score int")
    got = {r.provider_id: (r.claims, r.approved, r.approval_rate, r.avg_claim, r.avg_quality, r.efficiency_score, r.tier)
           for r in providers.provider_performance(pdf, cdf).collect()}
    assert got == want
    assert want[39][5:] == (30, "NEEDS IMPROVEMENT")


def test_prior_auth(spark):
    asked = dt.date(2023, 12, 28)
    rows = [(i, asked, asked + dt.timedelta(days=d), status)
            for i, (d, status) in enumerate([(0, "APPROVED"), (3, "APPROVED"), (4, "DENIED"), (7, "APPROVED"),
                                             (8, "DENIED"), (14, "APPROVED"), (15, "APPROVED"), (2, "WITHDRAWN")])]
    rows += [(8, asked, None, "PENDING"), (9, dt.date(2024, 1, 5), None, "PENDING")]
    as_of = dt.date(2024, 1, 10)
    days = {r[0]: ((r[2] or as_of) - r[1]).days for r in rows}
    band = {i: "FAST" if d <= 3 else "STANDARD" if d <= 7 else "SLOW" if d <= 14 else "OVERDUE"
            for i, d in days.items()}
    df = spark.createDataFrame(rows, "auth_id long, request_date date, approval_date date, auth_status string")
    detail = prior_auth.prior_auth_detail(df, as_of=as_of).collect()
    assert {r.auth_id: (r.turnaround_days, r.category) for r in detail} == {i: (days[i], band[i]) for i in days}
    n = 9
    fast, standard = (list(band.values()).count(b) for b in ("FAST", "STANDARD"))
    assert prior_auth.prior_auth_summary_report(df, as_of=as_of).first().asDict() == {
        "total_requests": n, "approved": 5, "denied": 2, "pending": 2,
        "fast": fast, "standard": standard, "slow": list(band.values()).count("SLOW"),
        "overdue": list(band.values()).count("OVERDUE"),
        "avg_days": cut(Fraction(sum(days.values()), n)), "min_days": 0, "max_days": 15,
        "approval_rate": cut(Fraction(500, n)), "denial_rate": cut(Fraction(200, n)),
        "fast_pct": cut(Fraction(fast * 100, n)), "sla_compliance": cut(Fraction((fast + standard) * 100, n)),
    }


def test_slots_are_cut_in_code_order(spark):
    rows = [(1, f"HCC{i}") for i in range(10, 25)] + [(1, "HCC10"), (2, "HCC18"), (2, "HCC85"), (2, "ZZZ"), (3, None)]
    df = spark.createDataFrame(rows, "member_id long, hcc_code string")
    got = {r.member_id: (r.hcc_slots, r.hcc_score_sum, r.codes_left_out) for r in risk.hcc_array_scores(df, slots=10).collect()}
    assert got == {
        1: ([f"HCC{i}" for i in range(10, 20)], 0.972, 5),
        2: (["HCC18", "HCC85", "ZZZ"], 0.625, 0),
    }
    whole = {r.member_id: r.hcc_slots for r in risk.hcc_array_scores(df).collect()}
    assert whole == {1: [f"HCC{i}" for i in range(10, 25)], 2: ["HCC18", "HCC85", "ZZZ"]}


def test_empty_inputs_keep_one_row(spark):
    def empty(schema):
        return spark.createDataFrame([], schema)

    cost = claims_plan.claims_cost_summary(
        empty("claim_amount decimal(9,2), paid_amount decimal(9,2), denied_amount decimal(9,2), claim_status string"))
    assert cost.first().asDict() == {
        "total_claims": 0, "approved_claims": 0, "denied_claims": 0, "high_cost_claims": 0, "total_billed": 0.0,
        "total_paid": 0.0, "total_denied": 0.0, "avg_claim": None, "avg_paid": None, "approval_rate": None,
        "denial_rate": None, "paid_pct": None,
    }
    people = empty("member_id long, gender string, age int, enrollment_status string, enrollment_months int")
    hits = empty("member_id long, procedure_code string")
    assert tuple(screening.screening_summary(people, hits).first()) == (0, 0, 0.0, 0, 0, 0)
    assert tuple(screening.screening_member_rate(people, hits).first()) == (0, 0, 0.0)
    auths = empty("auth_id long, request_date date, approval_date date, auth_status string")
    row = prior_auth.prior_auth_summary_report(auths, as_of="2024-01-01").first()
    assert tuple(row) == (0,) * 8 + (None,) * 7


def test_level_boundaries(spark):
    amounts = ["10000.00", "10000.01", "50000.00", "50000.01", "100000.00", "100000.01", "999.99", "1000.00", "9999.99"]
    df = spark.createDataFrame([(D(a),) for a in amounts], "claim_amount decimal(9,2)")
    levels = {r.risk_level: r.claims for r in claims_plan.claims_risk_levels(df).collect()}
    assert levels == {"LOW": 4, "MEDIUM": 2, "HIGH": 2, "CRITICAL": 1}
    flags = {r.cost_flag: r.claims for r in claims_plan.claims_cost_flags(df).collect()}
    assert flags == {"LOW_COST": 1, "STANDARD_COST": 2, "VERY_HIGH_COST": 6}


def test_results_do_not_depend_on_partitioning(spark, tiny):
    from claimweave.sources.payer import view

    rows = view(spark, tiny, "claims")
    want = claims_plan.claims_cost_summary(rows).first()
    for n in (1, 13):
        assert claims_plan.claims_cost_summary(rows.repartition(n).orderBy(F.rand(n))).first() == want


def test_duplicate_provider_rows_multiply_as_in_a_plain_join(spark):
    claims = spark.createDataFrame(
        [(1, "A", D("5.00"), D("2.00"), "Denied", dt.date(2023, 1, 1)), (1, "A", D("7.00"), D("3.00"), "Denied", dt.date(2023, 2, 1)),
         (2, "A", D("1.00"), D("4.00"), "Denied", dt.date(2022, 12, 31))],
        "provider_id long, procedure_code string, billed_amount decimal(9,2), paid_amount decimal(9,2), claim_status string, service_date date")
    people = spark.createDataFrame([(1, "X", "S"), (1, "X", "S"), (2, "Y", "S")], "provider_id long, provider_name string, specialty string")
    report = claims_plan.denied_claims_report(claims, people, since="2023-01-01").collect()
    assert [tuple(r) for r in report] == [(1, "X", "A", 4, 24.0)]
    board = providers.provider_dashboard(claims, people, since="2023-01-01").collect()
    assert [(r.provider_id, r.total_claims, r.total_paid_amount, r.avg_paid_amount) for r in board] == [(1, 4, 10.0, 2.5)]
