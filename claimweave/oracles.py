"""DuckDB statements that state each registered query independently.

They are written from the definitions of the reports, over the same views:
plain joins, windows over whole groups, distinct counts and RE2 patterns.
"""

from __future__ import annotations

from claimweave.plans import claims, members, prior_auth, providers, risk, screening
from claimweave.registry import ALL_TABLES, AS_OF, SINCE
from claimweave.sources.payer import portable

# White space and word characters as the Unicode classes Spark's patterns use.
_S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_W = r"[\p{L}\p{M}\p{N}_]"


def _with(*views: str, **ctes: str) -> str:
    parts = [f"{v} AS ({portable(v)})" for v in views]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def _cut(num: str, den: str, unit: int = 10000) -> str:
    """Percentage (or other ratio) of whole numbers with two decimals, cut."""
    return f"CASE WHEN {den} > 0 THEN CAST((CAST({num} AS HUGEINT) * {unit}) // CAST({den} AS HUGEINT) AS DOUBLE) / 100 END"


def _rounded(num: str, den: str) -> str:
    return (f"CASE WHEN {den} > 0 THEN CAST((CAST({num} AS HUGEINT) * 20000 + {den}) // (2 * CAST({den} AS HUGEINT)) "
            f"AS DOUBLE) / 100 END")


def _cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS HUGEINT)"


def _avg_money(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({_cents(total)} // {n} AS DOUBLE) / 100 END"


def _unpivot(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


def _lines(name: str, layout, extra: str = "", keys: str = "", texts: tuple[str, ...] = ()) -> str:
    """The lines of a report whose row is the statement ``name``."""
    def columns(column: str) -> str:
        value = f"CAST({'NULL' if column in texts else column} AS DOUBLE) AS value"
        return value + (f", CAST({column if column in texts else 'NULL'} AS VARCHAR) AS text" if texts else "")

    return f"WITH report AS (SELECT *{extra} FROM ({ORACLES[name]}))\n" + _unpivot([
        f"SELECT {keys}CAST({i} AS INT) AS seq, '{section}' AS section, '{label}' AS label, {columns(column)} FROM report"
        for i, (section, label, column) in enumerate(layout, 1)])


_ELIGIBLE = ("gender = 'F' AND age >= 50 AND age <= 74 AND enrollment_status = 'ACTIVE' "
             "AND enrollment_months = 12")
_CODES = "procedure_code IN ('77065', '77066', '77067')"

ORACLES: dict[str, str] = {}

ORACLES["screening_summary"] = _with("members", "claims",
    den=f"""SELECT count(*) AS denominator,
        count(*) FILTER (age <= 59) AS age_50_59,
        count(*) FILTER (age > 59 AND age <= 69) AS age_60_69,
        count(*) FILTER (age > 69) AS age_70_74 FROM members WHERE {_ELIGIBLE}""",
    num=f"SELECT count(*) AS numerator FROM claims WHERE {_CODES}") + f"""
SELECT denominator, numerator, coalesce({_cut('numerator', 'denominator')}, 0) AS compliance_rate,
  age_50_59, age_60_69, age_70_74 FROM den, num"""

ORACLES["screening_member_rate"] = _with("members", "claims",
    t=f"""SELECT count(DISTINCT member_id) AS denominator,
      count(DISTINCT CASE WHEN member_id IN (SELECT member_id FROM claims WHERE {_CODES}) THEN member_id END) AS numerator
      FROM members WHERE {_ELIGIBLE}""") + f"""
SELECT denominator, numerator, coalesce({_cut('numerator', 'denominator')}, 0) AS compliance_rate FROM t"""


def _age_groups(measure: str) -> str:
    return _with("hedis_measures",
        t=f"""SELECT age_group, CAST(sum(denominator) AS BIGINT) AS denominator, CAST(sum(numerator) AS BIGINT) AS numerator
        FROM hedis_measures WHERE measure_id = '{measure}' AND age BETWEEN 50 AND 74 AND measure_year = 2023
        AND exclusion = 0 GROUP BY age_group""") + f"""
SELECT age_group, denominator, numerator, {_rounded('numerator', 'denominator')} AS compliance_pct FROM t"""


ORACLES["measure_by_age_group"] = _age_groups("BCS")
ORACLES["colorectal_summary"] = _age_groups("COL")
ORACLES["diabetes_summary"] = _age_groups("CDC")

ORACLES["measure_distinct_members"] = _with("hedis_measures") + """
SELECT age_group, count(DISTINCT member_id) AS denominator,
  count(DISTINCT CASE WHEN numerator = 1 THEN member_id END) AS numerator
FROM hedis_measures WHERE measure_id = 'BCS' GROUP BY age_group"""

ORACLES["measure_crosstab"] = _with("hedis_measures") + """
SELECT age_group, numerator AS compliant, count(*) AS n FROM hedis_measures
WHERE measure_id = 'BCS' GROUP BY age_group, numerator"""

_COST = dict(
    t="""SELECT count(*) AS total_claims,
      count(*) FILTER (claim_status IN ('APPROVED', 'PARTIAL')) AS approved_claims,
      count(*) FILTER (claim_status = 'DENIED') AS denied_claims,
      count(*) FILTER (claim_amount > 50000) AS high_cost_claims,
      coalesce(sum(claim_amount), 0) AS billed,
      coalesce(sum(paid_amount) FILTER (claim_status IN ('APPROVED', 'PARTIAL')), 0) AS paid,
      coalesce(sum(denied_amount) FILTER (claim_status IN ('DENIED', 'PARTIAL')), 0) AS denied FROM claims""",
    s=f"""SELECT total_claims, approved_claims, denied_claims, high_cost_claims,
      CAST(billed AS DOUBLE) AS total_billed, CAST(paid AS DOUBLE) AS total_paid, CAST(denied AS DOUBLE) AS total_denied,
      {_avg_money('billed', 'total_claims')} AS avg_claim, {_avg_money('paid', 'approved_claims')} AS avg_paid,
      {_cut('approved_claims', 'total_claims')} AS approval_rate, {_cut('denied_claims', 'total_claims')} AS denial_rate,
      {_cut('paid * 100', 'billed * 100')} AS paid_pct FROM t""")
ORACLES["claims_cost_summary"] = _with("claims", **_COST) + "SELECT * FROM s"
ORACLES["claims_cost_lines"] = _lines("claims_cost_summary", claims.COST_REPORT)
ORACLES["screening_lines"] = _lines("screening_summary", screening.SCREENING_REPORT)

ORACLES["claims_risk_levels"] = _with("claims") + """
SELECT CASE WHEN claim_amount > 100000 THEN 'CRITICAL' WHEN claim_amount > 50000 THEN 'HIGH'
  WHEN claim_amount > 10000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  count(*) AS claims, CAST(sum(claim_amount) AS DOUBLE) AS total_amount FROM claims GROUP BY 1"""

ORACLES["claims_cost_flags"] = _with("claims") + """
SELECT CASE WHEN claim_amount < 1000 THEN 'LOW_COST' WHEN claim_amount >= 1000 AND claim_amount < 10000
  THEN 'STANDARD_COST' ELSE 'VERY_HIGH_COST' END AS cost_flag, count(*) AS claims FROM claims GROUP BY 1"""

ORACLES["denied_claims_report"] = _with("claims", "providers") + f"""
SELECT provider_id, provider_name, procedure_code, count(*) AS denied_claim_count,
  CAST(sum(billed_amount) AS DOUBLE) AS total_billed_amount
FROM claims JOIN providers USING (provider_id)
WHERE claim_status = 'Denied' AND service_date >= DATE '{SINCE}' GROUP BY ALL"""

_CHURN = """SELECT *, CAST(CASE WHEN premium_amount > 500 THEN 30 ELSE 0 END + CASE WHEN claims_last_year < 2 THEN 25 ELSE 0 END
  - CASE WHEN total_cost_last_yr > 50000 THEN 20 ELSE 0 END + CASE WHEN age < 30 THEN 20 ELSE 0 END AS INT) AS churn_score
  FROM members"""
_FAMILY = """CASE WHEN plan_type IN ('MEDICARE', 'MEDICARE-ADVANTAGE') THEN 'MEDICARE'
  WHEN plan_type IN ('COMMERCIAL', 'INDIVIDUAL', 'GROUP') THEN 'COMMERCIAL' END"""
ORACLES["member_churn_scores"] = _with("members", s=_CHURN) + """
SELECT member_id, churn_score, CASE WHEN churn_score >= 70 THEN 'CRITICAL' WHEN churn_score >= 50 THEN 'HIGH'
  WHEN churn_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category FROM s"""
ORACLES["churn_summary"] = _with("members", s=_CHURN, t=f"""
SELECT count(*) AS total, count(*) FILTER (enrollment_status = 'ACTIVE') AS active,
  count(*) FILTER (enrollment_status IN ('TERMINATED', 'SUSPENDED')) AS termed,
  count(*) FILTER (churn_score >= 50) AS high_risk,
  count(*) FILTER ({_FAMILY} = 'MEDICARE') AS medicare, count(*) FILTER ({_FAMILY} = 'COMMERCIAL') AS commercial FROM s""") + f"""
SELECT *, {_cut('termed', 'total')} AS churn_rate, {_cut('active', 'total')} AS retention_rate FROM t"""
ORACLES["plan_family_counts"] = _with("members") + f"SELECT {_FAMILY} AS plan_family, count(*) AS members FROM members GROUP BY 1"
ORACLES["enrollment_trends"] = _with("members") + """
SELECT CAST(year(enrollment_date) AS INT) AS enrollment_year, CAST(month(enrollment_date) AS INT) AS enrollment_month, plan_id,
  count(member_id) AS new_enrollments,
  CAST(sum(count(member_id)) OVER (PARTITION BY plan_id ORDER BY year(enrollment_date), month(enrollment_date)
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_enrollments
FROM members WHERE enrollment_status = 'ACTIVE' GROUP BY year(enrollment_date), month(enrollment_date), plan_id"""


def _raf(weight: str, tail: str, *extra: str, **ctes: str) -> str:
    return _with("members", "diagnoses", *extra,
        d=f"""SELECT member_id,
          count(*) FILTER (hcc_code IN ('HCC17', 'HCC18', 'HCC19')) AS n_d,
          count(*) FILTER (hcc_code = 'HCC85') AS n_f,
          count(*) FILTER (hcc_code IN ('HCC111', 'HCC112')) AS n_p FROM diagnoses GROUP BY member_id""",
        p="""SELECT member_id, plan_type,
          CASE WHEN gender = 'M' THEN CASE WHEN age >= 85 THEN 15000 WHEN age >= 75 THEN 13000 WHEN age >= 65 THEN 11000
              WHEN age >= 55 THEN 9000 ELSE 8000 END
            ELSE CASE WHEN age >= 85 THEN 14500 WHEN age >= 75 THEN 12500 WHEN age >= 65 THEN 10500
              WHEN age >= 55 THEN 8500 ELSE 7500 END END AS a,
          CASE WHEN disabled_flag = 'Y' THEN CASE WHEN original_entitled = 'Y' THEN 5000 ELSE 3000 END ELSE 0 END AS b,
          coalesce(n_d, 0) AS n_d, coalesce(n_f, 0) AS n_f, coalesce(n_p, 0) AS n_p FROM members LEFT JOIN d USING (member_id)""",
        raf=f"""SELECT member_id, plan_type, CAST(a AS DOUBLE) / 10000 AS age_sex_factor, CAST(b AS DOUBLE) / 10000 AS disabled_factor,
          CAST({weight} AS DOUBLE) / 10000 AS hcc_factor, CAST(10000 + a + b + {weight} AS DOUBLE) / 10000 AS total_raf_score,
          n_d > 0 AS has_diabetes, n_f > 0 AS has_chf, n_p > 0 AS has_copd FROM p""", **ctes) + tail


_PER_ROW = "(n_d * 3180 + n_f * 4190 + n_p * 3280)"
_ONCE = "(least(n_d, 1) * 3180 + least(n_f, 1) * 4190 + least(n_p, 1) * 3280)"
ORACLES["member_raf_scores"] = _raf(_PER_ROW, "SELECT * EXCLUDE (plan_type) FROM raf")
ORACLES["member_raf_scores_once"] = _raf(_ONCE, "SELECT * EXCLUDE (plan_type) FROM raf")
ORACLES["raf_report"] = _raf(_PER_ROW, """
SELECT count(*) AS members_scored, count(*) FILTER (total_raf_score > 3.0) AS high_raf_count,
  CAST(0.318 AS DOUBLE) AS weight_diabetes, CAST(0.419 AS DOUBLE) AS weight_chf, CAST(0.328 AS DOUBLE) AS weight_copd FROM raf""")
ORACLES["raf_means_by_plan"] = _raf(_PER_ROW, """
SELECT plan_type, round(avg(total_raf_score), 6) AS avg, round(stddev_samp(total_raf_score), 6) AS stddev,
  min(total_raf_score) AS min, max(total_raf_score) AS max FROM raf GROUP BY plan_type""")

_KEPT = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY member_id, disease_group
  ORDER BY risk_score DESC, hcc_code, hierarchical_flag) AS rn FROM risk_scores WHERE risk_year = 2023)
  WHERE hierarchical_flag = 0 OR rn = 1"""
_HIERARCHY = """SELECT member_id, CAST(sum(risk_score) AS DOUBLE) AS total_risk_score, CAST(max(risk_score) AS DOUBLE) AS max_hcc_score,
  count(hcc_code) AS hcc_count, CASE WHEN sum(risk_score) < 1.0 THEN 'Low Risk' WHEN sum(risk_score) < 2.0 THEN 'Medium Risk'
  ELSE 'High Risk' END AS risk_category FROM kept GROUP BY member_id"""
ORACLES["hcc_hierarchy_scores"] = _with("risk_scores", kept=_KEPT) + _HIERARCHY
ORACLES["risk_stratification"] = _with("risk_scores", kept=_KEPT, h=_HIERARCHY) + \
    "SELECT risk_category, count(*) AS members FROM h GROUP BY 1"
ORACLES["keep_top_rows"] = _with("risk_scores", kept=_KEPT) + \
    "SELECT * REPLACE (CAST(risk_score AS DOUBLE) AS risk_score) FROM kept"

_SLOTS = " ".join(f"WHEN '{code}' THEN {round(w * 1000)}" for code, w in risk.SLOT_WEIGHTS.items())
ORACLES["hcc_array_scores"] = _with("diagnoses") + f"""
SELECT member_id, string_agg(hcc_code, ',' ORDER BY hcc_code) AS hcc_slots,
  CAST(sum(CASE hcc_code {_SLOTS} ELSE 0 END) AS DOUBLE) / 1000 AS hcc_score_sum
FROM (SELECT member_id, hcc_code, row_number() OVER (PARTITION BY member_id ORDER BY hcc_code) AS slot
      FROM (SELECT DISTINCT member_id, hcc_code FROM diagnoses)) GROUP BY member_id"""
ORACLES["hcc_detail"] = _with("diagnoses") + \
    "SELECT member_id, hcc_code, count(*) AS diagnoses FROM diagnoses GROUP BY 1, 2"

ORACLES["provider_performance"] = _with("providers", "provider_claims",
    t="""SELECT p.provider_id, provider_name, specialty, count(c.provider_id) AS claims,
      count(*) FILTER (claim_status IN ('APPROVED', 'PARTIAL')) AS approved,
      coalesce(sum(claim_amount), 0) AS charges, coalesce(sum(paid_amount), 0) AS paid, sum(quality_score) AS quality
      FROM providers p LEFT JOIN provider_claims c ON p.provider_id = c.provider_id GROUP BY ALL""",
    r=f"""SELECT provider_id, provider_name, specialty, claims, approved, {_cut('approved', 'claims')} AS approval_rate,
      CAST(charges AS DOUBLE) AS total_charges, CAST(paid AS DOUBLE) AS total_paid, {_avg_money('charges', 'claims')} AS avg_claim,
      {_cut('quality', 'claims', 100)} AS avg_quality FROM t""",
    e="""SELECT *, CAST(CASE WHEN avg_quality >= 90 THEN 40 WHEN avg_quality >= 80 THEN 30 WHEN avg_quality >= 70 THEN 20 ELSE 10 END
      + CASE WHEN approval_rate >= 95 THEN 30 WHEN approval_rate >= 90 THEN 25 WHEN approval_rate >= 85 THEN 20 ELSE 10 END
      + CASE WHEN avg_claim < 200 THEN 30 WHEN avg_claim < 500 THEN 20 WHEN avg_claim < 1000 THEN 15 ELSE 10 END AS INT)
      AS efficiency_score FROM r""") + """
SELECT *, CASE WHEN efficiency_score >= 90 THEN 'TIER 1' WHEN efficiency_score >= 75 THEN 'TIER 2'
  WHEN efficiency_score >= 60 THEN 'TIER 3' ELSE 'NEEDS IMPROVEMENT' END AS tier FROM e"""

_DASHBOARD = _with("claims", "providers",
    m=f"""SELECT p.provider_id, provider_name, specialty, count(*) AS total_claims,
      count(*) FILTER (claim_status = 'Paid') AS paid_claims, count(*) FILTER (claim_status = 'Denied') AS denied_claims,
      sum(paid_amount) AS amount, count(paid_amount) AS n FROM claims c JOIN providers p ON c.provider_id = p.provider_id
      WHERE service_date >= DATE '{SINCE}' GROUP BY ALL""") + f"""
SELECT provider_id, provider_name, specialty, total_claims, paid_claims, denied_claims,
  CAST(amount AS DOUBLE) AS total_paid_amount,
  CAST(({_cents('amount')} * 20000 + n) // (2 * n) AS DOUBLE) / 1000000 AS avg_paid_amount,
  {_rounded('paid_claims', 'total_claims')} AS pay_rate_pct,
  rank() OVER (PARTITION BY specialty ORDER BY amount DESC) AS specialty_rank FROM m"""
ORACLES["provider_dashboard"] = _DASHBOARD + " ORDER BY amount DESC, provider_id LIMIT 20"
ORACLES["provider_dashboard_all"] = _DASHBOARD

_TIMED = f"""SELECT auth_id, auth_status, CAST(date_diff('day', request_date, coalesce(approval_date, DATE '{AS_OF}')) AS INT)
  AS turnaround_days FROM prior_auth_summary"""
_BANDED = """SELECT *, CASE WHEN turnaround_days <= 3 THEN 'FAST' WHEN turnaround_days <= 7 THEN 'STANDARD'
  WHEN turnaround_days <= 14 THEN 'SLOW' ELSE 'OVERDUE' END AS category FROM timed"""
ORACLES["prior_auth_detail"] = _with("prior_auth_summary", timed=_TIMED) + _BANDED
ORACLES["prior_auth_summary_report"] = _with("prior_auth_summary", timed=_TIMED, banded=_BANDED,
    t="""SELECT count(*) - count(*) FILTER (auth_status = 'WITHDRAWN') AS total_requests,
      count(*) FILTER (auth_status = 'APPROVED') AS approved, count(*) FILTER (auth_status = 'DENIED') AS denied,
      count(*) FILTER (auth_status = 'PENDING') AS pending, count(*) FILTER (category = 'FAST') AS fast,
      count(*) FILTER (category = 'STANDARD') AS standard, count(*) FILTER (category = 'SLOW') AS slow,
      count(*) FILTER (category = 'OVERDUE') AS overdue, sum(turnaround_days) AS days,
      CAST(min(turnaround_days) AS BIGINT) AS min_days, CAST(max(turnaround_days) AS BIGINT) AS max_days FROM banded""") + f"""
SELECT * EXCLUDE (days), {_cut('days', 'total_requests', 100)} AS avg_days, {_cut('approved', 'total_requests')} AS approval_rate,
  {_cut('denied', 'total_requests')} AS denial_rate, {_cut('fast', 'total_requests')} AS fast_pct,
  {_cut('(fast + standard)', 'total_requests')} AS sla_compliance FROM t"""

ORACLES["manifest"] = _unpivot([
    f"SELECT '{name}' AS table_name, count(*) AS actual_rows, CAST({rows} AS BIGINT) AS expected_rows, coalesce(count(*) = {rows}, false) AS complete FROM {name}"
    for name, rows in (("region", 5), ("nation", 25), ("supplier", "NULL"))])
ORACLES["typed_members"] = _with("members") + """
SELECT * REPLACE (CAST(age AS BIGINT) AS age, CAST(enrollment_months AS BIGINT) AS enrollment_months,
  CAST(claims_last_year AS BIGINT) AS claims_last_year, CAST(premium_amount AS DOUBLE) AS premium_amount,
  CAST(total_cost_last_yr AS DOUBLE) AS total_cost_last_yr) FROM members"""
ORACLES["table_row_counts"] = _unpivot([
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in ALL_TABLES])

ORACLES["high_cost_members"] = _with("claims") + """
SELECT member_id, count(*) AS claims, CAST(sum(claim_amount) AS DOUBLE) AS total_amount FROM claims GROUP BY member_id
ORDER BY sum(claim_amount) DESC, member_id LIMIT 100"""
ORACLES["utilization_trends"] = _with("claims") + """
SELECT CAST(year(service_date) AS INT) AS year, CAST(month(service_date) AS INT) AS month, claim_type, count(*) AS claims,
  CAST(sum(count(*)) OVER (PARTITION BY claim_type ORDER BY year(service_date), month(service_date)
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_claims
FROM claims GROUP BY year(service_date), month(service_date), claim_type"""
ORACLES["cost_trends"] = _with("claims") + """
SELECT CAST(year(service_date) AS INT) AS year, CAST(month(service_date) AS INT) AS month, count(*) AS claims,
  CAST(sum(claim_amount) AS DOUBLE) AS billed, CAST(sum(paid_amount) AS DOUBLE) AS paid FROM claims GROUP BY 1, 2"""
ORACLES["network_analysis"] = _with("claims", "providers") + """
SELECT network_status, count(DISTINCT provider_id) AS providers, count(*) AS claims,
  CAST(sum(claim_amount) AS DOUBLE) AS total_billed, CAST(sum(paid_amount) AS DOUBLE) AS total_paid
FROM claims JOIN providers USING (provider_id) GROUP BY network_status"""
ORACLES["quality_metrics"] = _with("claims", "providers") + """
SELECT specialty, round(avg(quality_score), 6) AS avg, round(stddev_samp(quality_score), 6) AS stddev,
  CAST(min(quality_score) AS DOUBLE) AS min, CAST(max(quality_score) AS DOUBLE) AS max
FROM claims JOIN providers USING (provider_id) GROUP BY specialty"""
ORACLES["member_segmentation"] = _with("members") + f"""
SELECT CASE WHEN age < 30 THEN 'under 30' WHEN age < 50 THEN '30-49' WHEN age < 65 THEN '50-64' ELSE '65 and over' END AS age_band,
  {_FAMILY} AS plan_family, count(*) AS members FROM members GROUP BY 1, 2"""
ORACLES["approval_rates"] = _with("prior_auth_summary", t="""
SELECT reviewer_id, count(*) AS requests, count(*) FILTER (auth_status = 'APPROVED') AS approved,
  count(*) FILTER (auth_status = 'DENIED') AS denied FROM prior_auth_summary WHERE auth_status <> 'WITHDRAWN' GROUP BY reviewer_id""") + f"""
SELECT *, {_cut('approved', 'requests')} AS approval_rate, {_cut('denied', 'requests')} AS denial_rate FROM t"""
ORACLES["denial_analysis"] = _with("prior_auth_summary") + """
SELECT reviewer_id, count(*) AS denied, CAST(sum(auth_amount) AS DOUBLE) AS denied_amount
FROM prior_auth_summary WHERE auth_status = 'DENIED' GROUP BY reviewer_id"""


def _check(name: str, column: str, rule: str, source: str) -> str:
    return (f"SELECT '{name}' AS \"check\", '{column}' AS \"column\", count(*) FILTER ({rule}) AS violations "
            f"FROM {source}")


def _unique(column: str, source: str) -> str:
    return _check("unique", column, "n > 1", f"(SELECT count(*) AS n FROM {source} GROUP BY {column})")


ORACLES["dq_claims"] = _with("claims") + _unpivot([
    _check("not_null", "claim_amount", "claim_amount IS NULL", "claims"),
    _check("non_negative", "paid_amount", "paid_amount < 0", "claims"),
    _check("at_most", "claim_amount", "claim_amount > 100000", "claims"),
    _check("not_null", "service_date", "service_date IS NULL", "claims"),
    _check("not_future", "service_date", "service_date > DATE '2000-06-30'", "claims"),
    _check("not_older", "service_date", f"service_date < DATE '{AS_OF}' - INTERVAL 60 MONTH", "claims"),
    _unique("claim_id", "claims"),
    _check("has_parent", "doc_id", "doc_id NOT IN (SELECT doc_id FROM labels)", "documents"),
])
ORACLES["dq_members"] = _with("members") + _unpivot([
    _check("not_null", "member_id", "member_id IS NULL", "members"),
    _check("within", "age", "age < 0 OR age > 85", "members"),
    _check("absent_when_active", "termination_date",
           "enrollment_status = 'ACTIVE' AND termination_date IS NOT NULL", "members"),
    _check("not_null", "termination_date", "termination_date IS NULL", "members"),
    _check("not_above_termination_date", "enrollment_date", "enrollment_date > termination_date", "members"),
    _unique("member_id", "members"),
    _unique("plan_id", "members"),
])
ORACLES["dq_hedis_measures"] = _with("hedis_measures") + _unpivot([
    _check("not_above_denominator", "numerator", "numerator > denominator", "hedis_measures"),
    _check("not_null", "exclusion", "exclusion IS NULL", "hedis_measures"),
    _check("within", "measure_year", "measure_year NOT BETWEEN 2020 AND 2022", "hedis_measures"),
    _check("at_most", "compliance_pct", "pct > 100", """(SELECT sum(numerator) * 100.0 / sum(denominator) AS pct
      FROM hedis_measures WHERE measure_id = 'BCS' AND age BETWEEN 50 AND 74 AND measure_year = 2023 AND exclusion = 0
      GROUP BY age_group)"""),
])
ORACLES["dq_raf_scores"] = _raf(_PER_ROW, _unpivot([
    _check("not_null", "total_raf_score", "total_raf_score IS NULL", "raf"),
    _check("non_negative", "total_raf_score", "total_raf_score < 0", "raf"),
    _check("at_most", "total_raf_score", "total_raf_score > 4.0", "raf"),
]))
ORACLES["dq_tables"] = _with("providers", "prior_auth_summary",
    lines="SELECT o_orderdate, l_shipdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    marked="SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id") + _unpivot([
    _check("non_negative", "c_acctbal", "c_acctbal < 0", "customer"),
    _check("at_most", "contract_rate", "contract_rate > 100", "providers"),
    _check("absent_when_withdrawn", "approval_date", "auth_status = 'WITHDRAWN' AND approval_date IS NOT NULL", "prior_auth_summary"),
    _check("not_above_l_shipdate", "o_orderdate", "o_orderdate > l_shipdate", "lines"),
    _check("not_null", "quality", "quality IS NULL", "marked"),
    _check("not_above_quality", "toxic", "toxic > quality", "marked"),
    _unique("l_orderkey", "lineitem"),
])
ORACLES["dq_prior_auth"] = _with("prior_auth_summary") + _unpivot([
    _check("not_null", "approval_date", "approval_date IS NULL", "prior_auth_summary"),
    _check("not_above_approval_date", "request_date", "request_date > approval_date", "prior_auth_summary"),
    _check("at_most", "auth_amount", "auth_amount > 400000", "prior_auth_summary"),
])
ORACLES["dq_reconciliation"] = _with("claims") + """
SELECT 'row_count' AS measure, CAST(count(*) AS DOUBLE) AS source_total, CAST(4 AS DOUBLE) AS result_total,
  CAST(count(*) - 4 AS DOUBLE) AS difference, count(*) = 4 AS matched FROM claims
UNION ALL SELECT 'claim_amount', CAST(sum(claim_amount) AS DOUBLE), CAST(sum(claim_amount) AS DOUBLE), 0.0, true FROM claims"""
ORACLES["dq_summary"] = _with("claims") + _unpivot([
    f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
    round(avg(CAST({c} AS DOUBLE)), 6) AS avg, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev FROM claims"""
    for c in ("claim_amount", "paid_amount", "quality_score")])
ORACLES["null_profile"] = _with("members") + \
    "SELECT 'termination_date' AS \"column\", count(*) AS nulls FROM members WHERE termination_date IS NULL HAVING count(*) > 0"

_BLANK = rf"NOT regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')"
ORACLES["corpus_validity"] = _with("sources",
    t=f"""SELECT file_id, {_BLANK} AS empty, list_bool_or([contains(upper(text), k) FOR k IN
      ['PROC', 'DATA', 'RUN', 'QUIT', 'SELECT', 'FROM', 'LIBNAME']]) AS known FROM sources""") + """
SELECT file_id, NOT empty AND known AS is_valid, CASE WHEN empty THEN 'empty' WHEN NOT known THEN 'no_keyword' ELSE 'ok' END AS reason
FROM t"""

_PROFILE = dict(
    t=rf"""SELECT file_id, string_split(text, chr(10)) AS lines, text, upper(text) AS up,
      list_sort(list_distinct(regexp_extract_all(text, 'PROC{_S}+({_W}+)', 1, 'i'))) AS procs FROM sources""",
    f=rf"""SELECT file_id, len(lines) AS line_count,
      len(list_filter(lines, lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]'))) AS non_empty_lines,
      array_to_string(procs, ',') AS procs_used, contains(up, 'PROC SQL') AS has_sql, contains(up, 'PROC FREQ') AS has_freq,
      regexp_matches(text, 'DATA{_S}+{_W}+', 'i') AS has_data_step, contains(up, 'LIBNAME') AS has_libname,
      contains(text, '%') AS has_macro,
      len(regexp_extract_all(text, 'FROM{_S}+(?:{_W}|\.)+|DATA{_S}+(?:{_W}|\.)+', 0, 'i')) AS table_references,
      len(procs) AS proc_count FROM t""",
    pr="""SELECT *, CASE WHEN proc_count <= 1 AND NOT has_macro AND line_count < 50 THEN 'Simple'
      WHEN has_macro OR proc_count >= 3 OR line_count > 200 THEN 'Complex' ELSE 'Medium' END AS complexity FROM f""")
ORACLES["corpus_profile"] = _with("sources", **_PROFILE) + "SELECT * FROM pr"
ORACLES["corpus_complexity"] = _with("sources", **_PROFILE) + \
    "SELECT complexity, count(*) AS files FROM pr GROUP BY complexity"


def _rule(name: str, severity: str, condition: str) -> str:
    return f"SELECT file_id, '{name}' AS rule, '{severity}' AS severity FROM sources WHERE {condition}"


# RE2 has no look-ahead: an aggregate lacks its cast when fewer matches are
# followed by one than there are matches.
_AGGREGATE = r"F\.(?:sum|avg|min|max|percentile_approx|stddev|variance|count|countDistinct)\([^)]+\)"
_DATE_CAST = _rule("casting_date_columns", "MEDIUM",
                   r"regexp_matches(text, '(?i)(F\.to_date|CAST\([^)]*date[^)]*AS DATE)')")
ORACLES["corpus_lint"] = _with("sources") + _unpivot([
    _rule("python_boolean_in_when", "HIGH", rf"regexp_matches(text, '(?i)F\.when\({_S}*{_W}+{_S}*[><=!]+')"),
    _rule("missing_cast_aggregation", "HIGH",
          rf"len(regexp_extract_all(text, '(?i){_AGGREGATE}')) > len(regexp_extract_all(text, '(?i){_AGGREGATE}{_S}*\.cast'))"),
    _DATE_CAST,
    _rule("persist_or_cache", "MEDIUM", r"regexp_matches(text, '(?i)\.(persist|cache)\(')"),
])
ORACLES["corpus_lint_sql"] = _with("sources") + _unpivot([
    _DATE_CAST,
    _rule("ambiguous_select_star", "MEDIUM", rf"regexp_matches(text, '(?im-s)SELECT{_S}+\*.*?FROM.*?(?:WHERE|GROUP|ORDER|$)')"),
    _rule("unused_pyspark_import_in_sql", "LOW", r"regexp_matches(text, '(?im-s)from pyspark\.sql import.*?F\b')"),
    _rule("pure_sql_in_mixed_mode", "HIGH",
          rf"""regexp_matches(text, '(?im-s)spark\.sql{_S}*\({_S}*f?["'']{{3}}{_S}*CREATE{_S}+OR{_S}+REPLACE{_S}+TABLE.*?SELECT{_S}+\*{_S}*,')"""),
])

_STAR = rf"SELECT{_S}+\*{_S}*,{_S}*{_W}+"


def _output(issues: dict[str, str], warnings: dict[str, str], corrections: dict[str, str]) -> str:
    def joined(rules):
        cases = ", ".join(f"CASE WHEN {rule} THEN '{label}' END" for label, rule in rules.items())
        return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"

    return _with("sources", t=f"SELECT file_id, {joined(issues)} AS issues, {joined(warnings)} AS warnings, "
                 f"{joined(corrections)} AS corrections FROM sources") + \
        "SELECT *, issues = '' AS is_valid FROM t"


_NO_SOURCE = "NOT contains(text, 'payer_dev.analytics_gold')"
ORACLES["corpus_output_checks"] = _output(
    {"no_dataframe_code": "NOT contains(text, 'spark.') AND NOT contains(text, 'df.')"},
    {"missing_source_namespace": _NO_SOURCE,
     "missing_target_catalog": "NOT contains(text, 'payer_analyst_dev')", "very_short": "length(text) < 50"},
    {"none": "false"})
ORACLES["corpus_output_checks_sql"] = _output(
    {"select_star_with_columns": f"regexp_matches(text, '(?i){_STAR}')",
     "create_select_star_with_columns":
         f"regexp_matches(text, '(?i)CREATE{_S}+(OR{_S}+REPLACE{_S}+)?(TEMP{_S}+VIEW|TABLE)[^;]*?{_STAR}')"},
    {"missing_source_namespace": _NO_SOURCE,
     "missing_functions_import": "NOT contains(text, 'from pyspark.sql import functions as F')",
     "very_short": "length(text) < 50"},
    {"add_columns_on_the_frame": f"regexp_matches(text, '(?i){_STAR}')",
     "add_columns_after_the_select":
         f"regexp_matches(text, '(?i)CREATE{_S}+(OR{_S}+REPLACE{_S}+)?(TEMP{_S}+VIEW|TABLE)[^;]*?{_STAR}')"})

_FENCE = r"(?is)```(?:python|sql|py|pyspark)?\n?(.*?)```"
_TRIM = rf"^{_S}+|{_S}+$"
ORACLES["corpus_code_blocks"] = _with("replies") + rf"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{_FENCE}')
  THEN replace(regexp_replace(regexp_extract(text, '{_FENCE}', 1), '{_TRIM}', '', 'g'), '```', '')
  ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_TRIM}', '', 'g'),
    '(?im)^```(?:python|sql|py|pyspark)?$', '', 'g'), '(?m)^```$', '', 'g'), '{_TRIM}', '', 'g') END AS code
FROM replies"""

ORACLES["corpus_preview"] = _with("sources", t="SELECT file_id, text, string_split(text, chr(10)) AS lines FROM sources") + """
SELECT file_id, CASE WHEN len(lines) <= 3 THEN text ELSE array_to_string(lines[1:3], chr(10)) || chr(10) || chr(10) || '... (' ||
  CAST(len(lines) - 3 AS VARCHAR) || ' more lines)' END AS preview FROM t"""


def _cobol_name(ext: str) -> str:
    name = "filename"
    for suffix in (".cbl", ".cobol", ".cob"):
        name = f"replace({name}, '{suffix}', '_converted{ext}')"
    return name


ORACLES["corpus_output_names"] = _with("sources") + f"""
SELECT file_id, {_cobol_name('.py')} AS python_name, {_cobol_name('.sql')} AS sql_name, {_cobol_name('')} AS notebook_name,
  replace(replace(filename, '.sas', ''), '.SAS', '') || '_converted.sql' AS sas_name FROM sources"""
ORACLES["batch_stats"] = _with("results") + """
SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
  coalesce(CAST(count(*) FILTER (success) AS DOUBLE) / nullif(count(*), 0) * 100, 0) AS success_rate,
  coalesce(avg(execution_time), 0) AS avg_execution_time FROM results"""
ORACLES["batch_report"] = _with("results", named="""
SELECT * REPLACE (coalesce(filename, 'File ' || CAST(seq AS VARCHAR)) AS filename, coalesce(output_type, 'N/A') AS output_type) FROM results""") + f"""
SELECT seq, filename, output_type,
  CASE WHEN success THEN CASE WHEN output_type = 'PySpark Notebook' THEN {_cobol_name('')} WHEN output_type = 'SQL (DBSQL)' THEN {_cobol_name('.sql')}
    ELSE {_cobol_name('.py')} END END AS output_file,
  CASE WHEN success THEN coalesce(source_name, 'N/A') END AS source_name, CASE WHEN success THEN coalesce(target_name, 'N/A') END AS target_name,
  CASE WHEN success THEN 'Success' ELSE 'Failed' END AS status, printf('%.2f', execution_time) || 's' AS execution_time,
  CASE WHEN success THEN validation_status END AS validation,
  CASE WHEN NOT success THEN coalesce(error, 'Unknown error') END AS error FROM named"""

_RECORDS = _with("claims") + """
SELECT claim_id, member_id, CAST(provider_id AS INT) AS provider_id, service_date,
  CASE claim_type WHEN 'Professional' THEN 'PROF' WHEN 'Institutional' THEN 'INST' ELSE 'RX' END AS claim_type, procedure_code, diagnosis_code, claim_amount, paid_amount,
  denied_amount, claim_status FROM claims"""
ORACLES["records_packed"] = _RECORDS
ORACLES["records_fixed"] = _RECORDS
ORACLES["claims_cost_from_records"] = ORACLES["claims_cost_summary"]
ORACLES["churn_from_records"] = ORACLES["churn_summary"]

ORACLES["claim_file"] = _RECORDS
ORACLES["churn_from_member_file"] = ORACLES["churn_summary"]
ORACLES["stored_member_costs"] = _with("claims", "members") + """
SELECT m.member_id, plan_id, coalesce(claims, 0) AS claims, paid, last_service FROM members m LEFT JOIN
  (SELECT member_id, count(*) AS claims, CAST(sum(paid_amount) AS DOUBLE) AS paid, max(service_date) AS last_service FROM claims GROUP BY member_id) c
  ON m.member_id = c.member_id"""
ORACLES["stored_provider_costs"] = _with("claims", "providers") + """
SELECT p.provider_id, specialty, coalesce(claims, 0) AS claims, denied FROM providers p LEFT JOIN
  (SELECT provider_id, count(*) AS claims, CAST(sum(denied_amount) AS DOUBLE) AS denied FROM claims GROUP BY provider_id) c
  ON p.provider_id = c.provider_id"""

ORACLES["join_left"] = _with("claims", "members") + """
SELECT m.member_id, plan_id, claims FROM members m LEFT JOIN
  (SELECT member_id, count(*) AS claims FROM claims GROUP BY member_id) c ON m.member_id = c.member_id"""
ORACLES["join_right"] = """
SELECT d.doc_id, marks, d.source FROM (SELECT doc_id, count(*) AS marks FROM labels GROUP BY doc_id) l
RIGHT JOIN documents d ON l.doc_id = d.doc_id"""
ORACLES["join_semi"] = _with("claims", "members") + """
SELECT member_id, plan_id FROM members m WHERE EXISTS (SELECT 1 FROM claims c WHERE c.member_id = m.member_id AND claim_amount > 40000)"""
ORACLES["join_anti"] = _with("claims", "members") + """
SELECT member_id, count(*) AS child_rows FROM claims c WHERE NOT EXISTS
  (SELECT 1 FROM members m WHERE m.member_id = c.member_id AND enrollment_status = 'ACTIVE') GROUP BY member_id"""
ORACLES["join_as"] = _with("claims", "members") + """
SELECT member_id, plan_type, count(*) AS claims FROM members JOIN claims USING (member_id) GROUP BY ALL"""
ORACLES["latest_per_key"] = """
SELECT conv_id, turn, role, length(text) AS chars FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, length(text)) = 1"""
ORACLES["rank_within_type"] = """
SELECT p_partkey, p_type, p_retailprice, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS price_rank FROM part"""
ORACLES["freq"] = _with("claims") + "SELECT claim_status, count(*) AS claims FROM claims GROUP BY 1"
ORACLES["freq2"] = _with("claims") + "SELECT claim_type, claim_status, count(*) AS claims FROM claims GROUP BY 1, 2"
ORACLES["freq2_wide"] = _with("claims") + """
SELECT claim_type, count(*) FILTER (claim_status = 'APPROVED') AS "n_APPROVED", count(*) FILTER (claim_status = 'PARTIAL') AS "n_PARTIAL",
  count(*) FILTER (claim_status = 'DENIED') AS "n_DENIED" FROM claims GROUP BY 1"""
ORACLES["band_counts"] = _with("members") + """
SELECT gender, count(*) FILTER (age < 30) AS under_30, count(*) FILTER (age >= 30 AND age < 65) AS age_30_64,
  count(*) FILTER (age >= 65) AS age_65_up, count(*) FILTER (age >= 65 AND age < 85) AS medicare_age FROM members GROUP BY gender"""
ORACLES["means"] = _with("claims") + """
SELECT claim_type, round(avg(CAST(claim_amount AS DOUBLE)), 6) AS avg, round(stddev_samp(CAST(claim_amount AS DOUBLE)), 6) AS stddev,
  CAST(min(claim_amount) AS DOUBLE) AS min, CAST(max(claim_amount) AS DOUBLE) AS max FROM claims GROUP BY 1"""
ORACLES["percentiles"] = """
SELECT l_returnflag, quantile_disc(l_quantity, 0.25) AS p25, quantile_disc(l_quantity, 0.5) AS p50,
  quantile_disc(l_quantity, 0.9) AS p90, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1"""
ORACLES["exact_percentiles"] = """
SELECT l_returnflag, quantile_disc(l_extendedprice, 0.01) AS p1, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.5) AS p50,
  quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1"""
ORACLES["checked_load"] = ORACLES["freq"]
ORACLES["published_load"] = ORACLES["freq"]
ORACLES["exact_moments"] = _with("claims", units="SELECT claim_type, claim_amount AS x, CAST(claim_amount * 100 AS HUGEINT) AS u FROM claims",
    sums="SELECT claim_type, count(x) AS n, CAST(sum(u) AS HUGEINT) AS s, CAST(sum(u * u) AS HUGEINT) AS q, min(x) AS lo, max(x) AS hi FROM units GROUP BY 1",
    parts="SELECT *, n * q - s * s AS squares FROM sums") + """
SELECT claim_type, n, CAST(s AS DOUBLE) / (n * 100.0::DOUBLE) AS avg, v AS variance, sqrt(v) AS stddev, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max
FROM (SELECT *, (CAST((squares + n - 1) // n AS DOUBLE) - CAST((n - squares % n) % n AS DOUBLE) / n) / ((n - 1) * 10000.0::DOUBLE) AS v FROM parts)"""
ORACLES["reconcile_by_provider"] = _with("claims") + """
SELECT provider_id, claim_type, count(*) AS source_rows, count(*) FILTER (claim_status = 'APPROVED') AS result_rows,
  CAST(sum(claim_amount) AS DOUBLE) AS source_amount, CAST(coalesce(sum(claim_amount) FILTER (claim_status = 'APPROVED'), 0) AS DOUBLE) AS result_amount
FROM claims GROUP BY 1, 2 HAVING count(*) <> count(*) FILTER (claim_status = 'APPROVED')"""
ORACLES["date_math"] = _with("prior_auth_summary") + """
SELECT auth_id, year(request_date) AS year, month(request_date) AS month,
  CAST(request_date - INTERVAL 60 MONTH AS DATE) AS five_years_before, date_diff('day', request_date, approval_date) AS days,
  request_date AS parsed, CAST(NULL AS DATE) AS unset
FROM prior_auth_summary WHERE request_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""
ORACLES["string_basics"] = """
WITH t AS (SELECT *, c_custkey * 997 AS n, CAST(CAST(c_acctbal AS DECIMAL(12,4)) * 10000 AS HUGEINT) AS units FROM customer),
u AS (SELECT *, CASE WHEN n < 1048576 THEN 1024 ELSE 1048576 END AS unit FROM t),
v AS (SELECT *, n * 10 // unit AS q, n * 10 % unit AS r FROM u),
w AS (SELECT *, q + CASE WHEN r * 2 > unit OR (r * 2 = unit AND q % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM v)
SELECT c_custkey, upper(c_name) AS upper_name, substring(c_name, 1, 8) AS name_start, true AS same_segment,
  CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) ||
    CASE unit WHEN 1024 THEN ' KB' ELSE ' MB' END END AS size,
  CAST(sign(units) * (abs(units) // 700) AS DOUBLE) / 100 AS stored, abs(c_acctbal) AS magnitude FROM w"""
ORACLES["top_k"] = """
SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey ORDER BY orders DESC, o_custkey LIMIT 25"""

ORACLES["churn_lines"] = _lines(
    "churn_summary", members.CHURN_REPORT,
    extra=", 500 AS premium_threshold, 2 AS claims_threshold, 50000 AS cost_threshold")
ORACLES["raf_lines"] = _lines("raf_report", risk.RAF_REPORT)
ORACLES["provider_lines"] = _lines("provider_performance", providers.PERFORMANCE_REPORT, keys="provider_id, ", texts=("provider_name", "specialty", "tier"))
ORACLES["raf_member_lines"] = _lines("member_raf_scores", risk.MEMBER_REPORT, keys="member_id, ")
ORACLES["prior_auth_lines"] = _lines("prior_auth_summary_report", prior_auth.TURNAROUND_REPORT)
