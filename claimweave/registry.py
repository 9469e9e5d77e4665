"""The registered queries: every operator over the payer views of a table directory."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import dates, text as tx
from claimweave.functions.expr import unpadded_equals
from claimweave.functions.pic import store
from claimweave.operators import quality as dq
from claimweave.operators import relational as rel
from claimweave.operators import scripts, stats
from claimweave.plans import claims, members, named, prior_auth, providers, risk, screening
from claimweave.sources import layouts
from claimweave.sources.payer import SCHEMAS, table, view
from claimweave.sources.record_files import read_records, write_records
from claimweave.sources.records import decode_records, encode_records
from claimweave.sources.tables import load_manifest, publish, report_lines, shared_folder, stack_counts, stored_by, typed

# Parameters of the registered queries; the claim lines run from 1995 to 2001.
SINCE = "1998-01-01"
AS_OF = "2001-12-31"
ALL_TABLES = tuple(SCHEMAS)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _claims(spark, sf, **kw):
    """Claim lines for reports that never look at the member."""
    return view(spark, sf, "claims", member=False, **kw)


# Screening.

@query
def screening_summary(spark, sf):
    return screening.screening_summary(view(spark, sf, "members"), _claims(spark, sf))


@query
def screening_lines(spark, sf):
    return report_lines(screening_summary(spark, sf), screening.SCREENING_REPORT)


@query
def screening_member_rate(spark, sf):
    return screening.screening_member_rate(view(spark, sf, "members"), view(spark, sf, "claims"))


@query
def measure_by_age_group(spark, sf):
    return screening.measure_by_age_group(view(spark, sf, "hedis_measures"))


@query
def measure_distinct_members(spark, sf):
    return screening.measure_distinct_members(view(spark, sf, "hedis_measures"))


@query
def measure_crosstab(spark, sf):
    return screening.measure_crosstab(view(spark, sf, "hedis_measures"))


# Claims.

@query
def claims_cost_summary(spark, sf):
    return claims.claims_cost_summary(_claims(spark, sf))


@query
def claims_cost_lines(spark, sf):
    return report_lines(claims.claims_cost_summary(_claims(spark, sf)), claims.COST_REPORT)


@query
def claims_risk_levels(spark, sf):
    return claims.claims_risk_levels(_claims(spark, sf))


@query
def claims_cost_flags(spark, sf):
    return claims.claims_cost_flags(_claims(spark, sf))


@query
def denied_claims_report(spark, sf):
    return claims.denied_claims_report(
        _claims(spark, sf, since=SINCE), view(spark, sf, "providers"), since=SINCE)


# Members.

@query
def member_churn_scores(spark, sf):
    return members.member_churn_scores(view(spark, sf, "members"))


@query
def churn_summary(spark, sf):
    return members.churn_summary(view(spark, sf, "members"))


@query
def churn_lines(spark, sf):
    return report_lines(members.with_thresholds(churn_summary(spark, sf)), members.CHURN_REPORT)


@query
def plan_family_counts(spark, sf):
    return members.plan_family_counts(view(spark, sf, "members"))


@query
def enrollment_trends(spark, sf):
    return members.enrollment_trends(view(spark, sf, "members"))


# Risk.

def _raf(spark, sf, **kw):
    return risk.member_raf_scores(view(spark, sf, "members"), view(spark, sf, "diagnoses"), **kw)


@query
def member_raf_scores(spark, sf):
    return _raf(spark, sf)


@query
def member_raf_scores_once(spark, sf):
    return _raf(spark, sf, dedupe="category")


@query
def raf_report(spark, sf):
    return risk.applied_weights(risk.raf_report(_raf(spark, sf)))


@query
def raf_lines(spark, sf):
    return report_lines(raf_report(spark, sf), risk.RAF_REPORT)


@query
def raf_member_lines(spark, sf):
    return report_lines(member_raf_scores(spark, sf), risk.MEMBER_REPORT, keys=["member_id"])


@query
def hcc_hierarchy_scores(spark, sf):
    return risk.hcc_hierarchy_scores(view(spark, sf, "risk_scores"))


@query
def hcc_array_scores(spark, sf):
    scored = risk.hcc_array_scores(view(spark, sf, "diagnoses"))
    return scored.withColumn("hcc_slots", F.array_join("hcc_slots", ","))


@query
def raf_means_by_plan(spark, sf):
    return risk.raf_means_by_plan(_raf(spark, sf, keep=("plan_type",)))


# Providers.

@query
def provider_performance(spark, sf):
    return providers.provider_performance(
        view(spark, sf, "providers"), view(spark, sf, "provider_claims", member=False))


@query
def provider_lines(spark, sf):
    return report_lines(provider_performance(spark, sf), providers.PERFORMANCE_REPORT, keys=["provider_id"])


def _dashboard(spark, sf, k):
    return providers.provider_dashboard(
        _claims(spark, sf, since=SINCE), view(spark, sf, "providers"), since=SINCE, k=k)


@query
def provider_dashboard(spark, sf):
    return _dashboard(spark, sf, 20)


@query
def provider_dashboard_all(spark, sf):
    return _dashboard(spark, sf, None)


# Prior authorisation.

@query
def prior_auth_detail(spark, sf):
    return prior_auth.prior_auth_detail(view(spark, sf, "prior_auth_summary"), as_of=AS_OF)


@query
def prior_auth_summary_report(spark, sf):
    return prior_auth.prior_auth_summary_report(view(spark, sf, "prior_auth_summary"), as_of=AS_OF)


@query
def prior_auth_lines(spark, sf):
    return report_lines(prior_auth_summary_report(spark, sf), prior_auth.TURNAROUND_REPORT)


@query
def manifest(spark, sf):
    """Loaded rows against the sizes that never change."""
    return load_manifest({name: table(spark, sf, name) for name in ("region", "nation", "supplier")}, {"region": 5, "nation": 25})


@query
def typed_members(spark, sf):
    return typed(view(spark, sf, "members"))


@query
def table_row_counts(spark, sf):
    return stack_counts({name: table(spark, sf, name) for name in ALL_TABLES})


# Outputs defined here, not by the reference programs.

@query
def colorectal_summary(spark, sf):
    return named.colorectal_summary(view(spark, sf, "hedis_measures"))


@query
def diabetes_summary(spark, sf):
    return named.diabetes_summary(view(spark, sf, "hedis_measures"))


@query
def hcc_detail(spark, sf):
    return named.hcc_detail(view(spark, sf, "diagnoses"))


@query
def risk_stratification(spark, sf):
    return named.risk_stratification(risk.hcc_hierarchy_scores(view(spark, sf, "risk_scores")))


@query
def high_cost_members(spark, sf):
    return named.high_cost_members(view(spark, sf, "claims"))


@query
def utilization_trends(spark, sf):
    return named.utilization_trends(_claims(spark, sf))


@query
def cost_trends(spark, sf):
    return named.cost_trends(_claims(spark, sf))


@query
def network_analysis(spark, sf):
    return named.network_analysis(_claims(spark, sf), view(spark, sf, "providers"))


@query
def quality_metrics(spark, sf):
    return named.quality_metrics(_claims(spark, sf), view(spark, sf, "providers"))


@query
def member_segmentation(spark, sf):
    return named.member_segmentation(view(spark, sf, "members"))


@query
def approval_rates(spark, sf):
    return named.approval_rates(view(spark, sf, "prior_auth_summary"))


@query
def denial_analysis(spark, sf):
    return named.denial_analysis(view(spark, sf, "prior_auth_summary"))


# Data quality.

@query
def dq_claims(spark, sf):
    rows = _claims(spark, sf)
    return dq.all_checks(
        dq.run_checks(rows, [
            dq.not_null("claim_amount"),
            dq.non_negative("paid_amount"),
            dq.at_most("claim_amount", 100000),
            dq.not_null("service_date"),
            dq.not_future("service_date", "2000-06-30"),
            dq.not_older("service_date", 60, AS_OF),
        ]),
        dq.duplicate_keys(rows, "claim_id"),
        dq.missing_parents(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id"),
    )


@query
def dq_members(spark, sf):
    rows = view(spark, sf, "members")
    return dq.all_checks(
        dq.run_checks(rows, [
            dq.not_null("member_id"),
            dq.within("age", 0, 85),
            dq.absent_when("termination_date", F.col("enrollment_status") == "ACTIVE", "active"),
            dq.not_null("termination_date"),
            dq.not_above("enrollment_date", "termination_date"),
        ]),
        dq.duplicate_keys(rows, "member_id"),
        dq.duplicate_keys(rows, "plan_id"),
    )


@query
def dq_hedis_measures(spark, sf):
    rates = screening.measure_by_age_group(view(spark, sf, "hedis_measures"))
    return dq.all_checks(
        dq.run_checks(view(spark, sf, "hedis_measures"), [
            dq.not_above("numerator", "denominator"),
            dq.not_null("exclusion"),
            dq.within("measure_year", 2020, 2022),
        ]),
        dq.run_checks(rates, [dq.at_most("compliance_pct", 100)]),
    )


@query
def dq_raf_scores(spark, sf):
    return dq.run_checks(_raf(spark, sf), [
        dq.not_null("total_raf_score"), dq.non_negative("total_raf_score"), dq.at_most("total_raf_score", 4.0),
    ])


@query
def dq_tables(spark, sf):
    """Rules on columns of the tables that break them."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    marked = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return dq.all_checks(
        dq.run_checks(table(spark, sf, "customer"), [dq.non_negative("c_acctbal")]),
        dq.run_checks(view(spark, sf, "providers"), [dq.at_most("contract_rate", 100)]),
        dq.run_checks(view(spark, sf, "prior_auth_summary"), [
            dq.absent_when("approval_date", F.col("auth_status") == "WITHDRAWN", "withdrawn")]),
        dq.run_checks(lines, [dq.not_above("o_orderdate", "l_shipdate")]),
        dq.run_checks(marked, [dq.not_null("quality"), dq.not_above("toxic", "quality")]),
        dq.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey"),
    )


@query
def dq_prior_auth(spark, sf):
    return dq.run_checks(view(spark, sf, "prior_auth_summary"), [
        dq.not_null("approval_date"),
        dq.not_above("request_date", "approval_date"),
        dq.at_most("auth_amount", 400000),
    ])


@query
def dq_reconciliation(spark, sf):
    """Claims against the risk-level report: totals must agree, row counts do not."""
    report = claims.claims_risk_levels(_claims(spark, sf))
    return dq.reconcile(_claims(spark, sf), report, {"claim_amount": ("claim_amount", "total_amount")})


@query
def dq_summary(spark, sf):
    return dq.summary(_claims(spark, sf), ["claim_amount", "paid_amount", "quality_score"])


@query
def null_profile(spark, sf):
    return dq.null_profile(view(spark, sf, "members"))


# Source corpus.

@query
def corpus_validity(spark, sf):
    return scripts.validity(view(spark, sf, "sources")).select("file_id", "is_valid", "reason")


@query
def corpus_profile(spark, sf):
    profiled = scripts.profile(view(spark, sf, "sources"), "file_id")
    return profiled.withColumn("procs_used", F.array_join("procs_used", ","))


@query
def corpus_complexity(spark, sf):
    return scripts.complexity_counts(scripts.profile(view(spark, sf, "sources"), "file_id"))


@query
def corpus_lint(spark, sf):
    return scripts.lint(view(spark, sf, "sources"), "file_id", "PySpark Notebook").drop("advice")


@query
def corpus_lint_sql(spark, sf):
    return scripts.lint(view(spark, sf, "sources"), "file_id", "SQL (DBSQL)", all_rules=True).drop("advice")


def _checked(spark, sf, dialect):
    checked = scripts.output_checks(view(spark, sf, "sources"), "file_id", dialect)
    return checked.withColumns({c: F.array_join(c, ",") for c in ("issues", "warnings", "corrections")})


@query
def corpus_output_checks(spark, sf):
    return _checked(spark, sf, "PySpark")


@query
def corpus_output_checks_sql(spark, sf):
    return _checked(spark, sf, "SQL")


@query
def corpus_code_blocks(spark, sf):
    return view(spark, sf, "replies").select(
        "conv_id", "turn", scripts.code_block(F.col("text")).alias("code"))


@query
def corpus_preview(spark, sf):
    return scripts.preview(view(spark, sf, "sources"), "file_id", 3)


@query
def corpus_output_names(spark, sf):
    name = F.col("filename")
    return view(spark, sf, "sources").select(
        "file_id",
        scripts.output_name(name, "PySpark").alias("python_name"),
        scripts.output_name(name, "SQL").alias("sql_name"),
        scripts.output_name(name, "PySpark", notebook=True).alias("notebook_name"),
        scripts.output_name(name, "SQL", family="sas").alias("sas_name"),
    )


@query
def batch_stats(spark, sf):
    return scripts.batch_stats(view(spark, sf, "results"))


@query
def batch_report(spark, sf):
    return scripts.batch_report(view(spark, sf, "results"))


# Record files, written to bytes and read back.

def _record_claims(spark, sf):
    return view(spark, sf, "claims").select(
        "claim_id", "member_id", "provider_id", "service_date",
        F.when(F.col("claim_type") == "Professional", "PROF").when(F.col("claim_type") == "Institutional", "INST")
        .otherwise("RX").alias("claim_type"),
        "procedure_code", "diagnosis_code",
        "claim_amount", "paid_amount", "denied_amount", "claim_status",
    )


@query
def records_packed(spark, sf):
    encoded = encode_records(_record_claims(spark, sf), layouts.CLAIM, packed=True)
    return decode_records(encoded, "record", layouts.CLAIM, packed=True)


@query
def records_fixed(spark, sf):
    encoded = encode_records(_record_claims(spark, sf), layouts.CLAIM, packed=False)
    return decode_records(encoded, "record", layouts.CLAIM, packed=False)


# Reports over record files, equal to the reports over the tables.

@query
def claims_cost_from_records(spark, sf):
    return claims.claims_cost_summary(records_packed(spark, sf))


def _record_members(spark, sf):
    return view(spark, sf, "members").select(
        "member_id", F.lit("").alias("first_name"), "last_name", F.lit(None).cast("date").alias("date_of_birth"), "gender", "age",
        "enrollment_date", "termination_date", "enrollment_status", "plan_type", "premium_amount", "claims_last_year", "total_cost_last_yr")


@query
def churn_from_records(spark, sf):
    encoded = encode_records(_record_members(spark, sf), layouts.CHURN_MEMBER, packed=True)
    return members.churn_summary(decode_records(encoded, "record", layouts.CHURN_MEMBER, packed=True))


# The same as files, in ranges of a megabyte.

@query
def claim_file(spark, sf):
    """Every claim written to packed record files and read back."""
    path = shared_folder(spark)
    write_records(_record_claims(spark, sf), path, layouts.CLAIM, packed=True)
    return read_records(spark, path, layouts.CLAIM, packed=True, range_bytes=1 << 20)


@query
def churn_from_member_file(spark, sf):
    """The churn report over a file of display fields, a line a member."""
    path = shared_folder(spark)
    write_records(_record_members(spark, sf), path, layouts.CHURN_MEMBER, packed=False, delimiter=b"\n")
    return members.churn_summary(read_records(spark, path, layouts.CHURN_MEMBER, packed=False, delimiter=b"\n", range_bytes=1 << 20))


# Reports over tables stored bucketed by their control key.

def _stored(spark, sf, name, key):
    """A payer view kept by ``key``; its stamp names the files it is made from."""
    sources = {"claims": ("lineitem", "orders"), "members": ("customer",), "providers": ("supplier",)}[name]
    stamp = zlib.crc32("\n".join(f for s in sources for f in sorted(table(spark, sf, s).inputFiles())).encode())
    return stored_by(spark, f"{name}_by_{key}", key, lambda: view(spark, sf, name), buckets=16, stamp=str(stamp))


@query
def stored_member_costs(spark, sf):
    """Every member with its claims, merged bucket by bucket."""
    costs = rel.master_detail(
        _stored(spark, sf, "members", "member_id").select("member_id", "plan_id"), _stored(spark, sf, "claims", "member_id"), "member_id",
        [F.count(F.lit(1)).alias("claims"), F.sum("paid_amount").cast("double").alias("paid"), F.max("service_date").alias("last_service")], zero=["claims"])
    return costs.select("member_id", "plan_id", "claims", "paid", "last_service")


@query
def stored_provider_costs(spark, sf):
    """Every provider with its claims, merged bucket by bucket."""
    costs = rel.master_detail(
        _stored(spark, sf, "providers", "provider_id").select("provider_id", "specialty"), _stored(spark, sf, "claims", "provider_id"), "provider_id",
        [F.count(F.lit(1)).alias("claims"), F.sum("denied_amount").cast("double").alias("denied")], zero=["claims"])
    return costs.select("provider_id", "specialty", "claims", "denied")


# Primitives.

@query
def join_left(spark, sf):
    claimed = view(spark, sf, "claims").groupBy("member_id").agg(F.count(F.lit(1)).alias("claims"))
    return view(spark, sf, "members").select("member_id", "plan_id").join(claimed, "member_id", "left")


@query
def join_right(spark, sf):
    """Labels, which cover some documents, against all documents."""
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("marks"))
    return marks.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "right")


@query
def join_semi(spark, sf):
    found = rel.with_event(
        view(spark, sf, "members"), view(spark, sf, "claims"), "member_id", F.col("claim_amount") > 40000)
    return found.select("member_id", "plan_id")


@query
def join_anti(spark, sf):
    """Claims of members outside the register, by member."""
    register = view(spark, sf, "members").filter("enrollment_status = 'ACTIVE'")
    return rel.orphans(view(spark, sf, "claims"), register, "member_id")


@query
def join_as(spark, sf):
    """Members joined to their claim counts on text keys."""
    counts = view(spark, sf, "claims").groupBy(F.col("member_id").cast("string").alias("member_id")).agg(
        F.count(F.lit(1)).alias("claims"))
    people = view(spark, sf, "members").select("member_id", "plan_type")
    return rel.join_as(people, counts, "member_id", "long")


@query
def latest_per_key(spark, sf):
    """The last turn of each conversation."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    order = [F.desc("turn"), F.col("role"), F.col("chars")]
    return rel.latest_per(turns, "conv_id", order).withColumn("chars", F.col("chars").cast("long"))


@query
def keep_top_rows(spark, sf):
    """Risk rows that survive the hierarchy."""
    rows = view(spark, sf, "risk_scores").filter("risk_year = 2023")
    order = [F.desc("risk_score"), F.col("hcc_code"), F.col("hierarchical_flag")]
    kept = rel.keep_top(rows, ("member_id", "disease_group"), order, F.col("hierarchical_flag") == 0)
    return kept.withColumn("risk_score", F.col("risk_score").cast("double"))


@query
def rank_within_type(spark, sf):
    """Rank of every part by price within its type."""
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    return rel.rank_within(parts, "p_type", "p_retailprice", "price_rank")


@query
def freq(spark, sf):
    return stats.freq(_claims(spark, sf), "claim_status", "claims")


@query
def freq2(spark, sf):
    return stats.freq2(_claims(spark, sf), "claim_type", "claim_status", "claims")


@query
def freq2_wide(spark, sf):
    return stats.freq2(_claims(spark, sf), "claim_type", "claim_status", "n",
                       values=("APPROVED", "PARTIAL", "DENIED"))


@query
def band_counts(spark, sf):
    age = F.col("age")
    return stats.band_counts(view(spark, sf, "members"), {
        "under_30": age < 30, "age_30_64": age.between(30, 64), "age_65_up": age >= 65,
        "medicare_age": age.between(65, 84),
    }, by=["gender"])


@query
def means(spark, sf):
    return stats.means(_claims(spark, sf), "claim_type", "claim_amount")


@query
def percentiles(spark, sf):
    return stats.percentiles(
        table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", (0.25, 0.5, 0.9))


@query
def date_math(spark, sf):
    rows = view(spark, sf, "prior_auth_summary").filter(
        dates.in_period(F.col("request_date"), "1996-01-01", "1999-12-31"))
    asked = F.col("request_date")
    return rows.select(
        "auth_id",
        F.year(asked).cast("long").alias("year"), F.month(asked).cast("long").alias("month"),
        dates.months_after(asked, -60).alias("five_years_before"),
        dates.days_between(asked, F.col("approval_date")).cast("long").alias("days"),
        dates.to_day(F.date_format(asked, "yyyyMMdd")).alias("parsed"),
        dates.to_day(F.lit("00000000")).alias("unset"),
    )


@query
def string_basics(spark, sf):
    rows = table(spark, sf, "customer")
    name = F.col("c_name")
    return rows.select(
        "c_custkey",
        F.upper(name).alias("upper_name"),
        F.substring(name, 1, 8).alias("name_start"),
        unpadded_equals(F.rpad("c_mktsegment", 12, " "), F.col("c_mktsegment")).alias("same_segment"),
        tx.file_size(F.col("c_custkey") * 997).alias("size"),
        store(F.col("c_acctbal").cast("decimal(12,4)") / F.lit(7).cast("decimal(3,0)"), 2)
        .cast("double").alias("stored"),
        F.abs("c_acctbal").alias("magnitude"),
    )


@query
def top_k(spark, sf):
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return rel.top_k(spend, [F.desc("orders"), F.col("o_custkey")], 25)


@query
def exact_percentiles(spark, sf):
    """Price percentiles per return flag, exact although the values are many."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return stats.exact_percentiles(lines, "l_returnflag", "l_extendedprice", ["0.01", "0.25", "0.5", "0.9", "0.99"])


@query
def checked_load(spark, sf):
    """Claims loaded under checks that the write observes, counted from the table they became."""
    rows = _claims(spark, sf)
    dq.load_checked(rows, "checked_claims", {
        "no_claim_id": F.col("claim_id").isNull(), "negative_amount": F.col("claim_amount") < 0, "no_service_date": F.col("service_date").isNull()})
    return stats.freq(spark.table("checked_claims"), "claim_status", "claims")


@query
def exact_moments(spark, sf):
    """Claim amounts per type, equal to the last bit on any partitioning."""
    return stats.exact_moments(_claims(spark, sf), "claim_type", "claim_amount")


@query
def reconcile_by_provider(spark, sf):
    """Providers whose claims are not all paid out: the rows and amounts on both sides."""
    rows = _claims(spark, sf)
    paid = rows.where(F.col("claim_status") == "APPROVED")
    return dq.reconcile_by(rows, paid, ["provider_id", "claim_type"], {"amount": ("claim_amount", "claim_amount")})


@query
def published_load(spark, sf):
    """Claims published twice under one name, the second time with other columns, and read by it."""
    rows = _claims(spark, sf)
    publish(rows.groupBy("claim_status", "claim_type").count(), "published_claims")
    publish(spark.table("published_claims").groupBy("claim_status").agg(F.sum("count").alias("claims")), "published_claims")
    return spark.table("published_claims")
