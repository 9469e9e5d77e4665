"""The physical plans: what is read, shuffled and sorted."""

import re

import pytest

from claimweave.registry import QUERIES


#: Queries over record files: Arrow reads the bytes, all else is native.
FILES = ("claim_file", "churn_from_member_file")


@pytest.fixture
def plan(spark, tiny):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def text(name):
        return QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()

    yield text
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_native_and_without_cross_joins(plan, name):
    text = plan(name)
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", *(() if name in FILES else ("Python",)), "MapInPandas", "ArrowEval", "Expand"):
        assert forbidden not in text, forbidden


@pytest.mark.parametrize("name", ["claims_cost_summary", "churn_summary", "prior_auth_summary_report", "dq_summary", "screening_summary"])
def test_one_pass_reports(plan, name):
    text = plan(name)
    assert text.count("Exchange") == 1 and "SinglePartition" in text


def test_service_date_reaches_the_scan(plan):
    text = plan("denied_claims_report")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate,1998-01-01T00:00\)", text)
    assert "l_tax" not in text and "l_quantity" not in text


def test_claims_shrink_before_the_provider_join(plan):
    for name in ("denied_claims_report", "provider_dashboard", "network_analysis"):
        text = plan(name)
        join = text.index("SortMergeJoin")
        assert "partial_count(1)" in text[join:], name


def test_dashboard_ranks_only_the_top_rows(plan):
    text = plan("provider_dashboard")
    assert text.index("Window") < text.index("TakeOrderedAndProject(limit=20")


def test_hierarchy_needs_no_window(plan):
    text = plan("hcc_hierarchy_scores")
    assert "Window" not in text and "partial_min" in text


@pytest.mark.parametrize("name", ["latest_per_key", "keep_top_rows"])
def test_top_rows_are_cut_before_the_shuffle(plan, name):
    assert re.search(r"WindowGroupLimit.*Partial", plan(name))


@pytest.mark.parametrize("name", ["stored_member_costs", "stored_provider_costs"])
def test_stored_tables_merge_without_an_exchange(plan, name):
    text = plan(name)
    assert "SortMergeJoin" in text and "Exchange" not in text and "SelectedBucketsCount: 16 out of 16" in text
