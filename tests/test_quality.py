"""Data-quality checks with planted violations."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from claimweave.operators import quality as dq
from claimweave.sources import tables

AS_OF = "2024-06-30"


@pytest.fixture(scope="module")
def rows(spark):
    day = dt.date
    data = [
        (1, D("10.00"), day(2024, 1, 1), day(2024, 2, 1), "ACTIVE", 1, 1),
        (1, D("-1.00"), day(2024, 7, 1), day(2024, 2, 1), "ACTIVE", 2, 1),
        (2, None, day(2019, 6, 29), None, "ACTIVE", 0, None),
        (None, D("2000000.00"), None, None, "TERMINATED", None, 1),
        (None, D("5.00"), day(2019, 6, 30), None, None, 1, 1),
    ]
    return spark.createDataFrame(data, "id long, amount decimal(12,2), start date, end date, status string, num int, den int")


def test_row_checks(rows):
    got = dq.run_checks(rows, [
        dq.not_null("id"), dq.non_negative("amount"), dq.at_most("amount", 1000000), dq.not_above("num", "den"),
        dq.not_above("start", "end"), dq.within("num", 0, 1), dq.absent_when("end", F.col("status") == "ACTIVE", "active"),
        dq.not_future("start", AS_OF), dq.not_older("start", 60, AS_OF),
    ]).collect()
    assert [tuple(r) for r in got] == [
        ("not_null", "id", 2), ("non_negative", "amount", 1), ("at_most", "amount", 1), ("not_above_den", "num", 1),
        ("not_above_end", "start", 1), ("within", "num", 1), ("absent_when_active", "end", 2),
        ("not_future", "start", 1), ("not_older", "start", 1),
    ]


def test_key_checks(spark, rows):
    assert dq.duplicate_keys(rows, "id").first().violations == 2  # the key 1 and the NULL key
    parents = spark.createDataFrame([(2,)], "pid long")
    assert dq.missing_parents(rows, parents, "id", "pid").first().violations == 2
    assert dq.missing_parents(rows.filter("false"), parents, "id", "pid").first().violations == 0


def test_profile_and_summary(rows):
    assert {r.column: r.nulls for r in dq.null_profile(rows).collect()} == {
        "id": 2, "amount": 1, "start": 1, "end": 3, "status": 1, "num": 1, "den": 1}
    assert tuple(dq.summary(rows, ["num"]).first()) == ("num", 0.0, 2.0, 1.0, 0.816497)


def test_reconcile_and_enforce(rows):
    pairs = {"amount": ("amount", "amount")}
    same = dq.reconcile(rows, rows.repartition(3), pairs)
    assert [r.matched for r in same.collect()] == [True, True]
    dq.enforce(same)
    less = dq.reconcile(rows, rows.filter("amount <> 5"), pairs)
    assert [(r.measure, r.difference, r.matched) for r in less.collect()] == [("row_count", 2.0, False), ("amount", 5.0, False)]
    with pytest.raises(dq.QualityError, match="row_count: 2.0; amount: 5.0"):
        dq.enforce(less)
    cent = rows.withColumn("amount", F.when(F.col("amount") == 5, D("5.01")).otherwise(F.col("amount")))
    assert [r.matched for r in dq.reconcile(rows, cent, pairs).collect()] == [True, False]

    checks = dq.run_checks(rows, [dq.not_null("id"), dq.non_negative("num")])
    with pytest.raises(dq.QualityError, match="not_null id: 2"):
        dq.enforce(checks)
    dq.enforce(checks, critical=["non_negative"])


def test_checked_load_replaces_only_when_checks_pass(spark):
    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    rule = {"negative": F.col("v") < 0, "no_key": F.col("k").isNull()}
    first = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    assert dq.load_checked(first, "test_checked", rule, {"total": F.sum("v")}) == {"rows": 2, "negative": 0, "no_key": 0, "total": 5}
    with pytest.raises(dq.QualityError, match="negative: 1; no_key: 2"):
        dq.load_checked(spark.createDataFrame([(None, 5), (None, -1)], "k int, v int"), "test_checked", rule)
    assert rows(spark.table("test_checked").where("v IS NOT NULL")) == [(1, 5)]
    failing = spark.createDataFrame([(1, 0)], "k int, v int").select("k", F.assert_true(F.col("v") > 0).cast("int").alias("v"))
    with pytest.raises(Exception):
        dq.load_checked(failing, "test_checked", rule)
    assert spark.table("test_checked").count() == 2
    dq.load_checked(spark.createDataFrame([(7, 7)], "k int, v int"), "test_checked", rule)
    assert rows(spark.table("test_checked")) == [(7, 7)]
    dq.load_checked(spark.createDataFrame([(7, 7, "x")], "k int, v int, w string"), "test_checked", rule)
    assert rows(spark.table("test_checked")) == [(7, 7, "x")]
    spark.sql("DROP TABLE test_checked")


def test_publish_shows_old_rows_or_new(spark, tmp_path):
    def rows():
        return sorted(tuple(r) for r in spark.table("test_published").collect())

    make = spark.createDataFrame
    first = tables.publish(make([(1, 5), (2, None)], "k int, v int"), "test_published", str(tmp_path))
    held = spark.table("test_published")
    failing = make([(1, 0)], "k int, v int").select("k", F.assert_true(F.col("v") > 0).cast("int").alias("v"))
    with pytest.raises(Exception, match="not true"):
        tables.publish(failing, "test_published", str(tmp_path))
    assert rows() == [(1, 5), (2, None)]
    # Other columns, made from the old rows.
    second = tables.publish(spark.table("test_published").select("k", F.lit("x").alias("w")), "test_published", str(tmp_path))
    assert rows() == [(1, "x"), (2, "x")] and first != second
    assert held.count() == 2 and held.columns == ["k", "v"]
    tables.publish(make([], "k int"), "test_published", str(tmp_path))
    assert rows() == []
    spark.sql("DROP VIEW test_published")
    make([(1,)], "k int").write.saveAsTable("test_a_table")
    with pytest.raises(ValueError, match="not a published view"):
        tables.publish(make([(2,)], "k int"), "test_a_table", str(tmp_path))
    assert spark.table("test_a_table").collect()[0].k == 1
    spark.sql("DROP TABLE test_a_table")


def test_reconcile_by_keys(spark):
    schema = "k string, v decimal(9,2)"
    source = spark.createDataFrame([("a", D("1.00")), ("a", D("2.00")), ("b", D("5.00")), (None, D("3.00")), ("same", None), ("near", D("1.00"))], schema)
    result = spark.createDataFrame([("a", D("3.00")), ("b", D("5.01")), ("c", D("7.00")), ("same", None), ("near", D("1.00"))], schema)
    got = {tuple(r) for r in dq.reconcile_by(source, result, ["k"], {"v": ("v", "v")}).collect()}
    assert got == {("a", 2, 1, 3.0, 3.0), ("b", 1, 1, 5.0, 5.01), (None, 1, 0, 3.0, 0.0), ("c", 0, 1, 0.0, 7.0)}
    assert dq.reconcile_by(source, source, ["k"], {"v": ("v", "v")}).count() == 0
    assert dq.reconcile_by(source.limit(0), result, ["k"], {}).columns == ["k", "source_rows", "result_rows"]
