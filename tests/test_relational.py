"""Joins, windows and statistics on hot keys, NULLs and ties, against plain Python."""

import datetime as dt
import math
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import dates
from claimweave.functions.expr import band_factor, case_of, ladder, points, present
from claimweave.functions.pic import pct, safe_avg, safe_divide, store
from claimweave.operators import relational as rel
from claimweave.operators import stats
from claimweave.plans import providers
from claimweave.sources import tables
from claimweave.sources.synth import ROWS, synth


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one key, with NULLs and many ties."""
    rng = random.Random(3)
    keys = [None, "a", "b"] + ["hot"] * 2
    rows = [(i, rng.choice(keys), rng.choice([None] + list(range(40)))) for i in range(2000)]
    rows += [(i, "hot", 7) for i in range(2000, 3000)]
    return spark.createDataFrame(rows, "id long, k string, v long").repartition(8)


@pytest.mark.parametrize("ranges, large", [(2, 1), (4, 1), (20, 30), (64, 10_000)])
def test_rank_within_equals_rank(hot, ranges, large):
    window = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last())
    want = hot.withColumn("rank", F.rank().over(window).cast("long"))
    assert bag(rel.rank_within(hot, "k", "v", ranges=ranges, large=large)) == bag(want)


def test_large_groups_are_told_by_their_hashes(spark):
    """Only the group of many values is cut; both ways give the same ranks."""
    df = spark.range(30_000).selectExpr("if(id % 10 = 0, 'few', 'many') k", "if(id % 10 = 0, id % 70, id) v").repartition(8)
    window = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last())
    want = df.withColumn("rank", F.rank().over(window).cast("long"))
    assert bag(rel.rank_within(df, "k", "v", large=2000)) == bag(want)


def test_stored_by_writes_once_and_merges(spark):
    made = []

    def make(rows):
        made.append(1)
        return spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(rows)], "k long, v long")

    name = "test_stored_by"
    first = tables.stored_by(spark, name, "k", lambda: make(300), 4, "a")
    again = tables.stored_by(spark, name, "k", lambda: make(300), 4, "a")
    assert len(made) == 1 and bag(first) == bag(again) and first.count() == 300
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = rel.master_detail(first.select("k").distinct(), again, "k", [F.sum("v").alias("total")])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert bag(joined) == bag(make(300).groupBy("k").agg(F.sum("v").alias("total")))
    assert tables.stored_by(spark, name, "k", lambda: make(10), 4, "b").count() == 10
    spark.sql(f"DROP TABLE {name}")


def test_keep_top_equals_the_plain_window(hot):
    window = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    rule = F.col("v") % 5 == 0
    want = hot.withColumn("rn", F.row_number().over(window)).filter(rule | (F.col("rn") == 1)).drop("rn")
    assert bag(rel.keep_top(hot, "k", [F.desc("v"), F.col("id")], rule)) == bag(want)


def test_latest_and_top(hot):
    got = {r.k: r.id for r in rel.latest_per(hot, "k", [F.desc("id")]).collect()}
    want = {}
    for r in hot.collect():
        want[r.k] = max(want.get(r.k, -1), r.id)
    assert got == want
    assert [r.id for r in rel.top_k(hot, [F.desc("id")], 3).collect()] == [2999, 2998, 2997]


def test_dashboard_top_rows_carry_full_ranks(spark):
    rng = random.Random(11)
    people = [(i, f"P{i}", rng.choice("ABC")) for i in range(60)]
    claims = [(rng.randrange(60), D(rng.choice([1, 2, 3])), "Paid", dt.date(2023, 1, 1)) for _ in range(200)]
    pdf = spark.createDataFrame(people, "provider_id long, provider_name string, specialty string")
    cdf = spark.createDataFrame(claims, "provider_id long, paid_amount decimal(9,2), claim_status string, service_date date")
    full = providers.provider_dashboard(cdf, pdf, since="2023-01-01", k=None).collect()
    top = providers.provider_dashboard(cdf, pdf, since="2023-01-01", k=20).collect()
    assert top == full[:20]


def test_joins(spark):
    members = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "m long, p string")
    events = spark.createDataFrame([(1, 10), (1, 90), (2, 5), (9, 99), (9, 98), (None, 1)], "m long, v int")
    assert [r.m for r in rel.with_event(members, events, "m", F.col("v") > 50).collect()] == [1]
    assert bag(rel.orphans(events, members, "m")) == [(9, 2)]
    totals = rel.master_detail(members, events, "m", [F.sum("v").alias("s"), F.count("v").alias("n")], zero=["n"])
    assert bag(totals) == [(1, "x", 100, 2), (2, "y", 5, 1), (3, "z", None, 0)]
    text = events.select(F.col("m").cast("string").alias("m"), "v")
    assert rel.join_as(members, text, "m", "long").count() == 3


def test_running_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", 2)], "p string, o int")
    got = rel.running_total(df, "p", "o", F.count(F.lit(1)), "n", "total")
    assert bag(got.select("p", "o", "n", "total")) == [("a", 1, 2, 2), ("a", 3, 1, 3), ("b", 2, 1, 1)]


def test_distinct_members(spark):
    df = spark.createDataFrame([("g", 1, 0), ("g", 1, 1), ("g", 2, 0), ("g", None, 1), ("h", 1, None)], "a string, m long, n int")
    assert bag(stats.distinct_members(df, "a", "m", F.col("n") == 1)) == [("g", 2, 1), ("h", 1, 0)]


def test_expressions(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (None,)], "v int")
    v = F.col("v")
    got = df.select(
        ladder(v, [(">=", 10, "hi"), (">", 0, "mid")], "low"),
        points([(v > 1, 3), (v > 7, -5)]),
        safe_divide(F.lit(10.0), v),
    ).collect()
    assert [tuple(r) for r in got] == [("low", 0, None), ("mid", 3, 2.0), ("hi", -2, 1.0), ("low", 0, None)]
    words = spark.createDataFrame([("a",), ("  ",), ("",), (None,), ("c",)], "w string")
    w = F.col("w")
    got = words.select(case_of(w, {("a", "b"): 1, "c": 2}), present(w)).collect()
    assert [tuple(r) for r in got] == [(1, True), (None, False), (None, False), (None, False), (2, True)]
    people = spark.createDataFrame([("M", 85), ("M", 84), ("F", 85), (None, 10)], "g string, a int")
    factor = band_factor(F.col("g"), F.col("a"), {"M": [(85, 1)], None: [(85, 3)]}, {"M": 2, None: 4})
    assert [r[0] for r in people.select(factor).collect()] == [1, 2, 3, 4]


def test_exact_arithmetic(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 800), (5, 0), (0, 4)], "n long, d long")
    n, d = F.col("n"), F.col("d")
    got = df.select(pct(n, d), pct(n, d, store="round"), pct(n, d, empty=F.lit(0.0))).collect()
    assert [tuple(r) for r in got] == [
        (33.33, 33.33, 33.33), (66.66, 66.67, 66.66), (0.12, 0.13, 0.12), (None, None, 0.0), (0.0, 0.0, 0.0)]
    money = spark.createDataFrame([(D("-10.00"), 3), (D("20.00"), 3), (D("9999999999999.99"), 1)], "t decimal(16,2), n long")
    t, m = F.col("t"), F.col("n")
    got = money.select(safe_avg(t, m), safe_avg(t, m, 3, "round"), store(t / 3)).collect()
    assert [tuple(r)[:2] for r in got][:2] == [(-3.33, -3.333), (6.66, 6.667)]
    assert [r[2] for r in got][:2] == [D("-3.33"), D("6.66")]
    assert got[2][0] == 9999999999999.99
    for bad in (lambda: pct(n, d, store="up"), lambda: safe_avg(n, d, store="up")):
        with pytest.raises(ValueError):
            bad()


def test_dates(spark):
    df = spark.createDataFrame([("20240229",), ("20230229",), ("00000000",)], "s string")
    assert [r[0] for r in df.select(dates.to_day(F.col("s"))).collect()] == [dt.date(2024, 2, 29), None, None]
    day = spark.range(1).select(dates.day("2024-03-31").alias("d"))
    row = day.select(dates.months_after(F.col("d"), -1), dates.days_between(F.col("d"), dates.day("2024-05-01")),
                     dates.in_period(F.col("d"), "2024-03-31", "2024-04-01"), dates.since(F.col("d"), "2024-04-01")).first()
    assert tuple(row) == (dt.date(2024, 2, 29), 31, True, False)


def test_tables(spark):
    tables.ensure_namespace(spark, "shop", reset=True)
    rows = tables.inline(spark, [(1, "a")], "id long, name string")
    tables.write_table(rows, "shop.t")
    tables.write_table(rows.withColumn("more", F.lit(2)), "shop.t")
    assert tables.gold(spark, "shop.t").columns == ["id", "name", "more"]
    tables.ctas(spark, "shop.u", "SELECT id + 1 AS id FROM {src}", src=tables.gold(spark, "shop.t"))
    assert tables.gold(spark, "shop.u").collect()[0].id == 2
    manifest = tables.load_manifest({"t": tables.gold(spark, "shop.t"), "u": rows.filter("false")}, {"t": 1, "u": 5})
    assert bag(manifest) == [("t", 1, 1, True), ("u", 0, 5, False)]
    assert tables.preview(tables.gold(spark, "shop.t"), 5).count() == 1
    lines = tables.report_lines(rows, [("S", "Id", "id")]).collect()
    assert [tuple(r) for r in lines] == [(1, "S", "Id", 1.0)]
    mixed = spark.sql("SELECT CAST(1 AS DECIMAL(5,2)) a, CAST(2 AS SMALLINT) b, CAST(3 AS FLOAT) c, 'x' d, DATE'2024-01-01' e")
    assert [t for _, t in tables.typed(mixed).dtypes] == ["double", "bigint", "double", "string", "date"]
    with pytest.raises(ValueError):
        tables.gold(spark, "a; drop")
    tables.ensure_namespace(spark, "shop", reset=True)
    assert spark.catalog.listTables("shop") == []


def test_gold_reads_files(spark, tiny):
    assert tables.gold(spark, "lake.raw.region", tiny).count() == 5


@pytest.mark.parametrize("name", sorted(ROWS))
def test_synth_is_stable_and_whole(spark, name):
    one, many = synth(spark, name, 500, partitions=1), synth(spark, name, 500, partitions=7)
    assert bag(one) == bag(many)
    assert bag(synth(spark, name, 500, seed=2)) != bag(one)
    assert synth(spark, name).count() == ROWS[name]


def test_synth_ranges(spark):
    rows = synth(spark, "claims", 4000)
    bad = rows.filter(
        (F.col("paid_amount") + F.col("denied_amount") > F.col("claim_amount")) | (F.col("paid_date") <= F.col("service_date"))
        | ~F.col("claim_amount").between(50, 5000) | ~F.col("quality_score").between(70, 100))
    assert bad.count() == 0
    shares = {r.claim_status: r.n for r in stats.freq(rows, "claim_status").collect()}
    assert 0.36 < shares["Paid"] / 4000 < 0.5
    members = synth(spark, "members", 2000)
    assert members.filter("termination_date IS NOT NULL AND member_status = 'ACTIVE'").count() == 0
    assert synth(spark, "claims", 1000, members=3).select("member_id").distinct().count() == 3


@pytest.mark.parametrize("accuracy", [50, 400])
def test_exact_percentiles(spark, accuracy):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None, "hot", "hot"]), rng.choice([None, rng.random(), float(rng.randrange(9))])) for _ in range(6000)] + [("empty", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    points = ["0", "0.003", "0.25", "0.5", "0.999", "1"]
    got = {r[0]: tuple(r)[1:] for r in stats.exact_percentiles(df.withColumnRenamed("v", "_c"), "k", "_c", points, accuracy).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key] == tuple(values[max(1, math.ceil(D(p) * len(values))) - 1] if values else None for p in points)


def test_percentiles_are_exact_among_many_values(spark):
    # Consecutive values: a sketch that is off by one rank gives another value.
    n = 60_000
    df = spark.range(n, numPartitions=7).select(F.lit("k").alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    points = [i / 40 for i in range(1, 40)]
    row = stats.percentiles(df, "k", "v", points).first()
    assert row[1:-1] == tuple(float(math.ceil(D(str(p)) * n) - 1) for p in points)
    assert math.isclose(row.variance, n * (n + 1) / 12)


def test_exact_moments_do_not_depend_on_partitions(spark):
    from fractions import Fraction

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", D(rng.randrange(-10**9, 10**9)) / 100) for _ in range(3000)]
    # Close values far from zero, where sums of doubles lose the variance.
    rows += [("far", D("9999999999.01") + D(i % 3) / 100) for i in range(999)] + [("one", D("4.20")), ("none", None), (None, D("1.00")), (None, D("-1.00")), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v decimal(14,2)")
    answers = [sorted(map(tuple, stats.exact_moments(df.repartition(n), "k", "v").collect()), key=str) for n in (1, 3, 8)]
    assert answers[0] == answers[1] == answers[2]
    for k, n, avg, variance, stddev, lo, hi in answers[0]:
        values = [Fraction(v) for key, v in rows if key == k and v is not None]
        assert n == len(values)
        if not values:
            assert (avg, variance, stddev, lo, hi) == (None,) * 5
            continue
        mean = sum(values) / n
        assert math.isclose(avg, float(mean), rel_tol=1e-15, abs_tol=1e-15) and (lo, hi) == (float(min(values)), float(max(values)))
        if n == 1:
            assert variance is None and stddev is None
        else:
            exact = float(sum((v - mean) ** 2 for v in values) / (n - 1))
            assert math.isclose(variance, exact, rel_tol=1e-14) and math.isclose(stddev, math.sqrt(exact), rel_tol=1e-14)
    assert stats.exact_moments(df.limit(0), "k", "v").count() == 0
