"""Corpus helpers on short texts with results worked out by hand, and on very long ones."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.functions import text as tx
from claimweave.operators import scripts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


# text -> lines, full lines, procedures, sql, freq, data step, libname, macro, references, complexity
PROFILES = [
    ("", (1, 0, [], False, False, False, False, False, 0, "Simple")),
    ("proc means; run;", (1, 1, ["means"], False, False, False, False, False, 0, "Simple")),
    ("PROC SQL;\nselect 1\n from a.b;\n\n", (5, 3, ["SQL"], True, False, False, False, False, 1, "Simple")),
    ("proc freq; proc sort;\ndata out; libname z;", (2, 2, ["freq", "sort"], False, True, True, True, False, 1, "Medium")),
    ("proc a; proc b; proc c; proc a;", (1, 1, ["a", "b", "c"], False, False, False, False, False, 0, "Complex")),
    ("%let x = 1;", (1, 1, [], False, False, False, False, True, 0, "Complex")),
    ("x\n" * 49 + "x", (50, 50, [], False, False, False, False, False, 0, "Medium")),
    ("x\n" * 200, (201, 200, [], False, False, False, False, False, 0, "Complex")),
    ("data\n\tlake.raw from one.two", (2, 2, [], False, False, True, False, False, 2, "Simple")),
]


def test_profiles(spark):
    got = {r.id: tuple(r)[1:] for r in scripts.profile(frame(spark, [t for t, _ in PROFILES]), "id").collect()}
    for i, (text, want) in enumerate(PROFILES):
        lines, full, procs, *flags, references, level = want
        assert got[i] == (lines, full, procs, *flags, references, len(procs), level), text


def test_validity(spark):
    cases = {"": "empty", " \n \x1c": "empty", "hello": "no_keyword", "Run it": "ok", "the database": "ok", "se lect": "no_keyword"}
    got = {r.text: (r.is_valid, r.reason) for r in scripts.validity(frame(spark, list(cases))).collect()}
    assert got == {t: (reason == "ok", reason) for t, reason in cases.items()}


# rule -> texts that break it, texts that do not
LINT = {
    "python_boolean_in_when": (["y = F.when(total >= 3, 'a')", "f.WHEN( n!=0, 1)"], ["F.when(F.col('n') > 3, 'a')", "when(n > 3)"]),
    "missing_cast_aggregation": (["F.max('fee')", "F.count(x).cast('int'), F.min(y)"], ["F.max('fee') .cast('int')", "G.max('fee')", "F.sum()"]),
    "casting_date_columns": (["F.to_date(x)", "cast(paid_date as date)", "CAST(date, AS DATE"], ["CAST(paid AS DATE)", "CAST(date) AS DATE", "CAST(x AS DATE) date"]),
    "persist_or_cache": (["t.cache()", "t.select(a).persist(LEVEL)"], ["cache()", "t.cached()"]),
    "ambiguous_select_star": (["select * from t", "SELECT  *, a FROM t WHERE b"], ["select a from t", "select *\nfrom t"]),
    "unused_pyspark_import_in_sql": (["from pyspark.sql import functions as F"], ["from pyspark.sql import types", "import pyspark.sql as F"]),
    "pure_sql_in_mixed_mode": (['spark.sql(f"""create or replace table a as select *, 1""")'], ['spark.sql("create or replace table a as select *, 1")']),
}


@pytest.mark.parametrize("rule", sorted(LINT))
def test_lint(spark, rule):
    wrong, right = LINT[rule]
    df = frame(spark, wrong + right)
    dialect = next(r.dialects[-1] for r in scripts.RULES if r.name == rule)
    hits = {r.id for r in scripts.lint(df, "id", dialect, all_rules=True).collect() if r.rule == rule}
    assert hits == set(range(len(wrong)))


def test_lint_choice_of_rules(spark):
    df = frame(spark, ["select * from t; F.to_date(x); t.cache()"])
    rules = lambda *a, **k: {r.rule for r in scripts.lint(df, "id", *a, **k).collect()}
    assert rules("PySpark Notebook") == {"casting_date_columns", "persist_or_cache"}
    assert rules("SQL (DBSQL)") == {"casting_date_columns"}
    assert rules("SQL", all_rules=True) == {"casting_date_columns", "ambiguous_select_star"}


def test_date_rule_equals_its_pattern(spark):
    rng = random.Random(11)
    parts = ["CAST(", "cast(", ")", "date", "Date", " as date", "AS DATE", "as dat", "e", "a", " ", "\n", "F.to_date", "x date as date"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(600)]
    pattern = next(r.pattern for r in scripts.RULES if r.name == "casting_date_columns")
    hits = {r.id for r in scripts.lint(frame(spark, texts), "id", "SQL").collect() if r.rule == "casting_date_columns"}
    assert hits == {i for i, t in enumerate(texts) if re.search(pattern, t, re.I)} and 20 < len(hits) < 580


LONG = "y" * 50


@pytest.mark.parametrize("dialect, text, issues, warnings", [
    ("PySpark", LONG, ["no_dataframe_code"], ["missing_source_namespace", "missing_target_catalog"]),
    ("PySpark Notebook", "df.x payer_dev.analytics_gold", [], ["missing_target_catalog", "very_short"]),
    ("PySpark", "spark.x payer_analyst_dev " + LONG, [], ["missing_source_namespace"]),
    ("SQL", "select * , b" + LONG, ["select_star_with_columns"], ["missing_source_namespace", "missing_functions_import"]),
    ("SQL (DBSQL)", "create temp view v as\nselect *,\nb from payer_dev.analytics_gold.t " + LONG,
     ["select_star_with_columns", "create_select_star_with_columns"], ["missing_functions_import"]),
    ("SQL", "create table a; " + LONG + " from pyspark.sql import functions as F", [], ["missing_source_namespace"]),
    ("Scala", "", [], ["missing_source_namespace", "very_short"]),
])
def test_output_checks(spark, dialect, text, issues, warnings):
    row = scripts.output_checks(frame(spark, [text]), "id", dialect).first()
    assert (row.issues, row.warnings, row.is_valid) == (issues, warnings, not issues)


@pytest.mark.parametrize("text, code", [
    ("plain words", "plain words"), ("  \n plain \t", "plain"), ("", ""), ("a ```b``` c", "b"), ("```\n\n``` after", ""),
    ("see\n```sql\none\n```\nand ```two```", "one"), ("```PY\n x = 1 \n```", "x = 1"), ("```pyspark\nq", "q"),
    ("```\nopen", "open"), ("open\n```", "open"), ("a\n```SQL\nb", "a\n\nb"), ("``` `` ```", "``"), ("```java\nz```", "java\nz"),
])
def test_code_blocks(spark, text, code):
    assert frame(spark, [text]).select(scripts.code_block(F.col("text"))).first()[0] == code


def test_long_texts_take_linear_time(spark):
    blanks, open_casts = "a" + " " * 1_000_000 + "b", "CAST(date " * 100_000
    body = "word " * 200_000
    fenced = body + "\n```sql\n" + body + "\n```" + body + "PROC LAST"
    df = frame(spark, [blanks, open_casts, open_casts + "as date", fenced])
    started = time.monotonic()
    code = [r[0] for r in df.orderBy("id").select(scripts.code_block(F.col("text"))).collect()]
    assert code[0] == blanks and code[1] == open_casts.strip() and code[3] == body.strip()
    hits = {r.id for r in scripts.lint(df, "id", "SQL").collect()}
    assert hits == {2}
    assert scripts.profile(df.filter("id = 3"), "id").first().procs_used == ["LAST"]
    assert time.monotonic() - started < 60


def test_preview_and_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd\ne"), (3, "")], "id long, text string")
    got = {r.id: r.preview for r in scripts.preview(df, "id", 3).collect()}
    assert got == {1: "a\nb\nc", 2: "a\nb\nc\n\n... (2 more lines)", 3: ""}
    names = {"a.cbl": "a_converted.py", "b.cob": "b_converted.py", "c.cobol": "c_converted.py", "d.txt": "d.txt"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.m for r in df.select("n", scripts.output_name(F.col("n"), "PySpark").alias("m")).collect()} == names
    sas = spark.createDataFrame([("a.sas",), ("b.SAS",), ("c",)], "n string")
    assert [r[0] for r in sas.select(scripts.output_name(F.col("n"), "SQL", family="sas")).collect()] == [
        "a_converted.sql", "b_converted.sql", "c_converted.sql"]


def test_file_size(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1408: "1.4 KB", 1536: "1.5 KB", 1048575: "1024.0 KB",
             1048576: "1.0 MB", 1310720: "1.2 MB", 10**10: "9536.7 MB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.s for r in df.select("n", tx.file_size(F.col("n")).alias("s")).collect()} == sizes


def test_batch(spark):
    schema = "seq long, filename string, success boolean, execution_time double, validation_status string, error string"
    log = [(1, "a.cbl", True, 0.125, "Passed", None), (2, None, False, 2.0, "Passed", None), (3, "c", False, 1.0, None, "boom")]
    df = spark.createDataFrame(log, schema)
    assert tuple(scripts.batch_stats(df).first()) == (3, 1, 2, 1 / 3 * 100, 3.125 / 3)
    assert tuple(scripts.batch_stats(df.filter("false")).first()) == (0, 0, 0, 0.0, 0.0)
    assert [tuple(r) for r in scripts.batch_report(df).orderBy("seq").collect()] == [
        (1, "a.cbl", "Success", "0.12s", "Passed", None, "N/A", "a_converted.py", "N/A", "N/A"),
        (2, "File 2", "Failed", "2.00s", None, "Unknown error", "N/A", None, None, None),
        (3, "c", "Failed", "1.00s", None, "boom", "N/A", None, None, None),
    ]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t\x1d ", max_size=30), min_size=1, max_size=40))
def test_properties_of_any_text(spark, sample):
    """A blank line changes the line count alone; a text without a fence keeps its words."""
    def measured(texts):
        df = frame(spark, texts).select(
            "id", tx.line_count(F.col("text")).alias("n"), tx.non_empty_lines(F.col("text")).alias("full"),
            tx.strip(F.col("text")).alias("bare"), scripts.code_block(F.col("text")).alias("code"))
        return {r.id: r for r in df.collect()}

    once, more = measured(sample), measured([t + "\n \t" for t in sample])
    for i, t in enumerate(sample):
        assert (more[i].n, more[i].full, more[i].bare) == (once[i].n + 1, once[i].full, once[i].bare)
        assert once[i].code.split() == t.split() and once[i].bare == t.strip()
