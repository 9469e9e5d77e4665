"""Profiling, linting and result statistics over tables of program texts.

Every helper is a native projection over ``(id, text)`` rows; whole texts are
searched, and only counts and flags leave the scan.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text as tx
from claimweave.functions.pic import safe_divide

# Java flags: ignore case, only \n ends a line, ^ and $ at each line, Unicode classes.
_SEARCH = "(?idmU)"

# Keywords, patterns, sizes and names that decide the results.
KEYWORDS = ("PROC", "DATA", "RUN", "QUIT", "SELECT", "FROM", "LIBNAME")
PROC_NAME = r"PROC\s+(\w+)"
TABLE_REFERENCE = r"FROM\s+[\w.]+|DATA\s+[\w.]+"
DATA_STEP = r"DATA\s+\w+"
FENCED = r"```(?:python|sql|py|pyspark)?\n?(.*?)```"
OPEN_FENCE = r"^```(?:python|sql|py|pyspark)?$"
BARE_FENCE = r"^```$"
SELECT_STAR_COMMA = r"SELECT\s+\*\s*,\s*\w+"
CREATE_SELECT_STAR_COMMA = (
    r"CREATE\s+(OR\s+REPLACE\s+)?(TEMP\s+VIEW|TABLE)[^;]*?SELECT\s+\*\s*,\s*\w+"
)
SOURCE_NAMESPACE = "payer_dev.analytics_gold"
TARGET_CATALOG = "payer_analyst_dev"
SQL_HELPER_IMPORT = "from pyspark.sql import functions as F"
SHORTEST = 50


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    severity: str
    dialects: tuple[str, ...]
    enabled: bool
    advice: str


# The lint rules.
RULES = (
    Rule("python_boolean_in_when", r"F\.when\(\s*\w+\s*[><=!]+", "HIGH", ("PySpark",), True,
         "Compare columns inside when(); wrap plain values in lit()."),
    Rule("missing_cast_aggregation",
         r"F\.(sum|avg|min|max|percentile_approx|stddev|variance|count|countDistinct)\([^)]+\)(?!\s*\.cast)",
         "HIGH", ("PySpark",), True,
         "Cast every aggregate where it is made."),
    Rule("casting_date_columns", r"(F\.to_date|CAST\([^)]*date[^)]*AS DATE)", "MEDIUM",
         ("PySpark", "SQL"), True,
         "Stored dates need no cast."),
    Rule("ambiguous_select_star", r"SELECT\s+\*.*?FROM.*?(?:WHERE|GROUP|ORDER|$)", "MEDIUM", ("SQL",), False,
         "List the columns when some are derived."),
    Rule("unused_pyspark_import_in_sql", r"from pyspark\.sql import.*?F\b", "LOW", ("SQL",), False,
         "Drop the import from SQL-only code."),
    Rule("pure_sql_in_mixed_mode",
         r"""spark\.sql\s*\(\s*f?["\'"]{3}\s*CREATE\s+OR\s+REPLACE\s+TABLE.*?SELECT\s+\*\s*,""",
         "HIGH", ("SQL",), False,
         "Add columns on a DataFrame and save it."),
    Rule("persist_or_cache", r"\.(persist|cache)\(", "MEDIUM", ("PySpark",), True,
         "Leave out persist() and cache()."),
)


def base_dialect(name: str) -> str:
    """``PySpark Notebook`` -> ``PySpark``; anything mentioning SQL -> ``SQL``."""
    name = name.replace(" Notebook", "").replace(" (DBSQL)", "")
    return "SQL" if "SQL" in name else name


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(_SEARCH + pattern)


def _casts_a_date(text: Column) -> Column:
    """The rule ``casting_date_columns`` in linear time.

    Its pattern rescans an unclosed ``CAST(`` for every way to place ``date`` before
    ``AS DATE``. Here each piece from a ``CAST(`` to its bracket is read once: the
    first ``date`` has to end before the last ``AS DATE`` starts.
    """
    pieces = F.regexp_extract_all(F.upper(text), F.lit(r"CAST\(([^)]*)"), F.lit(1))

    def broken(piece: Column) -> Column:
        first = F.instr(piece, "DATE")
        last = F.length(piece) - F.instr(F.reverse(piece), "ETAD SA") - 5  # 1-based start
        return (first > 0) & (F.instr(piece, "AS DATE") > 0) & (first + 4 <= last)

    return _found(text, r"F\.to_date") | F.exists(pieces, broken)


def _breaks(text: Column, rule: Rule) -> Column:
    return _casts_a_date(text) if rule.name == "casting_date_columns" else _found(text, rule.pattern)


def validity(files: DataFrame, text: str = "text") -> DataFrame:
    """Whether a text looks like a program, and why not."""
    empty = ~F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]")
    known = reduce(operator.or_, (F.contains("_upper", F.lit(k)) for k in KEYWORDS))
    # The upper-cased text is a column of its own, or each test would make it again.
    judged = files.withColumn("_upper", F.upper(text)).withColumn(
        "reason", F.when(empty, "empty").when(~known, "no_keyword").otherwise("ok"))
    return judged.withColumn("is_valid", F.col("reason") == "ok").drop("_upper")


def complexity(proc_count: Column, has_macro: Column, lines: Column) -> Column:
    """Simple, Complex or Medium, tested in that order."""
    return (
        F.when((proc_count <= 1) & ~has_macro & (lines < 50), "Simple")
        .when(has_macro | (proc_count >= 3) | (lines > 200), "Complex")
        .otherwise("Medium")
    )


def profile(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Size, procedures, features, table references and complexity per file."""
    t, upper = F.col(text), F.col("_upper")
    # A plain search rules most texts out before a pattern runs.
    has_proc, has_data, has_from = (F.contains(upper, F.lit(k)) for k in ("PROC", "DATA", "FROM"))
    procs = F.when(has_proc, F.regexp_extract_all(t, F.lit("(?iU)" + PROC_NAME), F.lit(1))).otherwise(
        F.array().cast("array<string>"))
    references = F.when(
        has_from | has_data, F.regexp_count(t, F.lit("(?iU)" + TABLE_REFERENCE))).otherwise(0)
    features = files.withColumn("_upper", F.upper(t)).select(
        key,
        tx.line_count(t).alias("line_count"),
        tx.non_empty_lines(t).alias("non_empty_lines"),
        F.array_sort(F.array_distinct(procs)).alias("procs_used"),
        F.contains(upper, F.lit("PROC SQL")).alias("has_sql"),
        F.contains(upper, F.lit("PROC FREQ")).alias("has_freq"),
        (has_data & t.rlike("(?iU)" + DATA_STEP)).alias("has_data_step"),
        F.contains(upper, F.lit("LIBNAME")).alias("has_libname"),
        F.contains(t, F.lit("%")).alias("has_macro"),
        references.cast("long").alias("table_references"),
    )
    counted = features.withColumn("proc_count", F.size("procs_used").cast("long"))
    return counted.withColumn(
        "complexity", complexity(F.col("proc_count"), F.col("has_macro"), F.col("line_count"))
    )


def complexity_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("complexity").agg(F.count(F.lit(1)).alias("files"))


def lint(files: DataFrame, key: str, dialect: str, text: str = "text", all_rules: bool = False) -> DataFrame:
    """One row per file and broken rule."""
    dialect = base_dialect(dialect)
    active = [r for r in RULES if (r.enabled or all_rules) and dialect in r.dialects]
    t = F.col(text)
    hits = F.array_compact(F.array(*[
        F.when(_breaks(t, r), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.advice).alias("advice"),
        ))
        for r in active
    ]))
    return files.select(key, F.inline(hits))


def output_checks(files: DataFrame, key: str, dialect: str, text: str = "text",
                  source: str = SOURCE_NAMESPACE, target: str = TARGET_CATALOG) -> DataFrame:
    """Blocking issues, warnings and correction notes of produced code."""
    dialect = base_dialect(dialect)
    t = F.col(text)

    def lacks(*needles: str) -> Column:
        missing = ~F.contains(t, F.lit(needles[0]))
        for needle in needles[1:]:
            missing = missing & ~F.contains(t, F.lit(needle))
        return missing

    def labels(rules: Sequence[tuple[Column, str]]) -> Column:
        if not rules:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules]))

    issues, warnings, corrections = [], [(lacks(source), "missing_source_namespace")], []
    if dialect == "PySpark":
        warnings.append((lacks(target), "missing_target_catalog"))
        issues.append((lacks("spark.", "df."), "no_dataframe_code"))
    elif dialect == "SQL":
        warnings.append((lacks(SQL_HELPER_IMPORT), "missing_functions_import"))
        for pattern, issue, note in (
            (SELECT_STAR_COMMA, "select_star_with_columns", "add_columns_on_the_frame"),
            (CREATE_SELECT_STAR_COMMA, "create_select_star_with_columns", "add_columns_after_the_select"),
        ):
            issues.append((_found(t, pattern), issue))
            corrections.append((_found(t, pattern), note))
    warnings.append((F.length(t) < SHORTEST, "very_short"))
    # A pattern is looked for once: its issue, in a generated column, tells also the note.
    found = files.select(key, F.inline(F.array(F.struct(labels(issues).alias("issues"), labels(warnings).alias("warnings")))))
    notes = labels([(F.array_contains("issues", issue), note) for (_, issue), (_, note) in zip(issues, corrections)])
    return found.select("*", notes.alias("corrections"), (F.size("issues") == 0).alias("is_valid"))


def code_block(text: Column) -> Column:
    """The first fenced block, or the text without stray fences."""
    fenced = "(?isU)" + FENCED
    block = F.replace(tx.strip(F.regexp_extract(text, fenced, 1)), F.lit("```"), F.lit(""))
    plain = tx.strip(text)
    for fence in (OPEN_FENCE, BARE_FENCE):
        plain = F.regexp_replace(plain, _SEARCH + fence, "")
    return F.when(text.rlike(fenced), block).otherwise(tx.strip(plain))


def preview(files: DataFrame, key: str, lines: int = 20, text: str = "text") -> DataFrame:
    return files.select(key, tx.head_lines(F.col(text), lines).alias("preview"))


def output_name(filename: Column, dialect: str, family: str = "cobol", notebook: bool = False) -> Column:
    """Name of the produced file; notebooks carry no extension."""
    ext = "" if notebook else ".py" if base_dialect(dialect) == "PySpark" else ".sql"
    if family == "sas":
        bare = F.regexp_replace(filename, r"\.(sas|SAS)", "")
        return F.concat(bare, F.lit(f"_converted{ext}"))
    return F.regexp_replace(filename, r"\.(cbl|cobol|cob)", f"_converted{ext}")


def batch_stats(results: DataFrame) -> DataFrame:
    """One row over a result log; zeros when it is empty."""
    total, ok = F.count(F.lit(1)), F.count_if("success")
    rate = safe_divide(ok.cast("double"), total.cast("double")) * 100
    return results.agg(
        total.alias("total"), ok.alias("successful"), (total - ok).alias("failed"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
        # Summed in decimals, so that the order of rows changes nothing.
        F.coalesce(F.sum(F.col("execution_time").cast("decimal(28,10)")).cast("double") / F.count("execution_time"), F.lit(0.0))
        .alias("avg_execution_time"),
    )


def batch_report(results: DataFrame) -> DataFrame:
    """Result rows as they appear in the batch report; names that are not given are ``N/A``."""
    def given(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("N/A")) if column in results.columns else F.lit("N/A")

    results = results.withColumns({c: given(c) for c in ("output_type", "source_name", "target_name")})
    name, kind = F.coalesce("filename", F.concat(F.lit("File "), F.col("seq").cast("string"))), F.col("output_type")
    written = (
        F.when(kind.endswith("Notebook"), output_name(name, "PySpark", notebook=True))
        .when(kind.contains("SQL"), output_name(name, "SQL")).otherwise(output_name(name, "PySpark"))
    )
    return results.select(
        "seq",
        F.coalesce("filename", F.concat(F.lit("File "), F.col("seq").cast("string"))).alias("filename"),
        F.when(F.col("success"), "Success").otherwise("Failed").alias("status"),
        F.concat(F.format_string("%.2f", F.bround("execution_time", 2)), F.lit("s")).alias("execution_time"),
        F.when(F.col("success"), F.col("validation_status")).alias("validation"),
        F.when(~F.col("success"), F.coalesce("error", F.lit("Unknown error"))).alias("error"),
        "output_type",
        F.when(F.col("success"), written).alias("output_file"),
        F.when(F.col("success"), F.col("source_name")).alias("source_name"),
        F.when(F.col("success"), F.col("target_name")).alias("target_name"),
    )
