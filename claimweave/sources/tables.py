"""Tables in and out: named tables, inline rows, overwrite, counts and reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"^\w+(\.\w+){0,2}$")


def _checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a table or schema name: {name!r}")
    return name


def gold(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A table by its name of up to three levels, or ``<root>/<last level>.parquet``."""
    _checked(name)
    if root is None:
        return spark.table(name)
    return spark.read.parquet(f"{root}/{name.rsplit('.', 1)[-1]}.parquet")


def inline(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """Literal rows under an explicit schema."""
    return spark.createDataFrame(rows, schema)


def write_table(df: DataFrame, name: str) -> None:
    """Replace a table's rows and schema."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(_checked(name))


def ctas(spark: SparkSession, name: str, query: str, **inputs: DataFrame) -> None:
    """Create or replace a table from a query; ``inputs`` fill ``{name}`` in its text.

    A v2 catalog replaces atomically; the built-in session catalog has no
    replace, so there the table is overwritten.
    """
    df = spark.sql(query, **inputs)
    parts = _checked(name).split(".")
    if len(parts) == 3 and parts[0] != "spark_catalog":
        df.writeTo(name).createOrReplace()
    else:
        write_table(df, name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder path that driver and executors share, under ``spark.checkpoint.dir``;
    unset, as in tests, on this machine, and only with a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tables-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored_by(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame], buckets: int = 64, stamp: str = "") -> DataFrame:
    """A table kept bucketed and sorted by ``key``, written once.

    Tables stored with the same key and ``buckets`` join and aggregate on it without an
    exchange: a control-break report merges them bucket by bucket. ``make`` is asked
    only if the catalog has no such table of this ``stamp`` (a version of its input)
    and layout; the new one then takes its place. Choose ``buckets`` so that one
    holds some hundred megabytes; a hot key's rows share a bucket, so reports should
    aggregate before they keep rows.
    """
    wanted = f"{key}/{buckets}/{stamp}"
    if spark.catalog.tableExists(_checked(name)):
        held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if held.get("stored_by") == wanted:
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    rows = make().repartition(buckets, key)  # as the buckets hash, so a task writes one file a bucket
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark)).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('stored_by' = '{wanted}')")
    return spark.table(name)


def swap_table(spark: SparkSession, name: str, path: str) -> None:
    """Points a table at a finished folder of Parquet files.

    With an unchanged schema that is one change in the catalog: readers see the old rows
    or the new ones. Another schema makes a new table; rows of the old folder stay on disk.
    """
    schema = spark.read.parquet(path).schema
    if spark.catalog.tableExists(_checked(name)):
        if spark.table(name).schema == schema:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path, "parquet")


def publish(df: DataFrame, name: str, root: str | None = None) -> str:
    """Replaces what readers of ``name`` see, atomically also on the built-in catalog; returns the new folder.

    The rows go to a folder of their own under ``root`` (unset: the shared folder) and
    ``name`` is a view of the newest one. Only after the job has ended is the view
    altered, one change in the catalog also where columns differ: readers see the
    old rows or the new ones, and a job that fails leaves the old ones. ``df`` may read
    ``name`` itself. Earlier folders stay for queries that still read them. A table
    of that name is not replaced but refused.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    path = f"{root.rstrip('/')}/{path.rsplit('/', 1)[-1]}" if root else path
    if spark.catalog.tableExists(_checked(name)) and spark.catalog.getTable(name).tableType != "VIEW":
        raise ValueError(f"{name} is a table, not a published view")
    df.write.parquet(path)
    verb = "ALTER VIEW" if spark.catalog.tableExists(name) else "CREATE VIEW"
    quoted = path.replace("`", "``")
    spark.sql(f"{verb} {name} AS SELECT * FROM parquet.`{quoted}`")
    return path


def ensure_namespace(spark: SparkSession, db: str, reset: bool = False) -> None:
    """Create a schema; with ``reset`` drop it and its tables first."""
    _checked(db)
    if reset:
        spark.sql(f"DROP SCHEMA IF EXISTS {db} CASCADE")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {db}")


def stack_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One labelled row count per table, all in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(label).alias("table_name"), "row_count")
        for label, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def load_manifest(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Row counts next to the expected ones."""
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    return stack_counts(tables).select(
        "table_name",
        F.col("row_count").alias("actual_rows"),
        F.element_at(wanted, F.col("table_name")).cast("long").alias("expected_rows"),
    ).withColumn("complete", F.coalesce(F.col("actual_rows") == F.col("expected_rows"), F.lit(False)))


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """Any ``n`` rows, for a look at a table."""
    return df.limit(n)


def typed(df: DataFrame) -> DataFrame:
    """Output types: decimals and floats as double, whole numbers as long."""
    def target(t: T.DataType) -> str | None:
        if isinstance(t, (T.DecimalType, T.FloatType)):
            return "double"
        return "long" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)) else None

    return df.select(*[
        F.col(f.name).cast(target(f.dataType)) if target(f.dataType) else F.col(f.name) for f in df.schema
    ])


def report_lines(metrics: DataFrame, layout: Sequence[tuple[str, str, str]],
                 keys: Sequence[str] = ()) -> DataFrame:
    """Labelled lines from each metrics row: ``layout`` holds (section, label, column).

    ``keys`` are repeated on every line, for reports with a page per key. A layout with
    text columns gives a column ``text`` too; each line has a value or a text.
    """
    words = {f.name for f in metrics.schema if isinstance(f.dataType, T.StringType)}
    with_text = any(column in words for _, _, column in layout)
    lines = [
        F.struct(
            F.lit(seq).cast("int").alias("seq"),
            F.lit(section).alias("section"),
            F.lit(label).alias("label"),
            (F.lit(None) if column in words else F.col(column)).cast("double").alias("value"),
            *([(F.col(column) if column in words else F.lit(None)).cast("string").alias("text")] if with_text else []),
        )
        for seq, (section, label, column) in enumerate(layout, 1)
    ]
    return metrics.select(*keys, F.inline(F.array(*lines)))
