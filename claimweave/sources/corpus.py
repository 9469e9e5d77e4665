"""Directories of source programs as a table of decoded texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str,
                exts: Sequence[str] = (".cbl", ".cob", ".cobol")) -> DataFrame:
    """Files under ``path`` with one of the extensions, in either case.

    Text is UTF-8 where the bytes are valid UTF-8, else Latin-1.
    """
    # A glob keeps other files unread; a filter on the path would read them first.
    any_case = ("".join(f"[{c.lower()}{c.upper()}]" for c in e.lstrip(".")) for e in exts)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(any_case) + "}")
        .load(path)
    )
    text = F.when(
        F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")
    ).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        text.alias("text"),
        F.col("length").alias("size_bytes"),
    )
