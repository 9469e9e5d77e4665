"""From raw documents to token ids: five stages, each an operator of ``claimweave.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between stages the
rows are written as Parquet to the folder that the cluster shares and read again, so
a lost executor repeats a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import decontam, jaccard, langid, lines, spm
from claimweave.llm.common import written
from claimweave.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is plain; ``lang`` becomes the language found.

    Gone are texts without a letter and those whose two best dictionaries tie. The
    model is learnt from the documents of the table itself that name a language.
    """
    model = langid.fit(docs.where(F.col("lang").isNotNull()))
    found = langid.identify_rows(docs, model)
    return found.where(~F.col("_rejected")).select("doc_id", "text", F.col("_lang_pred").alias("lang"), "source", "n_chars")


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; ``n_chars`` follows."""
    return _with_length(lines.drop_duplicate_lines(docs))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their checksum, and whether they decode to the text again."""
    return spm.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("line_dedup", unique_lines),
    ("near_duplicates", unique_documents),
    ("decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: Compression sizes, connected components and Viterbi paths are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
