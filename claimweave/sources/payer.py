"""Payer tables derived from the order-entry test tables.

Each view is one portable SQL text. Spark runs it over the parquet scans;
:func:`portable` turns the same text into the CTE the SQL checks use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Code lists of the payer tables, by position of a key's remainder.
VIEWS = {
    "claims": """
SELECT l_orderkey * 10 + l_linenumber AS claim_id,
  {member} l_suppkey AS provider_id,
  CAST(l_shipdate AS DATE) AS service_date,
  CASE l_partkey % 12 WHEN 0 THEN '77065' WHEN 1 THEN '77066' WHEN 2 THEN '77067' WHEN 3 THEN '99213' WHEN 4 THEN '99214' WHEN 5 THEN '99215' WHEN 6 THEN '81000' WHEN 7 THEN '85025' WHEN 8 THEN '80053' WHEN 9 THEN '99232' WHEN 10 THEN '70450' ELSE '73060' END AS procedure_code,
  CASE l_partkey % 7 WHEN 0 THEN 'E11.9' WHEN 1 THEN 'I10' WHEN 2 THEN 'J44.9' WHEN 3 THEN 'K21.9' WHEN 4 THEN 'M19.90' WHEN 5 THEN 'F41.9' ELSE 'E78.5' END AS diagnosis_code,
  CASE l_linenumber % 3 WHEN 0 THEN 'Professional' WHEN 1 THEN 'Institutional' ELSE 'Pharmacy' END AS claim_type,
  amount AS claim_amount, CAST(amount + l_linenumber * 10 AS DECIMAL(9,2)) AS billed_amount,
  CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' OR l_returnflag = 'N' AND l_linestatus = 'F' THEN amount - l_partkey % 500
            WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN amount - 500 ELSE 0 END AS DECIMAL(9,2)) AS paid_amount,
  CAST(CASE WHEN l_returnflag = 'R' THEN amount WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 500 ELSE 0 END AS DECIMAL(9,2)) AS denied_amount,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'APPROVED' WHEN 'AO' THEN 'PARTIAL' WHEN 'NF' THEN 'Paid' WHEN 'NO' THEN 'Pending' WHEN 'RF' THEN 'DENIED' ELSE 'Denied' END AS claim_status,
  70 + l_partkey % 31 AS quality_score
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(9,2)) AS amount FROM lineitem) {orders}""",
    "members": """
SELECT c_custkey AS member_id, c_name AS last_name,
  CAST(18 + (c_custkey * 37) % 73 AS INT) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  CASE c_custkey % 8 WHEN 0 THEN 'TERMINATED' WHEN 1 THEN 'TERMINATED' WHEN 2 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS enrollment_status,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE c_custkey % 36 + 1 END AS INT) AS enrollment_months,
  date_add(DATE '2020-01-01', CAST((c_custkey * 31) % 1096 AS INT)) AS enrollment_date,
  CASE WHEN c_custkey % 8 < 2 THEN date_add(DATE '2020-01-01', CAST((c_custkey * 31) % 1096 + 30 + c_custkey % 365 AS INT)) END AS termination_date,
  concat('PLAN', CAST(c_nationkey % 5 + 1 AS STRING)) AS plan_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MEDICARE' WHEN 'BUILDING' THEN 'MEDICARE-ADVANTAGE' WHEN 'FURNITURE' THEN 'COMMERCIAL' WHEN 'HOUSEHOLD' THEN 'INDIVIDUAL' ELSE 'GROUP' END AS plan_type,
  CAST(100 + abs(CAST(c_acctbal AS DECIMAL(9,2))) % 700 AS DECIMAL(9,2)) AS premium_amount,
  CAST((c_custkey * 13) % 11 AS INT) AS claims_last_year,
  CAST((c_custkey * 7919) % 100000 AS DECIMAL(11,2)) AS total_cost_last_yr,
  CASE WHEN c_custkey % 4 = 0 THEN 'Y' ELSE 'N' END AS disabled_flag,
  CASE WHEN c_custkey % 5 = 0 THEN 'Y' ELSE 'N' END AS original_entitled
FROM customer""",
    "providers": """
SELECT s_suppkey AS provider_id, s_name AS provider_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'PCP' WHEN 1 THEN 'Specialist' WHEN 2 THEN 'Hospital' WHEN 3 THEN 'Lab' ELSE 'Imaging Center' END AS provider_type,
  CASE s_suppkey % 9 WHEN 0 THEN 'Internal Medicine' WHEN 1 THEN 'Family Practice' WHEN 2 THEN 'Cardiology' WHEN 3 THEN 'Endocrinology' WHEN 4 THEN 'Orthopedics' WHEN 5 THEN 'Radiology' WHEN 6 THEN 'Pediatrics' WHEN 7 THEN 'Psychiatry' ELSE 'Dermatology' END AS specialty,
  CASE WHEN s_suppkey % 3 = 2 THEN 'Out of Network' ELSE 'In Network' END AS network_status,
  CAST(80 + s_suppkey % 41 AS DECIMAL(5,2)) AS contract_rate
FROM supplier""",
    "diagnoses": """
SELECT o_custkey AS member_id, CAST(l_shipdate AS DATE) AS service_date,
  CASE WHEN o_custkey % 10 = 7 OR (l_orderkey + l_partkey) % 8 <> 0 THEN 'NONE' ELSE CASE l_partkey % 9 WHEN 0 THEN 'HCC17' WHEN 1 THEN 'HCC18' WHEN 2 THEN 'HCC19' WHEN 3 THEN 'HCC85' WHEN 4 THEN 'HCC86' WHEN 5 THEN 'HCC87' WHEN 6 THEN 'HCC88' WHEN 7 THEN 'HCC111' ELSE 'HCC112' END END AS hcc_code
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "risk_scores": """
SELECT o_custkey AS member_id, CAST(2022 + l_linenumber % 2 AS INT) AS risk_year,
  concat('HCC', CAST(l_partkey % 189 + 1 AS STRING)) AS hcc_code,
  CAST((100 + (l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 1401) AS DECIMAL(7,3)) * CAST(0.001 AS DECIMAL(4,3)) AS risk_score,
  CASE l_partkey % 5 WHEN 0 THEN 'Diabetes' WHEN 1 THEN 'Heart Disease' WHEN 2 THEN 'COPD' WHEN 3 THEN 'Cancer' ELSE 'Kidney Disease' END AS disease_group,
  CAST(l_suppkey % 2 AS INT) AS hierarchical_flag
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "hedis_measures": """
SELECT CASE o_orderkey % 8 WHEN 0 THEN 'BCS' WHEN 1 THEN 'COL' WHEN 2 THEN 'CBP' WHEN 3 THEN 'CDC' WHEN 4 THEN 'HBD' WHEN 5 THEN 'CIS' WHEN 6 THEN 'W15' ELSE 'W30' END AS measure_id,
  o_custkey AS member_id, CAST(50 + (o_orderkey * 3) % 35 AS INT) AS age,
  concat(CAST(50 + 5 * ((o_orderkey % 7)) AS STRING), '-', CAST(54 + 5 * ((o_orderkey % 7)) AS STRING)) AS age_group,
  CAST(2022 + o_custkey % 2 AS INT) AS measure_year,
  CAST(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS INT) AS numerator, CAST(1 AS INT) AS denominator,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INT) AS exclusion,
  CAST(o_orderdate AS DATE) AS service_date
FROM orders""",
    "prior_auth_summary": """
SELECT o_orderkey AS auth_id, o_custkey AS member_id, o_orderkey % 10 AS provider_id,
  CAST(o_orderdate AS DATE) AS request_date,
  CASE WHEN o_orderkey % 20 < 17 OR o_orderkey % 20 = 19 THEN date_add(CAST(o_orderdate AS DATE), CAST((o_orderkey * 7) % 22 AS INT)) END AS approval_date,
  CASE WHEN o_orderkey % 20 < 12 THEN 'APPROVED' WHEN o_orderkey % 20 < 17 THEN 'DENIED' WHEN o_orderkey % 20 < 19 THEN 'PENDING' ELSE 'WITHDRAWN' END AS auth_status,
  CAST(o_totalprice AS DECIMAL(9,2)) AS auth_amount,
  concat('REV00', CAST(o_custkey % 5 + 1 AS STRING)) AS reviewer_id
FROM orders""",
    "provider_claims": """
SELECT CASE WHEN l_suppkey % 25 = 24 THEN l_suppkey - 1 ELSE l_suppkey END AS provider_id, {member} CAST(l_shipdate AS DATE) AS service_date,
  CAST(l_quantity * (2 + (l_suppkey * 7) % 50) AS DECIMAL(9,2)) AS claim_amount,
  CAST(CASE WHEN l_partkey % (5 + l_suppkey % 30) = 0 THEN 0 ELSE l_quantity * (2 + (l_suppkey * 7) % 50) END AS DECIMAL(9,2)) AS paid_amount,
  CASE WHEN l_partkey % (5 + l_suppkey % 30) = 0 THEN 'DENIED' WHEN l_partkey % 2 = 0 THEN 'PARTIAL' ELSE 'APPROVED' END AS claim_status,
  60 + (l_suppkey * 13) % 31 + l_partkey % 11 AS quality_score
FROM lineitem {orders}""",
    # Legacy source members: prose wrapped in statements so that every
    # profiling and lint rule has hits and misses at any scale.
    "sources": '''
SELECT doc_id AS file_id, concat('src_', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.cbl' WHEN 1 THEN '.sas' ELSE '.SAS' END) AS filename,
  CASE doc_id % 8
    WHEN 0 THEN concat('PROC SQL;\n  SELECT *, ', text)
    WHEN 1 THEN concat('libname gold; proc freq data=x; run;\nPROC MEANS; PROC SORT;\n', text, '\n%macro m;')
    WHEN 2 THEN concat('df.cache()\nF.sum("a").alias("b")\n', text)
    WHEN 3 THEN concat('spark.table("payer_dev.analytics_gold.t")\nF.when(n > 0, 1)\n', text, '\nF.avg("d").cast("double")')
    WHEN 4 THEN concat('CREATE OR REPLACE TABLE payer_analyst_dev.t AS\n', text, '\nSELECT *,\n x FROM t')
    WHEN 5 THEN concat('CAST(a.date_x AS DATE)\n   \n\n', text)
    WHEN 6 THEN concat('from pyspark.sql import functions as F\nspark.sql(f"""CREATE OR REPLACE TABLE t AS SELECT *, 1 AS x FROM u""")\n', text)
    ELSE text END AS text
FROM documents''',
    # Model answers holding code in fences of every supported kind.
    "replies": """
SELECT conv_id, turn,
  CASE (conv_id + turn) % 7
    WHEN 0 THEN concat('Here:\n```python\n', text, '\n```\nand\n```sql\nSELECT 1\n```')
    WHEN 1 THEN concat('```sql\n  ', text, '  \n```')
    WHEN 2 THEN concat('```', text, '```')
    WHEN 3 THEN concat('```pyspark\n', text, '```')
    WHEN 4 THEN concat('  ', text, '\n```')
    WHEN 5 THEN concat('```SQL\n', text)
    ELSE text END AS text
FROM conversations""",
    # One result row per converted file.
    "results": """
SELECT doc_id AS seq, CASE WHEN doc_id % 11 <> 0 THEN concat('src_', CAST(doc_id AS STRING), '.cbl') END AS filename,
  source <> 'src3' AS success, CAST(n_chars AS DOUBLE) / 64 AS execution_time,
  CASE WHEN doc_id % 4 <> 0 THEN 'Passed' END AS validation_status,
  CASE WHEN doc_id % 2 = 0 THEN concat('failed: ', lang) END AS error,
  CASE doc_id % 4 WHEN 0 THEN 'PySpark' WHEN 1 THEN 'SQL (DBSQL)' WHEN 2 THEN 'PySpark Notebook' END AS output_type,
  concat('raw.', source) AS source_name, CASE WHEN doc_id % 5 <> 0 THEN concat('gold.', lang) END AS target_name
FROM documents""",
}

# Declared schemas spare every query the job that would infer them from a footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_WITH_MEMBER = {"member": "o_custkey AS member_id,", "orders": "LEFT JOIN orders ON l_orderkey = o_orderkey"}
# Every claim line belongs to exactly one order, so without the member column
# the join would only cost a shuffle of the largest table.
_WITHOUT_MEMBER = {"member": "", "orders": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, member: bool = True,
         since: str | None = None) -> DataFrame:
    """A payer table; ``since`` bounds claim lines on the stored timestamp, which
    the parquet scan can use to skip row groups."""
    text = VIEWS[name].format(**(_WITH_MEMBER if member else _WITHOUT_MEMBER))
    inputs = {}
    for source in SCHEMAS:
        if re.search(rf"(FROM|JOIN) {source}\b", text):
            inputs[source] = table(spark, sf_dir, source)
            text = re.sub(rf"(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
    if since is not None:
        inputs["lineitem"] = inputs["lineitem"].filter(f"l_shipdate >= TIMESTAMP_NTZ '{since} 00:00:00'")
    return spark.sql(text, **inputs)


def portable(name: str) -> str:
    """The view as a DuckDB query."""
    text = VIEWS[name].format(**_WITH_MEMBER).replace("AS STRING", "AS VARCHAR")
    text = re.sub(r"date_add\(((?:[^()]|\([^()]*\))*?), (CAST\((?:[^()]|\([^()]*\))* AS INT\))\)", r"(\1 + \2)", text)
    return text
