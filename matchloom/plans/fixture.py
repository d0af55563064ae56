"""A synthetic matching task derived from the driver's tables, with known truth.

One SQL text for each table, in the dialect that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = """
  SELECT c.c_custkey AS k, CASE n.n_regionkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country,
         p.p_name || ' ' || replace(p.p_brand, '#', ' ') AS stem, CAST(100 + (c.c_custkey * 37) % 899 AS STRING) AS house,
         lower(c.c_mktsegment) AS street, n.n_name AS city, CAST(70000 + (c.c_custkey * 13) % 9973 AS STRING) AS pin
  FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {part} p ON p.p_partkey = c.c_custkey
"""

TABLES = {
    "biz_s1": """
SELECT 'S1-' || lpad(CAST(k AS STRING), 7, '0') AS entity_id,
       stem || CASE k % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Inc' WHEN 2 THEN ' S.A.S.' ELSE ' & Co' END AS business_name,
       CASE WHEN k % 23 = 0 THEN '' ELSE house || ' ' || street || ' St, ' || city || CASE WHEN country = 'US' THEN ', TX ' || pin ELSE ' ' || pin END END AS business_address, country
FROM base""",
    "biz_s2": """
SELECT 'S2-' || lpad(CAST(k AS STRING), 7, '0') AS entity_id,
       upper(stem) || CASE k % 4 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Incorporated' WHEN 2 THEN ' SAS' ELSE ' and Company' END AS business_name,
       CASE WHEN k % 29 = 0 THEN '' ELSE '0' || house || ' ' || street || ' Street ' || city END AS business_address, country
FROM base WHERE k % 10 < 7
UNION ALL
SELECT 'S2-D' || lpad(CAST(k AS STRING), 6, '0'), stem || ' Ltd', CAST(CAST(house AS INT) + 2 AS STRING) || ' ' || street || ' St, ' || city || ' ' || pin, country
FROM base WHERE k % 9 = 0""",
    "biz_s3": """
SELECT 'S3-' || lpad(CAST(k AS STRING), 7, '0') AS entity_id, CASE WHEN k % 11 = 0 THEN 'www.shop' || CAST(k AS STRING) || '.com' ELSE replace(stem, 'e', 'ee') END AS business_name,
       house || ' ' || street || ' Str. ' || city || ' ' || pin AS business_address, country
FROM base WHERE k % 10 >= 4 AND k % 10 < 9""",
    "biz_truth": """
SELECT 'S1-' || lpad(CAST(k AS STRING), 7, '0') AS source1_entity_id,
       CASE WHEN k % 10 < 4 THEN 'S2-' || lpad(CAST(k AS STRING), 7, '0')
            WHEN k % 10 < 7 THEN 'S2-' || lpad(CAST(k AS STRING), 7, '0') || ',S3-' || lpad(CAST(k AS STRING), 7, '0')
            WHEN k % 10 < 9 THEN 'S3-' || lpad(CAST(k AS STRING), 7, '0') ELSE '' END AS matched_entity_ids
FROM base""",
}


#: Columns that the fixture reads; naming them spares a look into the files for each query.
COLUMNS = {
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = {t: spark.read.schema(c).parquet(f"{sf_dir}/{t}.parquet") for t, c in COLUMNS.items()}
    return spark.sql(f"WITH base AS ({BASE}) {TABLES[name]}", **parts)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both target sources; ``source`` is 0 or 1."""
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "biz_s2").withColumn("source", F.lit(0)).unionByName(table(spark, sf_dir, "biz_s3").withColumn("source", F.lit(1)))


def with_sql() -> str:
    """The fixture as common table expressions for an oracle."""
    base = BASE.format(customer="customer", nation="nation", part="part")
    named = ",\n".join(f"{name} AS ({sql})" for name, sql in TABLES.items())
    return f"WITH RECURSIVE base AS ({base}),\n{named},\ntargets AS (SELECT *, 0 AS source FROM biz_s2 UNION ALL SELECT *, 1 AS source FROM biz_s3)"
