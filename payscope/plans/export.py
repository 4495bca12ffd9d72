"""Queries of the encodings for delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.operators import export as e
from payscope.plans.registry import register
from payscope.plans.stand_ins import COMPANIES_SQL, SEGMENT_CURVE, companies, table


@register("""WITH p AS (SELECT trim(p_type) AS value, min(p_partkey) AS pos FROM part WHERE trim(p_type) <> '' GROUP BY 1),
  q AS (SELECT value, row_number() OVER (ORDER BY pos, value) - 1 AS idx FROM p) SELECT p_partkey, idx AS p_type_index FROM part JOIN q ON q.value = trim(p_type)""")
def string_pool_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.pooled(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "p_type_index")


@register("""WITH f AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '1' ELSE '0' END AS bit FROM documents)
  SELECT CAST(floor(doc_id / CAST(4096 AS DOUBLE)) AS BIGINT) AS block, string_agg(bit, '' ORDER BY doc_id) AS mask FROM f GROUP BY 1""")
def presence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.presence_mask(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@register("SELECT count(*) AS n, sum(doc_id) AS total FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def presence_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return e.present_rows(e.presence_mask(docs, table(spark, sf_dir, "labels"), "doc_id", "doc_id")).agg(F.count("*").alias("n"), F.sum("place").alias("total"))


@register(f"""WITH {COMPANIES_SQL} SELECT '/' AS loc UNION ALL SELECT '/age/' || CAST(age AS VARCHAR) FROM (VALUES {", ".join(f"({a})" for a in C.TARGET_AGES)}) t(age)
  UNION ALL SELECT DISTINCT '/industry/' || CAST(tse33 AS VARCHAR) FROM companies UNION ALL SELECT '/company/' || CAST(id AS VARCHAR) FROM companies""")
def sitemap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.sitemap(companies(spark, sf_dir), C.TARGET_AGES)


@register("SELECT (SELECT count(*) FROM documents) AS source_rows, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched, (SELECT count(*) FROM labels) AS written")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return e.manifest(docs, docs.join(labels, "doc_id", "left_semi"), labels)


@register("""WITH u AS (SELECT c_nationkey AS id, c_custkey AS unit, c_acctbal AS value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
  SELECT id, """ + ", ".join(f"max(CASE WHEN k = {k} THEN unit END) AS unit{k}, max(CASE WHEN k = {k} THEN value END) AS unit{k}_value" for k in range(1, 6)) + " FROM u WHERE k <= 5 GROUP BY id")
def unit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").withColumn("k", F.expr("row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)")).where("k <= 5")
    items = first.groupBy(F.col("c_nationkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("value")))).alias("units"))
    return e.with_units(items, "units")


@register(f"""WITH {COMPANIES_SQL}, s AS (SELECT tse33, row_number() OVER (ORDER BY CAST(tse33 AS VARCHAR)) - 1 AS sector FROM (SELECT DISTINCT tse33 FROM companies) d)
  SELECT id, name, sector, CASE curve_key WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS curve, avg_age, avg_tenure, avg_salary, employees
  FROM companies JOIN s USING (tse33)""")
def company_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.company_tuples(companies(spark, sf_dir), list(SEGMENT_CURVE))


@register("SELECT p_partkey, trim(p_type) AS p_type FROM part")
def string_pool_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return e.unpooled(e.pooled(rows, "p_type", "p_partkey").select("p_partkey", "p_type_index"), e.string_pool(rows, "p_type", "p_partkey"), "p_type_index", "p_type")
