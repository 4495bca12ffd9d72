"""The domain's tables made from the driver's tables, as DataFrames and as SQL.

Customers stand for companies, orders for yearly filings, nations for sectors, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import constants as C

#: Which curve a market segment follows.
SEGMENT_CURVE = dict(zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), C.WAGE_CURVES, strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curve_of(segment: Column) -> Column:
    """The curve of a segment in yen: five fixed arrays, so no join is needed."""
    arrays = {s: F.array(*(F.lit(v * 1000) for v in C.WAGE_CURVES[k])) for s, k in SEGMENT_CURVE.items()}
    first, *rest = arrays.items()
    out = F.when(segment == first[0], first[1])
    for s, a in rest:
        out = out.when(segment == s, a)
    return out


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), key.alias("row_idx"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("tse33"), F.col("c_mktsegment").alias("curve_key"),
        (25 + (key * 7 % 360) / F.lit(10.0)).alias("avg_age"), ((key * 3 % 250) / F.lit(10.0)).alias("avg_tenure"),
        (2_000_000 + F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 2000).alias("avg_salary"), (50 + key * 37 % 5000).alias("employees"),
        curve_of(F.col("c_mktsegment")).alias("curve"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ties: parts with a price as pay."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("row_idx"), F.col("p_brand").alias("tse33"), F.lit(0).alias("basis"),
        F.floor(F.col("p_retailprice") * 10_000 + 0.5).cast("long").alias("salary"), F.col("p_size").cast("double").alias("age"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("value"),
        F.when(F.col("o_orderpriority") < "3", "tag").otherwise("textblock").alias("source"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"),
    )


# --- the same in SQL ---------------------------------------------------------------------------

COMPANIES_SQL = """companies AS (
  SELECT c_custkey AS id, c_custkey AS row_idx, c_name AS name, c_nationkey AS tse33, c_mktsegment AS curve_key,
    25 + (c_custkey * 7 % 360) / CAST(10 AS DOUBLE) AS avg_age, (c_custkey * 3 % 250) / CAST(10 AS DOUBLE) AS avg_tenure,
    2000000 + greatest(c_acctbal, CAST(0 AS DOUBLE)) * 2000 AS avg_salary, 50 + c_custkey * 37 % 5000 AS employees
  FROM customer)"""

CURVES_SQL = (
    "curves AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{s}', " + ", ".join(f"CAST({v} AS DOUBLE) * 1000" for v in C.WAGE_CURVES[k]) + ")" for s, k in SEGMENT_CURVE.items())
    + ") t(curve_key, " + ", ".join(f"v{k}" for k in range(len(C.AGE_POINTS))) + "))"
)


def sql_curve_at(x: str) -> str:
    """The curve of the joined row of ``curves`` at age ``x``."""
    p = C.AGE_POINTS
    inner = " ".join(f"WHEN {x} < {p[k + 1]} THEN v{k} + (v{k + 1} - v{k}) * ({x} - {p[k]}) / CAST({p[k + 1] - p[k]} AS DOUBLE)" for k in range(len(p) - 1))
    return f"(CASE WHEN {x} <= {p[0]} THEN v0 {inner} ELSE v{len(p) - 1} END)"


def sql_estimate(age: str, target: str, salary: str) -> str:
    ca, ct, c0 = sql_curve_at(age), sql_curve_at(target), "v0"
    ratio = f"{salary} * ({ct} / {ca})"
    line = f"{c0} + ({salary} - {c0}) * ({ct} - {c0}) / ({ca} - {c0})"
    return f"CAST(floor((CASE WHEN {target} > {age} THEN {ratio} WHEN {ca} - {c0} <= 0 OR {salary} <= {c0} THEN {ratio} ELSE {line} END) + 0.5) AS BIGINT)"


BASES_SQL = (
    f"{COMPANIES_SQL}, {CURVES_SQL}, ages AS (SELECT * FROM (VALUES (0), " + ", ".join(f"({a})" for a in C.TARGET_AGES) + f""") t(basis)), bases AS (
  SELECT id, row_idx, name, tse33, avg_age, avg_tenure, employees, avg_salary, basis,
    CASE WHEN basis = 0 THEN CAST(floor(avg_salary + 0.5) AS BIGINT) ELSE {sql_estimate("avg_age", "CAST(basis AS DOUBLE)", "avg_salary")} END AS salary
  FROM companies JOIN curves USING (curve_key) CROSS JOIN ages)"""
)

PARTS_SQL = """parts AS (SELECT p_partkey AS id, p_partkey AS row_idx, p_brand AS tse33, 0 AS basis,
  CAST(floor(p_retailprice * 10000 + 0.5) AS BIGINT) AS salary, CAST(p_size AS DOUBLE) AS age FROM part)"""

FILINGS_SQL = """filings AS (SELECT o_custkey AS code, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS doc_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS value,
  CASE WHEN o_orderpriority < '3' THEN 'tag' ELSE 'textblock' END AS source, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders)"""

HISTORY_SQL = f"""{FILINGS_SQL}, history AS (SELECT code, year, doc_id, value, source FROM (
  SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY doc_id DESC) AS rn FROM filings) t WHERE rn = 1)"""

DENSE_SQL = f"""{HISTORY_SQL}, years AS (SELECT DISTINCT year FROM history), codes AS (SELECT DISTINCT code FROM history),
  dense AS (SELECT c.code, y.year, h.value FROM codes c CROSS JOIN years y LEFT JOIN history h ON h.code = c.code AND h.year = y.year)"""
