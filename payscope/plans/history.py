"""Queries of the yearly history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.operators import history as h
from payscope.operators import sentences
from payscope.plans.registry import register
from payscope.plans.stand_ins import DENSE_SQL, FILINGS_SQL, HISTORY_SQL, filings, table


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.latest_per_year(filings(spark, sf_dir).select("code", "year", "doc_id", "value", "source"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.dense_years(_history(spark, sf_dir))


@register(f"WITH {HISTORY_SQL} SELECT code, year, doc_id, value, source FROM history")
def history_latest_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@register(f"""WITH {DENSE_SQL}, x AS (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY year) AS b,
    first_value(value IGNORE NULLS) OVER (PARTITION BY code ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
    min(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY code) AS y FROM dense)
  SELECT code, year, value, CASE WHEN b <> 0 THEN round((value - b) / CAST(b AS DOUBLE), 9) END AS yoy,
    CASE WHEN year <> y AND f <> 0 THEN round((value - f) / CAST(f AS DOUBLE), 9) END AS cumulative FROM x""")
def history_yoy_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.changes(_dense(spark, sf_dir))


@register(f"""WITH {HISTORY_SQL}, e AS (SELECT code, min(year) AS first_year, max(year) AS last_year FROM history GROUP BY code HAVING count(*) >= 2)
  SELECT e.code, first_year, last_year, z.value - a.value AS difference FROM e JOIN history a ON a.code = e.code AND a.year = first_year JOIN history z ON z.code = e.code AND z.year = last_year""")
def history_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.first_and_last(_history(spark, sf_dir))


def _man(x: str) -> str:
    return f"format('{{:,}}', CAST(floor(({x}) / CAST(10000 AS DOUBLE) + 0.5) AS BIGINT)) || '万円'"


@register(f"""WITH {HISTORY_SQL}, e AS (SELECT code, min(year) AS y0, max(year) AS y1 FROM history GROUP BY code HAVING count(*) >= 2),
  d AS (SELECT e.code, y0, y1, a.value AS a, z.value AS z FROM e JOIN history a ON a.code = e.code AND a.year = y0 JOIN history z ON z.code = e.code AND z.year = y1)
  SELECT code, CAST(y1 - y0 AS VARCHAR) || '年で ' || CASE WHEN z >= a THEN '＋' ELSE '−' END || {_man("abs(z - a)")} || '（' || CAST(y0 AS VARCHAR) || '年 ' || {_man("a")} || ' → ' || CAST(y1 AS VARCHAR) || '年 ' || {_man("z")} || '）。' AS summary FROM d""")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.history_summary(_history(spark, sf_dir))


@register(f"""WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY value DESC, year) AS rn, max(year) OVER (PARTITION BY code) AS last FROM history)
  SELECT code, 'この10年で最も高かったのは' || CAST(year AS VARCHAR) || '年の' || {_man("value")} || 'です。' AS sentence FROM r WHERE rn = 1 AND year <> last""")
def history_peak_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.history_peak(_history(spark, sf_dir))


@register(f"""WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY value DESC, year) AS rn, max(year) OVER (PARTITION BY code) AS last FROM history)
  SELECT code, year AS peak_year, value AS peak FROM r WHERE rn = 1 AND year <> last""")
def history_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.peak_year(_history(spark, sf_dir))


@register(f"""WITH {DENSE_SQL}, x AS (SELECT value, lag(value) OVER (PARTITION BY code ORDER BY year) AS b FROM dense)
  SELECT count(*) AS pairs, count(*) FILTER (WHERE value / CAST(b AS DOUBLE) > 1.8 OR value / CAST(b AS DOUBLE) < 0.55) AS jumps FROM x WHERE b IS NOT NULL AND value IS NOT NULL""")
def jump_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.jump_audit(_dense(spark, sf_dir))


@register(f"""WITH {HISTORY_SQL} SELECT year, count(*) AS n, count(*) FILTER (WHERE source = 'tag') AS tagged, count(*) FILTER (WHERE source = 'textblock') AS from_text FROM history GROUP BY year""")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.coverage(_history(spark, sf_dir), F.col("source"))


@register(f"""WITH {DENSE_SQL} SELECT code, string_agg(coalesce(CAST(value AS VARCHAR), '-'), ',' ORDER BY year) AS yearly FROM dense GROUP BY code""")
def history_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.pivoted(_dense(spark, sf_dir)).select("code", F.array_join("values", ",", "-").alias("yearly"))


@register(f"""WITH {FILINGS_SQL}, kept AS (SELECT * FROM filings WHERE code IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
  SELECT code, year, max(doc_id) AS doc_id FROM kept GROUP BY code, year""")
def semi_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    population = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("code")).distinct()
    return h.latest_per_year(filings(spark, sf_dir).select("code", "year", "doc_id"), population)


@register(f"""WITH {FILINGS_SQL}, history AS (SELECT code, year, value, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY doc_id DESC) AS rn FROM filings) t WHERE rn = 1),
  c AS (SELECT *, CASE WHEN source = 'textblock' AND doc_id % 3 = 0 THEN [value * 10, value, value + 1000] WHEN source = 'textblock' AND doc_id % 3 = 1 THEN [value] END AS candidates,
    CASE WHEN source = 'textblock' AND doc_id % 3 = 0 THEN value * 10 ELSE value END AS reading FROM history),
  r AS (SELECT *, coalesce(median(CASE WHEN source = 'tag' THEN reading END) OVER (PARTITION BY code), median(CASE WHEN candidates IS NULL OR len(candidates) < 2 THEN reading END) OVER (PARTITION BY code)) AS ref FROM c),
  k AS (SELECT code, year, unnest(candidates) AS v, generate_subscripts(candidates, 1) AS i, ref FROM r WHERE len(candidates) >= 2 AND ref IS NOT NULL),
  b AS (SELECT code, year, v FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY abs(ln(v / ref)), i) AS rn FROM k) t WHERE rn = 1)
  SELECT r.code, r.year, coalesce(b.v, r.reading) AS resolved, coalesce(b.v, r.reading) <> r.reading AS swapped FROM r LEFT JOIN b ON b.code = r.code AND b.year = r.year""")
def candidate_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("source") == "textblock"
    several = text & (F.col("doc_id") % 3 == 0)
    read = _history(spark, sf_dir).withColumn("candidates", F.when(several, F.array(F.col("value") * 10, F.col("value"), F.col("value") + 1000)).when(text & (F.col("doc_id") % 3 == 1), F.array("value")))
    return h.resolved(read.withColumn("value", F.when(several, F.col("value") * 10).otherwise(F.col("value")))).select("code", "year", "resolved", "swapped")
