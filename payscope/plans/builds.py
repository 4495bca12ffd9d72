"""Queries of landing, checks, tables that are kept up to date, and images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.functions.pixels import png_bytes
from payscope.operators import sentences, served
from payscope.operators.checks import Between, Build, Holds, Matched, Unique
from payscope.operators.history import changes, latest_per_year
from payscope.operators.logos import normalised_logos
from payscope.operators.ranking import bases
from payscope.plans.registry import register
from payscope.plans.stand_ins import BASES_SQL, COMPANIES_SQL, CURVES_SQL, HISTORY_SQL, companies, filings, sql_curve_at, sql_estimate, table
from payscope.sources import yearly
from payscope.sources.tables import scratch_path, spread
from payscope.streaming import landing


@register("""WITH source AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders),
  matched AS (SELECT * FROM source WHERE o_orderstatus <> 'P'), known AS (SELECT c_custkey FROM customer WHERE c_nationkey < 20)
  SELECT name, CAST(value AS DOUBLE) AS value FROM (
    SELECT 'source' AS name, count(*) AS value FROM source UNION ALL SELECT 'matched', count(*) FROM matched
    UNION ALL SELECT 'one order a key', count(*) FROM matched WHERE o_orderkey IN (SELECT o_orderkey FROM matched GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'one order a customer', count(*) FROM matched WHERE o_custkey IN (SELECT o_custkey FROM matched GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'small price', count(*) FROM matched WHERE NOT (o_totalprice < 100000)
    UNION ALL SELECT 'known customer', count(*) FROM matched WHERE o_custkey NOT IN (SELECT c_custkey FROM known)
    UNION ALL SELECT 'greatest key', max(o_orderkey) FROM matched)""")
def checks_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a build and of the rows that break its rules, gathered while its rows were written."""
    build = Build()
    source = build.counted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "source")
    matched = build.counted(source.where("o_orderstatus <> 'P'"), "matched")
    known = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    rows = build.checked(
        matched, "o_orderkey", Unique("one order a key", "o_orderkey"), Unique("one order a customer", "o_custkey"), Holds("small price", F.col("o_totalprice") < 100_000),
        Matched("known customer", known, "o_custkey"), Between("greatest key", F.max("o_orderkey")),
    )
    path = scratch_path(spark, "build")
    rows.write.parquet(f"{path}/rows")
    build.faults(spark.read.parquet(f"{path}/rows"))
    return spark.createDataFrame([(name, float(value)) for name, value in build.metrics.items()], "name string, value double")  # a row for each rule


@register("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, epoch(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS asked,
    CASE WHEN o_orderpriority < '2' THEN 'ok' WHEN o_orderpriority < '3' THEN 'empty' ELSE 'bad' END AS status FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY asked) AS k FROM a),
  s AS (SELECT day, min(k) FILTER (WHERE status <> 'bad') AS settled, max(k) AS all_, arg_min(status, k) FILTER (WHERE status <> 'bad') AS status, max(asked) AS last FROM n GROUP BY day)
  SELECT day, CASE WHEN settled <= 5 THEN status WHEN all_ >= 5 THEN 'failed' ELSE 'open' END AS state,
    CAST(CASE WHEN settled <= 5 THEN settled WHEN all_ >= 5 THEN 5 ELSE all_ END AS INT) AS answers,
    CAST(CASE WHEN coalesce(settled, 99) > 5 AND all_ < 5 THEN last + pow(2, all_) END AS BIGINT) AS ask_at FROM s""")
def landed_day_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of days whose answers, one for each order, have landed as JSON lines and went through the stream."""
    good = F.struct(F.struct(F.lit("200").alias("status")).alias("metadata"), F.array(F.struct(F.col("o_orderkey").cast("string").alias("docID"))).alias("results"))
    empty, limit = F.struct(F.struct(F.lit("404").alias("status")).alias("metadata")), F.struct(F.lit("429").alias("statusCode"))
    body = F.when(F.col("o_orderpriority") < "2", F.to_json(good)).when(F.col("o_orderpriority") < "3", F.to_json(empty)).otherwise(F.to_json(limit))
    answers = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("at"), F.col("o_orderkey").cast("string").alias("file"), body.alias("body"),
    )
    path = scratch_path(spark, "landing")
    answers.write.json(f"{path}/in")
    landed = spark.readStream.schema(landing.ANSWER).json(f"{path}/in")
    landing.keep_events(landed, f"{path}/events", f"{path}/checkpoint").awaitTermination()
    states = landing.day_states(spark.read.parquet(f"{path}/events"))
    return states.withColumn("ask_at", F.unix_seconds("ask_at"))


_CHANGED = f"{COMPANIES_SQL}, changed AS (SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN avg_salary * 1.5 ELSE avg_salary END AS avg_salary) FROM companies WHERE id % 97 > 0), " + BASES_SQL.removeprefix(
    COMPANIES_SQL + ", "
).replace("FROM companies JOIN curves", "FROM changed JOIN curves")


def _served(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The ranking of all companies, served, and then with some of them paying more and others gone."""
    all_ = companies(spark, sf_dir)
    ranked = lambda rows: bases(rows, (35,)).select("basis", "id", "row_idx", "name", "salary")
    folder = scratch_path(spark, "served")
    version = served.build(ranked(all_), folder)
    more = all_.where("id % 10 = 0").withColumn("avg_salary", F.col("avg_salary") * 1.5)
    return folder, served.merge(spark, folder, version, ranked(more), all_.where("id % 97 = 0").select("id"))


@register(f"""WITH {_CHANGED}, r AS (SELECT id, name, salary, row_number() OVER (ORDER BY salary DESC, row_idx) AS position, count(*) OVER () AS total FROM bases WHERE basis = 35)
  SELECT id, name, salary, position, total, 4 AS page FROM r WHERE position BETWEEN 91 AND 120""")
def served_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, version = _served(spark, sf_dir)
    return served.page(spark, folder, version, 35, 4).select("id", "name", "salary", "position", "total", "page")


@register(f"""WITH {_CHANGED}, r AS (SELECT basis, id, rank() OVER (PARTITION BY basis ORDER BY salary DESC) AS rank, count(*) OVER (PARTITION BY basis) AS total FROM bases WHERE basis IN (0, 35))
  SELECT * FROM r WHERE id IN (SELECT id FROM companies WHERE tse33 = 3)""")
def served_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, version = _served(spark, sf_dir)
    return served.standing(spark, folder, version, companies(spark, sf_dir).where("tse33 = 3").select("id"))


def _yearly(spark: SparkSession, sf_dir: str) -> str:
    """The name of the bucketed history of the filings, of which the odd ones arrived late."""
    rows = filings(spark, sf_dir).select("code", "doc_id", "value", "source", "year")
    path = scratch_path(spark, "yearly")
    name = "yearly_" + path.rsplit("-", 1)[1]
    yearly.create(latest_per_year(rows.where("doc_id % 2 = 0")), name, path)
    yearly.merge(spark, name, rows.where("doc_id % 2 = 1"))
    return name


_SOME = ", ".join(f"({y})" for y in range(1994, 1998))


@register(f"""WITH {HISTORY_SQL}, years AS (SELECT * FROM (VALUES {_SOME}) t(year)), own AS (SELECT * FROM history WHERE year BETWEEN 1994 AND 1997),
  dense AS (SELECT c.code, y.year, o.value FROM (SELECT DISTINCT code FROM own) c CROSS JOIN years y LEFT JOIN own o ON o.code = c.code AND o.year = y.year),
  x AS (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY year) AS b, first_value(value IGNORE NULLS) OVER (PARTITION BY code ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
    min(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY code) AS y FROM dense)
  SELECT code, CAST(year AS INT) AS year, value, CASE WHEN b <> 0 THEN round((value - b) / CAST(b AS DOUBLE), 9) END AS yoy,
    CASE WHEN year <> y AND f <> 0 THEN round((value - f) / CAST(f AS DOUBLE), 9) END AS cumulative FROM x""")
def bucketed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between some years, from the table by year and code."""
    return changes(yearly.dense(spark.table(_yearly(spark, sf_dir)), list(range(1994, 1998))))


@register(f"""WITH {HISTORY_SQL} SELECT code, max(value) AS peak, CAST(count(*) AS BIGINT) AS years FROM history WHERE year IN (SELECT CAST(year(max(o_orderdate)) AS INT) - k FROM orders, (VALUES (1), (3)) t(k) GROUP BY k) GROUP BY code""")
def bucketed_some_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the years that another table names: only their folders are read."""
    last = table(spark, sf_dir, "orders").agg(F.year(F.max("o_orderdate")).alias("last"))
    wanted = last.select(F.explode(F.array(F.col("last") - 1, F.col("last") - 3)).alias("year"))
    own = spark.table(_yearly(spark, sf_dir)).join(F.broadcast(wanted), "year")  # two rows
    return own.groupBy("code").agg(F.max("value").alias("peak"), F.count("*").alias("years"))


@register("""WITH s AS (SELECT p_partkey AS id, p_partkey % 6 AS kind, CASE WHEN p_partkey % 6 = 3 THEN 1 ELSE 2 + p_partkey * 7 % 200 END AS h, 2 + p_partkey % 60 AS w FROM part),
  r AS (SELECT *, CASE WHEN kind = 2 THEN 'notImage' WHEN kind = 3 THEN 'tooTiny' WHEN greatest(h, w) > 20 * least(h, w) THEN 'extremeRatio' WHEN kind = 1 THEN 'almostTransparent'
      WHEN kind = 0 OR round(w * CAST(24 AS DOUBLE) / greatest(h, w)) < 2 THEN 'solidColor' END AS reason, w - w // 2 AS cut FROM s),
  t AS (SELECT *, least(CAST(96 AS DOUBLE) / h, CAST(384 AS DOUBLE) / cut, 1) AS scale FROM r)
  SELECT id, reason, CASE WHEN reason IS NULL THEN CAST(greatest(1, floor(cut * scale + 0.5)) AS INT) END AS width, CASE WHEN reason IS NULL THEN CAST(greatest(1, floor(h * scale + 0.5)) AS INT) END AS height FROM t""")
def logo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of pictures that Spark paints of the parts: one colour, transparent, no image, a line, or two halves, of which the first is a margin."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        key.alias("id"), (key % 6).cast("int").alias("kind"), F.when(key % 6 == 3, 1).otherwise(2 + key * 7 % 200).cast("int").alias("h"), (2 + key % 60).cast("int").alias("w")
    )

    @F.udf("binary", useArrow=True)
    def painted(kind: int, height: int, width: int) -> bytes:
        picture = np.full((height, width, 4), 200, np.uint8)
        picture[:, :, 3] = 0 if kind == 1 else 255
        if kind > 3:
            picture[:, width // 2 :, :3] = 20
        return b"no image" if kind == 2 else png_bytes(picture)

    images = spread(parts, "id").select("id", painted("kind", "h", "w").alias("image"))
    return normalised_logos(images).select("id", "reason", "width", "height")


@register(f"""WITH {COMPANIES_SQL}, {CURVES_SQL} SELECT id, name, avg_age, avg_salary, 35 AS target_age, 22 AS anchor_age, v0 AS at_anchor, {sql_curve_at("CAST(35 AS DOUBLE)")} AS at_target,
  {sql_curve_at("avg_age")} AS at_age, {sql_estimate("avg_age", "CAST(35 AS DOUBLE)", "avg_salary")} AS estimated FROM companies JOIN curves USING (curve_key)""")
def formula_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.formula_example(companies(spark, sf_dir))
