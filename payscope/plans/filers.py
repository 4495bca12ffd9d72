"""Queries of the way from filings to the population and its exports."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.operators import company, export, history, population, statistics
from payscope.operators import filings as filing_records
from payscope.operators.ranking import bases, positions
from payscope.plans.registry import register
from payscope.plans.stand_ins import BASES_SQL, COMPANIES_SQL, CURVES_SQL, DENSE_SQL, SEGMENT_CURVE, companies, filings, sql_curve_at, table
from payscope.sources import archives
from payscope.sources.tables import scratch_path, spread, stored

_LISTS = """lists AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS doc_id, o_custkey AS code, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS sec_code,
    CASE WHEN o_orderkey % 5 = 0 THEN '130' ELSE '120' END AS doc_type, CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END AS withdrawn FROM orders),
  codes AS (SELECT c_custkey AS code, CASE WHEN c_nationkey < 20 THEN '内国法人・組合' ELSE '外国法人・組合' END AS kind, c_mktsegment AS tse33, CASE WHEN c_custkey % 2 = 0 THEN '上場' ELSE '' END AS listed,
    lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS corporate_number FROM customer WHERE c_custkey % 11 > 0),
  listed_ AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY sec_code ORDER BY day DESC, doc_id DESC) AS rn FROM lists WHERE isodow(day) <= 5 AND doc_type = '120' AND sec_code IS NOT NULL AND withdrawn = '0') t WHERE rn = 1),
  unlisted_ AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC, doc_id DESC) AS rn FROM lists
    WHERE doc_type = '120' AND sec_code IS NULL AND withdrawn <> '1' AND code IN (SELECT code FROM codes WHERE kind = '内国法人・組合')) t WHERE rn = 1)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select(
        "day", "doc_id", "code", F.when(F.col("code") % 3 > 0, F.col("code").cast("string")).alias("sec_code"), F.when(F.col("doc_id") % 5 == 0, "130").otherwise("120").alias("doc_type"),
        F.when(F.col("status") == "P", "1").otherwise("0").alias("withdrawn"),
    )


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 11 > 0").select(
        F.col("c_custkey").alias("code"), F.when(F.col("c_nationkey") < 20, population.DOMESTIC).otherwise("外国法人・組合").alias("kind"), F.col("c_mktsegment").alias("tse33"),
        F.when(F.col("c_custkey") % 2 == 0, "上場").otherwise("").alias("listed"), F.lpad(F.col("c_custkey").cast("string"), 13, "0").alias("corporate_number"),
    )


@register(f"WITH {_LISTS} SELECT code, doc_id, day FROM unlisted_")
def unlisted_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.unlisted_reports(_lists(spark, sf_dir), _codes(spark, sf_dir)).select("code", "doc_id", "day")


@register(f"WITH {_LISTS} SELECT code, sec_code, doc_id FROM listed_ UNION ALL SELECT code, sec_code, doc_id FROM unlisted_")
def listed_and_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.population_reports(_lists(spark, sf_dir), _codes(spark, sf_dir), with_unlisted=True).select("code", "sec_code", "doc_id")


@register(f"WITH {_LISTS} SELECT l.code AS edinet_code, l.doc_id, coalesce(c.tse33, '') AS tse33, coalesce(c.listed, '') AS listed, '産業計' AS industry FROM listed_ l LEFT JOIN codes c ON c.code = l.code")
def filings_with_codelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = population.population_reports(_lists(spark, sf_dir), _codes(spark, sf_dir)).select(F.col("code").alias("edinet_code"), "doc_id")
    return population.with_codelist(records, _codes(spark, sf_dir))


@register(f"""WITH {_LISTS} SELECT code, year, max(doc_id) AS doc_id FROM (SELECT *, CAST(year(day) AS INT) AS year FROM lists) l
  WHERE doc_type = '120' AND withdrawn <> '1' AND year BETWEEN 1993 AND 1996 AND code IN (SELECT code FROM codes) GROUP BY code, year""")
def yearly_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.yearly_targets(_lists(spark, sf_dir), _codes(spark, sf_dir), 1993, 1996).select("code", "year", "doc_id")


@register(f"""WITH {_LISTS}, t AS (SELECT code, year, max(doc_id) AS doc_id FROM (SELECT *, CAST(year(day) AS INT) AS year FROM lists) l
    WHERE doc_type = '120' AND withdrawn <> '1' AND code IN (SELECT code FROM codes) GROUP BY code, year)
  SELECT t.code AS edinet_code, t.year, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS avg_salary, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 4 AS DOUBLE) END AS avg_age, CAST(t.doc_id AS VARCHAR) AS doc_id
  FROM t JOIN orders ON o_orderkey = t.doc_id WHERE o_orderkey % 7 > 0""")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = population.yearly_targets(_lists(spark, sf_dir), _codes(spark, sf_dir), 1900, 2100)
    pay = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), pay.alias("avg_salary"), (F.col("o_custkey") % 4).cast("double").alias("avg_age"), F.lit(0.0).alias("employees_nonconsolidated"))
    out = population.history_export(population.history_records(targets, records).withColumn("doc_id", F.col("doc_id").cast("string")))
    return out.select("edinet_code", "year", "avg_salary", "avg_age", "doc_id")


@register("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'E' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS id, c_name AS name FROM customer")
def company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    sec = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(key)
    return table(spark, sf_dir, "customer").select(population.company_id(sec, F.concat(F.lit("E"), key), F.col("c_name")).alias("id"), F.col("c_name").alias("name"))


#: Folders for archives.
_SHELVES = 256


def _landed(docs: DataFrame, folder: str) -> None:
    """Archives on the shelves of ``folder``, one for each doc_id of ``docs`` (doc_id, seq, element, context, value)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shelves = set()
        facts = (r for b in batches for r in b.to_pylist())
        for path, own in itertools.groupby(facts, lambda r: r["path"]):
            at = root + path[len(folder) :]
            if (shelf := at.rpartition("/")[0]) not in shelves:
                store.create_dir(shelf)
                shelves.add(shelf)
            cells = ((r["element"], "", r["context"], "", "", "", "", "", r["value"]) for r in own)
            with zipfile.ZipFile(made := io.BytesIO(), "w") as z:
                z.writestr(zipfile.ZipInfo("facts.csv"), "\n".join(["header", *map("\t".join, cells)]).encode("utf-16"))
            with store.open_output_stream(at, compression=None) as f:
                f.write(made.getbuffer())
        yield pa.record_batch([pa.array([], pa.string())], names=["path"])

    placed = docs.select(archives.place_of(folder, "doc_id", _SHELVES).alias("path"), "seq", "element", "context", "value")
    placed = spread(placed, "path").sortWithinPartitions("path", "seq")
    placed.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


@register("""WITH lists AS (SELECT DISTINCT o_custkey AS code, CAST(year(o_orderdate) AS INT) AS year, 'S' || CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS doc_id FROM orders),
  wanted AS (SELECT * FROM lists WHERE code IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND year BETWEEN 1994 AND 1996),
  facts AS (SELECT w.doc_id, w.year, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS value, o_orderpriority < '3' AS alone FROM orders o JOIN wanted w ON w.code = o.o_custkey AND w.year = year(o.o_orderdate))
  SELECT doc_id, year, CAST(coalesce(arg_min(value, o_orderkey) FILTER (WHERE alone), arg_min(value, o_orderkey) FILTER (WHERE NOT alone)) AS DOUBLE) AS avg_salary, CAST(count(*) AS BIGINT) AS facts FROM facts GROUP BY 1, 2""")
def wanted_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of some filers and years, from archives that Spark wrote of all orders; the others stay closed."""
    pay = next(e for e, n in filing_records.ELEMENTS.items() if n == "avg_salary")
    year, code = F.year("o_orderdate"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), code.cast("string"), F.lit("-"), year.cast("string")).alias("doc_id"), code.alias("code"), year.alias("year"), F.col("o_orderkey").alias("seq"), F.lit(pay).alias("element"),
        F.when(F.col("o_orderpriority") < "3", "CurrentYearDuration_NonConsolidatedMember").otherwise("CurrentYearDuration").alias("context"), F.floor("o_totalprice").cast("string").alias("value"),
    )
    folder = scratch_path(spark, "archives")
    _landed(orders, folder)
    some = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("code"))
    index = archives.wanted_index(orders.join(some, "code", "left_semi").select("doc_id", "year"), folder, _SHELVES)
    facts = stored(archives.archive_facts(spark, index).where(F.col("year").between(1994, 1996)), "facts")  # archives are opened once
    counted = facts.groupBy("path", "doc_id", "year").agg(F.count("*").alias("facts"))
    return filing_records.records(facts).join(counted, "path").select("doc_id", "year", "avg_salary", "facts")


_EXPORT = f"""{BASES_SQL}, r AS (SELECT id, name, avg_age, avg_salary, salary AS salary35, round(salary / avg_salary, 4) AS factor, row_number() OVER (ORDER BY avg_salary DESC, row_idx) AS rank_raw,
    row_number() OVER (ORDER BY salary DESC, row_idx) AS rank_adj FROM bases WHERE basis = 35)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bases(companies(spark, sf_dir), (C.DEFAULT_AGE,)).where(F.col("basis") == C.DEFAULT_AGE).withColumnRenamed("salary", "salary35")
    rows = rows.withColumn("factor", population.pay_factor(F.col("salary35"), F.col("avg_salary")))
    placed = positions(positions(rows, "avg_salary", ["row_idx"], name="rank_raw"), "salary35", ["row_idx"], name="rank_adj")
    return placed.withColumns({"rank_delta": F.col("rank_raw") - F.col("rank_adj"), "sec_code": F.col("id").cast("string")})


@register(f"WITH {_EXPORT} SELECT rank_adj, rank_raw, rank_raw - rank_adj AS rank_delta, CAST(id AS VARCHAR) AS sec_code, name, avg_age, avg_salary, salary35, factor FROM r")
def unified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.unified_export(_ranked(spark, sf_dir)).select("rank_adj", "rank_raw", "rank_delta", "sec_code", "name", "avg_age", "avg_salary", "salary35", "factor")


@register(f"WITH {_EXPORT} SELECT CAST(id AS VARCHAR) AS sec_code, name, factor, salary35, rank_adj, CAST(NULL AS VARCHAR) AS salary35_fit, NOT (avg_age BETWEEN 28 AND 55) AS age_outlier FROM r")
def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).withColumn("age_outlier", model.age_outlier(F.col("avg_age")))
    return population.validation_export(rows).select("sec_code", "name", "factor", "salary35", "rank_adj", "salary35_fit", "age_outlier")


@register(f"""WITH {COMPANIES_SQL}, {CURVES_SQL}, k AS (SELECT id, avg_age, CASE WHEN id % 4 = 0 THEN 'AUTOMOBILE' ELSE curve_key END AS curve_key FROM (SELECT id, avg_age, CASE WHEN id % 4 = 0 THEN 'none' ELSE curve_key END AS curve_key FROM companies) c)
  SELECT id, round({sql_curve_at("avg_age")}, 4) AS level FROM k JOIN curves USING (curve_key)""")
def curve_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fourth of the companies have an industry without a series, which all industries stand in for."""
    key = F.element_at(F.create_map(*(F.lit(x) for pair in SEGMENT_CURVE.items() for x in pair)), F.col("curve_key"))
    rows = companies(spark, sf_dir).drop("curve").withColumn("industry", F.when(F.col("id") % 4 == 0, "none").otherwise(key))
    annual = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in C.WAGE_CURVES.items()], "curve_key string, curve array<double>").withColumn("curve", model.in_yen(F.col("curve")))
    curves, _ = population.curve_set({"annual_industry": annual}, "年収")
    return model.with_curve_values(population.with_curve(rows, curves), {"level": F.col("avg_age")}).select("id", F.round("level", 4).alias("level"))


@register(f"""WITH {DENSE_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year) - 1 AS place FROM dense), k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC) AS rn FROM p WHERE value IS NOT NULL)
  SELECT code, CAST(place AS INT) AS place, year, value FROM k WHERE rn = 1""")
def latest_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = history.dense_years(history.latest_per_year(filings(spark, sf_dir).select("code", "year", "doc_id", "value")))
    return population.latest_present(dense)


@register(f"WITH {COMPANIES_SQL} SELECT id, name FROM companies WHERE name = 'Customer#000000007' ORDER BY row_idx LIMIT 1")
def company_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.find_by_name(companies(spark, sf_dir), "Customer#000000007").select("id", "name")


@register("""WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN event_type END AS source, CASE WHEN event_id % 2 = 0 THEN 'timeout' END AS reason FROM events)
  SELECT CASE WHEN source IS NOT NULL THEN 'source' ELSE 'reason' END AS kind, coalesce(source, reason, 'unknown') AS value, count(*) AS n FROM e GROUP BY 1, 2""")
def source_and_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("source"), F.when(F.col("event_id") % 2 == 0, "timeout").alias("reason"))
    return population.reason_counts(rows)


@register(f"""WITH {BASES_SQL}, r AS (SELECT id, basis, tse33, salary, row_idx FROM bases WHERE basis IN (0, 35)),
  pairs AS (SELECT a.id, b.id AS neighbour_id, row_number() OVER (PARTITION BY a.id, a.basis ORDER BY abs(b.salary - a.salary), b.salary DESC, b.row_idx) AS place FROM r a JOIN r b ON a.basis = b.basis AND a.tse33 = b.tse33 AND a.id <> b.id),
  u AS (SELECT id, neighbour_id AS logo_id FROM pairs WHERE place <= 5 UNION SELECT id, id FROM r WHERE id IN (SELECT id FROM pairs))
  SELECT id, logo_id FROM u WHERE logo_id % 8 > 0""")
def page_logo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bases(companies(spark, sf_dir), (35,))
    return population.logo_ids(company.neighbours(rows), companies(spark, sf_dir).where("id % 8 > 0").select("id"))


@register(f"""WITH {_EXPORT}, a AS (SELECT id FROM r WHERE rank_raw <= 50), b AS (SELECT id FROM r WHERE rank_adj <= 50)
  SELECT id, 'left' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'entered' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def top50_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_churn(_ranked(spark, sf_dir), "avg_salary", "salary35", ["id"])


@register(f"WITH {BASES_SQL}, m AS (SELECT max(salary) AS most, avg(salary) AS mean FROM bases WHERE basis = 35 AND employees < 300) SELECT CASE WHEN mean <= most THEN round(mean / most * 100, 1) END AS marker, CAST(NULL AS DOUBLE) AS beyond FROM m")
def mean_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = bases(companies(spark, sf_dir), (35,)).where("basis = 35 AND employees < 300").agg(F.max("salary").alias("most"), F.avg("salary").alias("mean"))
    return ends.select(model.mean_marker(F.col("mean"), F.col("most")).alias("marker"), model.mean_marker(F.col("most") + 1, F.col("most")).alias("beyond"))


_UNITS_SQL = """SELECT c_custkey AS id, c_acctbal AS overtime_all, trim(c_mktsegment) AS overtime_scope, c_name AS as_of,
  CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ':' || CAST(c_custkey % 3 AS VARCHAR) ELSE '' END AS units FROM customer"""


@register(_UNITS_SQL)
def encoded_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with zero to two units, encoded with counted pairs and a pool, and read back."""
    unit = F.struct(F.col("c_mktsegment").alias("unit"), F.col("c_acctbal").alias("value"))
    none = F.array().cast("array<struct<unit: string, value: double>>")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("overtime_all"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("overtime_scope"), *(F.lit(None).cast("double").alias(c) for c in ("leave_all", "gap_all", "gap_regular", "gap_nonregular")),
        F.lit("").alias("gap_period"), F.col("c_name").alias("as_of"), F.lit(None).cast("string").alias("updated_at"),
        F.when(F.col("c_custkey") % 3 == 1, F.array(unit)).when(F.col("c_custkey") % 3 == 2, F.array(unit, unit)).otherwise(none).alias("overtime_units"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(unit)).otherwise(none).alias("leave_units"),
    )
    pool = stored(export.row_pool(rows, "id"), "row-pool")
    back = export.decoded_rows(export.encoded_rows(rows, pool), pool)
    units = F.when(F.size("overtime_units") > 0, F.concat(F.get("overtime_units", F.lit(0))["unit"], F.lit(":"), F.size("overtime_units").cast("string"))).otherwise("")
    return back.select("id", "overtime_all", "overtime_scope", "as_of", units.alias("units"))
