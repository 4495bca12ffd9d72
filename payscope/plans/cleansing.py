"""Queries of cleansing, resolution and joins by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.functions import model
from payscope.operators import resolution as r
from payscope.operators import worklife
from payscope.operators.statistics import majority
from payscope.plans.registry import register
from payscope.plans.stand_ins import COMPANIES_SQL, FILINGS_SQL, companies, filings, table

_PAY = "CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice * 100 WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice * 10 ELSE l_extendedprice * 100000 END"
_CEILING = "CASE WHEN l_quantity >= 20 THEN 30000000 ELSE 120000000 END"


def _fits(x: str) -> str:
    return f"{x} BETWEEN 2000000 AND ceiling"


def _tries(op: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {_fits(f'pay {op} {f}')} THEN pay {op} {f} END" for f in (10, 100, 1000, 10000)) + ")"


@register(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_PAY} AS pay, {_CEILING} AS ceiling FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN {_fits("pay")} THEN pay WHEN pay < 2000000 THEN {_tries("*")} ELSE {_tries("/")} END, 4) AS repaired FROM p""")
def digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, k = F.col("l_extendedprice"), F.col("l_linenumber") % 4
    pay = F.when(k == 0, price * 100).when(k == 1, price).when(k == 2, price * 10).otherwise(price * 100_000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(model.repaired_pay(pay, F.col("l_quantity")), 4).alias("repaired"))


@register(f"""WITH {COMPANIES_SQL}, g AS (SELECT id, employees, CASE WHEN id % 7 = 0 THEN NULL ELSE employees * (1 + id % 23) END AS everybody, avg_age FROM companies),
  q AS (SELECT *, CASE WHEN everybody > 0 THEN round(employees / CAST(everybody AS DOUBLE), 4) END AS emp_ratio FROM g)
  SELECT id, emp_ratio, CASE WHEN emp_ratio IS NULL OR emp_ratio >= 0.1 THEN '' ELSE '本社のみ' END AS badge, coalesce(emp_ratio < 0.1 AND everybody >= 500, false) AS holding, NOT (avg_age BETWEEN 28 AND 55) AS age_outlier FROM q""")
def emp_ratio_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    everybody = F.when(F.col("id") % 7 != 0, F.col("employees") * (1 + F.col("id") % 23))
    rows = companies(spark, sf_dir).withColumn("everybody", everybody).withColumn("emp_ratio", model.staff_ratio(F.col("employees"), F.col("everybody")))
    return rows.select("id", "emp_ratio", model.badge(F.col("emp_ratio")).alias("badge"), model.holding_flag(F.col("emp_ratio"), F.col("everybody")).alias("holding"), model.age_outlier(F.col("avg_age")).alias("age_outlier"))


@register(f"""WITH {COMPANIES_SQL} SELECT id FROM companies WHERE avg_age BETWEEN 20 AND 65 AND avg_salary > 1000000 AND coalesce(employees, 0) >= 100 AND avg_age BETWEEN 28 AND 55""")
def body_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = companies(spark, sf_dir)
    return rows.where(model.plausible(F.col("avg_salary"), F.col("avg_age")) & (F.coalesce("employees", F.lit(0)) >= 100) & ~model.age_outlier(F.col("avg_age"))).select("id")


@register(f"""WITH {FILINGS_SQL}, n AS (SELECT code, doc_id, value, year FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, doc_id) AS rn FROM filings) t WHERE rn = 1)
  SELECT c_custkey AS code, c_name AS name, doc_id, value, year FROM customer JOIN n ON n.code = c_custkey""")
def newest_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    return r.join_by_key(people, filings(spark, sf_dir).select("code", "doc_id", "value", "year"), "code", "year", "doc_id")


@register("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.unmatched(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


_CODES = """codes AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS sec_code, c_custkey * 7 % 37 + 37 * (c_custkey // 120) AS name_key, c_custkey % 5 AS listed FROM customer),
  rows_ AS (SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 5 > 0 THEN '' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS sec_code, c_custkey * 11 % 37 + 37 * (c_custkey // 120) AS name_key, c_custkey % 7 AS listed FROM customer)"""


@register(f"""WITH RECURSIVE {_CODES}, u AS (SELECT sec_code, min(code) AS code FROM codes WHERE sec_code <> '' GROUP BY sec_code HAVING count(*) = 1),
  one AS (SELECT r.row_idx, r.name_key, r.listed, u.code FROM rows_ r LEFT JOIN u ON u.sec_code = r.sec_code),
  pend AS (SELECT row_idx, name_key, listed, row_number() OVER (PARTITION BY name_key ORDER BY row_idx) AS i FROM one WHERE code IS NULL),
  grp AS (SELECT name_key, list({{'code': code, 'listed': listed}} ORDER BY code) AS cands, list(code) FILTER (WHERE code IN (SELECT code FROM one WHERE code IS NOT NULL)) AS used FROM codes GROUP BY name_key),
  walk AS (
    SELECT name_key, CAST(0 AS BIGINT) AS i, coalesce(used, []) AS used, CAST(NULL AS BIGINT) AS row_idx, CAST(NULL AS BIGINT) AS code FROM grp
    UNION ALL
    SELECT name_key, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, row_idx, pick FROM (
      SELECT *, CASE WHEN len(c2) = 1 THEN c2[1].code END AS pick FROM (
        SELECT *, CASE WHEN len(c1) > 1 AND len(list_filter(c1, lambda x: NOT list_contains(used, x.code))) = 1 THEN list_filter(c1, lambda x: NOT list_contains(used, x.code)) ELSE c1 END AS c2 FROM (
          SELECT w.name_key, p.i, w.used, p.row_idx, CASE WHEN len(g.cands) > 1 AND len(list_filter(g.cands, lambda x: x.listed = p.listed)) = 1 THEN list_filter(g.cands, lambda x: x.listed = p.listed) ELSE g.cands END AS c1
          FROM walk w JOIN grp g ON g.name_key = w.name_key JOIN pend p ON p.name_key = w.name_key AND p.i = w.i + 1) a) b) c)
  SELECT row_idx, code, 1 AS phase FROM one WHERE code IS NOT NULL
  UNION ALL SELECT p.row_idx, w.code, CASE WHEN w.code IS NULL THEN 0 ELSE 2 END FROM pend p LEFT JOIN walk w ON w.row_idx = p.row_idx""")
def two_phase_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL walks the rows of each name in order with a list of what was taken."""
    key = F.col("c_custkey")
    code = lambda when: F.when(when, "").otherwise((key % 1000).cast("string")).alias("sec_code")
    name = lambda k: (key * k % 37 + 37 * F.floor(key / 120)).cast("long").alias("name_key")
    people = table(spark, sf_dir, "customer")
    codes = people.select(key.alias("code"), code(key % 3 == 0), name(7), (key % 5).alias("listed"))
    rows = people.select(key.alias("row_idx"), code(key % 5 > 0), name(11), (key % 7).alias("listed"))
    return r.two_phase(rows, codes)


@register("""WITH p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE '2000-03' END AS period FROM orders), c AS (SELECT period, count(*) AS n FROM p GROUP BY 1)
  SELECT period, n, (SELECT count(*) FROM p) AS total FROM c ORDER BY n DESC, period DESC LIMIT 1""")
def fiscal_mode_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("2000-03")
    return majority(table(spark, sf_dir, "orders").select(period.alias("period")), "period")


@register(f"""WITH {FILINGS_SQL}, k AS (SELECT code, day, doc_id FROM filings WHERE status <> 'P' AND isodow(day) <= 5)
  SELECT code, day, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC, doc_id DESC) AS rn FROM k) t WHERE rn = 1""")
def filing_weekday_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).select(F.col("code").alias("sec_code"), "day", "doc_id", F.lit("120").alias("doc_type"), F.when(F.col("status") == "P", "1").otherwise("0").alias("withdrawn"))
    return r.annual_reports(rows).select(F.col("sec_code").alias("code"), "day", "doc_id")


_SLOTS = ("error", "click", "view", "purchase")


@register("WITH f AS (SELECT user_id, event_type, min_by(value, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{s}' THEN v END) AS \"{s}\"" for s in _SLOTS) + " FROM f WHERE event_type IN (" + ", ".join(f"'{s}'" for s in _SLOTS) + ") GROUP BY user_id")
def slot_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.first_per_slot(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id", _SLOTS)


_FLAGS = ("A", "N", "R")


@register("""WITH w AS (SELECT l_suppkey, l_returnflag, round(avg(l_extendedprice) * 12 + max(l_quantity), 1) AS wage FROM lineitem GROUP BY 1, 2)
  SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN wage END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN wage END) AS "N", max(CASE WHEN l_returnflag = 'R' THEN wage END) AS "R" FROM w GROUP BY 1""")
def wage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wages = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_extendedprice") * 12 + F.max("l_quantity"), 1).alias("wage"))
    return wages.groupBy("l_suppkey").pivot("l_returnflag", list(_FLAGS)).agg(F.max("wage"))


@register("""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders), d AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS day FROM b),
  n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
  SELECT CAST(d.day AS DATE) AS day, coalesce(n, 0) AS n FROM d LEFT JOIN n ON n.day = d.day WHERE isodow(d.day) <= 5""")
def working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The working days between the first and the last order, with how many orders each has."""
    day = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return r.working_days_of(day).join(day.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as register rows: hours that may be negative, and two rows for every third number."""
    given = {
        "corporate_number": F.lpad(F.col("c_custkey").cast("string"), 13, "0"), "name": F.col("c_name"), "overtime_all": F.round("c_acctbal", 0).cast("long").cast("string"),
        "leave_all": F.when(F.col("c_custkey") % 4 == 0, "-").otherwise((F.col("c_custkey") % 110).cast("string")), "overtime_unit1": F.col("c_mktsegment"),
        "overtime_unit1_value": F.when(F.col("c_custkey") % 5 == 0, "-3").otherwise("7"), "updated_at": F.concat(F.lit("2024-0"), (F.col("copy") + 1).cast("string")),
    }
    rows = table(spark, sf_dir, "customer").select("*", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.select(*(given.get(c, F.lit("")).alias(c) for c in worklife.POSITIONS), (F.col("c_custkey") * 2 + F.col("copy")).alias("seq"))


_REGISTER = """reg AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS corporate_number, c_custkey, CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS DOUBLE) AS hours,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 110 AS DOUBLE) END AS leave_all, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN CAST(-3 AS DOUBLE) ELSE CAST(7 AS DOUBLE) END AS u FROM customer)"""


@register(f"""WITH {_REGISTER} SELECT corporate_number, CASE WHEN hours >= 0 THEN hours END AS overtime_all, leave_all, c_mktsegment AS unit, CASE WHEN u >= 0 THEN u END AS unit_value,
  CASE WHEN c_custkey % 3 = 0 THEN '2024-02' ELSE '2024-01' END AS updated_at FROM reg WHERE hours >= 0 OR u >= 0 OR leave_all IS NOT NULL""")
def worklife_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 13, "0").alias("corporate_number"))
    unit = F.get(F.col("overtime_units"), F.lit(0))
    return worklife.joined(people, _register(spark, sf_dir)).select("corporate_number", "overtime_all", "leave_all", unit["unit"].alias("unit"), unit["value"].alias("unit_value"), "updated_at")


@register(f"""WITH {_REGISTER}, twice AS (SELECT r.* FROM reg r UNION ALL SELECT r.* FROM reg r WHERE c_custkey % 3 = 0)
  SELECT corporate_number, 'overtime_all' AS field, count(*) AS n FROM twice WHERE hours < 0 GROUP BY 1 UNION ALL SELECT corporate_number, 'overtime_unit:' || c_mktsegment, count(*) FROM twice WHERE u < 0 GROUP BY 1, 2""")
def worklife_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklife.dropped(_register(spark, sf_dir)).groupBy("corporate_number", "field").agg(F.count("*").alias("n"))


@register(f"""WITH {_REGISTER}, kept AS (SELECT * FROM reg WHERE hours >= 0 OR u >= 0 OR leave_all IS NOT NULL)
  SELECT count(*) FILTER (WHERE hours >= 0 OR u >= 0) AS overtime, count(leave_all) AS leave, CAST(0 AS BIGINT) AS gap, CAST(0 AS BIGINT) AS note, count(*) AS n FROM kept""")
def worklife_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 13, "0").alias("corporate_number"))
    return worklife.fill_rates(worklife.joined(people, _register(spark, sf_dir)))
