"""Queries of the model and of the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.functions import model
from payscope.operators.ranking import RankingQuery, bases, competition_ranks, positions, ranked, run_query
from payscope.operators.statistics import dense_counts, movement, movers
from payscope.plans.registry import register
from payscope.plans.stand_ins import BASES_SQL, COMPANIES_SQL, CURVES_SQL, PARTS_SQL, companies, parts, sql_curve_at, sql_estimate, table

_COLUMNS = ("rank", "population_rank", "id", "name", "tse33", "salary", "avg_age", "employees", "page", "total", "page_max")


@register(f"WITH {COMPANIES_SQL}, {CURVES_SQL} SELECT id, CAST(floor({sql_curve_at('avg_age')} + 0.5) AS BIGINT) AS wage FROM companies JOIN curves USING (curve_key)")
def interp_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.with_curve_values(companies(spark, sf_dir), {"wage": F.col("avg_age")}).select("id", model.half_up(F.col("wage")).alias("wage"))


@register(f"WITH {COMPANIES_SQL}, {CURVES_SQL} SELECT id, {sql_estimate('avg_age', 'CAST(35 AS DOUBLE)', 'avg_salary')} AS salary35 FROM companies JOIN curves USING (curve_key)")
def estimate_age35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.with_estimates(companies(spark, sf_dir), {"salary35": F.lit(35.0)}).select("id", "salary35")


@register(f"WITH {BASES_SQL} SELECT id, basis, salary FROM bases")
def estimate_all_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases(companies(spark, sf_dir)).select("id", "basis", "salary")


def _sql(basis: int = 35, where: str = "true", order: str = "salary DESC", page: int = 1) -> str:
    return f"""WITH {BASES_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY salary DESC, row_idx) AS population_rank FROM bases WHERE basis = {basis}),
      kept AS (SELECT *, row_number() OVER (ORDER BY population_rank) AS rank FROM placed WHERE {where}),
      paged AS (SELECT *, row_number() OVER (ORDER BY {order}, rank) AS pos, count(*) OVER () AS total FROM kept),
      clamped AS (SELECT *, CAST(least({page}, greatest(1, ceil(total / CAST(30 AS DOUBLE)))) AS INT) AS page FROM paged),
      shown AS (SELECT * FROM clamped WHERE pos > (page - 1) * 30 AND pos <= page * 30)
      SELECT rank, population_rank, id, name, tse33, salary, avg_age, employees, page, total, max(salary) OVER () AS page_max FROM shown"""


def _ranking(name: str, query: RankingQuery, sql: str, fold: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_query(companies(spark, sf_dir), query, fold).select(*_COLUMNS)

    register(sql, name)(run)


_ranking("ranking_default_page1", RankingQuery(), _sql())
_ranking("ranking_raw_page2", RankingQuery(age=None, page=2), _sql(0, page=2))
_ranking("ranking_industry", RankingQuery(industry=7), _sql(where="tse33 = 7"))
_ranking("ranking_filtered_page", RankingQuery(employees="1000-", tenure="13-17", avg_age="-40"), _sql(where="employees >= 1000 AND avg_tenure >= 13 AND avg_tenure < 17 AND avg_age < 40"))
_ranking("ranking_page_clamp", RankingQuery(page=9999), _sql(page=9999))
_ranking("search_contains", RankingQuery(text="株式会社 Customer#00000012"), _sql(where="contains(replace(lower(name), ' ', ''), 'customer#00000012')"))
for _axis, _column in (("salary", "salary"), ("age", "avg_age"), ("emp", "employees")):
    for _down in (True, False):
        _word = "desc" if _down else "asc"
        _ranking(f"ranking_sort_{_axis}_{_word}", RankingQuery(sort=_axis, descending=_down), _sql(order=f"{_column} {_word.upper()}"))


@register(f"""WITH {BASES_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY salary DESC, row_idx) AS population_rank FROM bases WHERE basis = 40)
  SELECT id, salary, population_rank, row_number() OVER (ORDER BY population_rank) AS rank FROM placed WHERE employees < 300""")
def ranking_filtered_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(companies(spark, sf_dir), RankingQuery(age=40, employees="-300")).select("id", "salary", "population_rank", "rank")


@register(f"""WITH {COMPANIES_SQL} SELECT 'employees' AS axis, CASE WHEN employees < 300 THEN '-300' WHEN employees < 1000 THEN '300-1000' ELSE '1000-' END AS bucket, count(*) AS n FROM companies GROUP BY 1, 2
  UNION ALL SELECT 'tenure', CASE WHEN avg_tenure < 13 THEN '-13' WHEN avg_tenure < 17 THEN '13-17' ELSE '17-' END, count(*) FROM companies GROUP BY 1, 2
  UNION ALL SELECT 'age', CASE WHEN avg_age < 40 THEN '-40' WHEN avg_age < 43 THEN '40-43' ELSE '43-' END, count(*) FROM companies GROUP BY 1, 2""")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda axis, bucket: F.struct(F.lit(axis).alias("axis"), bucket.alias("bucket"))
    each = F.array(pair("employees", model.employee_bucket(F.col("employees"))), pair("tenure", model.tenure_bucket(F.col("avg_tenure"))), pair("age", model.age_bucket(F.col("avg_age"))))
    return companies(spark, sf_dir).select(F.inline(each)).groupBy("axis", "bucket").agg(F.count("*").alias("n"))


@register(f"""WITH {COMPANIES_SQL} SELECT n_nationkey AS tse33, n_name AS industry, count(id) AS n FROM nation
  LEFT JOIN (SELECT * FROM companies WHERE employees < 100) c ON c.tse33 = n_nationkey GROUP BY 1, 2""")
def industry_counts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = companies(spark, sf_dir).where("employees < 100")
    return dense_counts(small, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tse33"), F.col("n_name").alias("industry")), "tse33")


@register(f"WITH {PARTS_SQL} SELECT id, salary, rank() OVER (ORDER BY salary DESC) AS rank FROM parts")
def rank_all_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competition_ranks(parts(spark, sf_dir), "salary", ["basis"]).select("id", "salary", "rank")


@register(f"WITH {PARTS_SQL} SELECT id, tse33, salary, rank() OVER (PARTITION BY tse33 ORDER BY salary DESC) AS rank FROM parts")
def rank_industry_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competition_ranks(parts(spark, sf_dir), "salary", ["tse33"]).select("id", "tse33", "salary", "rank")


_MOVES = f"""{BASES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY avg_salary DESC, row_idx) AS rank_raw, row_number() OVER (ORDER BY salary DESC, row_idx) AS rank_adj FROM bases WHERE basis = 35)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bases(companies(spark, sf_dir), (35,)).where("basis = 35")
    return positions(positions(rows, "avg_salary", ["row_idx"], name="rank_raw"), "salary", ["row_idx"], name="rank_adj")


@register(f"WITH {_MOVES} SELECT id, rank_raw, rank_adj, rank_raw - rank_adj AS rank_delta FROM r")
def rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).select("id", "rank_raw", "rank_adj", (F.col("rank_raw") - F.col("rank_adj")).alias("rank_delta"))


@register(f"""WITH {_MOVES} SELECT count(*) AS n, round(avg(abs(rank_raw - rank_adj)), 6) AS mean_move, CAST(median(abs(rank_raw - rank_adj)) AS DOUBLE) AS median_move, count(*) FILTER (WHERE abs(rank_raw - rank_adj) >= 50) AS far,
  count(*) FILTER (WHERE rank_raw > rank_adj) AS risen, count(*) FILTER (WHERE rank_raw < rank_adj) AS fallen FROM r""")
def movement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement(_moves(spark, sf_dir))


@register(f"""WITH {_MOVES}, d AS (SELECT id, rank_raw - rank_adj AS move FROM r), x AS (SELECT id, move, row_number() OVER (ORDER BY move DESC, id) AS u, row_number() OVER (ORDER BY move, id) AS v FROM d)
  SELECT id, move, 'up' AS side, CAST(u AS INT) AS place FROM x WHERE u <= 15 UNION ALL SELECT id, move, 'down', CAST(v AS INT) FROM x WHERE v <= 15""")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movers(_moves(spark, sf_dir))


@register(f"""WITH {BASES_SQL} SELECT id, round(salary * CAST(0.8 AS DOUBLE), 4) AS low, round(salary * CAST(1.2 AS DOUBLE), 4) AS high FROM bases WHERE basis = 45""")
def estimate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = model.estimate_range(F.col("salary"))
    return bases(companies(spark, sf_dir), (45,)).where("basis = 45").select("id", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@register(f"""WITH {BASES_SQL}, m AS (SELECT max(salary) AS most FROM bases WHERE basis = 35)
  SELECT id, round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), CAST(salary AS DOUBLE) / CAST(most AS DOUBLE) * 100)), 1) AS bar FROM bases, m WHERE basis = 35""")
def bar_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bases(companies(spark, sf_dir), (35,)).where("basis = 35")
    most = rows.agg(F.max("salary").alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("id", model.bar_percent(F.col("salary"), F.col("most")).alias("bar"))  # one row
