"""Queries of population statistics and of one company among the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.functions.text import bin_label
from payscope.operators import company, sentences, statistics
from payscope.operators.ranking import bases, positions, with_pays
from payscope.plans.registry import register
from payscope.plans.stand_ins import BASES_SQL, COMPANIES_SQL, CURVES_SQL, PARTS_SQL, companies, parts, sql_curve_at
from payscope.sources.tables import spread

_ROWS = """placed AS (SELECT basis, salary, row_number() OVER (PARTITION BY basis ORDER BY salary) - 1 AS pos, count(*) OVER (PARTITION BY basis) AS n FROM bases)"""


def _at(p: float) -> str:
    return f"max(CASE WHEN pos = least(n - 1, CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT)) THEN salary END)"


_SPAN = " ".join(f"WHEN q95 - q02 <= {C.BINS * w * 10_000} THEN {w * 10_000}" for w in C.BIN_LADDER[:-1])
_SCALE = f"""{_ROWS}, ends AS (SELECT basis, {_at(0.02)} AS q02, {_at(0.95)} AS q95 FROM placed GROUP BY basis),
  widths AS (SELECT *, CASE {_SPAN} ELSE {C.BIN_LADDER[-1] * 10_000} END AS width FROM ends),
  scale AS (SELECT basis, CAST(floor(q02 / CAST(width AS DOUBLE)) * width AS BIGINT) AS low, CAST(width AS BIGINT) AS width FROM widths)"""
_BIN = "CAST(greatest(0, least(8, floor((salary - low) / CAST(width AS DOUBLE)))) AS INT)"
_PEOPLE = "people AS (SELECT basis, count(*) AS n, CAST(floor(avg(salary) + 0.5) AS BIGINT) AS mean, round(stddev_pop(salary), 3) AS sd FROM bases GROUP BY basis)"


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases(companies(spark, sf_dir))


@register(f"WITH {BASES_SQL}, {_PEOPLE} SELECT * FROM people")
def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.population(_bases(spark, sf_dir))


@register(f"WITH {BASES_SQL}, {_ROWS} SELECT basis, {_at(0.5)} AS median, {_at(0.02)} AS q02, {_at(0.95)} AS q95 FROM placed GROUP BY basis")
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.nearest_rank(_bases(spark, sf_dir), {"median": 0.5, "q02": 0.02, "q95": 0.95})


@register(f"""WITH {BASES_SQL}, {_SCALE}, bins AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) t(bin)),
  counted AS (SELECT b.basis, {_BIN} AS bin, count(*) AS n FROM bases b JOIN scale s ON s.basis = b.basis GROUP BY 1, 2)
  SELECT s.basis, i.bin, s.low, s.width, coalesce(c.n, 0) AS n FROM scale s CROSS JOIN bins i LEFT JOIN counted c ON c.basis = s.basis AND c.bin = i.bin""")
def adaptive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(_bases(spark, sf_dir))


@register(f"WITH {BASES_SQL}, {_SCALE} SELECT b.id, b.basis, {_BIN} AS bin FROM bases b JOIN scale s ON s.basis = b.basis")
def bin_of_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bases(spark, sf_dir)
    scale = statistics.histogram_scale(rows)
    return rows.join(F.broadcast(scale), "basis").select("id", "basis", model.bin_of(F.col("salary"), F.col("low"), F.col("width")).alias("bin"))  # nine rows


@register(f"""WITH {BASES_SQL}, {_PEOPLE} SELECT b.id, b.basis, round(CASE WHEN sd > 0 THEN 50 + CAST(10 AS DOUBLE) * (salary - mean) / sd ELSE 50 END, 6) AS deviation FROM bases b JOIN people p ON p.basis = b.basis""")
def deviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bases(spark, sf_dir)
    people = statistics.population(rows)
    return rows.join(F.broadcast(people), "basis").select("id", "basis", F.round(model.deviation(F.col("salary"), F.col("mean"), F.col("sd")), 6).alias("deviation"))  # nine rows


@register(f"""WITH {BASES_SQL}, {_PEOPLE}, {_SCALE}, med AS (SELECT basis, {_at(0.5)} AS median FROM placed GROUP BY basis),
  ranks AS (SELECT *, rank() OVER (PARTITION BY basis ORDER BY salary DESC) AS rank_all, rank() OVER (PARTITION BY basis, tse33 ORDER BY salary DESC) AS rank_industry,
    count(*) OVER (PARTITION BY basis, tse33) AS industry_n FROM bases)
  SELECT r.id, r.basis, r.salary, rank_all, rank_industry, industry_n, mean, median, round(rank_all / CAST(n AS DOUBLE) * 100, 6) AS top_percent,
    round(CASE WHEN n > 1 THEN (n - rank_all) / CAST(n - 1 AS DOUBLE) * 100 ELSE 0 END, 6) AS position_percent,
    round(CASE WHEN sd > 0 THEN 50 + CAST(10 AS DOUBLE) * (r.salary - mean) / sd ELSE 50 END, 6) AS deviation, r.salary - mean AS from_mean, {_BIN.replace("salary", "r.salary")} AS bin
  FROM ranks r JOIN people p ON p.basis = r.basis JOIN scale s ON s.basis = r.basis JOIN med m ON m.basis = r.basis""")
def company_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.view(_bases(spark, sf_dir))


@register(f"""WITH {BASES_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY basis, tse33 ORDER BY salary DESC) AS industry_rank FROM bases WHERE basis IN (0, 35)),
  pairs AS (SELECT a.id, a.basis, b.id AS neighbour_id, b.salary AS neighbour_salary, abs(b.salary - a.salary) AS gap, b.industry_rank,
    row_number() OVER (PARTITION BY a.id, a.basis ORDER BY abs(b.salary - a.salary), b.salary DESC, b.row_idx) AS place
    FROM r a JOIN r b ON a.basis = b.basis AND a.tse33 = b.tse33 AND a.id <> b.id)
  SELECT id, basis, neighbour_id, neighbour_salary, gap, industry_rank, CAST(place AS INT) AS place FROM pairs WHERE place <= 5""")
def neighbors_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.neighbours(bases(companies(spark, sf_dir), (35,)))


@register(f"""WITH {PARTS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY basis, tse33 ORDER BY salary DESC) AS industry_rank FROM parts),
  pairs AS (SELECT a.id, a.basis, b.id AS neighbour_id, b.salary AS neighbour_salary, abs(b.salary - a.salary) AS gap, b.industry_rank,
    row_number() OVER (PARTITION BY a.id, a.basis ORDER BY abs(b.salary - a.salary), b.salary DESC, b.row_idx) AS place
    FROM r a JOIN r b ON a.basis = b.basis AND a.tse33 = b.tse33 AND a.id <> b.id)
  SELECT id, basis, neighbour_id, neighbour_salary, gap, industry_rank, CAST(place AS INT) AS place FROM pairs WHERE place <= 5""")
def neighbors_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.neighbours(parts(spark, sf_dir))


_V = "v AS (SELECT id, basis, CAST(floor(salary / CAST(10000 AS DOUBLE) + 0.5) AS BIGINT) AS v, salary FROM bases WHERE basis > 0)"
_STEPS = "steps AS (SELECT * FROM (VALUES " + ", ".join(f"({m})" for m in C.MILESTONES) + ") t(step))"


@register(f"""WITH {BASES_SQL}, {_V}, {_STEPS}, before AS (SELECT *, max(v) OVER (PARTITION BY id ORDER BY basis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM v),
  crossed AS (SELECT id, basis, max(step) AS milestone FROM before JOIN steps ON step > most AND step <= v GROUP BY 1, 2),
  placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY basis) - 1 AS place, count(*) OVER (PARTITION BY id) AS n FROM crossed)
  SELECT id, basis, milestone FROM placed WHERE n <= 3 OR place = 0 OR place = CAST(floor((n - 1) / CAST(2 AS DOUBLE)) AS BIGINT) OR place = n - 1""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.milestones(_bases(spark, sf_dir))


_JUMP = f"""{_V}, j AS (SELECT id, basis, lead(salary) OVER (PARTITION BY id ORDER BY basis) - salary AS jump FROM v),
  best AS (SELECT id, basis AS from_age, jump FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jump DESC, basis) AS rn FROM j WHERE jump IS NOT NULL) t WHERE rn = 1)"""


@register(f"WITH {BASES_SQL}, {_JUMP} SELECT * FROM best")
def largest_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.largest_jump(_bases(spark, sf_dir))


def _man(x: str) -> str:
    return f"format('{{:,}}', CAST(floor(({x}) / CAST(10000 AS DOUBLE) + 0.5) AS BIGINT)) || '万円'"


_MILES = f"""before AS (SELECT *, max(v) OVER (PARTITION BY id ORDER BY basis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM v), {_STEPS},
  crossed AS (SELECT id, basis, max(step) AS milestone FROM before JOIN steps ON step > most AND step <= v GROUP BY 1, 2),
  picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY basis) - 1 AS place, count(*) OVER (PARTITION BY id) AS n FROM crossed) t
    WHERE n <= 3 OR place = 0 OR place = CAST(floor((n - 1) / CAST(2 AS DOUBLE)) AS BIGINT) OR place = n - 1),
  said AS (SELECT id, string_agg(CAST(basis AS VARCHAR) || '歳で' || format('{{:,}}', milestone) || '万円', '、' ORDER BY basis) AS steps FROM picked GROUP BY id),
  top AS (SELECT id, name, basis, salary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY salary DESC, basis) AS rn FROM bases WHERE basis > 0) t WHERE rn = 1)"""


@register(f"""WITH {BASES_SQL}, {_JUMP}, {_MILES} SELECT t.id, t.name || 'の推定年収を年齢別に見ると、' ||
    CASE WHEN steps IS NOT NULL THEN steps || 'に達します。最も高い水準は' || CAST(t.basis AS VARCHAR) || '歳の' || {_man("t.salary")} || 'です。'
      ELSE CAST(t.basis AS VARCHAR) || '歳の' || {_man("t.salary")} || 'が最も高い水準になります。' END ||
    CASE WHEN jump > 0 THEN '5歳刻みで比べると' || CAST(from_age AS VARCHAR) || '歳から' || CAST(from_age + 5 AS VARCHAR) || '歳の伸びが最も大きく、＋' || {_man("jump")} || 'でした。' ELSE '' END AS summary
  FROM top t JOIN best b ON b.id = t.id LEFT JOIN said s ON s.id = t.id""")
def curve_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.curve_sentences(with_pays(spread(companies(spark, sf_dir), "id"))).select("id", F.array_join("sentences", "").alias("summary"))


@register(f"""WITH {COMPANIES_SQL} SELECT id, '有価証券報告書によると、' || name || 'の平均年収は' || {_man("avg_salary")} || '、平均年齢は' || printf('%.1f', avg_age) || '歳、平均勤続年数は' || printf('%.1f', avg_tenure) ||
  '年、従業員数は' || format('{{:,}}', employees) || '人です。' AS sentence FROM companies""")
def actuals_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.actuals(companies(spark, sf_dir))


_LAYER = "'平均年齢' || printf('%.1f', avg_age) || '歳・平均勤続' || printf('%.1f', avg_tenure) || '年。掲載企業を3つに分けたとき、'"


@register(f"""WITH {BASES_SQL}, {_PEOPLE}, r AS (SELECT b.*, p.mean, p.sd, p.n, rank() OVER (PARTITION BY b.basis ORDER BY salary DESC) AS ra, rank() OVER (PARTITION BY b.basis, tse33 ORDER BY salary DESC) AS ri,
    count(*) OVER (PARTITION BY b.basis, tse33) AS n_ind, count(*) FILTER (WHERE employees >= 1000) OVER (PARTITION BY b.basis) AS n_large, count(*) FILTER (WHERE employees < 300) OVER (PARTITION BY b.basis) AS n_small
    FROM bases b JOIN people p ON p.basis = b.basis WHERE b.basis IN (0, 35))
  SELECT id, basis, CASE WHEN basis = 0 THEN '有価証券報告書の平均年間給与' ELSE '35歳にそろえた推定年収' END || 'は' || {_man("salary")} || '。全' || format('{{:,}}', n) || '社中' || format('{{:,}}', ra) || '位（偏差値' ||
    printf('%.1f', round(50 + CAST(10 AS DOUBLE) * (salary - mean) / sd, 6)) || '）で、全体平均より' || {_man("abs(salary - mean)")} || CASE WHEN salary >= mean THEN '高い' ELSE '低い' END || '。' ||
    CAST(tse33 AS VARCHAR) || 'の' || format('{{:,}}', n_ind) || '社の中では' || format('{{:,}}', ri) || '位。' ||
    CASE WHEN avg_age < 40 THEN {_LAYER} || '年齢は最も短い層に入る。' WHEN avg_tenure < 13 THEN {_LAYER} || '勤続は最も短い層に入る。' WHEN avg_age >= 43 THEN {_LAYER} || '年齢は最も長い層に入る。'
      WHEN avg_tenure >= 17 THEN {_LAYER} || '勤続は最も長い層に入る。' ELSE '' END ||
    CASE WHEN employees >= 1000 THEN '単体で' || format('{{:,}}', employees) || '人。掲載企業のうち1,000人以上の' || format('{{:,}}', n_large) || '社に入る。'
      WHEN employees < 300 THEN '単体で' || format('{{:,}}', employees) || '人。掲載企業のうち300人未満の' || format('{{:,}}', n_small) || '社に入る。' ELSE '' END ||
    CASE WHEN id % 50 = 0 THEN '単体従業員数が連結の10%未満で、「本社のみ」に該当する。この金額はグループ全体を代表していない。' ELSE '' END ||
    CASE WHEN basis = 0 AND avg_age < 40 THEN '平均年齢が低いぶん、実測値は他社より低めに出る。「年齢そろえ」で比べ直せる。'
      WHEN basis = 0 AND avg_age >= 43 THEN '平均年齢が高いぶん、実測値は他社より高めに出る。「年齢そろえ」で比べ直せる。' ELSE '' END AS highlights FROM r""")
def company_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = companies(spark, sf_dir)
    said = sentences.highlights(people, bases(people, (35,)), people.where("id % 50 = 0"))
    return said.select("id", "basis", F.array_join("sentences", "").alias("highlights"))


@register(f"""WITH {COMPANIES_SQL} SELECT count(*) AS companies, count(DISTINCT tse33) AS industries, count(DISTINCT curve_key) AS curves, min(avg_age) AS age_low, max(avg_age) AS age_high,
  CAST(floor(min(avg_salary) / 10000 + 0.5) AS BIGINT) AS pay_low, CAST(floor(max(avg_salary) / 10000 + 0.5) AS BIGINT) AS pay_high FROM companies""")
def about_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.facts(companies(spark, sf_dir))


_FIT = """grid AS (SELECT CAST(range AS INT) AS age FROM range(26, 56)), e AS (SELECT age, avg_age - age AS u, ln(avg_salary) AS y FROM companies CROSS JOIN grid),
  w AS (SELECT age, u, y, exp(-0.5 * (u / 3.0) * (u / 3.0)) AS w FROM e),
  s AS (SELECT age, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1, count(*) AS n FROM w GROUP BY age),
  levels AS (SELECT age, round(CASE WHEN abs(s0 * s2 - s1 * s1) < 1e-12 THEN t0 / s0 ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END, 6) AS level FROM s WHERE n >= 50)"""


@register(f"""WITH {COMPANIES_SQL}, {_FIT} SELECT id, round(exp(z.level - a.level), 6) AS factor FROM companies
  JOIN levels a ON a.age = CAST(greatest(26, least(55, round(avg_age))) AS INT) JOIN levels z ON z.age = 35""")
def fitted_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = companies(spark, sf_dir)
    pairs = people.select("id", F.col("avg_age").alias("from_age"), F.lit(35.0).alias("to_age"))
    return statistics.fitted_factors(statistics.local_linear(people, "avg_age", "avg_salary"), pairs).select("id", "factor")


@register(f"""WITH {BASES_SQL}, {_SCALE}, i AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) t(bin))
  SELECT basis, bin, CASE bin WHEN 0 THEN {_man("low + width")} || '未満' WHEN 8 THEN {_man("low + width * bin")} || '以上'
    ELSE format('{{:,}}', CAST(floor((low + width * bin) / 10000 + 0.5) AS BIGINT)) || '〜' || {_man("low + width * (bin + 1)")} END AS label FROM scale CROSS JOIN i""")
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = statistics.histogram_scale(_bases(spark, sf_dir)).select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("bin"))
    return scale.select("basis", "bin", bin_label(F.col("low"), F.col("width"), F.col("bin")).alias("label"))


@register(f"""WITH {COMPANIES_SQL}, {CURVES_SQL}, p AS (SELECT id, row_idx, round(avg_salary / {sql_curve_at("avg_age")}, 6) AS premium FROM companies JOIN curves USING (curve_key)),
  o AS (SELECT *, row_number() OVER (ORDER BY premium) - 1 AS pos, count(*) OVER () AS n FROM p)
  SELECT max(CASE WHEN pos = CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) THEN premium END) AS median, max(CASE WHEN pos = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN premium END) AS p90,
    max(premium) AS most, (SELECT id FROM p ORDER BY premium DESC, row_idx LIMIT 1) AS most_id FROM o""")
def premium_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.fit_summary(companies(spark, sf_dir))


@register(f"WITH {COMPANIES_SQL}, ages AS (SELECT * FROM (VALUES " + ", ".join(f"({a})" for a in C.TARGET_AGES) + ") t(age)) SELECT age, round(avg(abs(age - avg_age)), 6) AS distance FROM companies CROSS JOIN ages GROUP BY age")
def extrapolation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.extrapolation(companies(spark, sf_dir))


@register(f"""WITH {BASES_SQL}, w AS (SELECT id, tse33, row_idx, {", ".join(f"max(CASE WHEN basis = {a} THEN salary END) AS s{a}" for a in C.TARGET_AGES)} FROM bases GROUP BY 1, 2, 3),
  pairs AS (SELECT {" OR ".join(f"((a.s{x} > b.s{x}) <> (a.s25 > b.s25))" for x in C.TARGET_AGES[1:])} AS swapped FROM w a JOIN w b ON a.tse33 = b.tse33 AND a.row_idx < b.row_idx)
  SELECT count(*) AS pairs, sum(CASE WHEN swapped THEN 1 ELSE 0 END) AS swapped, round(sum(CASE WHEN swapped THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100, 6) AS percent FROM pairs""")
def pair_swap_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {f"s{a}": F.lit(float(a)) for a in C.TARGET_AGES}
    wide = model.with_estimates(companies(spark, sf_dir), names).select("tse33", "row_idx", *names)
    return statistics.swapped_pairs(wide, list(names), "tse33", "row_idx")


@register(f"""WITH {BASES_SQL}, r AS (SELECT row_number() OVER (ORDER BY avg_salary DESC, row_idx) AS a, row_number() OVER (ORDER BY salary DESC, row_idx) AS b FROM bases WHERE basis = 35),
  s AS (SELECT sum(CAST(a - b AS DOUBLE) * (a - b)) AS s, count(*) AS n FROM r)
  SELECT round(1 - 6 * s / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1)), 9) AS rho, n FROM s""")
def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spearman(bases(companies(spark, sf_dir), (35,)).where("basis = 35"), "avg_salary", "salary", ["row_idx"])


@register(f"""WITH {BASES_SQL}, b AS (SELECT * FROM bases WHERE basis = 35), x AS (SELECT id FROM b ORDER BY avg_salary DESC, row_idx LIMIT 50), y AS (SELECT id FROM b ORDER BY salary DESC, row_idx LIMIT 50)
  SELECT count(*) AS shared FROM x JOIN y USING (id)""")
def top50_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_overlap(bases(companies(spark, sf_dir), (35,)).where("basis = 35"), "avg_salary", "salary", ["row_idx"])


@register(f"""WITH {COMPANIES_SQL}, grid AS (SELECT CAST(range AS INT) AS age FROM range(26, 56)), e AS (SELECT age, avg_age - age AS u, ln(avg_salary) AS y FROM companies CROSS JOIN grid),
  w AS (SELECT age, u, y, exp(-0.5 * (u / 3.0) * (u / 3.0)) AS w FROM e),
  s AS (SELECT age, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1, count(*) AS n FROM w GROUP BY age)
  SELECT age, round(CASE WHEN abs(s0 * s2 - s1 * s1) < 1e-12 THEN t0 / s0 ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END, 6) AS level FROM s WHERE n >= 50""")
def local_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.local_linear(companies(spark, sf_dir), "avg_age", "avg_salary")


@register(f"""WITH {BASES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY basis ORDER BY salary DESC, row_idx) AS place FROM bases) SELECT id, basis, place FROM r""")
def positions_all_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(_bases(spark, sf_dir), "salary", ["row_idx"], ["basis"], "place").select("id", "basis", "place")
