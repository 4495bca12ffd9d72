"""Queries of the text and markup functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.functions import html, text
from payscope.functions.employee_block import employee_block
from payscope.operators.pages import ordered_candidates, page_candidates
from payscope.plans.registry import register
from payscope.plans.stand_ins import table
from payscope.sources.tables import spread


@register("SELECT page_id, nullif(lower(regexp_extract(url, '^(https?://[^/?#[:space:]]+)', 1)), '') AS origin FROM pages")
def url_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.origin_of(F.col("url")).alias("origin"))


@register("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[[:space:]]+', ' ', 'g')) AS title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


@register("""WITH s AS (SELECT p_partkey, CAST(p_size AS INT) AS w FROM part)
  SELECT p_partkey, greatest(w * 16, w) AS width, CASE WHEN w * 16 >= w THEN 32 ELSE 32 END AS height FROM s""")
def sizes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("p_size")
    sizes = F.concat(w.cast("string"), F.lit("x16 any "), (w * 16).cast("string"), F.lit("X32"))
    return table(spark, sf_dir, "part").select("p_partkey", html.largest_size(sizes).alias("s")).select("p_partkey", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


@register("""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS plain, CAST(NULL AS DOUBLE) AS bad, round(o_totalprice, 2) AS lead, round(o_custkey % 40 + (o_orderkey % 12) / CAST(12 AS DOUBLE), 2) AS years FROM orders""")
def number_unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat(F.format_number("o_totalprice", 2), F.lit("円"))
    years = F.concat((F.col("o_custkey") % 40).cast("string"), F.lit("年"), (F.col("o_orderkey") % 12).cast("string"), F.lit("ヶ月"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.number(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("plain"), text.number(F.lit("非公表")).alias("bad"),
        text.leading_number(price).alias("lead"), text.years_and_months(years).alias("years"),
    )


@register("""WITH r AS (SELECT l_orderkey, l_linenumber, round((l_discount - 0.05) * 100, 1) AS p FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN p > 0 THEN '＋' WHEN p < 0 THEN '−' ELSE '±' END || printf('%.1f', abs(p)) || '%' AS label FROM r""")
def rates_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.rate_label(F.col("l_discount") - 0.05).alias("label"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y') || '年' || CAST(month(o_orderdate) AS VARCHAR) || '月期' AS label, format('{:,}', CAST(floor(o_totalprice / 10000 + 0.5) AS BIGINT)) || '万円' AS pay FROM orders")
def fiscal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.fiscal_label(F.date_format("o_orderdate", "yyyy-MM")).alias("label"), text.pay_label(F.col("o_totalprice")).alias("pay"))


@register()
def page_logo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every page: relative addresses are resolved in Arrow batches, which SQL can't; tested on fixtures."""
    return ordered_candidates(page_candidates(table(spark, sf_dir, "pages")))


_BLOCK = """WITH c AS (SELECT c_custkey AS id, 100 + c_custkey * 37 % 9000 AS employees, 300 + c_custkey * 7 % 250 AS age10, 20 + c_custkey * 3 % 120 AS tenure10, 3000000 + c_custkey * 12347 % 9000000 AS salary FROM customer)
  SELECT id, CAST(salary AS DOUBLE) AS avg_salary, age10 / CAST(10 AS DOUBLE) AS avg_age, tenure10 / CAST(10 AS DOUBLE) AS avg_tenure, CAST(employees AS DOUBLE) AS employees, 'textblock' AS source FROM c"""


@register(_BLOCK)
def employee_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the table of employees, its values apart in a third of them, in lines in another and stuck together in the
    last, where the number of employees is known from elsewhere."""
    key = F.col("c_custkey")
    numbers = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        key.alias("id"), (100 + key * 37 % 9000).alias("people"), ((300 + key * 7 % 250) / 10).alias("age"), ((20 + key * 3 % 120) / 10).alias("tenure"), (3_000_000 + key * 12_347 % 9_000_000).alias("pay")
    )
    separator = F.element_at(F.array(F.lit(" "), F.lit("\n"), F.lit("")), (F.col("id") % 3 + 1).cast("int"))
    values = F.array_join(F.array(F.format_number("people", 0), F.format_number("age", 1), F.format_number("tenure", 1), F.format_number("pay", 0)), "|")
    body = F.concat(F.lit("提出会社の状況\n従業員数（人）平均年齢（歳）平均勤続年数（年）平均年間給与（円）"), separator, F.replace(values, F.lit("|"), separator), separator, F.lit("（注）従業員数は就業人員です。"))
    known = F.when(F.col("id") % 3 == 2, F.col("people").cast("double"))
    return numbers.select("id", employee_block(body, known).alias("b")).select("id", "b.avg_salary", "b.avg_age", "b.avg_tenure", "b.employees", "b.source")


@register("SELECT c_custkey, lower(c_name) AS name_key FROM customer")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search keys of names in wide letters, with a corporate form in front or behind and wide spaces."""
    name = F.translate(F.col("c_name"), "Customer#0123456789", "Ｃｕｓｔｏｍｅｒ＃０１２３４５６７８９")
    form = F.element_at(F.array(F.lit("株式会社　"), F.lit("㈱"), F.lit("（株） ")), (F.col("c_custkey") % 3 + 1).cast("int"))
    full = F.when(F.col("c_custkey") % 2 == 0, F.concat(form, name)).otherwise(F.concat(name, form))
    return table(spark, sf_dir, "customer").select("c_custkey", text.search_key(full).alias("name_key"))
