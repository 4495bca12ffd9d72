"""From filings to the population: unlisted filers, code list, identifiers, derived columns, yearly targets, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.operators.resolution import QualityError, annual_reports, two_phase

# --- fixed values: who counts, curve sets, exported columns in order -------------------------------
DOMESTIC = "内国法人・組合"
ANNUAL_REPORT = "120"
#: Curve sets: the table of each, and the one that stands in where it is empty.  Sets of one size are flat.
CURVE_SETS = {
    "年収": ("annual_industry", "monthly_industry"), "年収_大企業": ("annual_large", "monthly_size"), "所定内": ("monthly_industry", "monthly_industry"),
}
DEFAULT_SET = "年収"
SIZES = ("大企業", "中企業", "小企業")
VALIDATION_COLUMNS = (
    "sec_code", "name", "listed", "source", "tse33", "industry", "avg_age", "avg_tenure", "avg_salary", "factor", "salary35", "rank_raw", "rank_adj", "rank_delta", "salary35_fit",
    "employees_nonconsolidated", "employees_consolidated", "emp_ratio", "holding_flag", "age_outlier", "salary_fixed", "period_end", "doc_id",
)
UNIFIED_COLUMNS = (
    "rank_adj", "rank_raw", "rank_delta", "sec_code", "name", "tse33", "listed", "avg_age", "avg_tenure", "avg_salary", "salary35", "factor", "employees_nonconsolidated",
    "employees_consolidated", "emp_ratio", "badge", "industry", "source", "period_end", "edinet_code", "corporate_number", "doc_id",
)
HISTORY_COLUMNS = ("edinet_code", "year", "avg_salary", "avg_age", "employees_nonconsolidated", "source", "period_end", "doc_id")
LOGO_BYTES, LOGOS_BYTES, LOGOS_LEAST = 20 * 1024, 10 * 1024 * 1024, 1400
# -------------------------------------------------------------------------------------------------


def unlisted_reports(filings: DataFrame, codelist: DataFrame) -> DataFrame:
    """The last annual report of each domestic filer without a security code (``day``, ``doc_id``, ``code``, ``sec_code``,
    ``doc_type``, ``withdrawn``), on any day of the week."""
    kept = filings.where((F.col("doc_type") == ANNUAL_REPORT) & (F.coalesce("sec_code", F.lit("")) == "") & (F.coalesce("withdrawn", F.lit("")) != "1"))
    domestic = codelist.where(F.col("kind") == DOMESTIC).select("code")
    rest = [c for c in filings.columns if c != "code"]
    best = kept.join(domestic, "code", "left_semi").groupBy("code").agg(F.max_by(F.struct(*rest), F.struct("day", "doc_id")).alias("m"))
    return best.select("code", *(F.col(f"m.{c}").alias(c) for c in rest)).select(filings.columns)


def population_reports(filings: DataFrame, codelist: DataFrame, with_unlisted: bool = False) -> DataFrame:
    """Annual reports of listed firms, and behind them those of unlisted ones if they are wanted."""
    listed = annual_reports(filings).select(filings.columns)
    return listed.unionByName(unlisted_reports(filings, codelist)) if with_unlisted else listed


def with_codelist(records: DataFrame, codelist: DataFrame, by_industry: bool = True, curve: str = DEFAULT_SET) -> DataFrame:
    """``records`` (edinet_code, ...) with ``tse33`` and ``listed`` of their code, '' where it is unknown, and the
    industry of their wage curve (the set's own name where it isn't by industry).

    The list has a few ten thousand codes, which Spark broadcasts by its size, or not.
    """
    known = codelist.select(F.col("code").alias("edinet_code"), "tse33", "listed").dropDuplicates(["edinet_code"])
    out = records.join(known, "edinet_code", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("tse33", "listed")})
    return out.withColumn("industry", model.industry_of(F.col("tse33")) if by_industry else F.lit(curve))


def curve_set(tables: Mapping[str, DataFrame], name: str) -> tuple[DataFrame, bool]:
    """(curves: curve_key, curve; by industry or not) of a named set; an unknown name means the default one.

    ``tables`` has annual_industry, annual_large, monthly_industry and monthly_size; an absent or empty annual table
    is replaced by its monthly one, and a size's set is its one series.
    """
    if name in SIZES:
        return tables["monthly_size"].where(F.col("curve_key") == name), False
    first, instead = CURVE_SETS.get(name, CURVE_SETS[DEFAULT_SET])
    found = tables.get(first)
    return (tables[instead] if found is None or found.isEmpty() else found), True


def with_curve(rows: DataFrame, curves: DataFrame, key: str = "industry") -> DataFrame:
    """``rows`` with the ``curve`` of their key, else that of all industries, else the first of the table by its key."""
    named = curves.select(F.col("curve_key").alias(key), F.col("curve").alias("_own"))
    # One row: what stands in for a key without a series.
    other = curves.agg(F.coalesce(F.max_by("curve", F.when(F.col("curve_key") == C.ALL_INDUSTRIES, 1)), F.min_by("curve", "curve_key")).alias("_other"))
    return rows.join(named, key, "left").crossJoin(F.broadcast(other)).withColumn("curve", F.coalesce("_own", "_other")).drop("_own", "_other")


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of ``paths`` that is there, whatever the store."""
    for path in paths:
        try:
            spark.read.format("text").option("recursiveFileLookup", True).load(path)  # its folder is looked up, its files aren't read
            return path
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def company_id(sec_code: Column, edinet_code: Column, name: Column) -> Column:
    """The security code, else the filer's code; an error where both are empty."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(sec_code), given(edinet_code), F.raise_error(F.concat(F.coalesce(name, F.lit("a company")), F.lit(" has no code"))).cast("string"))


def pay_factor(salary35: Column, salary: Column) -> Column:
    """What pay was multiplied by, four decimals; null where either is missing or zero."""
    return F.when((salary35 != 0) & (salary != 0), F.round(salary35 / salary, 4))


def backfilled_codes(rows: DataFrame, codelist: DataFrame) -> DataFrame:
    """``rows`` (row_idx, sec_code, name, name_key, listed) with ``edinet_code``; an error that lists rows without one."""
    found = two_phase(rows, codelist).select("row_idx", F.col("code").alias("edinet_code"))
    out = rows.join(found, "row_idx", "left")
    open_ = out.where("edinet_code IS NULL").select("name", "sec_code").orderBy("row_idx").limit(20).collect()
    if open_:
        raise QualityError(f"no code for {[tuple(r) for r in open_]}")
    return out


def backfilled_numbers(rows: DataFrame, codelist: DataFrame) -> DataFrame:
    """``rows`` with ``corporate_number`` by their ``edinet_code``; an error that lists rows without one."""
    known = codelist.select(F.col("code").alias("edinet_code"), F.nullif(F.trim("corporate_number"), F.lit("")).alias("corporate_number")).dropDuplicates(["edinet_code"])
    out = rows.drop("corporate_number").join(known, "edinet_code", "left")
    open_ = out.where("corporate_number IS NULL").select("name", "edinet_code").orderBy("edinet_code").limit(20).collect()
    if open_:
        raise QualityError(f"no corporate number for {[tuple(r) for r in open_]}")
    return out


def in_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` in the exported columns and their order; those that are missing are null, others are left out."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def validation_export(rows: DataFrame) -> DataFrame:
    """The 23 columns of the validation file, by adjusted rank, rows without one last."""
    return in_columns(rows, VALIDATION_COLUMNS).orderBy(F.asc_nulls_last("rank_adj"))


def unified_export(rows: DataFrame) -> DataFrame:
    """The 22 columns of the unified file, by adjusted rank."""
    return in_columns(rows, UNIFIED_COLUMNS).orderBy(F.asc_nulls_last("rank_adj"))


def yearly_targets(filings: DataFrame, population: DataFrame, first: int, last: int) -> DataFrame:
    """For each code of ``population`` and each year the annual report with the greatest ``doc_id``.

    ``filings`` as of the daily lists (``day`` is that of the list's file, and so is the year); reports of any weekday.
    """
    year = F.year("day")
    kept = filings.where((F.col("doc_type") == ANNUAL_REPORT) & (F.coalesce("withdrawn", F.lit("")) != "1") & year.between(first, last)).withColumn("year", year)
    rest = [c for c in kept.columns if c not in ("code", "year")]
    best = kept.join(population.select("code"), "code", "left_semi").groupBy("code", "year").agg(F.max_by(F.struct(*rest), "doc_id").alias("m"))
    return best.select("code", "year", *(F.col(f"m.{c}").alias(c) for c in rest))


def history_records(targets: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` (doc_id, avg_salary, ...) of the ``targets`` that have one with pay, under the target's code and year."""
    own = records.where("avg_salary IS NOT NULL").drop("edinet_code", "year", "code")
    return targets.select("doc_id", F.col("code").alias("edinet_code"), "year").join(own, "doc_id")


def history_export(records: DataFrame) -> DataFrame:
    """The rows of the history file by code and year: pay as a whole number, halves up, and nothing for nulls and zeros
    of the other figures; rows without pay are left out."""
    blank = lambda c: F.when(F.col(c) != 0, F.col(c))
    rows = records.where("avg_salary IS NOT NULL").withColumns({"avg_salary": model.half_up(F.col("avg_salary")), "avg_age": blank("avg_age"), "employees_nonconsolidated": blank("employees_nonconsolidated")})
    return in_columns(rows, HISTORY_COLUMNS).orderBy("edinet_code", "year")


def latest_present(dense: DataFrame, value: str = "value") -> DataFrame:
    """(code, place, year, value): the last year with a value and its place among all years, from 0; no row without any."""
    placed = dense.withColumn("place", F.expr("row_number() OVER (PARTITION BY code ORDER BY year) - 1")).where(F.col(value).isNotNull())
    return placed.groupBy("code").agg(F.max_by(F.struct("place", "year", value), "year").alias("m")).select("code", "m.*")


def find_by_name(rows: DataFrame, name: str, order: str = "row_idx") -> DataFrame:
    """The first row of exactly that name, as one row; an error if there is none."""
    found = rows.where(F.col("name") == name).orderBy(order).limit(1)
    if found.isEmpty():
        raise QualityError(f"nobody is called {name}")
    return found


def reason_counts(rows: DataFrame, source: str = "source", reason: str = "reason") -> DataFrame:
    """(kind, value, n): how many rows each source gave, and for what reasons those without one have none."""
    has = F.col(source).isNotNull() & (F.col(source) != "")
    each = rows.select(F.when(has, "source").otherwise("reason").alias("kind"), F.when(has, F.col(source)).otherwise(F.coalesce(reason, F.lit("unknown"))).alias("value"))
    return each.groupBy("kind", "value").agg(F.count("*").alias("n"))


def logo_ids(neighbours: DataFrame, logos: DataFrame) -> DataFrame:
    """(id, logo_id): the company itself and its neighbours of any basis, those that have a logo, each once."""
    both = neighbours.select("id", F.explode(F.array("id", "neighbour_id")).alias("logo_id")).distinct()
    return both.join(logos.select(F.col("id").alias("logo_id")), "logo_id", "left_semi").select("id", "logo_id")


def check_logos(index: DataFrame, companies: DataFrame, files: DataFrame, partial: bool = False) -> DataFrame:
    """``index`` (id, w, h, src, source) if it is sound against ``companies`` (id) and ``files`` (id, bytes): ids known, nothing
    missing, an image for each, sizes within bounds, and enough of them unless it is ``partial``.  One job for all rules."""
    named = index.select("id", "w", "h", "src", "source", F.lit(True).alias("_index"))
    held = files.select("id", "bytes", F.lit(True).alias("_file"))
    known = companies.select("id").distinct().withColumn("_company", F.lit(True))
    both = named.join(held, "id", "full").join(known, "id", "left")
    own = F.col("_index")
    lacking = F.coalesce(F.col("w") * F.col("h") == 0, F.lit(True)) | (F.coalesce("src", F.lit("")) == "") | (F.coalesce("source", F.lit("")) == "")
    rules = {"unknown ids": own & F.col("_company").isNull(), "incomplete": own & lacking, "no image": own & F.col("_file").isNull(), "image too large": F.col("bytes") > LOGO_BYTES}
    broken = [c for k, rule in enumerate(rules.values()) for c in (F.count_if(rule).alias(f"n{k}"), F.min(F.when(rule, F.col("id"))).alias(f"first{k}"))]
    got = both.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(own).alias("n"), *broken).first()
    faults = {name: f"{got[f'n{k}']}, the first is {got[f'first{k}']}" for k, name in enumerate(rules) if got[f"n{k}"]}
    if got["bytes"] > LOGOS_BYTES:
        faults["all images"] = f"{got['bytes']} bytes"
    if not partial and got["n"] < LOGOS_LEAST:
        faults["too few"] = str(got["n"])
    if faults:
        raise QualityError(str(faults))
    return index


def missing_sites(companies: DataFrame, *known: DataFrame) -> DataFrame:
    """The companies whose number none of the tables ``known`` (corporate_number, site) has a site for: those to look up."""
    out = companies
    for table in known:
        out = out.join(table.where("site IS NOT NULL AND site <> ''").select("corporate_number"), "corporate_number", "left_anti")
    return out


def credited_images(landed: DataFrame) -> DataFrame:
    """(title, url, width, height, licence, author, attribution) from landed answers about images (page objects with
    imageinfo); licence and author without markup."""
    from payscope.functions.text import plain_markup
    from payscope.operators.export import needs_credit

    info = F.get(F.col("imageinfo"), F.lit(0))
    meta = info["extmetadata"]
    rows = landed.where(info.isNotNull()).select(
        "title", info["url"].alias("url"), info["width"].alias("width"), info["height"].alias("height"), plain_markup(meta["LicenseShortName"]["value"]).alias("licence"), plain_markup(meta["Artist"]["value"]).alias("author")
    )
    return rows.withColumn("attribution", needs_credit("licence"))
