"""Command line: ``python -m payscope population|unified|history ...``, on landed files, to CSV files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.operators import export, filings, population
from payscope.operators.history import resolved
from payscope.operators.ranking import positions
from payscope.sources import archives, files
from payscope.sources.tables import stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="payscope", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("population", help="reports to the validation file")
    build.add_argument("--limit", type=int, default=300, help="reports to take; 0: all")
    build.add_argument("--curve", default=population.DEFAULT_SET, choices=[*population.CURVE_SETS, *population.SIZES])
    build.add_argument("--include-unlisted", action="store_true")
    build.add_argument("--start", help="first day of the lists (YYYY-MM-DD)")
    build.add_argument("--end", help="last day of the lists (YYYY-MM-DD)")
    unified = sub.add_parser("unified", help="a written file with its derived columns made anew")
    unified.add_argument("--from-csv", required=True)
    unified.add_argument("--backfill-edinet-code", action="store_true")
    unified.add_argument("--backfill-corporate-number", action="store_true")
    history = sub.add_parser("history", help="reports of several years to the history file")
    history.add_argument("first_year", type=int, nargs="?", default=2017)
    history.add_argument("last_year", type=int, nargs="?", default=2026)
    history.add_argument("--universe", required=True, help="a unified file: whose history")
    for one in (build, unified, history):
        one.add_argument("--codelist", required=True)
        one.add_argument("--out", required=True)
    for one in (build, history):
        one.add_argument("--lists", required=True)
        one.add_argument("--filings", required=True)
    for one in (build, unified):
        one.add_argument("--curves", required=True, help="JSON file of annual wage curves (ANNUAL_INDUSTRY, ANNUAL_LARGE)")
    build.add_argument("--monthly-curves", help="JSON file of monthly wage curves (INDUSTRY, SIZE), for the sets that want them")
    return p


def _derived(rows, curves, industry: str = "industry"):
    """Pay at 35, the factor and both ranks, from ``avg_salary`` and ``avg_age``."""
    paid = model.with_estimates(population.with_curve(rows, curves, industry), {"salary35": F.lit(float(C.DEFAULT_AGE))}).drop("curve")
    body = stored(paid.where("salary35 IS NOT NULL").withColumn("factor", population.pay_factor(F.col("salary35"), F.col("avg_salary"))), "derived")  # read many times by the ranks
    placed = positions(positions(body, "avg_salary", ["doc_id"], name="rank_raw"), "salary35", ["doc_id"], name="rank_adj")
    return placed.withColumn("rank_delta", F.col("rank_raw") - F.col("rank_adj"))


def _records(targets, folder: str):
    """Records of the ``targets`` (doc_id, year) alone: no other archive is opened."""
    index = archives.wanted_index(targets, folder)
    spark = targets.sparkSession
    found = filings.records(archives.archive_facts(spark, index))
    return stored(found.join(spark.read.parquet(index).select("path", "doc_id"), "path"), "records")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("payscope").getOrCreate()
    codes = files.codelist(spark, args.codelist)
    if args.command == "unified":
        rows = files.untyped_csv(spark, args.from_csv)
        if args.backfill_edinet_code:
            from payscope.functions.text import search_name

            keyed = rows.withColumns({"row_idx": F.monotonically_increasing_id(), "name_key": search_name(F.col("name"))}).drop("edinet_code")
            rows = population.backfilled_codes(keyed, codes.withColumn("name_key", search_name(F.col("name")))).drop("row_idx", "name_key")
        if args.backfill_corporate_number:
            rows = population.backfilled_numbers(rows, codes)
        derived = ("salary35", "factor", "rank_raw", "rank_adj", "rank_delta")
        out = population.unified_export(_derived(rows.drop(*derived), files.wage_curves(spark, args.curves)))
    elif args.command == "population":
        lists = files.filing_lists(spark, args.lists)
        lists = lists.where(F.col("day") >= args.start) if args.start else lists
        lists = lists.where(F.col("day") <= args.end) if args.end else lists
        reports = population.population_reports(lists, codes, args.include_unlisted)
        reports = reports.orderBy("day", "doc_id").limit(args.limit) if args.limit else reports
        reports = stored(reports.withColumn("year", F.year("day")), "reports")
        own = _records(reports, args.filings).join(reports.select("doc_id", "period_end"), "doc_id")
        tables = {"annual_industry": files.wage_curves(spark, args.curves), "annual_large": files.wage_curves(spark, args.curves, "ANNUAL_LARGE")}
        if args.monthly_curves:
            tables |= {"monthly_industry": files.wage_curves(spark, args.monthly_curves, "INDUSTRY"), "monthly_size": files.wage_curves(spark, args.monthly_curves, "SIZE")}
        curves, by_industry = population.curve_set(tables, args.curve)
        fixed = population.with_codelist(own, codes, by_industry, args.curve).withColumn("salary_fixed", model.repaired_pay(F.col("avg_salary"), F.col("employees_nonconsolidated")))
        fixed = fixed.withColumns({"avg_salary": F.col("salary_fixed"), "salary_fixed": F.col("salary_fixed") != F.col("avg_salary"), "emp_ratio": model.staff_ratio(F.col("employees_nonconsolidated"), F.col("employees_consolidated"))})
        marked = fixed.withColumns({"holding_flag": model.holding_flag(F.col("emp_ratio"), F.col("employees_consolidated")), "age_outlier": model.age_outlier(F.col("avg_age"))})
        out = population.validation_export(_derived(marked.where(model.plausible(F.col("avg_salary"), F.col("avg_age"))), curves))
    else:
        universe = files.untyped_csv(spark, args.universe, []).where("edinet_code <> ''").select(F.col("edinet_code").alias("code")).distinct()
        targets = population.yearly_targets(files.filing_lists(spark, args.lists), universe, args.first_year, args.last_year)
        targets = stored(targets, "targets")
        rows = population.history_records(targets, _records(targets, args.filings))
        chosen = resolved(rows.select("*", F.col("edinet_code").alias("code"), F.col("avg_salary").alias("value"))).withColumn("avg_salary", model.repaired_pay(F.col("resolved"), F.col("employees_nonconsolidated")))
        out = population.history_export(chosen)
    export.write_csv(out, args.out, byte_order_mark=args.command != "history")


if __name__ == "__main__":
    main()
