"""Yearly history of each entity: latest filing of a year, years without one, changes, peaks, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_year(filings: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """One filing for each (code, year): that with the greatest ``doc_id``.  ``population``: codes to keep."""
    kept = filings.join(population, "code", "left_semi") if population is not None else filings
    rest = [c for c in filings.columns if c not in ("code", "year")]
    best = kept.groupBy("code", "year").agg(F.max_by(F.struct(*rest), "doc_id").alias("m"))
    return best.select("code", "year", *(F.col(f"m.{c}").alias(c) for c in rest))


def dense_years(history: DataFrame, value: str = "value") -> DataFrame:
    """(code, year, value) for every entity and every year that any of them has; null where it has none.

    The years are few, whatever the number of rows, and come along as one array.
    """
    years = history.agg(F.sort_array(F.collect_set("year")).alias("years"))
    codes = history.where(F.col(value).isNotNull()).select("code").distinct()
    full = codes.crossJoin(F.broadcast(years)).select("code", F.explode("years").alias("year"))  # one row
    return full.join(history.select("code", "year", value), ["code", "year"], "left")


def changes(dense: DataFrame, value: str = "value") -> DataFrame:
    """Change against the year before and against the first year with a value; null if either lacks one."""
    over = "OVER (PARTITION BY code ORDER BY year)"
    before = F.expr(f"lag({value}) {over}")
    first = F.expr(f"first_value({value}) IGNORE NULLS OVER (PARTITION BY code ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    first_year = F.expr(f"min(CASE WHEN {value} IS NOT NULL THEN year END) OVER (PARTITION BY code)")
    rate = lambda x, base: F.when(base != 0, F.round((x - base) / base, 9))
    return dense.withColumns({"_b": before, "_f": first, "_y": first_year}).select(
        "code", "year", value, rate(F.col(value), F.col("_b")).alias("yoy"), F.when(F.col("year") != F.col("_y"), rate(F.col(value), F.col("_f"))).alias("cumulative")
    )


def first_and_last(history: DataFrame, value: str = "value") -> DataFrame:
    """(code, first_year, last_year, difference) of entities with two years or more."""
    own = history.where(F.col(value).isNotNull())
    return (
        own.groupBy("code")
        .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), (F.max_by(value, "year") - F.min_by(value, "year")).alias("difference"), F.count("*").alias("n"))
        .where("n >= 2")
        .drop("n")
    )


def peak_year(history: DataFrame, value: str = "value") -> DataFrame:
    """(code, peak_year, peak): the first year of the greatest value, unless that is the last year."""
    own = history.where(F.col(value).isNotNull())
    best = own.groupBy("code").agg(F.max(F.struct(value, (-F.col("year")).alias("y"))).alias("m"), F.max("year").alias("last"))
    return best.where("-m.y <> last").select("code", (-F.col("m.y")).alias("peak_year"), F.col(f"m.{value}").alias("peak"))


def jump_audit(dense: DataFrame, value: str = "value", up: float = 1.8, down: float = 0.55) -> DataFrame:
    """(pairs, jumps): adjacent years with values on both sides, and those whose ratio is implausible."""
    before = F.expr(f"lag({value}) OVER (PARTITION BY code ORDER BY year)")
    ratio = F.when(F.col("_b") > 0, F.col(value) / F.col("_b"))
    rows = dense.withColumn("_b", before).where(F.col("_b").isNotNull() & F.col(value).isNotNull())
    return rows.agg(F.count("*").alias("pairs"), F.count_if((ratio > up) | (ratio < down)).alias("jumps"))


def coverage(history: DataFrame, source: Column) -> DataFrame:
    """(year, n, tagged, from_text)."""
    return history.groupBy("year").agg(F.count("*").alias("n"), F.count_if(source == "tag").alias("tagged"), F.count_if(source == "textblock").alias("from_text"))


def pivoted(dense: DataFrame, value: str = "value") -> DataFrame:
    """(code, values): the values of all years in order, null for gaps, as one array for each entity."""
    items = F.sort_array(F.collect_list(F.struct("year", value)))
    return dense.groupBy("code").agg(items.alias("x")).select("code", F.col(f"x.{value}").alias("values"))


def resolved(history: DataFrame) -> DataFrame:
    """``history`` (code, year, value, source, candidates) with ambiguous readings chosen anew.

    The reference value of an entity is the median of its tagged years, or else of its readings
    without candidates; the candidate nearest to it by logarithm is taken.  Without one, nothing changes.
    """
    from payscope.functions.model import nearest_candidate

    own = "OVER (PARTITION BY code)"
    tagged = F.expr(f"median(CASE WHEN source = 'tag' THEN value END) {own}")
    plain = F.expr(f"median(CASE WHEN candidates IS NULL OR size(candidates) < 2 THEN value END) {own}")
    rows = history.withColumn("_ref", F.coalesce(tagged, plain))
    pick = F.when((F.size("candidates") >= 2) & F.col("_ref").isNotNull(), nearest_candidate(F.col("candidates"), F.col("_ref")))
    return rows.withColumn("resolved", F.coalesce(pick, F.col("value"))).withColumn("swapped", ~F.col("resolved").eqNullSafe(F.col("value"))).drop("_ref")
