"""Cleansing and entity resolution: slots, joins by key, two-phase matching, checks that stop a build."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_per_slot(facts: DataFrame, key: str, slot: str, value: str, order: str, slots: Sequence[str]) -> DataFrame:
    """Long facts to one row for each key: the first value of each slot by ``order``."""
    first = facts.where(F.col(slot).isin(*slots)).groupBy(key, slot).agg(F.min_by(value, order).alias("v"))
    return first.groupBy(key).agg(*(F.max(F.when(F.col(slot) == s, F.col("v"))).alias(s) for s in slots))


def newest(rows: DataFrame, key: str, updated: str, seq: str) -> DataFrame:
    """One row for each key: the greatest ``updated``, the first by ``seq`` of ties."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(updated, -F.col(seq))).alias("m"))
    return best.select(key, *(F.col(f"m.{c}").alias(c) for c in rest))


def join_by_key(companies: DataFrame, registry: DataFrame, key: str, updated: str, seq: str) -> DataFrame:
    """Inner join on the number alone, newest registry row first; names and codes are never a fallback."""
    return companies.join(newest(registry, key, updated, seq), key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def two_phase(rows: DataFrame, codelist: DataFrame) -> DataFrame:
    """(row_idx, code, phase) for ``rows`` (row_idx, sec_code, name_key, listed) against ``codelist`` (code, sec_code,
    name_key, listed).

    Phase 1 matches a security code that only one code has.  Phase 2 takes the open rows in their order and matches the
    name: the only code of that name; else the only one listed alike; else the only one that no row before has
    taken, in either phase.  Rows that stay open have a null code.

    Phase 2 is no loop.  The first two cases do not depend on what was taken, so it is known from which row on they
    take a code.  The codes of a name that are left over only become fewer, so exactly one is left between the rows that
    take the last but one and the last, and the first row of the third case in between gets it.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("name_key", "listed")))
    named = lambda a, b: F.col(f"{a}.name_key").eqNullSafe(F.col(f"{b}.name_key"))
    unique = codelist.where("sec_code IS NOT NULL AND sec_code <> ''").groupBy("sec_code").agg(F.count("*").alias("n"), F.min("code").alias("code")).where("n = 1").drop("n")
    one = rows.join(unique, "sec_code", "left").select("row_idx", "name_key", "listed", "code")
    open_ = one.where("code IS NULL").drop("code")
    of_name = codelist.groupBy("name_key").agg(F.count("*").alias("n"), F.min("code").alias("only"))
    alike = codelist.groupBy("name_key", "listed").agg(F.count("*").alias("n_alike"), F.min("code").alias("only_alike"))
    known = (
        open_.alias("r").join(of_name.alias("n"), named("r", "n"), "left").join(alike.alias("a"), same("r", "a"), "left")
        .select("r.*", "n", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_alike") == 1, F.col("only_alike")).alias("code"))
    )
    fixed = known.where("code IS NOT NULL")
    # Codes that phase 1 left over, with the row that takes them by the first two cases.
    taken = fixed.groupBy("code").agg(F.min("row_idx").alias("taken"))
    left = codelist.join(one.where("code IS NOT NULL").select("code"), "code", "left_anti").join(taken, "code", "left")
    ranked = left.withColumn("k", F.expr("row_number() OVER (PARTITION BY name_key ORDER BY taken DESC NULLS FIRST, code)")).where("k <= 2")
    last = ranked.groupBy("name_key").agg(
        F.max(F.when(F.col("k") == 1, F.col("code"))).alias("last"), F.max(F.when(F.col("k") == 1, F.col("taken"))).alias("until"),
        F.max(F.when(F.col("k") == 2, F.col("taken"))).alias("after"), F.count("*").alias("left"),
    )
    alone = ((F.col("left") == 1) | (F.col("row_idx") > F.col("after"))) & (F.col("until").isNull() | (F.col("row_idx") < F.col("until")))
    third = known.where("code IS NULL AND n > 1").alias("r").join(last.alias("l"), named("r", "l")).where(alone).groupBy("last").agg(F.min("row_idx").alias("row_idx")).withColumnRenamed("last", "code")
    by_name = fixed.select("row_idx", "code").unionByName(third.select("row_idx", "code"))
    rest = open_.select("row_idx").join(by_name, "row_idx", "left")
    return (
        one.where("code IS NOT NULL").select("row_idx", "code", F.lit(1).alias("phase"))
        .union(rest.select("row_idx", "code", F.when(F.col("code").isNotNull(), 2).otherwise(0)))
    )


def filing_status(response: str = "metadata", results: str = "results") -> Column:
    """``ok`` for status 200 with results, ``empty`` for 404, else null: a rate-limit answer is neither."""
    status = F.col(f"{response}.status")
    return F.when((status == "200") & F.col(results).isNotNull(), "ok").when(status == "404", "empty")


def annual_reports(filings: DataFrame) -> DataFrame:
    """The last annual report of each security code, from working days only (``day``, ``doc_id``, ``sec_code``,
    ``doc_type``, ``withdrawn``)."""
    kept = filings.where((F.weekday("day") < 5) & (F.col("doc_type") == "120") & F.col("sec_code").isNotNull() & (F.coalesce("withdrawn", F.lit("0")) == "0"))
    rest = [c for c in filings.columns if c != "sec_code"]
    best = kept.groupBy("sec_code").agg(F.max_by(F.struct(*rest), F.struct("day", "doc_id")).alias("m"))
    return best.select("sec_code", *(F.col(f"m.{c}").alias(c) for c in rest))


def working_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day) from Monday to Friday between two dates, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5)


def working_days_of(rows: DataFrame, day: str = "day") -> DataFrame:
    """(day) from Monday to Friday between the first and the last day of ``rows``; none if there are no rows."""
    bounds = rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).where("first IS NOT NULL")
    return bounds.select(F.explode(F.sequence("first", "last")).alias("day")).where(F.weekday("day") < 5)


class QualityError(ValueError):
    """A check of the data failed."""


def expect_unique(rows: DataFrame, key: str) -> DataFrame:
    twice = rows.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise QualityError(f"{key} is not unique: {[r[key] for r in twice]}")
    return rows


def expect_rows(rows: DataFrame, n: int) -> DataFrame:
    got = rows.count()
    if got != n:
        raise QualityError(f"{got} rows instead of {n}")
    return rows


def expect_matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of ``left`` has its partner in ``right``."""
    open_ = unmatched(left, right, key).limit(5).collect()
    if open_:
        raise QualityError(f"no partner for {[r[key] for r in open_]}")
    return left
