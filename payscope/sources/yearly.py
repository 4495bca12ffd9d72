"""The yearly history as a table by year and code: partitions for the years, buckets for the codes.

What groups or looks back by code needs no exchange, as all years of a code lie in buckets of one number.  What wants some years
reads those folders only, also where the years come from another table.  Arriving years replace their folders and leave the others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.operators.history import latest_per_year
from payscope.sources.tables import stored

#: Buckets: a task for each reads the wanted years of a share of the codes.
BUCKETS = 8


def create(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table ``name`` at ``path`` with ``rows`` (code, year, ...); each bucket of a year is one file."""
    by_code = rows.repartition(buckets, "code").sortWithinPartitions("year", "code")
    by_code.write.mode("overwrite").format("parquet").partitionBy("year").bucketBy(buckets, "code").sortBy("code").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def attach(spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int = BUCKETS) -> DataFrame:
    """A table that another session created, known to this one."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (year) CLUSTERED BY (code) SORTED BY (code) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def merge(spark: SparkSession, name: str, arrived: DataFrame, buckets: int = BUCKETS) -> None:
    """The latest filing of each code and year out of the table and ``arrived`` (its columns): the years that arrive are read and replaced."""
    table = spark.table(name)
    arrived = stored(arrived.select(table.columns), "arrived")
    years = F.broadcast(arrived.select("year").distinct())  # few, whatever arrives
    latest = stored(latest_per_year(table.join(years, "year", "left_semi").unionByName(arrived)).select(table.columns), "merged")
    by_code = latest.repartition(buckets, "code").sortWithinPartitions("year", "code")
    mode = "spark.sql.sources.partitionOverwriteMode"  # an option of the writer doesn't reach a table of the catalog
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        by_code.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)


def dense(history: DataFrame, years: list[int], value: str = "value") -> DataFrame:
    """(code, year, value) for every code and each of ``years``, null where it has none: gathered by code, without a join."""
    own = history.where(F.col("year").isin(years) & F.col(value).isNotNull())
    known = own.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("year", value))).alias("_known"))  # a year each
    each = known.select("code", "_known", F.explode(F.array(*map(F.lit, sorted(years)))).alias("year"))
    return each.select("code", "year", F.try_element_at("_known", F.col("year")).alias(value))
