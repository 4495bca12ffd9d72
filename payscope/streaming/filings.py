"""Filings as they arrive: new files are read once, later corrections replace earlier ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payscope.operators.history import latest_per_year
from payscope.operators.population import first_existing


def arriving(spark: SparkSession, landing: str, schema: str) -> DataFrame:
    """A stream of the JSON lines that land in a folder."""
    return spark.readStream.schema(schema).json(landing)


def keep_latest(filings: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Read all that has arrived since the last run and merge it into ``table`` (Parquet, by batch and year).

    A batch writes the whole of the years it touches, made of what the batches before it left and what has arrived,
    so one that runs again writes the same folder again.  Folders that a later batch replaces may be deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = current(batch.sparkSession, table, number)
        if before is not None:
            years = batch.select("year").distinct()  # few, whatever arrives
            batch = before.join(years, "year", "left_semi").select(batch.columns).unionByName(batch)
        latest_per_year(batch).write.mode("overwrite").partitionBy("year").parquet(f"{table}/batch={number}")

    return filings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The latest filing of each entity and year, read from the last folder of each year only; None if there is no table,
    or none from a batch under ``before``."""
    if first_existing(spark, [table]) is None:
        return None
    rows = spark.read.parquet(table)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = {r["year"]: r["batch"] for r in rows.groupBy("year").agg(F.max("batch").alias("batch")).collect()}  # one row a year
    if not last:
        return None if before is not None else rows.drop("batch")
    wanted = reduce(lambda x, y: x | y, ((F.col("year") == year) & (F.col("batch") == batch) for year, batch in last.items()))
    return rows.where(wanted).drop("batch")
