"""Tables that are written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session that names none (tests) gets one under the machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a table and read again: what stands before it is computed once and survives lost executors.

    The table is left for whoever clears the shared folder.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` over a few tasks for each core: a small file is one task, however long its rows take."""
    return rows.repartition(min(200, 4 * rows.sparkSession.sparkContext.defaultParallelism), key)
