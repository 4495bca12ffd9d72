"""Helpers that several document operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``.  Only a local session
    without that setting (tests) gets a folder under the machine's temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df`` through a Parquet table in the shared folder.

    The table outlives lost executors.  It is left for whoever clears that folder.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or a plain path; None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def rows_of(batches: Iterator[pa.RecordBatch], names: list[str], size: Callable[[list], int], limit: int) -> Iterator[list[list]]:
    """Columns ``names`` of the batches as Python lists, cut so that ``size(values)`` summed over the
    last column stays near ``limit``: what one block of work holds is bounded, however long the rows."""
    block: list[list] = [[] for _ in names]
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
            for values, value in zip(block, row, strict=True):
                values.append(value)
            held += size(row[-1]) if row[-1] is not None else 0
            if held >= limit:
                yield block
                block, held = [[] for _ in names], 0
    if block[0]:
        yield block


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))
