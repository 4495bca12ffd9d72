"""Filings in archives as a data source that opens only the archives that are wanted.

What is wanted is a narrow table, the index: doc_id, year and path of each filing.  It comes from a semi-join of the daily lists
with a population, so no folder is listed and no archive of another filer or year is touched.  Each row group of the index is a
task.  Filters on ``doc_id`` and ``year`` are taken over by the source: they leave out row groups by their statistics and
archives by their rows, before anything is opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as source
from pyspark.sql import functions as F

from payscope.sources.files import facts_of
from payscope.sources.tables import scratch_path

NAME = "filing_archives"
SCHEMA = "doc_id STRING, year INT, path STRING, seq LONG, element STRING, context STRING, value STRING"
#: Archives of a row group of the index; they have some 70 KB each.
ARCHIVES_PER_TASK = 1000
#: Facts that are handed over together.
_FACTS = 50_000
_COMPARED = {source.EqualTo: "__eq__", source.GreaterThan: "__gt__", source.GreaterThanOrEqual: "__ge__", source.LessThan: "__lt__", source.LessThanOrEqual: "__le__"}


def _opened(path: str) -> bytes | None:
    """The bytes of an archive; None if it has not landed."""
    store, at = fs.FileSystem.from_uri(path)
    try:
        with store.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


class RowGroup(source.InputPartition):
    """Some row groups of one file of the index."""

    def __init__(self, path: str, groups: list[int]) -> None:
        self.path, self.groups = path, groups


class ArchiveReader(source.DataSourceReader):
    """Reads the archives of an index as far as the pushed filters want them."""

    def __init__(self, index: str) -> None:
        self.index = index
        self.pushed: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[source.Filter]) -> Iterable[source.Filter]:  # noqa: N802
        for one in filters:
            column = getattr(one, "attribute", ())
            if column not in (("doc_id",), ("year",)):
                yield one
            elif type(one) in _COMPARED and one.value is not None:
                self.pushed.append((column[0], _COMPARED[type(one)], one.value))
            elif isinstance(one, source.In) and None not in one.value:
                self.pushed.append((column[0], "isin", list(one.value)))
            elif isinstance(one, source.IsNotNull):
                self.pushed.append((column[0], "is_valid", None))
            else:
                yield one

    def _condition(self) -> pc.Expression | None:
        out = None
        for column, how, value in self.pushed:
            one = getattr(pc.field(column), how)(*([] if how == "is_valid" else [value]))
            out = one if out is None else out & one
        return out

    def partitions(self) -> list[RowGroup]:
        """The row groups that may hold a wanted filing, by their statistics: the driver sees footers, not filings."""
        store, at = fs.FileSystem.from_uri(self.index)
        found = []
        for fragment in ds.dataset(at, filesystem=store, format="parquet").get_fragments():
            found += [RowGroup(part.path, [g.id for g in part.row_groups]) for part in fragment.split_by_row_group(self._condition()) if part.row_groups]
        return found or [RowGroup(at, [])]  # Spark asks for one at least

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        store, _ = fs.FileSystem.from_uri(self.index)
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, store, row_groups=partition.groups)
        held: list[tuple] = []
        for wanted in fragment.to_batches(columns=["doc_id", "year", "path"], filter=self._condition()):
            for doc_id, year, path in zip(*(c.to_pylist() for c in wanted.columns), strict=True):
                content = _opened(path)
                held += ((doc_id, year, path, *fact) for fact in (facts_of(content) if content else ()))
                if len(held) >= _FACTS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["doc_id", "year", "path", "seq", "element", "context", "value"]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class ArchiveSource(source.DataSource):
    """``spark.read.format("filing_archives").option("index", path)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ArchiveReader:
        return ArchiveReader(self.options["index"])


def place_of(folder: str, doc_id: str = "doc_id", shelves: int = 0) -> Column:
    """Where the archive of a filing is: in ``folder``, or in one of its ``shelves``, as tasks that write into one folder wait for each other."""
    shelf = F.concat(F.pmod(F.crc32(doc_id), F.lit(shelves)).cast("string"), F.lit("/")) if shelves else F.lit("")
    return F.concat(F.lit(folder.rstrip("/") + "/"), shelf, doc_id, F.lit(".zip"))


def wanted_index(targets: DataFrame, folder: str, shelves: int = 0) -> str:
    """The path of an index of ``targets`` (doc_id, year): each filing once, at its place in ``folder`` (see ``place_of``), sorted by year and doc_id
    so that a row group holds few years."""
    spark = targets.sparkSession
    path = scratch_path(spark, "archive-index")
    own = folder if "://" in folder else f"file://{folder}"
    rows = targets.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.col("year").cast("int")).alias("year"))
    placed = rows.where("doc_id IS NOT NULL").withColumn("path", place_of(own, "doc_id", shelves))
    tasks = max(1, -(-placed.count() // ARCHIVES_PER_TASK))
    placed.repartitionByRange(tasks, "year", "doc_id").sortWithinPartitions("year", "doc_id").write.parquet(path)
    return path


def archive_facts(spark: SparkSession, index: str) -> DataFrame:
    """Facts of the filings of an index: doc_id, year, path, seq, element, context, value.

    An archive that has not landed, and what is no archive, gives no rows; a broken archive is an error.  Filters on doc_id and
    year are pushed to the index.
    """
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("index", index).load()
