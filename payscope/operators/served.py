"""The ranking as tables that are served and kept up to date: a page reads the rows of one shelf and a small index.

Rows lie in folders by basis and shelf, a stretch of cells of pay.  The index has a row for each shelf: how many rows it holds, how many rows have more
pay than any in it (the sum over the shelves above), and the version that wrote it.  A change writes the shelves it touches under a new version, and
the whole index, which is a few hundred rows for each basis at any number of companies.  Readers name a version and see all of it or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.operators.ranking import cell_of

#: Cells of a shelf.
SHELF = 8
_KEYS = ["basis", "shelf"]


def _shelved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shelf", F.floor(cell_of(F.col("salary")) / F.lit(SHELF)).cast("int"))


def _index(counts: DataFrame) -> DataFrame:
    """``counts`` (basis, shelf, version, n) with ``ahead``; a few hundred rows meet for each basis."""
    return counts.select(*_KEYS, "version", "n", F.expr("sum(n) OVER (PARTITION BY basis ORDER BY shelf DESC) - n").alias("ahead"))


def _put(rows: DataFrame, folder: str, version: int) -> DataFrame:
    """Writes shelves and returns their counts.  A shelf that very many rows share is written by several tasks."""
    path = f"{folder}/rows/version={version}"
    rows.hint("rebalance", *_KEYS).write.mode("overwrite").partitionBy(*_KEYS).parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return written.groupBy(*_KEYS).agg(F.count("*").alias("n")).withColumn("version", F.lit(version))


def build(rows: DataFrame, folder: str) -> int:
    """Version 1 of ``rows`` (basis, id, row_idx, salary, ...): each (basis, id) once."""
    _index(_put(_shelved(rows), folder, 1)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/version=1")
    return 1


def index(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(basis, shelf, version, n, ahead): ``version`` is that of the folder which holds the shelf's rows."""
    return spark.read.parquet(f"{folder}/index/version={version}/")


def rows_of(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """All rows of a version, with their ``shelf``: each shelf from the folder that the index names."""
    known = F.broadcast(index(spark, folder, version).select(*_KEYS, "version"))  # a few hundred rows for each basis
    return spark.read.parquet(f"{folder}/rows").join(known, [*_KEYS, "version"], "left_semi").drop("version")


def merge(spark: SparkSession, folder: str, version: int, changed: DataFrame, removed: DataFrame | None = None) -> int:
    """The next version, with ``changed`` (rows as of ``build``, new ones or in place of those of their basis and id) and without
    ``removed`` (id).  Only the shelves that lose or get a row are read whole and written; of the others nothing but ids is read."""
    before = rows_of(spark, folder, version)
    new = _shelved(changed)
    keys = new.select("basis", "id")
    leave = before.join(keys, ["basis", "id"], "left_semi").select(*_KEYS)
    if removed is not None:
        gone = removed.select("id").distinct()
        leave = leave.union(before.join(gone, "id", "left_semi").select(*_KEYS))
        new = new.join(gone, "id", "left_anti")
    known = index(spark, folder, version)
    touched = leave.union(new.select(*_KEYS)).distinct()
    touched = spark.createDataFrame(touched.collect(), "basis int, shelf int")  # at most all shelves, see above
    stay = before.join(F.broadcast(touched), _KEYS, "left_semi").join(keys, ["basis", "id"], "left_anti")
    stay = stay if removed is None else stay.join(gone, "id", "left_anti")
    counts = _put(stay.select(*new.columns).unionByName(new), folder, version + 1)
    kept = known.join(F.broadcast(touched), _KEYS, "left_anti").select(*_KEYS, "n", "version")
    _index(kept.unionByName(counts)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/version={version + 1}")
    return version + 1


def page(spark: SparkSession, folder: str, version: int, basis: int, number: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """The rows of a page by pay (then ``row_idx``) with their ``position`` from 1, ``total``, and the ``page`` shown, which is the last if there
    are fewer.  Only the folders of the shelves that the page lies in are listed and read."""
    shelves = index(spark, folder, version).where(F.col("basis") == basis).collect()  # a few hundred rows
    total = sum(s["n"] for s in shelves)
    number = min(max(1, number), max(1, -(-total // size)))
    first, last = (number - 1) * size, number * size
    on = [s for s in shelves if s["ahead"] < last and s["ahead"] + s["n"] > first]
    if not on:
        return rows_of(spark, folder, version).limit(0).select("*", *(F.lit(0).cast(kind).alias(c) for c, kind in (("position", "long"), ("total", "long"), ("page", "int"))))
    paths = [f"{folder}/rows/version={s['version']}/basis={basis}/shelf={s['shelf']}" for s in on]
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(*paths)
    ahead = F.element_at(F.create_map(*(F.lit(x) for s in on for x in (s["shelf"], s["ahead"]))), F.col("shelf"))
    placed = rows.withColumn("position", (ahead + F.expr("row_number() OVER (PARTITION BY shelf ORDER BY salary DESC, row_idx)")).cast("long"))
    shown = placed.where((F.col("position") > first) & (F.col("position") <= last)).drop("version")
    return shown.withColumns({"total": F.lit(total).cast("long"), "page": F.lit(number)})


def standing(spark: SparkSession, folder: str, version: int, ids: DataFrame) -> DataFrame:
    """(basis, id, rank, total) of some companies (``ids``): 1 + the rows with more pay.  The shelves of these companies are read, and the index."""
    known = index(spark, folder, version)
    rows = rows_of(spark, folder, version).select(*_KEYS, "id", "salary")
    own = rows.join(ids.select("id").distinct(), "id", "left_semi")
    theirs = F.broadcast(own.select(*_KEYS).distinct())  # at most all shelves
    values = rows.join(theirs, _KEYS, "left_semi").groupBy(*_KEYS, "salary").agg(F.count("*").alias("_n"))
    within = values.withColumn("_within", F.expr("sum(_n) OVER (PARTITION BY basis, shelf ORDER BY salary DESC) - _n"))
    totals = known.withColumn("total", F.expr("sum(n) OVER (PARTITION BY basis)")).select(*_KEYS, "ahead", "total")
    ranked = own.join(within, [*_KEYS, "salary"]).join(F.broadcast(totals), _KEYS)
    return ranked.select("basis", "id", (F.col("ahead") + F.col("_within") + 1).alias("rank"), "total")
