"""Encodings for delivery: string pools, presence masks, address lists, metrics and files."""

from __future__ import annotations

import gzip
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.functions.text import path_segment
from payscope.operators.ranking import positions
from payscope.operators.resolution import QualityError


def _numbered(first: DataFrame, ties: Sequence[str]) -> DataFrame:
    """(value, index): from 0 in the order of ``ties``, counted in stretches of the first one if that is a whole number."""
    placed = positions(first.withColumn("_all", F.lit(0)), "_all", ties)
    return placed.select("value", (F.col("position") - 1).cast("int").alias("index"))


def string_pool(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(value, index): distinct trimmed, non-empty values, numbered from 0 by where each is first seen."""
    value = F.trim(F.col(column))
    first = rows.where(value != "").groupBy(value.alias("value")).agg(F.min(order).alias("at"))
    return _numbered(first, ["at", "value"])


def pooled(rows: DataFrame, column: str, order: str) -> DataFrame:
    """``rows`` with ``<column>_index``: the place in the pool, -1 for null and empty values."""
    pool = string_pool(rows, column, order)
    out = rows.withColumn("_v", F.trim(F.col(column))).join(pool, F.col("_v") == pool["value"], "left")
    return out.withColumn(f"{column}_index", F.coalesce("index", F.lit(-1))).drop("_v", "value", "index")


def unpooled(rows: DataFrame, pool: DataFrame, index: str, name: str) -> DataFrame:
    """The values behind the places of a pool; '' for -1."""
    names = pool.select(F.col("value").alias(name), F.col("index").alias(index))
    return rows.join(names, index, "left").withColumn(name, F.coalesce(name, F.lit(""))).drop(index)


#: The fixed part of an encoded row, and which of its places are texts (fixed values).
ROW_FIELDS = ("overtime_all", "overtime_scope", "leave_all", "gap_all", "gap_regular", "gap_nonregular", "gap_period", "as_of", "updated_at")
ROW_TEXTS = ("overtime_scope", "gap_period", "as_of", "updated_at")
ROW_UNITS = ("overtime_units", "leave_units")


def row_pool(rows: DataFrame, order: str) -> DataFrame:
    """(value, index) of all texts of ``rows``, units' names too, numbered from 0 as a walk by ``order`` meets them."""
    names = F.flatten(F.array(*(F.transform(F.col(u), lambda x: x["unit"]) for u in ROW_UNITS)))
    each = rows.select(order, F.posexplode(F.concat(F.array(*ROW_TEXTS), names)).alias("k", "value")).withColumn("value", F.trim("value"))
    first = each.where("value <> ''").groupBy("value").agg(F.min(F.struct(order, "k")).alias("at"))
    return _numbered(first.select("value", F.col(f"at.{order}").alias("_at"), F.col("at.k").alias("_k")), ["_at", "_k"])


def _looked_up(rows: DataFrame, wanted: Column, kind: str, pool: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``_got``: for each member of the array ``wanted`` what the pool has for it, null if nothing.

    The members are joined as rows, so no task holds the pool.  The first row of each carries the rest.  Null members get keys of
    their own that are in no pool (values are trimmed, places are not negative), else they would all meet in one task.
    """
    whole = rows.withColumn("_row", F.monotonically_increasing_id())
    each = whole.select("_row", F.struct(*rows.columns).alias("_whole"), F.posexplode(F.concat(F.array(F.lit(None).cast(kind)), wanted)).alias("_k", "_x"))
    none = F.concat(F.lit(" "), F.col("_row").cast("string")) if kind == "string" else -1 - F.col("_row")
    keyed = each.select("_row", F.when(F.col("_k") == 0, F.col("_whole")).alias("_whole"), "_k", F.coalesce("_x", none).alias("_x"))
    found = keyed.join(pool.select(F.col(key).cast(kind).alias("_x"), F.col(name).alias("_y")), "_x", "left")
    together = found.groupBy("_row").agg(F.first("_whole", ignorenulls=True).alias("_whole"), F.sort_array(F.collect_list(F.struct("_k", "_y"))).alias("_all"))
    return together.select("_whole.*", F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda x: x["_y"]).alias("_got"))


def encoded_rows(rows: DataFrame, pool: DataFrame, key: str = "id") -> DataFrame:
    """(key, cells): nine fixed cells, texts as places in the pool (-1 for none), then for each kind of units their number
    and so many pairs of name and value."""
    names = F.flatten(F.array(*(F.transform(F.col(u), lambda x: x["unit"]) for u in ROW_UNITS)))
    texts = F.transform(F.concat(F.array(*ROW_TEXTS), names), lambda x: F.nullif(F.trim(x), F.lit("")))
    placed = _looked_up(rows.select(key, *ROW_FIELDS, *ROW_UNITS), texts, "string", pool, "value", "index")
    place = lambda at: F.coalesce(F.get("_got", at).cast("double"), F.lit(-1.0))
    fixed = F.array(*(place(F.lit(ROW_TEXTS.index(c))) if c in ROW_TEXTS else F.col(c).cast("double") for c in ROW_FIELDS))

    def counted(units: str, start: Column) -> Column:
        pairs = F.transform(F.col(units), lambda x, i: F.array(place(start + i), x["value"].cast("double")))
        return F.concat(F.array(F.size(units).cast("double")), F.flatten(pairs))

    first, second = ROW_UNITS
    start = F.lit(len(ROW_TEXTS))
    return placed.select(key, F.concat(fixed, counted(first, start), counted(second, start + F.size(first))).alias("cells"))


def decoded_rows(encoded: DataFrame, pool: DataFrame, key: str = "id") -> DataFrame:
    """The rows behind ``encoded_rows``; '' where a text was empty or missing."""
    cell = lambda at: F.get("cells", at)
    n = [F.col("_n0"), F.col("_n1")]
    starts = [F.lit(len(ROW_FIELDS)), F.lit(len(ROW_FIELDS) + 1) + 2 * n[0]]
    count = lambda at: F.coalesce(cell(at).cast("int"), F.lit(0))
    sized = encoded.select(key, "cells").withColumn("_n0", count(starts[0])).withColumn("_n1", count(starts[1]))
    steps = lambda k: F.when(n[k] > 0, F.sequence(F.lit(1), n[k])).otherwise(F.array().cast("array<int>"))
    name = lambda k: F.transform(steps(k), lambda i: cell(starts[k] + 2 * i - 1))
    places = F.concat(F.array(*(cell(F.lit(ROW_FIELDS.index(c))) for c in ROW_TEXTS)), name(0), name(1))
    wanted = F.transform(places, lambda x: F.when(x >= 0, x.cast("long")))
    named = _looked_up(sized, wanted, "long", pool, "index", "value")
    text = lambda at: F.coalesce(F.get("_got", at), F.lit(""))
    fixed = [(text(F.lit(ROW_TEXTS.index(c))) if c in ROW_TEXTS else cell(F.lit(k))).alias(c) for k, c in enumerate(ROW_FIELDS)]
    earlier = [F.lit(len(ROW_TEXTS)), F.lit(len(ROW_TEXTS)) + n[0]]
    units = lambda k: F.transform(steps(k), lambda i: F.struct(text(earlier[k] + i - 1).alias("unit"), cell(starts[k] + 2 * i).alias("value")))
    return named.select(key, *fixed, *(units(k).alias(u) for k, u in enumerate(ROW_UNITS)))


def company_tuples(companies: DataFrame, curve_keys: Sequence[str]) -> DataFrame:
    """Companies as they are delivered: the sector and the curve as places, the sectors in Japanese order.
    A curve key that is not among ``curve_keys`` is an error."""
    sectors = companies.select(F.col("tse33").cast("string").alias("tse33")).distinct()
    # A few dozen sectors at any number of companies.
    placed = sectors.select("tse33", F.expr("row_number() OVER (ORDER BY tse33 COLLATE ja, tse33) - 1").alias("sector"))
    known = F.array_position(F.array(*map(F.lit, curve_keys)), F.col("curve_key"))
    curve = F.when(known > 0, known - 1).otherwise(F.raise_error(F.concat(F.lit("unknown curve: "), F.coalesce("curve_key", F.lit("null")))).cast("long"))
    rows = companies.withColumn("tse33", F.col("tse33").cast("string")).join(F.broadcast(placed), "tse33")
    return rows.select("id", "name", "sector", curve.cast("int").alias("curve"), "avg_age", "avg_tenure", "avg_salary", "employees")


def orphans(files: DataFrame, written: DataFrame, key: str = "id") -> DataFrame:
    """Files of entries that are no longer written."""
    return files.join(written.select(key), key, "left_anti")


def needs_credit(licence: str) -> Column:
    """Whether a licence asks for attribution: all but public domain and CC0."""
    return ~F.coalesce(F.col(licence), F.lit("")).rlike(r"(?i)^(public domain|pd|cc0)")


def presence_mask(rows: DataFrame, present: DataFrame, key: str, order: str, block: int = 4096) -> DataFrame:
    """(block, mask): '1' or '0' for each row in order, whether its key is in ``present``; blocks of rows numbered
    by ``order``, so that no string and no group grows with the data."""
    flagged = rows.select(key, order).join(present.select(key).distinct().withColumn("_one", F.lit("1")), key, "left")
    bits = flagged.select(F.floor(F.col(order) / block).cast("long").alias("block"), F.struct(order, F.coalesce("_one", F.lit("0")).alias("bit")).alias("x"))
    return bits.groupBy("block").agg(F.array_join(F.sort_array(F.collect_list("x"))["bit"], "").alias("mask"))


def present_rows(masks: DataFrame, block: int = 4096) -> DataFrame:
    """The places marked by ``presence_mask`` of a dense order."""
    each = masks.select("block", F.posexplode(F.split("mask", "")).alias("at", "bit"))
    return each.where("bit = '1'").select((F.col("block") * block + F.col("at")).alias("place"))


def sitemap(companies: DataFrame, ages: Sequence[int], origin: str = "") -> DataFrame:
    """(loc): start page, pages of ages, of industries that have a company, and of companies."""
    spark = companies.sparkSession
    fixed = spark.createDataFrame([("/",), *((f"/age/{a}",) for a in ages)], "path string")
    industries = companies.select(F.concat(F.lit("/industry/"), path_segment(F.col("tse33").cast("string"))).alias("path")).distinct()
    each = companies.select(F.concat(F.lit("/company/"), path_segment(F.col("id").cast("string"))).alias("path")).distinct()
    return fixed.unionByName(industries).unionByName(each).select(F.concat(F.lit(origin), "path").alias("loc"))


def with_units(rows: DataFrame, units: str, most: int = 5) -> DataFrame:
    """An array of (unit, value) as ``most`` pairs of columns, null where there are fewer."""
    out = rows
    for k in range(most):
        item = F.get(F.col(units), F.lit(k))
        out = out.withColumns({f"unit{k + 1}": item["unit"], f"unit{k + 1}_value": item["value"]})
    return out.drop(units)


def manifest(source: DataFrame, matched: DataFrame, written: DataFrame) -> DataFrame:
    """One row of counts of a build."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(source, "source_rows").crossJoin(count(matched, "matched")).crossJoin(count(written, "written"))  # one row each


def write_csv(rows: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """CSV with a header, quoted only where needed, quotes doubled; ``byte_order_mark``: spreadsheet programs want one,
    so the file is then one piece (an export of the whole population is a few thousand rows by its purpose)."""
    if byte_order_mark:
        first, *rest = rows.columns
        rows = rows.coalesce(1).withColumnRenamed(first, "\ufeff" + first).select("\ufeff" + first, *rest)
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def check_size(payload: str, most_kb: int) -> int:
    """The compressed size of a delivered piece; an error above its budget."""
    size = len(gzip.compress(payload.encode()))
    if size > most_kb * 1024:
        raise QualityError(f"{size} bytes compressed, more than {most_kb} KB")
    return size


def write_bundle(pieces: Mapping[str, tuple[DataFrame, int]], folder: str) -> dict[str, int]:
    """Each piece (rows, budget in KB) as one JSON array in ``folder``, once all are within their budgets; their
    compressed sizes.  Pieces are what a browser loads whole: their budgets bound what reaches the driver."""
    bodies, sizes = {}, {}
    for name, (rows, most_kb) in pieces.items():
        kept, held = [], 0
        for row in rows.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator():
            kept.append(row["json"])
            held += len(row["json"])
            if held > 100 * most_kb * 1024:  # no text is compressed to a hundredth
                raise QualityError(f"{name}: more than {most_kb} KB")
        bodies[name] = "[" + ",".join(kept) + "]"
        sizes[name] = check_size(bodies[name], most_kb)
    for name, body in bodies.items():
        spark = pieces[name][0].sparkSession
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")
    return sizes
