"""Strict file sources: CSV with a fixed header, quoted CSV by position, filing lists, filings in ZIP files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.functions.model import in_yen
from payscope.operators.resolution import QualityError, filing_status

UNIFIED = (
    "rank_adj INT, rank_raw INT, rank_delta INT, sec_code STRING, name STRING, tse33 STRING, listed STRING, avg_age DOUBLE, avg_tenure DOUBLE, avg_salary DOUBLE, "
    "salary35 BIGINT, factor DOUBLE, emp_ratio DOUBLE, employees_nonconsolidated DOUBLE, employees_consolidated DOUBLE, badge STRING, industry STRING, source STRING, "
    "period_end STRING, edinet_code STRING, corporate_number STRING, doc_id STRING"
)
HISTORY = "edinet_code STRING, year INT, avg_salary BIGINT, avg_age DOUBLE, employees_nonconsolidated DOUBLE, source STRING, period_end STRING, doc_id STRING"
FILING_LIST = (
    "metadata STRUCT<status: STRING>, results ARRAY<STRUCT<docID: STRING, edinetCode: STRING, secCode: STRING, filerName: STRING, docTypeCode: STRING, withdrawalStatus: STRING, periodEnd: STRING>>"
)
FACTS = "path STRING, seq LONG, element STRING, context STRING, value STRING"
#: Values of a filing that say nothing (fixed values).
_NOTHING = ("", "－", "-")


def _header(spark: SparkSession, path: str) -> list[str]:
    """The first line of the first file that has one, without a byte order mark, as cells."""
    first = spark.read.text(path, wholetext=False).limit(1).collect()
    return first[0][0].lstrip("﻿").rstrip("\r").split(",") if first else []


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header is exactly the columns of ``schema`` in order; another header, or a row of another
    length or type, is an error.  Empty numbers are null and empty strings stay empty."""
    kind = T.StructType.fromDDL(schema)
    got = _header(spark, path)
    if got != kind.names:
        at = next((k for k, (a, b) in enumerate(zip(got, kind.names, strict=False)) if a != b), min(len(got), len(kind)))
        raise QualityError(f"column {at + 1} of {path}: {got[at] if at < len(got) else 'missing'} instead of {kind.names[at] if at < len(kind) else 'nothing'}")
    rows = spark.read.schema(kind).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    texts = {f.name: F.coalesce(F.col(f.name), F.lit("")) for f in kind if isinstance(f.dataType, T.StringType)}
    return rows.withColumns(texts)


def positional_csv(spark: SparkSession, path: str, names: Sequence[str], positions: dict[str, int]) -> DataFrame:
    """Quoted CSV with line breaks in cells, by position: ``positions`` names the wanted columns (from 1).

    The header must be ``names`` in order, which may repeat, so it is never used as column names.
    Only the wanted columns are parsed; empty cells, quoted or not, are empty strings.
    """
    schema = T.StructType([T.StructField(f"c{k + 1}", T.StringType()) for k in range(len(names))])
    # A place in the file stands for the row's order.
    raw = spark.read.schema(schema).option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\u0000").csv(path)
    head = raw.limit(1).collect()
    got = [("" if v is None else v).lstrip("﻿") for v in head[0]] if head else []
    for k, (a, b) in enumerate(zip(got, names, strict=False)):
        if a != b:
            raise QualityError(f"column {k + 1}: {a!r} instead of {b!r}")
    if len(got) != len(names):
        raise QualityError(f"{len(got)} columns instead of {len(names)}")
    first = names[0]
    body = raw.where(~((F.ltrim(F.regexp_replace("c1", "^﻿", "")) == first) & (F.coalesce(f"c{len(names)}", F.lit("")) == names[-1])))
    return body.select(*(F.coalesce(F.col(f"c{at}"), F.lit("")).alias(name) for name, at in positions.items()))


def filing_lists(spark: SparkSession, path: str) -> DataFrame:
    """Filings of daily lists (one JSON file a day, named by it): day, doc_id, code, sec_code, name, doc_type, withdrawn,
    period_end.  Files that are neither a list nor an empty day are left out."""
    raw = spark.read.schema(FILING_LIST).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    fine = raw.where(filing_status() == "ok").select(F.to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1)).alias("day"), F.explode("results").alias("r"))
    code4 = F.nullif(F.substring("r.secCode", 1, 4), F.lit(""))
    return fine.select(
        "day", F.col("r.docID").alias("doc_id"), F.col("r.edinetCode").alias("code"), code4.alias("sec_code"), F.col("r.filerName").alias("name"),
        F.col("r.docTypeCode").alias("doc_type"), F.col("r.withdrawalStatus").alias("withdrawn"), F.col("r.periodEnd").alias("period_end"),
    )


def rejected_lists(spark: SparkSession, path: str) -> DataFrame:
    """The files that ``filing_lists`` leaves out, to be fetched again."""
    raw = spark.read.schema(FILING_LIST).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return raw.where(filing_status().isNull()).select("file")


def _decoded(raw: bytes) -> str:
    """UTF-16 as filings are written, else UTF-8."""
    try:
        return raw.decode("utf-16")
    except UnicodeError:
        return raw.decode("utf-8", "replace")


def facts_of(content: bytes) -> Iterator[tuple[int, str, str, str]]:
    """(seq, element, context, value) of an archive's tab-separated files; nothing of what is no archive.

    Short lines, headers and values that say nothing are skipped.
    """
    if content[:2] != b"PK":
        return
    seq = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member in (m for m in z.namelist() if m.lower().endswith(".csv")):
            for line in _decoded(z.read(member)).splitlines()[1:]:
                cells = [c.strip().strip('"') for c in line.split("\t")]
                if len(cells) >= 9 and cells[8] not in _NOTHING:
                    yield seq, cells[0], cells[2], cells[8]
                    seq += 1


def filing_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of all filings of a folder (ZIP files of tab-separated text): path, seq, element, context, value, long form.

    Opens every archive; ``archives.archive_facts`` opens those of an index.
    """
    blobs = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *fact) for fact in facts_of(content)], columns=["path", "seq", "element", "context", "value"])

    return blobs.mapInPandas(run, FACTS)


def codelist(spark: SparkSession, path: str, encoding: str = "cp932", names: Sequence[str] = ("code", "kind", "listed", "capital", "name", "tse33", "sec_code", "corporate_number"), at: Sequence[int] = (0, 1, 2, 4, 6, 10, 11, 12)) -> DataFrame:
    """Rows of the CSV file in a ZIP file after its title and header lines; short rows are dropped; the
    security code is cut to four characters."""
    import csv

    schema = ", ".join(f"{n} string" for n in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    text = z.read(next(m for m in z.namelist() if m.lower().endswith(".csv"))).decode(encoding, "replace")
                rows = [[r[k] for k in at] for r in list(csv.reader(io.StringIO(text)))[2:] if len(r) > max(at)]
                yield pd.DataFrame(rows, columns=list(names), dtype=str)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema).withColumn("sec_code", F.substring("sec_code", 1, 4))


def only_zip(spark: SparkSession, folder: str) -> str:
    """The one ZIP file of a folder; an error if there are none or several."""
    found = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path").limit(3).collect()]
    if len(found) != 1:
        raise QualityError(f"{'no' if not found else 'more than one'} ZIP file in {folder}")
    return found[0]


def untyped_csv(spark: SparkSession, path: str, numbers: Sequence[str] = ("avg_age", "avg_salary")) -> DataFrame:
    """A written CSV read again with all columns as they are, as text, but for ``numbers``; empty texts stay empty."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    clean = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    return clean.select(*(F.col(c).cast("double").alias(c) if c in numbers else F.coalesce(c, F.lit("")).alias(c) for c in clean.columns))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def wage_curves(spark: SparkSession, path: str, name: str = "ANNUAL_INDUSTRY") -> DataFrame:
    """(curve_key, curve in yen) from the JSON file of wage curves."""
    kind = f"{name} MAP<STRING, ARRAY<DOUBLE>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode(name).alias("curve_key", "curve")).withColumn("curve", in_yen(F.col("curve")))


# --- fixed values: codes of the wage survey ------------------------------------------------------
SURVEY_INDUSTRIES = {
    "01": "産業計", "02": "鉱業", "03": "建設業", "07": "製造業", "32": "電気・ガス業", "37": "情報通信業", "43": "運輸業", "52": "卸売業・小売業",
    "67": "金融業・保険業", "74": "不動産業", "78": "学術研究・専門技術", "83": "宿泊業・飲食", "87": "生活関連・娯楽", "91": "教育・学習支援",
    "94": "医療・福祉", "98": "複合サービス", "101": "サービス業",
}
SURVEY_AGES = ("03", "04", "05", "06", "07", "08", "09", "10", "11", "12")
SURVEY_SIZES = {"01": "ANNUAL_INDUSTRY", "02": "ANNUAL_LARGE"}
_MONTHLY, _BONUS = "40", "44"
# -------------------------------------------------------------------------------------------------


def survey_curves(spark: SparkSession, path: str) -> DataFrame:
    """(size, curve_key, curve) from a landed answer of the wage survey: twelve months and the bonus, one decimal,
    in thousand yen at the ten ages; null where either is missing.  An answer with another status is an error."""
    value = "STRUCT<`@tab`: STRING, `@cat01`: STRING, `@cat02`: STRING, `@cat04`: STRING, `$`: STRING>"
    schema = f"GET_STATS_DATA STRUCT<RESULT: STRUCT<STATUS: INT, ERROR_MSG: STRING>, STATISTICAL_DATA: STRUCT<DATA_INF: STRUCT<VALUE: ARRAY<{value}>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = raw.where("GET_STATS_DATA.RESULT.STATUS <> 0 OR GET_STATS_DATA.RESULT.STATUS IS NULL").limit(1).collect()
    if bad:
        raise QualityError(f"the survey answered {bad[0][0]['RESULT']}")
    v = raw.select(F.explode("GET_STATS_DATA.STATISTICAL_DATA.DATA_INF.VALUE").alias("v"))
    rows = v.select(F.col("v.`@tab`").alias("tab"), F.col("v.`@cat01`").alias("size"), F.col("v.`@cat02`").alias("industry"), F.col("v.`@cat04`").alias("age"), F.col("v.`$`").try_cast("double").alias("x"))
    part = lambda tab: F.max(F.when(F.col("tab") == tab, F.col("x")))
    wages = rows.groupBy("size", "industry", "age").agg(F.round(part(_MONTHLY) * 12 + part(_BONUS), 1).alias("wage"))
    curves = wages.groupBy("size", "industry").agg(*(F.max(F.when(F.col("age") == a, F.col("wage"))).alias(a) for a in SURVEY_AGES))
    named = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(key))
    return curves.select(named(SURVEY_SIZES, "size").alias("size"), named(SURVEY_INDUSTRIES, "industry").alias("curve_key"), F.array(*(F.col(f"`{a}`") for a in SURVEY_AGES)).alias("curve")).where("size IS NOT NULL AND curve_key IS NOT NULL")
