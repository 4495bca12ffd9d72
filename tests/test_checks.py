"""All rules in one job, and what they say."""

import pytest
from pyspark.sql import functions as F

from payscope.operators.checks import Between, Build, Holds, Matched, Unique
from payscope.operators.resolution import QualityError


def rules(other):
    return [
        Unique("same id", "id"), Holds("pay above 0", F.col("pay") > 0), Matched("known sector", other, "sector"),
        Between("all pay", F.sum("pay"), 10, 1000), Between("rows", F.count(F.lit(1)), most=5),
    ]


def sectors(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "sector string, x int")


def test_sound_build_has_a_manifest(spark, tmp_path):
    source = spark.createDataFrame([(k, 10 * k, "ab"[k % 2]) for k in range(1, 8)], "id long, pay int, sector string")
    build = Build()
    kept = build.counted(build.counted(source, "source").where("id < 6"), "matched")
    got = build.write(build.checked(kept, "id", *rules(sectors(spark))), str(tmp_path / "b"))
    assert got == {"source": 7, "matched": 5, "same id": 0, "pay above 0": 0, "known sector": 0, "all pay": 150.0, "rows": 5.0}
    assert {r["name"]: r["value"] for r in spark.read.json(str(tmp_path / "b/manifest")).collect()} == got
    back = spark.read.parquet(str(tmp_path / "b/rows"))
    assert back.columns == source.columns and back.count() == 5


def test_all_faults_are_named(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (1, None, "c"), (2, -5, None), (None, 3, "a"), (None, 4, "b"), (9, 2000, "b")], "id long, pay int, sector string")
    build = Build()
    with pytest.raises(QualityError) as e:
        build.write(build.checked(rows, "id", *rules(sectors(spark))), str(tmp_path / "b"))
    said = str(e.value)
    assert "same id: 4 rows, the first is 1" in said and "pay above 0: 2 rows, the first is 1" in said and "known sector: 2 rows, the first is 1" in said
    assert "all pay: 2012 is not within 10 and 1000" in said and "rows: 6 is not within None and 5" in said
    assert not (tmp_path / "b/manifest").exists()


def test_one_job_reads_the_source_once(spark, tmp_path):
    source = spark.createDataFrame([(k, 10, "a") for k in range(1, 6)], "id long, pay int, sector string")
    path = str(tmp_path / "s")
    source.write.parquet(path)
    build = Build()
    rows = build.checked(build.counted(spark.read.parquet(path), "source"), "id", *[r for r in rules(sectors(spark)) if not isinstance(r, Matched)])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 2 and plan.count("Relation") == 1
    assert build.write(rows, str(tmp_path / "b"))["source"] == 5


def test_no_rows(spark, tmp_path):
    build = Build()
    none = spark.createDataFrame([], "id long, pay int, sector string")
    got = build.write(build.checked(build.counted(none, "source"), "id", Unique("same id", "id"), Between("all pay", F.sum("pay"), most=5)), str(tmp_path / "b"))
    assert got == {"source": 0, "same id": 0, "all pay": 0.0}
    with pytest.raises(QualityError):
        build = Build()
        build.write(build.checked(none, "id", Between("rows", F.count(F.lit(1)), least=1)), str(tmp_path / "c"))
