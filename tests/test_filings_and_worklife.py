import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from payscope.operators import export, filings, worklife
from payscope.operators.resolution import QualityError
from payscope.sources.files import SURVEY_AGES, survey_curves

PAY, AGE = (e for e, n in filings.ELEMENTS.items() if n in ("avg_salary", "avg_age"))
PEOPLE, TEXT = "jpcrp_cor:NumberOfEmployees", "jpcrp_cor:InformationAboutEmployeesTextBlock"
BLOCK = "従業員数（人）平均年齢平均勤続年数平均年間給与（円）4,179(4,046)34.09.924,320,256"


def test_records(spark):
    now, alone = "CurrentYearInstant", "CurrentYearInstant_NonConsolidatedMember"
    facts = [
        ("a", 0, PAY, "CurrentYearDuration", "5,000,000"), ("a", 1, PAY, "CurrentYearDuration_NonConsolidatedMember", "6,000,000"), ("a", 2, PAY, "Prior1YearDuration", "1"),
        ("a", 3, AGE, alone, "40.5"), ("a", 4, AGE, alone, "99"), ("a", 5, PEOPLE, now, "900"), ("a", 6, PEOPLE, f"{now}_SegmentMember", "7"), ("a", 7, PEOPLE, alone, "100"),
        ("b", 0, PEOPLE, alone, "4179"), ("b", -1, TEXT, "FilingDateInstant", "従業員の状況は別に記載"), ("b", 1, TEXT, "FilingDateInstant", BLOCK), ("b", 2, "jpdei_cor:SecurityCodeDEI", "FilingDateInstant", "12340"),
    ]
    got = {r["path"]: r for r in filings.records(spark.createDataFrame(facts, "path string, seq long, element string, context string, value string")).collect()}
    a, b = got["a"], got["b"]
    assert (a["avg_salary"], a["avg_age"], a["employees_nonconsolidated"], a["employees_consolidated"], a["source"], a["candidates"]) == (6e6, 40.5, 100, 900, "tag", None)
    assert (b["source"], b["sec_code"], sorted(b["candidates"])) == ("textblock", "1234", [4_320_256, 24_320_256])


def register_row(**given):
    return tuple(given.get(c, "") for c in worklife.POSITIONS)


def test_register(spark):
    rows = [
        register_row(name=" A ", corporate_number="0001", overtime_all="-16.8", leave_all="103.0", gap_all="638.6", overtime_unit1="x", overtime_unit1_value="-2", overtime_unit2_value="5", updated_at="2024-01"),
        register_row(name="A2", corporate_number="0001", overtime_all="0", updated_at="2025-01"),
        register_row(name="B", corporate_number="0002", as_of="2024", gap_all="-", updated_at="2024-01"),
        register_row(name="C", corporate_number="0003", leave_unit3="u", leave_unit3_value="50.1"),
    ]
    raw = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ", ".join(f"{c} string" for c in worklife.POSITIONS) + ", seq int")
    first = worklife.normalized(raw).first()
    assert (first["overtime_all"], first["leave_all"], first["gap_all"], first["name"]) == (None, 103.0, 638.6, "A")
    assert [(u["unit"], u["value"]) for u in first["overtime_units"]] == [("x", None), ("", 5.0)]
    assert sorted((r["field"], r["raw"]) for r in worklife.dropped(raw).collect()) == [("overtime_all", "-16.8"), ("overtime_unit:x", "-2.0")]
    companies = spark.createDataFrame([("1", "0001"), ("2", "0002"), ("3", "0003"), ("4", "0004")], "id string, corporate_number string")
    got = worklife.joined(companies, raw)
    assert sorted((r["id"], r["register_name"], r["overtime_all"]) for r in got.collect()) == [("1", "A2", 0.0), ("3", "C", None)]
    assert tuple(worklife.fill_rates(got).first()) == (1, 1, 0, 0, 2)


def test_survey(spark, tmp_path):
    value = lambda tab, age, x: {"@tab": tab, "@cat01": "01", "@cat02": "07", "@cat04": age, "$": x}
    answer = lambda status, values: {"GET_STATS_DATA": {"RESULT": {"STATUS": status, "ERROR_MSG": ""}, "STATISTICAL_DATA": {"DATA_INF": {"VALUE": values}}}}
    (tmp_path / "ok.json").write_text(json.dumps(answer(0, [value("40", "03", "250.5"), value("44", "03", "390.9"), value("40", "04", "300")])))
    row = survey_curves(spark, str(tmp_path / "ok.json")).first()
    assert (row["size"], row["curve_key"], row["curve"]) == ("ANNUAL_INDUSTRY", "製造業", [3396.9] + [None] * (len(SURVEY_AGES) - 1))
    (tmp_path / "bad.json").write_text(json.dumps(answer(100, [])))
    with pytest.raises(QualityError):
        survey_curves(spark, str(tmp_path / "bad.json"))


def test_encodings(spark):
    rows = spark.createDataFrame([(1, " x"), (2, ""), (3, "y")], "n int, v string")
    pool = export.string_pool(rows, "v", "n")
    back = export.unpooled(export.pooled(rows, "v", "n").select("n", "v_index"), pool, "v_index", "v")
    assert sorted(map(tuple, back.select("n", "v").collect())) == [(1, "x"), (2, ""), (3, "y")]
    firms = spark.createDataFrame([("a", "A", "b業", "k2", 1.0, 2.0, 3.0, 4), ("b", "B", "a業", "k1", 1.0, 2.0, 3.0, 4)], "id string, name string, tse33 string, curve_key string, avg_age double, avg_tenure double, avg_salary double, employees int")
    assert sorted((r["id"], r["sector"], r["curve"]) for r in export.company_tuples(firms, ["k1", "k2"]).collect()) == [("a", 1, 1), ("b", 0, 0)]
    with pytest.raises(PySparkException, match="unknown curve"):
        export.company_tuples(firms, ["k1"]).collect()
    licences = spark.createDataFrame([("Public domain",), ("CC0 1.0",), ("CC BY-SA 4.0",), (None,)], "l string")
    assert [r["x"] for r in licences.select(export.needs_credit("l").alias("x")).collect()] == [False, False, True, True]
    assert export.orphans(rows.select(F.col("n").alias("id")), rows.where("n = 1").select(F.col("n").alias("id"))).count() == 2
