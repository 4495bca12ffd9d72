"""The pay model against published examples and plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model, text
from payscope.operators.ranking import bases


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(spark, x, values, points):
    row = spark.createDataFrame([(float(x), [float(v) for v in values])], "x double, curve array<double>")
    return model.with_curve_values(row, {"y": F.col("x")}, points=points).first()["y"]


@pytest.mark.parametrize("x, y", [(18, 100), (70, 1000), (29.5, 250), (22, 100), (67, 1000)])
def test_interpolate(spark, x, y):
    assert at(spark, x, range(100, 1001, 100), C.AGE_POINTS) == pytest.approx(y)


def estimate(spark, salary, age, target, curve):
    row = spark.createDataFrame([(float(salary), float(age), [float(v) for v in curve])], "avg_salary double, avg_age double, curve array<double>")
    return model.with_estimates(row, {"pay": F.lit(float(target))}).first()["pay"]


def yen(name):
    return [v * 1000 for v in C.WAGE_CURVES[name]]


SHORT = [3e6, 5e6, 6e6, *[6e6] * 7]


@pytest.mark.parametrize(
    "salary, age, target, curve, pay",
    [
        (10_000_000, 27, 32, SHORT, 12_000_000),
        (10_000_000, 32, 27, SHORT, 7_666_667),
        (3_000_000, 32, 27, [4e6, 5e6, 6e6, *[6e6] * 7], 2_500_000),
        (5_432_100, 35, 35, yen("製造業"), 5_432_100),
        (8_701_000, 40.7, 35, yen("金融業・保険業"), 7_553_491),
    ],
)
def test_estimate(spark, salary, age, target, curve, pay):
    assert estimate(spark, salary, age, target, curve) == pay


def test_estimate_over_all_ages(spark):
    row = spark.createDataFrame([(21_783_259.0, 35.0, yen("製造業"))], "avg_salary double, avg_age double, curve array<double>")
    got = [r["salary"] for r in bases(row).where("basis > 0").orderBy("basis").collect()]
    assert [math.floor(v / 10_000 + 0.5) for v in got] == [788, 1487, 2178, 2365, 2493, 2620, 2699, 2213]


def test_no_curve_no_estimate(spark):
    assert estimate(spark, 5_000_000, 30, 40, [0.0] * 10) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=30))
def test_half_up(spark, xs):
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(model.half_up(F.col("x")).alias("y")).collect()]
    assert got == [math.floor(x + 0.5) for x in xs]


def test_half_up_of_halves(spark):
    assert one(spark, model.half_up(F.lit(-2.5))) == -2
    assert one(spark, model.half_up(F.lit(2.5))) == 3


def test_deviation(spark):
    assert one(spark, model.deviation(F.lit(21_783_259.0), F.lit(6_291_889.0), F.lit(1_548_572.0))) == pytest.approx(150.03, abs=0.01)
    assert one(spark, model.deviation(F.lit(5.0), F.lit(1.0), F.lit(0.0))) == 50


def test_shares(spark):
    assert round(one(spark, model.top_percent(F.lit(120), F.lit(1867))), 1) == 6.4
    assert [one(spark, model.position_percent(F.lit(r), F.lit(n))) for r, n in ((1, 1867), (1867, 1867), (1, 1))] == [100, 0, 0]


@pytest.mark.parametrize(
    "salary, people, fixed", [(7_196.0, 100, 7_196_000), (719_600.0, 100, 7_196_000), (71_960_000.0, 100, 7_196_000), (71_960_000.0, 5, 71_960_000), (1.0, 100, None)]
)
def test_repair(spark, salary, people, fixed):
    assert one(spark, model.repaired_pay(F.lit(salary), F.lit(people))) == fixed


def test_industries(spark):
    assert [one(spark, model.industry_of(F.lit(s))) for s in (" 食料品 ", "銀行業", "水産・農林業", "?")] == ["製造業", "金融業・保険業", "産業計", "産業計"]


@pytest.mark.parametrize("raw, value", [("0", 0), ("", None), ("-", None), ("非公表", None), (" 20.3", 20.3), ("-16.8", -16.8), ("1e5", None)])
def test_number(spark, raw, value):
    assert one(spark, text.number(F.lit(raw))) == value


@pytest.mark.parametrize("rate, label", [(0.25, "＋25.0%"), (-0.142, "−14.2%"), (-0.0004, "±0.0%"), (0.0, "±0.0%")])
def test_rate_label(spark, rate, label):
    assert one(spark, text.rate_label(F.lit(rate))) == label


@pytest.mark.parametrize("a, b", [("株式会社　商船三井", "商船三井"), ("ｷｰｴﾝｽ", "キーエンス"), ("ＡＢＣ株式会社", "abc"), ("株式会社", ""), ("㈱ A B", "ab"), ("(有)A", "(有)a")])
def test_search_key(spark, a, b):
    assert one(spark, text.search_key(F.lit(a))) == one(spark, text.search_key(F.lit(b)))


def test_initials(spark):
    assert [one(spark, text.initial_of(F.lit(n))) for n in ("株式会社キーエンス", "㈱ あ", "株式会社", "Abc")] == ["キ", "あ", "株", "A"]


def test_units(spark):
    assert one(spark, text.years_and_months(F.lit("13年6ケ月"))) == 13.5
    assert one(spark, text.leading_number(F.lit("7,463,281円"))) == 7_463_281
    assert one(spark, text.fiscal_label(F.lit("2026-03"))) == "2026年3月期"
    assert one(spark, text.path_segment(F.lit("a b!銀"))) == "a%20b!%E9%8A%80"
    assert one(spark, text.plain_markup(F.lit("<a href=x>A &amp; B</a>  C"))) == "A & B C"
