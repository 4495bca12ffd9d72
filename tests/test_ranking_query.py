import re
import pytest
from pyspark.sql import functions as F

from payscope.operators.ranking import RankingQuery, canonical_path, competition_ranks, page_strip, positions, run_query
from payscope.plans.stand_ins import companies


def test_params():
    q = RankingQuery.from_params
    assert q({"age": "33"}).age is None
    assert q({"age": "35"}).age == 35
    assert (q({"sort": "age-zzz"}).sort, q({"sort": "age-asc"}).descending) == ("salary", False)
    assert q({"page": "0"}).page == 1
    assert q({"emp": "toString"}).employees is None
    assert q({"age": ["40", "25"]}).age == 40
    full = RankingQuery(40, "銀行業", "1000-", "-13", "40-43", "abc", "emp", False, 3)
    assert list(full.to_params()) == ["age", "ind", "emp", "ten", "aage", "q", "sort", "page"]
    assert q(full.to_params()) == full
    assert RankingQuery().to_params() == {"age": "35"}


def test_changes_go_back_to_page_one():
    q = RankingQuery(page=4)
    assert (q.with_(tenure="-13").page, q.with_(page=5).page, q.toggled("salary").descending, q.toggled("age").descending) == (1, 5, False, True)


def test_canonical():
    assert canonical_path(RankingQuery(industry="銀行業")).startswith("/industry/%E9")
    assert canonical_path(RankingQuery(employees="1000-")) == "/"
    assert canonical_path(RankingQuery(age=40, page=2), pages=3) == "/age/40?page=2"
    assert canonical_path(RankingQuery(age=40, page=9), pages=3) == "/age/40"


def test_page_strip():
    assert page_strip(5, 10) == [1, None, 4, 5, 6, None, 10]
    assert page_strip(1, 1) == [1]


def test_a_form_alone_matches_everybody(spark):
    rows = run_query(companies(spark, "/root/testdata/sf0.001"), RankingQuery(text="株式会社"))
    assert rows.first()["total"] == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()


def test_no_match_is_an_empty_page(spark):
    assert run_query(companies(spark, "/root/testdata/sf0.001"), RankingQuery(text="no such name")).count() == 0


@pytest.mark.parametrize("values", [[5, 5, 5], [3_000_000, 3_000_000, 1, 900_000_000, 900_000_001], []])
def test_ranks_against_counting(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "row_idx long, v long")
    got = {r["row_idx"]: (r["rank"], r["position"]) for r in positions(competition_ranks(rows, "v"), "v", ["row_idx"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    assert got == {i: (1 + sum(v > values[i] for v in values), order.index(i) + 1) for i in range(len(values))}


def test_plan_has_no_window_over_everything(spark):
    plan = companies(spark, "/root/testdata/sf0.001").transform(lambda df: positions(df.withColumn("v", F.col("avg_salary").cast("long")), "v", ["row_idx"]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # The one window without partitions is over the counts of cells.
    assert set(re.findall(r"windowspecdefinition\((\w+)#\w+ (?:ASC|DESC)", text)) == {"_cell"}
    assert text.count("windowspecdefinition(v#") == 2 and text.count("windowspecdefinition(") == 4


def test_positions_of_many_ties(spark):
    """A third of the rows share a value, ids reach over several stretches, and some values are far above the even cells."""
    rows = [(k * 1000, 5 if k % 3 == 0 else k * k * 10**7 if k % 3 == 1 else k % 4 * 10**5) for k in range(600)]
    got = {r["id"]: r["position"] for r in positions(spark.createDataFrame(rows, "id long, v long").repartition(4), "v", ["id"]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    named = [(f"n{k:03}", k % 5) for k in range(100)]
    got = {r["id"]: r["position"] for r in positions(spark.createDataFrame(named, "id string, v long"), "v", ["id"]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(named, key=lambda r: (-r[1], r[0])), 1)}
