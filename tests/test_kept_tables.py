"""Tables that are kept up to date: the served ranking and the history by year and code, with what their readers read."""

import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from payscope.operators import served
from payscope.operators.history import changes
from payscope.sources import yearly

KIND = "basis int, id string, row_idx long, name string, salary long"


def companies(seed, n=300):
    rng = random.Random(seed)
    pay = lambda: rng.choice([rng.randrange(1, 9) * 1_000_000, rng.randrange(2_000_000, 90_000_000), 5_000_000, 10**12])
    return {(basis, f"c{k}"): (basis, f"c{k}", k, f"name {k}", pay()) for k in range(n) for basis in (0, 35)}


def order(rows, basis):
    return sorted((r for r in rows.values() if r[0] == basis), key=lambda r: (-r[4], r[2]))


def shown(spark, folder, version, basis, number, size):
    rows = served.page(spark, folder, version, basis, number, size).orderBy("position").collect()
    return [(r.basis, r.id, r.row_idx, r.name, r.salary) for r in rows], [r.position for r in rows], {(r.total, r.page) for r in rows}


def test_pages_and_merges(spark, tmp_path):
    rows, folder = companies(1), str(tmp_path / "s")
    version, history = served.build(spark.createDataFrame(list(rows.values()), KIND), folder), {1: dict(rows)}
    for step in range(2):
        more = {k: v for k, v in companies(10 + step, 330).items() if int(k[1][1:]) % 7 == step or int(k[1][1:]) >= 300 + 20 * step}
        gone = [f"c{k}" for k in range(step, 300, 41)]
        version = served.merge(spark, folder, version, spark.createDataFrame(list(more.values()), KIND), spark.createDataFrame([(g,) for g in gone], "id string"))
        rows = {k: v for k, v in (rows | more).items() if k[1] not in gone}
        history[version] = dict(rows)
    for v, state in history.items():  # an older version stays what it was
        for basis in (0, 35):
            want = order(state, basis)
            for number in (1, 2, 9):
                got, places, seen = shown(spark, folder, v, basis, number, 40)
                page = min(number, -(-len(want) // 40))
                assert got == want[(page - 1) * 40 : page * 40] and places == list(range((page - 1) * 40 + 1, (page - 1) * 40 + len(got) + 1)) and seen == {(len(want), page)}
    ids = spark.createDataFrame([("c5",), ("c5",), ("c17",), ("none",)], "id string")
    got = {(r.basis, r.id): (r["rank"], r.total) for r in served.standing(spark, folder, version, ids).collect()}
    assert got == {(b, i): (1 + sum(r[4] > rows[b, i][4] for r in order(rows, b)), len(order(rows, b))) for b in (0, 35) for i in ("c5", "c17") if (b, i) in rows}


def test_a_page_reads_its_shelves_only(spark, tmp_path):
    rows, folder = companies(2, 2000), str(tmp_path / "s")
    version = served.build(spark.createDataFrame(list(rows.values()), KIND), folder)
    shelves = served.index(spark, folder, version).where("basis = 35").count()
    read = served.page(spark, folder, version, 35, 30, 10)
    files = {f.rsplit("/", 2)[1] for f in read.inputFiles()}
    assert all("/basis=35/" in f for f in read.inputFiles()) and 1 <= len(files) <= 2 < shelves


def test_no_rows(spark, tmp_path):
    folder = str(tmp_path / "s")
    version = served.build(spark.createDataFrame([(0, "a", 1, "n", 5)], KIND), folder)
    version = served.merge(spark, folder, version, spark.createDataFrame([], KIND), spark.createDataFrame([("a",)], "id string"))
    assert served.page(spark, folder, version, 0, 3).collect() == [] and served.index(spark, folder, version).count() == 0
    version = served.merge(spark, folder, version, spark.createDataFrame([(0, "b", 1, "n", 7)], KIND))
    assert [(r.id, r.position) for r in served.page(spark, folder, version, 0, 1).collect()] == [("b", 1)]


@pytest.fixture
def table(spark, tmp_path):
    rows = [(code, year, 10 * code + year, 100 * code + year % 7, "tag") for code in range(40) for year in range(2015, 2023) if (code + year) % 5]
    df = spark.createDataFrame(rows, "code long, year int, doc_id long, value long, source string").select("code", "doc_id", "value", "source", "year")
    name = f"yearly_{abs(hash(str(tmp_path)))}"
    yearly.create(df, name, str(tmp_path / "y"), 4)
    yield name, df, str(tmp_path / "y")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_history_needs_no_exchange_on_code(spark, table):
    name, df, _ = table
    for out in (changes(yearly.dense(spark.table(name), [2017, 2018, 2019])), spark.table(name).groupBy("code").agg(F.max("value"))):
        plan = executed(out)
        assert not re.search(r"Exchange hashpartitioning\(code", plan) and "Bucketed: true" in plan
    plain = changes(yearly.dense(df, [2017, 2018, 2019]))
    bucketed = changes(yearly.dense(spark.table(name), [2017, 2018, 2019]))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, bucketed.collect()), key=repr)


def test_only_wanted_years_are_read(spark, table):
    name, df, path = table
    for year in (2015, 2016, 2022):  # reading them would fail
        for part in pathlib.Path(path, f"year={year}").glob("*.parquet"):
            part.write_bytes(b"broken")
    wanted = spark.createDataFrame([(2018,), (2020,)], "year int")
    got = spark.table(name).join(F.broadcast(wanted.where("year > 2000")), "year").groupBy("code").agg(F.count("*").alias("n"))
    assert "dynamicpruning" in executed(got)
    assert {r.code: r.n for r in got.collect()} == {r.code: r.n for r in df.where("year IN (2018, 2020)").groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert spark.table(name).where("year BETWEEN 2017 AND 2021").count() == df.where("year BETWEEN 2017 AND 2021").count()


def test_arriving_years_replace_theirs(spark, table):
    name, df, path = table
    arrived = spark.createDataFrame([(1, 2018, 5, 7, "late"), (1, 2019, 10**6, 8, "new"), (99, 2030, 1, 9, "new")], "code long, year int, doc_id long, value long, source string")
    yearly.merge(spark, name, arrived, 4)
    rows = {(r.code, r.year): (r.doc_id, r.value, r.source) for r in df.collect()}
    rows |= {(1, 2019): (10**6, 8, "new"), (99, 2030): (1, 9, "new")}
    assert {(r.code, r.year): (r.doc_id, r.value, r.source) for r in spark.table(name).collect()} == rows  # doc_id 5 is older than what was there
    assert "Bucketed: true" in executed(spark.table(name).groupBy("code").agg(F.max("value")))
    other = f"{name}_again"
    try:
        again = yearly.attach(spark, other, path, spark.table(name).schema, 4)
        assert again.count() == len(rows) and "Bucketed: true" in executed(again.groupBy("code").agg(F.max("value")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {other}")
