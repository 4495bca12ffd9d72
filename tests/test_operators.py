import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from payscope.operators import export, history, resolution, sentences, statistics


def yearly(spark, *values):
    rows = [("a", 2017 + k, v) for k, v in enumerate(values)]
    return spark.createDataFrame([*rows, *(("b", 2017 + k, 1) for k in range(len(values)))], "code string, year int, value long")


def changes(spark, *values):
    dense = history.dense_years(yearly(spark, *values).where("value IS NOT NULL"))
    return [(r["yoy"], r["cumulative"]) for r in history.changes(dense).where("code = 'a'").orderBy("year").collect()]


def test_changes(spark):
    got = changes(spark, 1_000_000, 1_250_000, 1_100_000)
    assert got == [(None, None), (0.25, 0.25), (-0.12, 0.1)]


def test_changes_over_a_gap(spark):
    assert changes(spark, None, 5_000_000, 6_000_000) == [(None, None), (None, None), (0.2, 0.2)]
    assert changes(spark, 5, None, 6)[2] == (None, 0.2)


def test_summary_and_peak(spark):
    rows = yearly(spark, None, 5_000_000, 6_000_000).where("value IS NOT NULL")
    assert "1年で ＋100万円" in sentences.history_summary(rows).where("code = 'a'").first()["summary"]
    assert history.peak_year(rows).where("code = 'a'").count() == 0
    assert history.peak_year(yearly(spark, 7, 9, 9, 8)).where("code = 'a'").first()["peak_year"] == 2018


def test_majority(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "p string")
    assert statistics.majority(rows("x", "x", "y"), "p").first()["p"] == "x"
    with pytest.raises(PySparkException, match="majority"):
        statistics.majority(rows("x", "y", "z"), "p").collect()


@pytest.mark.parametrize("values, median", [([1, 2, 3, 4], 3), ([5], 5), ([2, 2, 9], 2)])
def test_nearest_rank(spark, values, median):
    rows = spark.createDataFrame([(0, v) for v in values], "basis int, salary long")
    assert statistics.nearest_rank(rows, {"m": 0.5}).first()["m"] == median


def test_swapped_pairs_in_blocks(spark):
    rows = [(0, i, (i * 37) % 101, (i * 53) % 97, (i * 11) % 89) for i in range(1300)]
    got = statistics.swapped_pairs(spark.createDataFrame(rows, "g int, i int, a int, b int, c int"), ["a", "b", "c"], "g", "i").first()
    pairs = [(x, y) for k, x in enumerate(rows) for y in rows[k + 1 :]]
    swapped = sum(any((x[j] > y[j]) != (x[2] > y[2]) for j in (3, 4)) for x, y in pairs)
    assert (got["pairs"], got["swapped"]) == (len(pairs), swapped)


def test_newest_wins_first_of_ties(spark):
    rows = spark.createDataFrame([("k", "2024-01", 1, "a"), ("k", "2025-01", 2, "b"), ("k", "2025-01", 3, "c")], "key string, updated string, seq int, v string")
    assert resolution.newest(rows, "key", "updated", "seq").first()["v"] == "b"


def test_two_phases(spark):
    codes = spark.createDataFrame(
        [("E1", "1111", "alpha", True), ("E2", "2222", "beta", True), ("E3", "", "beta", False), ("E4", "", "gamma", False), ("E5", "", "gamma", False), ("E6", "6666", "delta", False), ("E7", "", "delta", False)],
        "code string, sec_code string, name_key string, listed boolean",
    )
    rows = spark.createDataFrame(
        [(1, "1111", "other", True), (2, "", "beta", False), (3, "9999", "alpha", True), (4, "", "gamma", False), (5, "6666", "delta", False), (6, "", "delta", True), (7, None, "none", True)],
        "row_idx int, sec_code string, name_key string, listed boolean",
    )
    got = {r["row_idx"]: (r["code"], r["phase"]) for r in resolution.two_phase(rows, codes).collect()}
    assert got == {1: ("E1", 1), 2: ("E3", 2), 3: ("E1", 2), 4: (None, 0), 5: ("E6", 1), 6: ("E7", 2), 7: (None, 0)}


def walked(rows, codes):
    """Both phases plainly, row by row."""
    used, out, pending = set(), {}, []
    for idx, sec, name, listed in rows:
        found = [c for c, s, _, _ in codes if sec and s == sec]
        if len(found) == 1:
            out[idx] = (found[0], 1)
            used.add(found[0])
        else:
            pending.append((idx, name, listed))
    for idx, name, listed in pending:
        found = [(c, own) for c, _, n, own in codes if n == name]
        alike = [x for x in found if x[1] == listed]
        found = alike if len(found) > 1 and len(alike) == 1 else found
        free = [x for x in found if x[0] not in used]
        found = free if len(found) > 1 and len(free) == 1 else found
        out[idx] = (found[0][0], 2) if len(found) == 1 else (None, 0)
        used |= {out[idx][0]} - {None}
    return out


def test_two_phases_row_by_row(spark):
    import random

    rng = random.Random(12)
    pick = lambda n: rng.choice([None, *map(str, range(n))])
    codes = [(f"E{k:03}", pick(150) or "", pick(45), pick(3)) for k in range(200)]
    rows = [(k, pick(150), pick(45), pick(3)) for k in range(400)]
    want = walked(rows, codes)
    assert {phase for _, phase in want.values()} == {0, 1, 2}
    got = resolution.two_phase(spark.createDataFrame(rows, "row_idx int, sec_code string, name_key string, listed string"), spark.createDataFrame(codes, "code string, sec_code string, name_key string, listed string"))
    assert {r["row_idx"]: (r["code"], r["phase"]) for r in got.collect()} == want


def test_quality(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    for check in (lambda: resolution.expect_unique(rows, "id"), lambda: resolution.expect_rows(rows, 2), lambda: resolution.expect_matched(rows, rows.where("id = 1"), "id"), lambda: export.check_size("x" * 9, 0)):
        with pytest.raises(resolution.QualityError):
            check()


def test_mask_round_trip(spark):
    rows = spark.range(0, 9000).select(F.col("id").cast("long").alias("id"))
    present = spark.createDataFrame([(3,), (4095,), (4096,), (8999,)], "id long")
    masks = export.presence_mask(rows, present, "id", "id")
    assert sorted(r["place"] for r in export.present_rows(masks).collect()) == [3, 4095, 4096, 8999]


def test_pool(spark):
    rows = spark.createDataFrame([(1, " x"), (2, ""), (3, "y"), (4, "x"), (5, None)], "n int, v string")
    assert [r["v_index"] for r in export.pooled(rows, "v", "n").orderBy("n").collect()] == [0, -1, 1, 0, -1]


def test_candidates_by_logarithm(spark):
    rows = [("a", 2020, 8_000_000.0, "tag", None), ("a", 2021, 18_617_851.0, "textblock", [18_617_851.0, 8_617_851.0]), ("b", 2021, 5.0, "textblock", [5.0, 6.0])]
    df = spark.createDataFrame(rows, "code string, year int, value double, source string, candidates array<double>")
    got = {(r["code"], r["year"]): (r["resolved"], r["swapped"]) for r in history.resolved(df).collect()}
    assert got == {("a", 2020): (8_000_000.0, False), ("a", 2021): (8_617_851.0, True), ("b", 2021): (5.0, False)}


def test_sectors_in_japanese_order(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(["銀行業", "化学", "サービス業", "ガス業", "医薬品"])], "id int, tse33 string")
    full = rows.selectExpr("id", "'n' AS name", "tse33", "'k' AS curve_key", "1.0 AS avg_age", "1.0 AS avg_tenure", "1.0 AS avg_salary", "1 AS employees")
    got = export.company_tuples(full, ["k"]).collect()
    # Kana before kanji, kanji by their readings as the collation has them.
    assert [r["sector"] for r in sorted(got, key=lambda r: r["sector"])] == [0, 1, 2, 3, 4]
    assert {r["id"]: r["sector"] for r in got}[3] < {r["id"]: r["sector"] for r in got}[2] < min(r["sector"] for r in got if r["id"] in (0, 1, 4))
