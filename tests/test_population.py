import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from payscope.functions import model
from payscope.operators import company, export, pages, population, sentences, statistics
from payscope.operators.ranking import bases, with_pays
from payscope.operators.resolution import QualityError
from payscope.plans.stand_ins import companies
from payscope.sources import files
from payscope.sources.tables import stored


def test_company_id(spark):
    rows = spark.createDataFrame([("7203", "E1", "a"), ("", "E2", "b"), (None, "E3", "c")], "s string, e string, n string")
    ids = population.company_id(F.col("s"), F.col("e"), F.col("n"))
    assert [r[0] for r in rows.select(ids).collect()] == ["7203", "E2", "E3"]
    with pytest.raises(PySparkException, match="nobody has no code"):
        spark.createDataFrame([("", "", "nobody")], "s string, e string, n string").select(ids).collect()


def test_curve_sets(spark):
    table = lambda *keys: spark.createDataFrame([(k, [float(i)] * 10) for i, k in enumerate(keys)], "curve_key string, curve array<double>")
    tables = {"annual_industry": table("x"), "annual_large": table("y").limit(0), "monthly_industry": table("m"), "monthly_size": table("大企業", "中企業")}
    keys = lambda name: ([r["curve_key"] for r in population.curve_set(tables, name)[0].orderBy("curve_key").collect()], population.curve_set(tables, name)[1])
    assert keys("年収") == (["x"], True) and keys("no such set") == (["x"], True)
    assert keys("年収_大企業") == (["中企業", "大企業"], True) and keys("所定内") == (["m"], True) and keys("中企業") == (["中企業"], False)
    del tables["annual_industry"]
    assert keys("年収") == (["m"], True)


def test_curve_of_an_unknown_industry(spark):
    rows = spark.createDataFrame([("a",), ("none",), (None,)], "industry string")
    curves = lambda *keys: spark.createDataFrame([(k, [float(i)]) for i, k in enumerate(keys)], "curve_key string, curve array<double>")
    of = lambda c: {r["industry"]: r["curve"] for r in population.with_curve(rows, c).collect()}
    assert of(curves("z", "a", "産業計")) == {"a": [1.0], "none": [2.0], None: [2.0]}
    assert of(curves("z", "a")) == {"a": [1.0], "none": [1.0], None: [1.0]}


def test_first_existing(spark, tmp_path):
    (tmp_path / "b").write_text("x")
    assert population.first_existing(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]) == f"file://{tmp_path}/b"
    assert population.first_existing(spark, [f"file://{tmp_path}/a"]) is None


def test_backfill(spark):
    codes = spark.createDataFrame([("E1", "1111", "alpha", "x", " 77 "), ("E2", "", "beta", "x", ""), ("E3", "", "gamma", "", "9")], "code string, sec_code string, name_key string, listed string, corporate_number string")
    rows = spark.createDataFrame([(1, "1111", "Alpha", "alpha", "x"), (2, "", "Gamma", "gamma", "")], "row_idx int, sec_code string, name string, name_key string, listed string")
    out = population.backfilled_codes(rows, codes)
    assert [(r["row_idx"], r["edinet_code"]) for r in out.orderBy("row_idx").collect()] == [(1, "E1"), (2, "E3")]
    assert [r["corporate_number"] for r in population.backfilled_numbers(out, codes).orderBy("row_idx").collect()] == ["77", "9"]
    with pytest.raises(QualityError, match="Delta"):
        population.backfilled_codes(rows.unionByName(spark.createDataFrame([(3, "", "Delta", "delta", "")], rows.schema)), codes)
    with pytest.raises(QualityError, match="Beta"):
        population.backfilled_numbers(spark.createDataFrame([("Beta", "E2")], "name string, edinet_code string"), codes)


def test_unlisted_reports(spark):
    rows = [("2024-06-01", "S1", "E1", None, "120", "0"), ("2024-06-02", "S2", "E1", "", "120", "0"), ("2024-06-03", "S3", "E1", None, "120", "1"), ("2024-06-03", "S4", "E1", "1234", "120", "0"), ("2024-06-03", "S5", "E2", None, "120", None), ("2024-06-04", "S6", "E1", None, "130", "0")]
    lists = spark.createDataFrame(rows, "day string, doc_id string, code string, sec_code string, doc_type string, withdrawn string")
    codes = spark.createDataFrame([("E1", population.DOMESTIC), ("E2", "other")], "code string, kind string")
    assert [r["doc_id"] for r in population.unlisted_reports(lists, codes).collect()] == ["S2"]


def test_exports_in_order_with_mark(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 1.5, "x"), (None, "c", None, "x"), (1, "a", 2.0, "x")], "rank_adj int, name string, factor double, more string")
    assert population.unified_export(rows).columns == list(population.UNIFIED_COLUMNS) and len(population.VALIDATION_COLUMNS) == 23
    assert [r["name"] for r in population.validation_export(rows).collect()] == ["a", "b", "c"]
    export.write_csv(population.validation_export(rows).select("name", "factor", "rank_adj"), str(tmp_path / "v"), byte_order_mark=True)
    (written,) = (tmp_path / "v").glob("*.csv")
    assert written.read_bytes().startswith("﻿name,factor,rank_adj\na,2.0,1\n".encode())
    back = files.untyped_csv(spark, str(tmp_path / "v"), ["factor"]).collect()
    assert [(r["name"], r["factor"], r["rank_adj"]) for r in back] == [("a", 2.0, "1"), ("b", 1.5, "2"), ("c", None, "")]


def test_counted_pairs(spark):
    units = "array<struct<unit: string, value: double>>"
    schema = ", ".join(["id int", *(f"{c} {'string' if c in export.ROW_TEXTS else 'double'}" for c in export.ROW_FIELDS), f"overtime_units {units}", f"leave_units {units}"])
    given = {"overtime_all": 1.5, "overtime_scope": " all ", "as_of": "2024"}
    row = lambda i, a, b, **more: (i, *((given | more).get(c) for c in export.ROW_FIELDS), a, b)
    rows = spark.createDataFrame([row(1, [("x", 3.0), ("", 4.0)], []), row(2, [], [("all", None)], overtime_scope="", as_of="x")], schema)
    pool = export.row_pool(rows, "id")
    assert [r["value"] for r in pool.orderBy("index").collect()] == ["all", "2024", "x"]
    cells = {r["id"]: r["cells"] for r in export.encoded_rows(rows, pool).collect()}
    assert cells[1] == [1.5, 0, None, None, None, None, -1, 1, -1, 2, 2, 3.0, -1, 4.0, 0]
    assert cells[2] == [1.5, -1, None, None, None, None, -1, 2, -1, 0, 1, 0, None]
    back = {r["id"]: r for r in export.decoded_rows(export.encoded_rows(rows, pool), pool).collect()}
    assert [tuple(u) for u in back[1]["overtime_units"]] == [("x", 3.0), ("", 4.0)] and back[1]["leave_units"] == [] and [tuple(u) for u in back[2]["leave_units"]] == [("all", None)]


def test_pool_is_joined_and_not_held_whole(spark):
    units = F.array().cast("array<struct<unit: string, value: double>>")
    rows = spark.range(70_000, numPartitions=4).select("id", *((F.concat(F.lit("t"), F.col("id") % 69_000) if c == "as_of" else F.lit(None).cast("string" if c in export.ROW_TEXTS else "double")).alias(c) for c in export.ROW_FIELDS), *(units.alias(c) for c in export.ROW_UNITS))
    pool = stored(export.row_pool(rows, "id"), "pool")
    back = export.decoded_rows(export.encoded_rows(rows, pool), pool)
    assert "NestedLoopJoin" not in back._jdf.queryExecution().executedPlan().toString()
    assert pool.where("value <> concat('t', index)").count() == 0 and pool.count() == 69_000
    assert back.where("as_of <> concat('t', id % 69000) OR gap_period <> ''").count() == 0 and back.count() == 70_000


def test_bundle(spark, tmp_path):
    rows = spark.range(3)
    assert set(export.write_bundle({"a": (rows, 100)}, str(tmp_path))) == {"a"}
    assert json.loads(spark.read.text(str(tmp_path / "a.json")).first()[0]) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(QualityError):
        export.write_bundle({"b": (spark.range(200_000).selectExpr("uuid() AS u"), 100)}, str(tmp_path))
    assert not (tmp_path / "b.json").exists()


def test_logo_index(spark):
    index = spark.createDataFrame([("1", 10, 10, "s", "icon"), ("2", 5, 5, "s", "icon")], "id string, w int, h int, src string, source string")
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    images = spark.createDataFrame([("1", 100), ("2", 200)], "id string, bytes long")
    assert population.check_logos(index, ids, images, partial=True).count() == 2
    faults = [
        ("too few", (index, ids, images, False)), ("unknown", (index, ids.limit(1), images, True)), ("no image", (index, ids, images.limit(1), True)), ("too large", (index, ids, images.withColumn("bytes", F.lit(30_000).cast("long")), True)),
        ("incomplete", (index.withColumn("w", F.lit(0)), ids, images, True)),
    ]
    for words, (a, b, c, partial) in faults:
        with pytest.raises(QualityError, match=words):
            population.check_logos(a, b, c, partial)


def test_manifests(spark):
    page = '<link rel="icon" href="/i.png"><link rel="Manifest" href="/app/site.webmanifest"><link rel=manifest href=/second>'
    got = pages.manifest_links(spark.createDataFrame([(1, "https://a.example/x", page), (2, "https://a.example", "<p>"), (3, "https://a.example", None)], "page_id int, url string, html string"))
    assert [tuple(r) for r in got.collect()] == [(1, "https://a.example/app/site.webmanifest")]
    body = '{"icons": [{"src": "i/192.png", "sizes": "192x192 48x48"}, {"sizes": "1x1"}, {"src": "https://b.example/s.svg"}]}'
    icons = pages.manifest_icons(spark.createDataFrame([(1, "https://a.example/app/m", body), (2, "https://a.example/m", "no json"), (3, "https://a.example/m", '{"icons": 5}')], "page_id int, manifest string, body string"))
    assert sorted((r["page_id"], r["url"], r["width"]) for r in icons.collect()) == [(1, "https://a.example/app/i/192.png", 192), (1, "https://b.example/s.svg", None)]


def test_sources_of_sites_and_images(spark, tmp_path):
    companies = spark.createDataFrame([("1",), ("2",), ("3",)], "corporate_number string")
    known = spark.createDataFrame([("1", "https://x"), ("2", "")], "corporate_number string, site string")
    assert sorted(r[0] for r in population.missing_sites(companies, known).collect()) == ["2", "3"]
    info = "array<struct<url: string, width: int, height: int, extmetadata: struct<LicenseShortName: struct<value: string>, Artist: struct<value: string>>>>"
    landed = spark.createDataFrame([("a", [("u", 3, 4, (("CC BY 4.0",), ("<a href=x>Ann &amp; Bo</a>",)))]), ("b", [("v", 1, 1, (("CC0",), None))]), ("c", None)], f"title string, imageinfo {info}")
    assert sorted((r["title"], r["author"], r["attribution"]) for r in population.credited_images(landed).collect()) == [("a", "Ann & Bo", True), ("b", None, False)]
    with pytest.raises(QualityError, match="no ZIP"):
        files.only_zip(spark, str(tmp_path))
    (tmp_path / "a.zip").write_bytes(b"PK")
    assert files.only_zip(spark, str(tmp_path)).endswith("a.zip")
    (tmp_path / "b.zip").write_bytes(b"PK")
    with pytest.raises(QualityError, match="more than one"):
        files.only_zip(spark, str(tmp_path))


def test_small_columns(spark):
    rows = spark.createDataFrame([(6_000_000, 5_000_000.0), (None, 5.0), (0, 5.0)], "a long, b double")
    assert [r[0] for r in rows.select(population.pay_factor(F.col("a"), F.col("b"))).collect()] == [1.2, None, None]
    assert [r[0] for r in spark.range(1).select(model.mean_marker(F.lit(50), F.lit(200))).collect()] == [25.0]
    with pytest.raises(QualityError):
        population.find_by_name(spark.createDataFrame([("x", 1)], "name string, row_idx int"), "y")


@pytest.mark.parametrize("same", [True, False])
def test_swapped_pairs_as_sets(same):
    rng = np.random.default_rng(3)
    x, y = (np.column_stack([rng.permutation(150) + at, *rng.integers(0, 6, (3, 150))]).astype(float) for at in (0, 75.5))
    x[::17, 2] = np.nan
    y = x if same else y
    pairs = swapped = 0
    for a in x:
        for b in y:
            if a[0] < b[0] or not same:
                above = [p > q if a[0] < b[0] else q > p for p, q in zip(a[1:], b[1:], strict=True)]
                pairs, swapped = pairs + 1, swapped + (len(set(above)) > 1)
    assert statistics._swapped(x, y, same, step=64) == (pairs, swapped)


def test_curve_summaries_without_a_shuffle_of_bases(spark):
    rows = companies(spark, "/root/testdata/sf0.001")
    each = sentences.curve_sentences(with_pays(rows))
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()
    unfolded = sentences.curve_summary(bases(rows))
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, unfolded.collect()))


def test_neighbours_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(company, "CHUNK", 8)
    rows = spark.range(100).select("id", F.col("id").alias("row_idx"), F.lit(0).alias("basis"), F.lit(1).alias("tse33"), (F.pmod(F.xxhash64("id"), F.lit(60)) * 1000).alias("salary"))
    found = company.neighbours(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "_chunk" in plan
    own = [(r.id, r.salary) for r in rows.collect()]
    want = sorted((a, b) for a, s in own for b, _ in sorted(((b, t) for b, t in own if b != a), key=lambda x, s=s: (abs(x[1] - s), -x[1], x[0]))[:5])
    assert sorted((r.id, r.neighbour_id) for r in found.collect()) == want
