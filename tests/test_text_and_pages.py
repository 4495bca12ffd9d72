import pytest
from pyspark.sql import functions as F

from payscope.functions import html
from payscope.functions.employee_block import employee_block, parse_block
from payscope.operators.pages import chosen_logo, ordered_candidates, page_candidates, with_commons
from payscope.plans.text import employee_blocks

HEAD = "従業員数（人）平均年齢平均勤続年数平均年間給与（円）"


@pytest.mark.parametrize(
    "text, expected, figures",
    [
        (HEAD + "261(440)40.6歳13年6ケ月7,463,281", 261, (261, 40.6, 13.5, 7_463_281)),
        ("従業員数 平均年齢 平均勤続年数 平均年間給与 158(78)人 40才3ヵ月 15年0ヵ月 5,795千円", None, (158, 40.2, 15.0, 5_795_000)),
        ("従業員数平均年齢平均勤続年数平均年間給与 28,030人 41歳 2月 17年 6月 9,338千円", None, (28_030, 41.2, 17.5, 9_338_000)),
        ("従業員数（人）平均年齢（歳）平均勤続年数（年）平均年間給与（千円） 46 39.3 2.4 6,469", 46, (46, 39.3, 2.4, 6_469_000)),
        ("従業員数（人）平均年齢（歳）平均勤続年数（年）平均年間給与（千円） 4639.32.46,469", 46, (46, 39.3, 2.4, 6_469_000)),
    ],
)
def test_block(text, expected, figures):
    got = parse_block(text, expected)
    assert (got["employees"], got["avg_age"], got["avg_tenure"], got["avg_salary"]) == pytest.approx(figures, abs=0.06)


@pytest.mark.parametrize("values, expected, right", [("2,12136.112.418,617,851", 2121, 18_617_851), ("4,179(4,046)34.09.924,320,256", 4179, 4_320_256)])
def test_ambiguous_block_lists_candidates(values, expected, right):
    got = parse_block(HEAD + values, expected)
    assert right in got["candidates"] and len(got["candidates"]) == 2


@pytest.mark.parametrize("text", ["", None, "平均年間給与", HEAD, "no table here", HEAD + "10 99.9 5.0 7,000,000"])
def test_no_block(text):
    assert parse_block(text) is None


def test_block_udf(spark):
    df = spark.createDataFrame([(HEAD + "261(440)40.6歳13年6ケ月7,463,281", 261.0), (None, None)], "t string, e double")
    got = [r["b"] for r in df.select(employee_block("t", "e").alias("b")).collect()]
    assert got[0]["avg_salary"] == 7_463_281 and got[1]["avg_salary"] is None


PAGE = """<html><head><link rel="icon" sizes="16x16 180x180 32x32" href="/i.png"><link rel='apple-touch-icon' href=touch.png>
<script type="application/ld+json">{"@graph": [{"@type": "Organization", "logo": {"url": "https://cdn.example.com/l.svg"}}]}</script>
<script type="application/ld+json">not json</script></head>
<body><header><img class="site-Logo" src="../logo.png?a=1&amp;b=2"><img src="banner.png"></header><img class="logo" src="other.png"></body></html>"""


def test_candidates(spark):
    pages = spark.createDataFrame([(1, "https://example.com/a/b/index.html", PAGE), (2, "https://example.org", None)], "page_id long, url string, html string")
    got = ordered_candidates(page_candidates(pages)).orderBy("page_id", "place").collect()
    one = [(r["source"], r["url"]) for r in got if r["page_id"] == 1]
    assert one[0] == ("jsonld", "https://cdn.example.com/l.svg")
    assert one[1] == ("header", "https://example.com/a/logo.png?a=1&b=2")
    assert ("icon", "https://example.com/i.png") in one and ("icon", "https://example.com/a/b/touch.png") in one
    assert [r["width"] for r in got if r["url"] == "https://example.com/i.png"] == [180]
    assert all("other.png" not in u and "banner" not in u for _, u in one)
    assert len([r for r in got if r["page_id"] == 2]) == 2


def test_choice(spark):
    rows = spark.createDataFrame([(1, k, f"https://e.com/{k}", "icon", k) for k in range(1, 9)], "page_id long, seq int, url string, source string, place int")
    assert chosen_logo(rows, F.col("place") >= 3).first()["url"] == "https://e.com/3"
    assert chosen_logo(rows, F.col("place") >= 7).count() == 0


def test_markup_functions(spark):
    row = spark.range(1).select(
        html.largest_size(F.lit("16x16 180x180 any 32x32"))["width"].alias("w"), html.largest_size(F.lit("any")).alias("none"),
        html.origin_of(F.lit("HTTPS://Example.com/a?b#c")).alias("o"), html.origin_of(F.lit("data:x")).alias("d"), html.title_of(F.lit("<title> a\n b </title>")).alias("t"),
    ).first()
    assert (row["w"], row["none"], row["o"], row["d"], row["t"]) == (180, None, "https://example.com", None, "a b")


def test_labels(spark):
    from payscope.functions import text as t

    row = spark.range(1).select(
        t.top_label(F.lit(0.054)).alias("a"), t.top_label(F.lit(6.43)).alias("b"), t.difference_label(F.lit(-15_000)).alias("c"), t.to_fixed(F.lit(1.45)).alias("d"), t.to_fixed(F.lit(0.25)).alias("e"),
        *(t.bin_tick(F.lit(5_000_000), F.lit(1_000_000), F.lit(k)).alias(f"t{k}") for k in (0, 1, 8)), t.bin_label(F.lit(5_000_000), F.lit(1_000_000), F.lit(1)).alias("l"),
    ).first()
    assert tuple(row) == ("上位0.1%未満", "上位6.4%", "−2万円", "1.4", "0.3", "〜600", "600", "1,300+", "600〜700万円")


def test_nice_ticks():
    from payscope.functions.text import nice_ticks

    assert nice_ticks(4_220_000, 34_480_000) == [10_000_000, 20_000_000, 30_000_000]
    assert nice_ticks(1, 1) == nice_ticks(2, 1) == []


def test_image_headers(spark):
    import struct

    from payscope.functions.images import header_of, image_header

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 30)
    ico = b"\0\0\1\0\2\0" + bytes([16, 16]) + bytes(14) + bytes([0, 0]) + bytes(14)
    assert header_of(png) == ("png", 40, 30) and header_of(ico) == ("ico", 256, 256) and header_of(b"<?xml?><SVG>") == ("svg", None, None)
    rows = spark.createDataFrame([(png,), (None,), (b"x",)], "b binary").select(image_header("b").alias("h")).collect()
    assert [r["h"]["width"] for r in rows] == [40, None, None]


def test_free_images_come_first(spark):
    candidates = spark.createDataFrame([(1, 0, "header", "https://a.example/l.png", 9, 9), (2, 0, "icon", "https://b.example/i.png", None, None)], "page_id int, seq int, source string, url string, width int, height int")
    titles = spark.createDataFrame([(1, "File:B.svg"), (1, "File:A.svg"), (2, "File:None.svg"), (3, "File:C.svg")], "page_id int, title string")
    images = spark.createDataFrame([("File:A.svg", "https://c.example/a.svg", 300, 100), ("File:B.svg", "https://c.example/b.svg", 1, 1), ("File:C.svg", "https://c.example/c.svg", 2, 2), ("File:None.svg", None, 1, 1)], "title string, url string, width long, height long")
    ordered = ordered_candidates(with_commons(candidates, titles, images))
    assert sorted((r["page_id"], r["place"], r["source"], r["url"]) for r in ordered.collect()) == [
        (1, 1, "commons", "https://c.example/a.svg"), (1, 2, "header", "https://a.example/l.png"), (2, 1, "icon", "https://b.example/i.png"), (3, 1, "commons", "https://c.example/c.svg")
    ]


def test_blocks_of_a_small_file_are_dealt_over_tasks(spark):
    assert employee_blocks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


@pytest.mark.parametrize(("people", "expected", "got"), [("1,234", 1234.0, 1234.0), ("1234", 1234.0, 1234.0), ("1,234人[56]名", 1234.0, 1234.0), ("12341.5", 1234.0, None)])
def test_known_number_of_employees(people, expected, got):
    found = parse_block(f"従業員数 平均年齢 平均勤続年数 平均年間給与 {people} 41.5 12.5 6,543,210", expected)
    assert (found or {}).get("employees") == got
