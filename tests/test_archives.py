"""The archive source opens what is wanted and nothing else."""

import zipfile

import pytest
from pyspark.sql import datasource as source
from pyspark.sql import functions as F

from payscope.plans import filers
from payscope.sources import archives


def landed(root, years=(2020, 2021, 2022), filers=12, broken=()):
    """An archive for each filer and year, and rows (doc_id, year) of them; ``broken`` ones can't be read."""
    root.mkdir(exist_ok=True)
    rows = []
    for year in years:
        for k in range(filers):
            doc = f"S{year}{k:02}"
            rows.append((doc, year))
            body = "\n".join(["header", "short\tline", f"a:Pay\tx\tNow{'\t' * 6}\"{year + k}\"", f"a:Nothing\tx\tNow{'\t' * 6}\"－\"", f"a:Age\tx\tThen{'\t' * 6}{k}"])
            if doc in broken or year in broken:
                (root / f"{doc}.zip").write_bytes(b"PK broken")
            else:
                with zipfile.ZipFile(root / f"{doc}.zip", "w") as z:
                    z.writestr("f/a.csv", body.encode("utf-16"))
                    z.writestr("f/readme.txt", "no facts")
    return rows


def test_only_wanted_archives_are_opened(spark, tmp_path):
    rows = landed(tmp_path / "zips", broken={2020, "S202105"})
    (tmp_path / "zips" / "S202107.zip").write_bytes(b"too many requests")
    (tmp_path / "zips" / "S202108.zip").unlink()
    targets = spark.createDataFrame([r for r in rows if r[0] != "S202105"] + [("S202101", 2021), (None, 2021)], "doc_id string, year int").withColumn("path", F.lit("clash"))
    index = archives.wanted_index(targets, str(tmp_path / "zips"))
    facts = archives.archive_facts(spark, index).where("year >= 2021")
    got = sorted((r.doc_id, r.year, r.seq, r.element, r.context, r.value) for r in facts.collect())
    want = []
    for doc, year in rows:
        if year >= 2021 and doc not in ("S202105", "S202107", "S202108"):
            want += [(doc, year, 0, "a:Pay", "Now", str(year + int(doc[-2:]))), (doc, year, 1, "a:Age", "Then", str(int(doc[-2:])))]
    assert got == sorted(want)
    with pytest.raises(Exception, match="(?i)zip"):  # without the filter the broken ones are opened
        archives.archive_facts(spark, index).collect()


@pytest.mark.parametrize(
    "condition, wanted",
    [
        ("doc_id = 'S202103'", {"S202103"}),
        ("doc_id IN ('S202003', 'S202204', 'none')", {"S202003", "S202204"}),
        ("year = 2022 AND element = 'a:Pay'", {f"S2022{k:02}" for k in range(12)}),
        ("year < 2021 AND doc_id > 'S202009'", {"S202010", "S202011"}),
        ("year = 2020 OR doc_id = 'S202101'", None),
    ],
)
def test_opened_archives_are_counted(spark, tmp_path, monkeypatch, condition, wanted):
    monkeypatch.setattr(archives, "ARCHIVES_PER_TASK", 5)
    rows = landed(tmp_path / "zips")
    index = archives.wanted_index(spark.createDataFrame(rows, "doc_id string, year int"), str(tmp_path / "zips"))
    got = {r.doc_id for r in archives.archive_facts(spark, index).where(condition).select("doc_id").collect()}
    assert got == (wanted or {d for d, y in rows if y == 2020} | {"S202101"})
    # The same filters as Spark pushes them, in this process, where openings can be counted.
    pushed = {
        "doc_id = 'S202103'": [source.EqualTo(("doc_id",), "S202103")],
        "doc_id IN ('S202003', 'S202204', 'none')": [source.In(("doc_id",), ("S202003", "S202204", "none"))],
        "year = 2022 AND element = 'a:Pay'": [source.IsNotNull(("year",)), source.EqualTo(("year",), 2022), source.EqualTo(("element",), "a:Pay")],
        "year < 2021 AND doc_id > 'S202009'": [source.LessThan(("year",), 2021), source.GreaterThan(("doc_id",), "S202009")],
    }.get(condition, [])
    reader, opened = archives.ArchiveReader(index), []
    left = list(reader.pushFilters(pushed))
    assert [f.attribute for f in left] == ([("element",)] if "element" in condition else [])
    real = archives._opened
    monkeypatch.setattr(archives, "_opened", lambda path: opened.append(path) or real(path))
    parts = reader.partitions()
    for part in parts:
        list(reader.read(part))
    assert {p.rsplit("/", 1)[1].removesuffix(".zip") for p in opened} == (wanted or {d for d, _ in rows}) and len(opened) == len(set(opened))
    if wanted and len(wanted) <= 2:
        assert len(parts) <= 2 < len(archives.ArchiveReader(index).partitions())  # the others are left out by their statistics


def test_empty_index(spark, tmp_path):
    index = archives.wanted_index(spark.createDataFrame([], "doc_id string, year int"), str(tmp_path))
    assert archives.archive_facts(spark, index).collect() == []


def test_archives_on_shelves(spark, tmp_path):
    docs = spark.range(40).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("doc_id"), F.lit(2021).alias("year"), F.lit(0).alias("seq"), *(F.lit(x).alias(c) for c, x in (("element", "a:Pay"), ("context", "Now"), ("value", "7"))))
    filers._landed(docs, f"file://{tmp_path}/zips")
    assert not list((tmp_path / "zips").glob("*.zip")) and len(list((tmp_path / "zips").glob("*/S*.zip"))) == 40
    index = archives.wanted_index(docs.where("seq = 0 AND doc_id < 'S2'"), f"file://{tmp_path}/zips", filers._SHELVES)
    got = archives.archive_facts(spark, index).collect()
    assert sorted(r.doc_id for r in got) == sorted(f"S{k}" for k in range(40) if f"S{k}" < "S2") and {(r.element, r.context, r.value) for r in got} == {("a:Pay", "Now", "7")}
