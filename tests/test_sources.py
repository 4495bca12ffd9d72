import json
import zipfile

import pytest
from pyspark.sql import functions as F

from payscope.operators.resolution import QualityError, annual_reports, first_per_slot
from payscope.sources import files
from payscope.streaming import filings


def test_strict_csv(spark, tmp_path):
    p = tmp_path / "h.csv"
    head = "edinet_code,year,avg_salary,avg_age,employees_nonconsolidated,source,period_end,doc_id"
    p.write_text("﻿" + head + "\r\nE1,2020,5000000,40.1,,tag,2020-03-31,S1\r\n", encoding="utf-8")
    row = files.strict_csv(spark, str(p), files.HISTORY).first()
    assert (row["edinet_code"], row["avg_salary"], row["employees_nonconsolidated"], row["doc_id"]) == ("E1", 5_000_000, None, "S1")
    p.write_text(head.replace("year", "Year") + "\n")
    with pytest.raises(QualityError, match="column 2"):
        files.strict_csv(spark, str(p), files.HISTORY)
    p.write_text(head + "\nE1,x,5000000,40.1,,tag,2020-03-31,S1\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        files.strict_csv(spark, str(p), files.HISTORY).collect()


def test_positional_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes('﻿"n","x","x"\r\n"a","l1\r\nl2",""\r\nb,"say ""hi""",\r\n'.encode())
    rows = files.positional_csv(spark, str(p), ["n", "x", "x"], {"name": 1, "note": 2, "last": 3}).collect()
    assert [(r["name"], r["note"].replace("\r", ""), r["last"]) for r in rows] == [("a", "l1\nl2", ""), ("b", 'say "hi"', "")]
    with pytest.raises(QualityError):
        files.positional_csv(spark, str(p), ["n", "y", "x"], {"name": 1})


def filing(doc, sec="12340", kind="120", withdrawn="0"):
    return {"docID": doc, "edinetCode": "E1", "secCode": sec, "filerName": "N", "docTypeCode": kind, "withdrawalStatus": withdrawn, "periodEnd": "2024-03-31"}


def test_filing_lists(spark, tmp_path):
    put = lambda day, x: (tmp_path / f"{day}.json").write_text(json.dumps(x))
    put("2024-06-03", {"metadata": {"status": "200"}, "results": [filing("S1"), filing("S2", sec=None), filing("S3", withdrawn="1"), filing("S4", kind="130")]})
    put("2024-06-04", {"metadata": {"status": "200"}, "results": [filing("S5")]})
    put("2024-06-05", {"metadata": {"status": "404"}})
    put("2024-06-06", {"statusCode": "429"})
    put("2024-06-07", {"metadata": {"status": "200"}})
    put("2024-06-08", {"metadata": {"status": "200"}, "results": [filing("S9")]})
    lists = files.filing_lists(spark, str(tmp_path))
    assert lists.count() == 6
    assert sorted(r["file"] for r in files.rejected_lists(spark, str(tmp_path)).collect()) == ["2024-06-06.json", "2024-06-07.json"]
    best = annual_reports(lists).collect()
    assert [(r["sec_code"], r["doc_id"]) for r in best] == [("1234", "S5")]


def archive(path, name, data):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, data)


def test_filing_facts(spark, tmp_path):
    line = lambda element, value: "\t".join([element, "x", "ctx", *[""] * 5, value])
    body = "\n".join(["header", line("pay", '"5,000"'), line("pay", "6,000"), line("age", "－"), "short\tline"])
    archive(tmp_path / "a.zip", "XBRL_TO_CSV/a.csv", body.encode("utf-16"))
    (tmp_path / "b.zip").write_text('{"statusCode": "429"}')
    facts = files.filing_facts(spark, str(tmp_path))
    assert [(r["element"], r["value"]) for r in facts.orderBy("seq").collect()] == [("pay", "5,000"), ("pay", "6,000")]
    assert first_per_slot(facts, "path", "element", "value", "seq", ["pay", "age"]).first()["pay"] == "5,000"


def test_codelist(spark, tmp_path):
    row = ["E1", "内国法人・組合", "上場", "", "100", "", "会社", "", "", "", "化学", "12340", "1234567890123"]
    archive(tmp_path / "c.zip", "c.csv", ("title\nheader\n" + ",".join(row) + "\nshort,row\n").encode("cp932"))
    got = files.codelist(spark, str(tmp_path)).collect()
    assert [(r["code"], r["name"], r["sec_code"], r["corporate_number"]) for r in got] == [("E1", "会社", "1234", "1234567890123")]
    assert len(files.provenance(spark, str(tmp_path)).first()["sha256"]) == 64


def test_curves(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"ANNUAL_INDUSTRY": {"k": [1.5] * 10}}))
    assert files.wage_curves(spark, str(tmp_path)).first()["curve"][0] == 1500


def test_stream_replaces_older_filings(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    schema = "code string, year int, doc_id string, value long"
    run = lambda: filings.keep_latest(filings.arriving(spark, str(landing), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (landing / "1.json").write_text(json.dumps({"code": "a", "year": 2020, "doc_id": "S1", "value": 1}))
    run()
    (landing / "2.json").write_text(json.dumps({"code": "a", "year": 2020, "doc_id": "S2", "value": 2}))
    run()
    run()
    assert [(r["doc_id"], r["value"]) for r in filings.current(spark, str(tmp_path / "out")).collect()] == [("S2", 2)]
    (landing / "3.json").write_text("\n".join(json.dumps({"code": c, "year": y, "doc_id": d, "value": v}) for c, y, d, v in [("b", 2020, "S3", 3), ("a", 2021, "S4", 4), ("a", 2020, "S0", 0)]))
    run()
    now = filings.current(spark, str(tmp_path / "out"))
    assert sorted((r["code"], r["year"], r["doc_id"]) for r in now.collect()) == [("a", 2020, "S2"), ("a", 2021, "S4"), ("b", 2020, "S3")]
    assert all("batch=0" not in r[0] for r in now.select(F.input_file_name()).collect())
    assert filings.current(spark, str(tmp_path / "none")) is None

