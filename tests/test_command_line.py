import json
import zipfile

from payscope.__main__ import main
from payscope.operators.filings import ELEMENTS
from payscope.sources import files

PAY, AGE = (e for e, n in ELEMENTS.items() if n in ("avg_salary", "avg_age"))
EDINET, NAME, SEC = (next(e for e, n in ELEMENTS.items() if n == k) for k in ("edinet_code", "name", "sec_code"))
PEOPLE = "jpcrp_cor:NumberOfEmployees"


def landed(root):
    """Three filers, one of them unlisted, with reports of two years."""
    for folder in ("lists", "zips", "codes"):
        (root / folder).mkdir()
    filers = [("E1", "11110", "アルファ株式会社", 6_000_000, 40.0), ("E2", "22220", "ベータ株式会社", 650, 35.0), ("E3", None, "ガンマ株式会社", 5_000_000, 45.0)]
    for year in (2023, 2024):
        results = []
        for code, sec, name, pay, age in filers:
            doc = f"S{year}{code}"
            results.append({"docID": doc, "edinetCode": code, "secCode": sec, "filerName": name, "docTypeCode": "120", "withdrawalStatus": "0", "periodEnd": f"{year}-03-31"})
            facts = [(PAY, "CurrentYearDuration_NonConsolidatedMember", pay + (year - 2023) * pay // 10), (AGE, "CurrentYearInstant_NonConsolidatedMember", age), (PEOPLE, "CurrentYearInstant_NonConsolidatedMember", 200), (PEOPLE, "CurrentYearInstant", 800),
                     (EDINET, "FilingDateInstant", code), (NAME, "FilingDateInstant", name), (SEC, "FilingDateInstant", sec or "－")]
            body = "\n".join(["header", *("\t".join([e, "x", c, *[""] * 5, f'"{v}"']) for e, c, v in facts)])
            with zipfile.ZipFile(root / "zips" / f"{doc}.zip", "w") as z:
                z.writestr("XBRL_TO_CSV/a.csv", body.encode("utf-16"))
        (root / "lists" / f"list_{year}-06-2{year % 10}.json").write_text(json.dumps({"metadata": {"status": "200"}, "results": results}))
    rows = [[code, "内国法人・組合", "上場" if sec else "非上場", "", "1", "", name, "", "", "", "化学", sec or "", f"{i:013}"] for i, (code, sec, name, *_) in enumerate(filers, 1)]
    with zipfile.ZipFile(root / "codes" / "c.zip", "w") as z:
        z.writestr("c.csv", ("title\nheader\n" + "\n".join(map(",".join, rows)) + "\n").encode("cp932"))
    (root / "curves.json").write_text(json.dumps({"ANNUAL_INDUSTRY": {"製造業": [3000.0 + 200 * k for k in range(10)]}}))
    return ["--lists", str(root / "lists"), "--filings", str(root / "zips")], ["--codelist", str(root / "codes")], ["--curves", str(root / "curves.json")]


def test_population_unified_history(spark, tmp_path):
    lists, codes, curves = landed(tmp_path)
    main(["population", "--include-unlisted", "--limit", "0", *lists, *codes, *curves, "--out", str(tmp_path / "v")], spark)
    got = {r["name"]: r for r in files.untyped_csv(spark, str(tmp_path / "v"), ["avg_salary"]).collect()}
    assert {n: (r["avg_salary"], r["salary_fixed"], r["rank_raw"], r["doc_id"], r["emp_ratio"]) for n, r in got.items()} == {
        "アルファ株式会社": (6_600_000, "false", "2", "S2024E1", "0.25"), "ベータ株式会社": (7_150_000, "true", "1", "S2024E2", "0.25"), "ガンマ株式会社": (5_500_000, "false", "3", "S2024E3", "0.25")
    }
    main(["unified", "--from-csv", str(tmp_path / "v"), "--backfill-edinet-code", "--backfill-corporate-number", *codes, *curves, "--out", str(tmp_path / "u")], spark)
    unified = files.untyped_csv(spark, str(tmp_path / "u"), []).collect()
    assert [(r["rank_adj"], r["edinet_code"], r["corporate_number"]) for r in unified] == [("1", "E2", f"{2:013}"), ("2", "E1", f"{1:013}"), ("3", "E3", f"{3:013}")]
    assert {r["name"]: (r["salary35"], r["factor"]) for r in unified} == {n: (r["salary35"], r["factor"]) for n, r in got.items()}
    main(["history", "2023", "2024", "--universe", str(tmp_path / "u"), *lists, *codes, "--out", str(tmp_path / "h")], spark)
    rows = files.strict_csv(spark, str(tmp_path / "h"), files.HISTORY).collect()
    assert [(r["edinet_code"], r["year"], r["avg_salary"]) for r in rows] == [("E1", 2023, 6_000_000), ("E1", 2024, 6_600_000), ("E2", 2023, 6_500_000), ("E2", 2024, 7_150_000), ("E3", 2023, 5_000_000), ("E3", 2024, 5_500_000)]
