"""Reading the table of employees out of running text, where columns may stick together.

``従業員数 平均年齢 平均勤続年数 平均年間給与`` are followed by their values, often without a space between
them.  The reader looks at each run of headers, tries the readings of its columns from left to right
and keeps the first that is plausible; other pay readings of the same place come along as candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("avg_salary", "avg_age", "avg_tenure", "employees")]
    + [T.StructField("source", T.StringType()), T.StructField("candidates", T.ArrayType(T.DoubleType()))]
)

_HEADERS = {
    "employees": re.compile(r"従\s*業\s*員\s*数|従\s*業\s*員(?!の)"),
    "age": re.compile(r"平\s*均\s*年\s*(?:齢|令)"),
    "tenure": re.compile(r"平\s*均\s*勤\s*続\s*年\s*数|平\s*均\s*勤\s*続"),
    "salary": re.compile(r"平\s*均\s*年\s*間\s*給\s*与(?:額)?"),
}
#: How far headers reach back and ahead, and how much of the text behind them is read (fixed values).
_REACH_BACK, _REACH_AHEAD, _VALUES = 130, 60, 240
_MARK = re.compile(r"[（(]\s*(?:注|※)?\s*[0-9０-９]{0,2}\s*[)）]|※\s*[0-9]?|注\s*[0-9]")
_UNIT_AFTER_HEADER = re.compile(r"\s*[（(]\s*(?:人|名|歳|才|年|千円|円)\s*[)）]|\s*[（(][^)）]{0,12}[)）]")
_GAP = re.compile(r"[\s、，・:：／/|]*")
_MONTHS = r"\s*([0-9]{1,2})\s*[ヶケヵカか箇]?\s*月"
_AFTER = r"\s*(?:人|名)?(?:\s*[\[(［]\s*[0-9,]+\s*[\])］])?\s*(?:人|名)?"
_PEOPLE_AFTER = re.compile(_AFTER)
_PEOPLE = re.compile(r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)" + _AFTER)
_PAY = re.compile(r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{4,9})\s*(千円|円)?")
#: Years and months, years with so many decimals, whole years.
_YEARS = {
    column: (re.compile(rf"([0-9]{{1,2}})\s*{unit}{_MONTHS}"), {n: re.compile(rf"([0-9]{{1,2}}\.[0-9]{{{n}}})\s*{unit}?") for n in (1, 2)}, re.compile(rf"([0-9]{{1,2}})\s*{unit}"))
    for column, unit in (("age", "[歳才]"), ("tenure", "年"))
}
#: Decimals of age and tenure, in the order tried.
_DECIMALS = ((1, 1), (1, 2), (2, 2), (2, 1))
_DIGITS = str.maketrans("０１２３４５６７８９．，（）", "0123456789.,()")

Reading = tuple[float, int]


def _float(text: str) -> float:
    return float(text.replace(",", ""))


def _plausible(v: dict[str, float], expected: float | None) -> bool:
    salary, age, tenure, people = v.get("salary"), v.get("age"), v.get("tenure"), v.get("employees")
    if salary is None or age is None or not 18 <= age <= 70 or not 1_000_000 <= salary <= 60_000_000:
        return False
    if tenure is not None and not 0 <= tenure <= age - 15:
        return False
    if people is not None and people >= 50 and salary > 25_000_000:
        return False
    return people is None or expected is None or abs(people - expected) <= max(1.0, 0.02 * expected)


def _readings(column: str, text: str, at: int, decimals: int, expected: float | None, thousand: bool) -> Iterator[Reading]:
    """What a column may be at a place, and where it ends."""
    at = _GAP.match(text, at).end()  # type: ignore[union-attr]
    if column == "employees":
        if expected is not None:
            number = next((x for x in (f"{expected:,.0f}", f"{expected:.0f}") if text.startswith(x, at)), None)
            if number is not None:
                yield _float(number), _PEOPLE_AFTER.match(text, at + len(number)).end()  # type: ignore[union-attr]
        elif m := _PEOPLE.match(text, at):
            yield _float(m[1]), m.end()
        return
    if column in ("age", "tenure"):
        with_months, decimal, whole = _YEARS[column]
        if m := with_months.match(text, at):
            years = int(m[1]) + int(m[2]) / 12
            yield round(years, 1 if column == "age" else 2), m.end()
        if m := decimal[decimals].match(text, at):
            yield float(m[1]), m.end()
        if m := whole.match(text, at):
            yield float(m[1]), m.end()
        return
    if m := _PAY.match(text, at):
        scale = 1000 if m[2] == "千円" or (thousand and m[2] is None) else 1
        yield _float(m[1]) * scale, m.end()


def _read(columns: list[str], text: str, at: int, decimals: tuple[int, int], expected: float | None, thousand: bool, got: dict[str, float]) -> dict[str, float] | None:
    """The first plausible reading of the columns, left to right."""
    if not columns:
        return got if _plausible(got, expected) else None
    column = columns[0]
    places = decimals[0] if column == "age" else decimals[1]
    pinned = expected if column == "employees" else None
    for value, end in _readings(column, text, at, places, pinned, thousand):
        found = _read(columns[1:], text, end, decimals, expected, thousand, got | {column: value})
        if found:
            return found
    return None


def _runs(text: str) -> Iterator[tuple[list[str], int, bool]]:
    """Runs of headers around each pay header: their columns in order, where values begin, and if pay is in thousands."""
    for pay in _HEADERS["salary"].finditer(text):
        low, high = max(0, pay.start() - _REACH_BACK), pay.end() + _REACH_AHEAD
        spans = sorted((m.start() + low, m.end() + low, name) for name, p in _HEADERS.items() for m in p.finditer(text[low:high]))
        run: list[tuple[int, int, str]] = []
        for span in spans:
            if run and span[0] < run[-1][1]:
                continue
            between = _MARK.sub("", text[run[-1][1] : span[0]]) if run else ""
            if re.search("[0-9]", between):
                if any(s[2] == "salary" and s[0] == pay.start() for s in run):
                    break
                run = []
            run.append(span)
        if not any(s[0] == pay.start() for s in run):
            continue
        end = run[-1][1]
        while m := _UNIT_AFTER_HEADER.match(text, end):
            if re.fullmatch(r"\s*\([0-9,]+\)", m.group()):
                break
            end = m.end()
        names = [s[2] for s in run]
        if len(set(names)) == len(names):
            yield names, end, "千円" in text[pay.end() : end]


def parse_block(text: str | None, expected: float | None = None) -> dict | None:
    """The figures of a text, or None.  ``expected``: the number of employees known from elsewhere."""
    if not text:
        return None
    whole = text.translate(_DIGITS)
    for body in (whole, re.sub(r"\s+", "", whole)):
        attempts = [(expected, False), (None, False), (None, True)] if expected is not None else [(None, False), (None, True)]
        for pin, without_people in attempts:
            for columns, start, thousand in _runs(body):
                values = body[start : start + _VALUES]
                own = [c for c in columns if not (without_people and c == "employees")]
                found = [r for d in _DECIMALS if (r := _read(own, values, 0, d, pin, thousand, {}))]
                if found:
                    best = found[0]
                    others = sorted({r["salary"] for r in found} - {best["salary"]})
                    return {
                        "avg_salary": best["salary"], "avg_age": best["age"], "avg_tenure": best.get("tenure"), "employees": best.get("employees"),
                        "source": "textblock", "candidates": [best["salary"], *others] if others else None,
                    }
    return None


@F.pandas_udf(SCHEMA)  # type: ignore[call-overload]
def employee_block(text: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Figures of each text, all null where there are none."""
    fields = SCHEMA.names
    rows = [parse_block(t, None if pd.isna(e) else float(e)) or dict.fromkeys(fields) for t, e in zip(text, expected, strict=True)]
    return pd.DataFrame(rows, columns=fields)
