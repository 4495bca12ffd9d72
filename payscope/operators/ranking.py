"""Ranks over a whole population, and the rank / filter / search / sort / page query.

A global rank is not a window without partitions, which would bring all rows to one task.  Distinct pays
are put into cells; the rows of higher cells are counted, and only pays of one cell are ordered together.
There are at most a few thousand cells at any number of rows.  Rows of equal pay are numbered in stretches of
their tie-breaker, so a pay that very many rows share is spread over many tasks.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.functions.text import search_key

#: Yen in a cell, and how many cells are that wide; each higher one is a hundredth of an octave.
CELL, EVEN_CELLS = 50_000, 4000
#: How far the tie-breaker goes in a stretch of rows that are numbered together.
TIE_STRETCH = 65_536


def bases(companies: DataFrame, ages: Sequence[int] = C.TARGET_AGES) -> DataFrame:
    """Each company once with its pay as it is (basis 0) and once for each target age.

    ``companies`` has ``avg_salary``, ``avg_age`` and ``curve``; ``salary`` is added.  All pays of a company are
    made in one row and then unfolded, so no condition on ``salary`` is rewritten into the whole formula.
    """
    paid = model.with_estimates(companies, {f"_pay{a}": F.lit(float(a)) for a in ages})
    item = lambda basis, pay: F.struct(F.lit(basis).alias("basis"), pay.alias("salary"))
    each = F.array(item(0, model.half_up(F.col("avg_salary"))), *(item(a, F.col(f"_pay{a}")) for a in ages))
    kept = [c for c in companies.columns if c != "curve"]
    return paid.select(*kept, F.inline(each))


def with_pays(companies: DataFrame, ages: Sequence[int] = C.TARGET_AGES) -> DataFrame:
    """Each company in one row, with ``pays``: an array of (basis, salary) of the target ages."""
    paid = model.with_estimates(companies, {f"_pay{a}": F.lit(float(a)) for a in ages})
    pays = F.array(*(F.struct(F.lit(a).alias("basis"), F.col(f"_pay{a}").alias("salary")) for a in ages))
    return paid.select(*(c for c in companies.columns if c != "curve"), F.inline(F.array(F.struct(pays.alias("pays")))))  # unfolded as in ``bases``


def cell_of(value: Column, width: float = CELL) -> Column:
    """The number of a cell, never falling with the value; cells are even up to a point and grow with the value above it."""
    at = F.floor(value / F.lit(width))
    high = F.lit(EVEN_CELLS) + F.floor(F.log2(F.greatest(at, F.lit(EVEN_CELLS)) / F.lit(EVEN_CELLS)) * 100)
    return F.when(at < EVEN_CELLS, F.greatest(F.lit(0), at)).otherwise(high).cast("int")


def rows_ahead(rows: DataFrame, value: str, group: Sequence[str], weight: str | None = None) -> DataFrame:
    """(group, value, _ahead): how many rows of the group have a higher value.  ``weight``: how many rows each one stands for."""
    values = rows.groupBy(*group, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n")).withColumn("_cell", cell_of(F.col(value)))
    keys = ", ".join((*group, "_cell"))
    partition = f"PARTITION BY {', '.join(group)} " if group else ""
    cells = values.groupBy(*group, "_cell").agg(F.sum("_n").alias("_m"))
    # A few thousand rows in each group.
    ahead = cells.withColumn("_higher", F.expr(f"sum(_m) OVER ({partition}ORDER BY _cell DESC) - _m")).drop("_m")
    return (
        values.withColumn("_within", F.expr(f"sum(_n) OVER (PARTITION BY {keys} ORDER BY {value} DESC) - _n"))
        .join(ahead, [*group, "_cell"])
        .select(*group, value, (F.col("_higher") + F.col("_within")).alias("_ahead"))
    )


def positions(rows: DataFrame, value: str, ties: Sequence[str], group: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``rows`` with the place of each by ``value`` descending, then ``ties`` ascending (they must make it unique)."""
    number = dict(rows.dtypes)[ties[0]] in ("tinyint", "smallint", "int", "bigint")
    rows = rows.withColumn("_stretch", F.floor(F.col(ties[0]) / F.lit(TIE_STRETCH)) if number else F.lit(0).cast("long"))
    keys = [*group, value, "_stretch"]
    stretches = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    earlier = stretches.withColumn("_earlier", F.expr(f"sum(_n) OVER (PARTITION BY {', '.join((*group, value))} ORDER BY _stretch) - _n")).drop("_n")
    starts = earlier.join(rows_ahead(rows, value, group), [*group, value])
    numbered = rows.withColumn("_within", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(ties)})"))
    return numbered.join(starts, keys).withColumn(name, (F.col("_ahead") + F.col("_earlier") + F.col("_within")).cast("long")).drop("_stretch", "_ahead", "_earlier", "_within")


def competition_ranks(rows: DataFrame, value: str, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``rows`` with 1 + the number of rows with a higher ``value``; ties share a rank.

    Ranks are found among the distinct values, so a value that very many rows share costs nothing more.
    """
    ranked = rows_ahead(rows, value, group).select(*group, value, (F.col("_ahead") + 1).cast("long").alias(name))
    return rows.join(ranked, [*group, value])


# --- the query ---------------------------------------------------------------------------------

_EMPLOYEES = ("-300", "300-1000", "1000-")
_TENURES = ("-13", "13-17", "17-")
_AGES = ("-40", "40-43", "43-")
_SORTS = {"salary": "salary", "age": "avg_age", "emp": "employees"}


@dataclasses.dataclass(frozen=True)
class RankingQuery:
    """The state of the ranking: basis, filters, search text, order and page."""

    age: int | None = C.DEFAULT_AGE
    industry: str | int | None = None
    employees: str | None = None
    tenure: str | None = None
    avg_age: str | None = None
    text: str = ""
    sort: str = "salary"
    descending: bool = True
    page: int = 1

    @classmethod
    def from_params(cls, params: Mapping[str, str | Sequence[str]]) -> RankingQuery:
        """From request parameters; what is not valid counts as not given.  Of a repeated key the first value counts."""
        first = {k: v if isinstance(v, str) else next(iter(v), "") for k, v in params.items()}
        age = first.get("age", "")
        pick = lambda key, known: first[key] if first.get(key) in known else None
        axis, _, order = first.get("sort", "").partition("-")
        known = axis in _SORTS and order in ("", "asc", "desc")
        page = first.get("page", "")
        return cls(
            age=int(age) if age.isdecimal() and int(age) in C.TARGET_AGES else None,
            industry=first.get("ind") or None,
            employees=pick("emp", _EMPLOYEES),
            tenure=pick("ten", _TENURES),
            avg_age=pick("aage", _AGES),
            text=first.get("q", "").strip(),
            sort=axis if known else "salary",
            descending=order != "asc" if known else True,
            page=int(page) if page.isdecimal() and int(page) >= 1 else 1,
        )

    def to_params(self) -> dict[str, str]:
        """Request parameters in their fixed order, without defaults."""
        out = {"age": str(self.age) if self.age else "", "ind": str(self.industry or ""), "emp": self.employees or "", "ten": self.tenure or "", "aage": self.avg_age or "", "q": self.text}
        if (self.sort, self.descending) != ("salary", True):
            out["sort"] = f"{self.sort}-{'desc' if self.descending else 'asc'}"
        if self.page > 1:
            out["page"] = str(self.page)
        return {k: v for k, v in out.items() if v}

    def with_(self, **changes: object) -> RankingQuery:
        """With changes; any change but of the page goes back to page 1."""
        return dataclasses.replace(self, **({"page": 1} | changes))  # type: ignore[arg-type]

    def active_filters(self) -> list[tuple[str, str]]:
        named = {"industry": self.industry, "employees": self.employees, "tenure": self.tenure, "avg_age": self.avg_age, "text": self.text}
        return [(k, str(v)) for k, v in named.items() if v]

    def toggled(self, axis: str) -> RankingQuery:
        """The same axis turns round; another starts descending."""
        return self.with_(sort=axis, descending=not self.descending if axis == self.sort else True)


def canonical_path(q: RankingQuery, pages: int = 1) -> str:
    """The one address of a view: filters without an own page give the start page, industry goes before age."""
    if q.employees or q.tenure or q.avg_age or q.text or (q.sort, q.descending) != ("salary", True):
        return "/"
    from urllib.parse import quote

    path = f"/industry/{quote(str(q.industry), safe="!'()*~")}" if q.industry else f"/age/{q.age}" if q.age and q.age != C.DEFAULT_AGE else "/"
    return f"{path}?page={q.page}" if 2 <= q.page <= pages else path


def page_strip(page: int, pages: int) -> list[int | None]:
    """Page numbers to show: the first, the last and those beside this one; None for a gap."""
    shown = sorted({1, pages, *(p for p in (page - 1, page, page + 1) if 1 <= p <= pages)})
    out: list[int | None] = []
    for p in shown:
        if out and out[-1] is not None and p - out[-1] > 1:
            out.append(None)
        out.append(p)
    return out


def matches(q: RankingQuery, fold: bool = True) -> Column:
    """The filter of a query over ``tse33``, ``employees``, ``avg_tenure``, ``avg_age`` and ``name``."""
    out = F.lit(True)
    if q.industry is not None:
        out &= F.col("tse33") == q.industry
    if q.employees:
        out &= model.employee_bucket(F.col("employees")) == q.employees
    if q.tenure:
        out &= model.tenure_bucket(F.col("avg_tenure")) == q.tenure
    if q.avg_age:
        out &= model.age_bucket(F.col("avg_age")) == q.avg_age
    if q.text:
        out &= F.contains(search_key(F.col("name"), fold), search_key(F.lit(q.text), fold))
    return out


def ranked(companies: DataFrame, q: RankingQuery, fold: bool = True) -> DataFrame:
    """All rows of a query: salary, population_rank over everybody, rank among those that match."""
    rows = bases(companies, (q.age,) if q.age else ()).where(F.col("basis") == (q.age or 0)).drop("basis")
    placed = positions(rows, "salary", ["row_idx"], name="population_rank").where(matches(q, fold))
    return positions(placed, "salary", ["row_idx"], name="rank")


def page_of(rows: DataFrame, q: RankingQuery, total: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """One page of ``ranked`` in the order of the query, with its total, its number (clamped) and its maximum.

    The sort keeps the order of ranks among ties and leaves the ranks as they are.
    """
    page = min(max(1, q.page), max(1, math.ceil(total / size)))
    key = F.col(_SORTS[q.sort])
    order = [key.desc() if q.descending else key.asc(), F.col("rank").asc()]
    shown = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    # A window over the rows of a page, which are together already.
    return shown.withColumns({"page_max": F.expr("max(salary) OVER (PARTITION BY 1)"), "page": F.lit(page), "total": F.lit(total).cast("long")})


def run_query(companies: DataFrame, q: RankingQuery, fold: bool = True) -> DataFrame:
    """The page that a query shows; the rows that match are counted without being ranked."""
    return page_of(ranked(companies, q, fold), q, companies.where(matches(q, fold)).count())
