"""Text functions: names, numbers with units, formats.  Unicode folding is the one Arrow function."""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Corporate forms that a search ignores anywhere, and those that an initial ignores in front (fixed values).
CORPORATE_FORMS = ("株式会社", "(株)", "㈱", "有限会社", "合同会社")
LEADING_FORMS = ("株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "(株)", "（株）", "㈱")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def search_key(name: Column, fold: bool = True) -> Column:
    """A name as the search compares it: folded, without corporate forms, lower case, without spaces."""
    name = nfkc(name) if fold else name
    bare = F.regexp_replace(name, "|".join(map(re.escape, CORPORATE_FORMS)), "")
    return F.regexp_replace(F.lower(bare), r"(?U)\s+", "")


def search_name(name: Column) -> Column:
    """A name as the code list is compared: folded, without white space, corporate forms and case as they are; '' for null."""
    return F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), r"(?U)\s+", "")


def initial_of(name: Column) -> Column:
    """The first character of a name behind a corporate form; of the whole name if nothing is left."""
    rest = F.trim(F.regexp_replace(name, f"^({'|'.join(map(re.escape, LEADING_FORMS))})", ""))
    return F.when(rest != "", F.substring(rest, 1, 1)).otherwise(F.substring(name, 1, 1))


def number(text: Column) -> Column:
    """A plain decimal number, else null; zero is not null."""
    text = F.trim(text)
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))


def leading_number(text: Column) -> Column:
    """The number at the start, with thousands separators and decimals."""
    return F.replace(F.regexp_extract(text, r"^(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def half_width_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９．，", "0123456789.,")


def years_and_months(text: Column) -> Column:
    """``13年6ケ月`` and the like as years, two decimals."""
    years = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*[年歳才]", 1).try_cast("double")
    months = F.regexp_extract(text, r"[年歳才]\s*(\d+)\s*(?:[ヶケヵカか箇]?月)", 1).try_cast("double")
    return F.round(years + F.coalesce(months, F.lit(0.0)) / 12, 2)


def ten_thousands(yen: Column) -> Column:
    """Yen in units of 10,000, half up."""
    return F.floor(yen / 10_000 + F.lit(0.5)).cast("long")


def pay_label(yen: Column) -> Column:
    return F.concat(F.format_number(ten_thousands(yen), 0), F.lit("万円"))


def rate_label(rate: Column) -> Column:
    """A change in percent with one decimal; the sign is chosen after rounding."""
    percent = F.round(rate * 100, 1)
    sign = F.when(percent > 0, "＋").when(percent < 0, "−").otherwise("±")
    return F.concat(sign, F.format_number(F.abs(percent), 1), F.lit("%"))


def fiscal_label(period: Column) -> Column:
    """``YYYY-MM`` as a fiscal period; an error if it has another form."""
    fine = period.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    label = F.concat(F.substring(period, 1, 4), F.lit("年"), F.substring(period, 6, 2).try_cast("int").cast("string"), F.lit("月期"))
    return F.when(fine, label).otherwise(F.raise_error(F.concat(F.lit("not a period: "), F.coalesce(period, F.lit("null")))))


def path_segment(text: Column) -> Column:
    """Percent-encoded as a part of a path."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def plain_markup(text: Column, most: int = 120) -> Column:
    """Markup without tags and with the common references decoded, at most ``most`` characters."""
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for code, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)


@F.pandas_udf(T.StringType())
def to_fixed(x: pd.Series) -> pd.Series:
    """One decimal, rounded from the exact binary value, halves away from zero."""
    return x.map(lambda v: format(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP), "f"), na_action="ignore").astype(object)


def difference_label(yen: Column) -> Column:
    """A difference in units of 10,000 yen, always with a sign."""
    return F.concat(F.when(yen >= 0, "＋").otherwise("−"), pay_label(F.abs(yen)))


def top_label(percent: Column) -> Column:
    return F.when(percent < 0.1, "上位0.1%未満").otherwise(F.concat(F.lit("上位"), to_fixed(percent), F.lit("%")))


def bin_label(low: Column, width: Column, k: Column, bins: int = 9) -> Column:
    """The range of a histogram bin in words; the end bins are open."""
    start = low + width * k
    man = lambda x: F.format_number(ten_thousands(x), 0)
    inner = F.concat(man(start), F.lit("〜"), man(start + width), F.lit("万円"))
    return F.when(k == 0, F.concat(man(start + width), F.lit("万円未満"))).when(k == bins - 1, F.concat(man(start), F.lit("万円以上"))).otherwise(inner)


def bin_tick(low: Column, width: Column, k: Column, bins: int = 9) -> Column:
    """The short form of ``bin_label`` for an axis."""
    start = low + width * k
    man = lambda x: F.format_number(ten_thousands(x), 0)
    return F.when(k == 0, F.concat(F.lit("〜"), man(start + width))).when(k == bins - 1, F.concat(man(start), F.lit("+"))).otherwise(man(start))


def nice_ticks(low: float, high: float, count: int = 4) -> list[float]:
    """Round values between two ends, about ``count`` of them: steps of 1, 2, 2.5 or 5 times a power of ten;
    of steps that come equally near the larger.  For axes, on the driver."""
    span = high - low
    if not span > 0 or count < 2:
        return []
    power = math.floor(math.log10(span))
    steps = sorted(f * 10.0**e for e in range(power - 2, power + 2) for f in (1, 2, 2.5, 5))
    ticks = [[k * s for k in range(math.ceil(low / s), math.floor(high / s) + 1)] for s in steps]
    fitting = [t for t in ticks if len(t) >= 2]
    return min(reversed(fitting), key=lambda t: abs(len(t) - count), default=[])
