"""Column functions over markup: attributes, structured data, sizes, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not, with the three common references decoded; null without it."""
    quoted = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.when(tag.rlike(quoted), F.concat(*(F.regexp_extract(tag, quoted, k) for k in (1, 2, 3))))
    for code, sign in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(code), F.lit(sign))
    return F.nullif(F.trim(found), F.lit(""))


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))


def json_logos(html: Column, depth: int = 4) -> Column:
    """Logo addresses in the page's JSON-LD blocks, down to ``depth`` levels of arrays and ``@graph``.

    Blocks that are not JSON are skipped.  A logo is a string or an object with a ``url``.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    nodes = F.filter(F.transform(blocks, lambda b: F.get_json_object(F.trim(b), "$")), lambda b: b.isNotNull())
    array_of = lambda text: F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    opened = lambda n: F.when(F.trim(n).startswith("["), array_of(n)).otherwise(F.concat(F.array(n), array_of(F.get_json_object(n, "$['@graph']"))))
    for _ in range(depth):
        level = F.flatten(F.transform(nodes, opened))
        nodes = F.array_distinct(level)
    objects = F.filter(nodes, lambda n: F.trim(n).startswith("{"))
    logos = F.transform(objects, lambda n: F.coalesce(F.get_json_object(n, "$.logo.url"), F.get_json_object(n, "$.logo")))
    return F.filter(logos, lambda u: u.isNotNull() & ~F.trim(u).startswith("{") & ~F.trim(u).startswith("["))


def largest_size(sizes: Column) -> Column:
    """The size of greatest area in ``16x16 180x180``, as (width, height); null without any."""
    parts = F.filter(F.split(F.lower(F.trim(sizes)), r"\s+"), lambda p: p.rlike(r"^\d{1,6}x\d{1,6}$"))
    each = F.transform(parts, lambda p: F.struct(
        (F.split_part(p, F.lit("x"), F.lit(1)).cast("long") * F.split_part(p, F.lit("x"), F.lit(2)).cast("long")).alias("area"),
        F.split_part(p, F.lit("x"), F.lit(1)).cast("int").alias("width"), F.split_part(p, F.lit("x"), F.lit(2)).cast("int").alias("height"),
    ))
    return F.array_max(each)


def origin_of(url: Column) -> Column:
    """Scheme and host of a web address; null for any other."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#\s]+)", 1)), F.lit(""))
