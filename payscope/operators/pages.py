"""Logo candidates from web pages: structured data, header images, icons, manifests; their order and choice."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.functions.html import attribute, json_logos, largest_size, origin_of

#: Sources in order of preference (fixed values).
SOURCES = ("commons", "jsonld", "header", "icon")
MOST_ATTEMPTS = 6


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, url: pd.Series) -> pd.Series:
    """``url`` seen from ``base``; null unless that is http or https."""

    def one(b: str | None, u: str | None) -> str | None:
        try:
            full = urljoin(b or "", (u or "").strip())
        except ValueError:
            return None
        return full if u and full.startswith(("http://", "https://")) else None

    return pd.Series([one(b, u) for b, u in zip(base, url, strict=True)], dtype=object)


def page_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, seq, source, url, width, height) from ``pages`` (page_id, url, html): logos in structured
    data, images of the header that are called logo, icon links and the default icons."""
    html = F.coalesce(F.col("html"), F.lit(""))
    found = F.regexp_extract(html, r"(?is)<header\b.*?</header>", 0)
    header = F.when(found != "", found).otherwise(F.substring(html, 1, 60_000))
    images = F.filter(F.regexp_extract_all(header, F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1)), lambda tag: tag.rlike(r"(?i)logo|ロゴ"))
    icons = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1)), lambda tag: F.lower(attribute(tag, "rel")).contains("icon"))
    item = lambda source, url, size: F.struct(F.lit(source).alias("source"), url.alias("raw"), size.alias("size"))
    none = F.lit(None).cast("string")
    image = lambda tag: item("header", F.coalesce(attribute(tag, "src"), attribute(tag, "data-src"), attribute(tag, "data-original")), none)
    apple = lambda tag: F.when(F.lower(attribute(tag, "rel")).contains("apple"), "180x180")
    icon = lambda tag: item("icon", attribute(tag, "href"), F.coalesce(attribute(tag, "sizes"), apple(tag)))
    defaults = F.array(item("icon", F.lit("/apple-touch-icon.png"), F.lit("180x180")), item("icon", F.lit("/favicon.ico"), none))
    logos = F.transform(json_logos(html), lambda u: item("jsonld", u, none))
    all_ = F.concat(logos, F.transform(images, image), F.transform(icons, icon), defaults)
    rows = pages.select("page_id", "url", F.posexplode(all_).alias("seq", "c")).select("page_id", "seq", "c.source", absolute(F.col("url"), F.col("c.raw")).alias("url"), largest_size(F.col("c.size")).alias("s"))
    return rows.where("url IS NOT NULL").select("page_id", "seq", "source", "url", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


def manifest_links(pages: DataFrame) -> DataFrame:
    """(page_id, manifest): the web address of the first manifest link of each page that has one."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1)), lambda tag: F.lower(attribute(tag, "rel")).contains("manifest") & attribute(tag, "href").isNotNull())
    found = pages.select("page_id", "url", attribute(F.get(links, F.lit(0)), "href").alias("raw")).where("raw IS NOT NULL")
    return found.select("page_id", absolute(F.col("url"), F.col("raw")).alias("manifest")).where("manifest IS NOT NULL")


def manifest_icons(manifests: DataFrame) -> DataFrame:
    """Candidates from fetched manifests (page_id, manifest: its address, body: its JSON), in the form of ``page_candidates``.

    Bodies that are no JSON objects, and icons without an address, give none.
    """
    icons = F.from_json(F.get_json_object("body", "$.icons"), "array<struct<src: string, sizes: string>>")
    each = manifests.select("page_id", "manifest", F.posexplode(icons).alias("seq", "c")).where("c.src IS NOT NULL")
    rows = each.select("page_id", "seq", F.lit("icon").alias("source"), absolute(F.col("manifest"), F.col("c.src")).alias("url"), largest_size(F.col("c.sizes")).alias("s"))
    return rows.where("url IS NOT NULL").select("page_id", "seq", "source", "url", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


def with_commons(candidates: DataFrame, titles: DataFrame, images: DataFrame) -> DataFrame:
    """``candidates`` and, ahead of all of a page's, the free image that is known for its company: ``titles`` (page_id, title) of ``images`` (title, url,
    width, height), the first by title where there are several; a title without an image adds nothing."""
    known = titles.join(images.where("url IS NOT NULL"), "title").groupBy("page_id").agg(F.min_by(F.struct("url", "width", "height"), "title").alias("m"))
    free = known.select("page_id", F.lit(-1).alias("seq"), F.lit("commons").alias("source"), "m.url", F.col("m.width").cast("int").alias("width"), F.col("m.height").cast("int").alias("height"))
    return free.unionByName(candidates)


def _priority(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCES)), source)


def ordered_candidates(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """The first occurrence of each web address, numbered by source, then by declared area, then as found."""
    kept = candidates.where(F.col("url").rlike("^https?://")).groupBy(key, "url").agg(F.min_by(F.struct("seq", "source", "width", "height"), "seq").alias("m")).select(key, "url", "m.*")
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0))
    sorted_ = kept.withColumns({"_p": _priority(F.col("source")), "_a": area})
    return sorted_.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY _p, _a DESC, seq)")).drop("_p", "_a")


def chosen_logo(ordered: DataFrame, accepted: Column, key: str = "page_id") -> DataFrame:
    """The first acceptable candidate among the first six."""
    fine = ordered.where((F.col("place") <= MOST_ATTEMPTS) & accepted)
    return fine.groupBy(key).agg(F.min_by(F.struct("url", "source"), "place").alias("m")).select(key, "m.*")


def merged_sites(companies: DataFrame, wikidata: DataFrame, registry: DataFrame) -> DataFrame:
    """``companies`` (corporate_number, ...) with the site each source knows, the first source first, as an origin."""
    one = lambda df, name: df.groupBy("corporate_number").agg(F.last("site").alias(name))
    out = companies.join(one(wikidata, "_w"), "corporate_number", "left").join(one(registry, "_g"), "corporate_number", "left")
    return out.withColumn("site", origin_of(F.coalesce("_w", "_g"))).drop("_w", "_g")


def credits(entries: DataFrame, companies: DataFrame) -> DataFrame:
    """Entries that must be attributed, with the company's name, or the id where there is none."""
    named = entries.where("attr").join(companies.select("id", "name"), "id", "left")
    return named.withColumn("name", F.coalesce("name", F.col("id").cast("string")))
