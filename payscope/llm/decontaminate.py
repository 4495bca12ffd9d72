"""Benchmark decontamination (operator 5), in DataFrame functions only.

Windows of a document as long as a benchmark item are fingerprinted by SimHash, looked up in a
multi-index of Hamming blocks (radius + 1 blocks, so no fingerprint within the radius is
missed), and each candidate is verified by the exact weighted likeness of its word shingles.

Which windows are formed is decided by two exact filters.  A window at the threshold t shares at least
t / (1 + t) of both sizes with an item, as multisets.  So of any item's s shingles each such window holds one
of any s - ceil(t s) + 1, and only those that are rarest in the benchmark are looked up in the documents; and of the
windows around such a place only those are formed that hold enough shingles of that item, in any order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import let, materialize

#: Benchmarks of more shingles than this are joined by shuffle instead of broadcast.
MOST_BROADCAST_SHINGLES = 500_000


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, width: int) -> Column:
    """Hashes of the shingles of ``width`` words; empty if there are fewer words."""
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return let(hashes, lambda h: F.when(F.size(h) >= width, many(h)).otherwise(F.array().cast("array<bigint>")))


def with_simhash(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with the SimHash of an array of hashes: a bit is set if it is in over half of them, repeats counted.

    ``keys`` tell the rows apart.  The bits are summed over the unfolded arrays, in compiled code.
    """
    sums = rows.select(*keys, F.explode(column).alias("h")).groupBy(*keys).agg(F.count("*").alias("n"), *(F.expr(f"sum(shiftright(h, {b}) & 1L)").alias(f"s{b}") for b in range(64)))
    fp = F.expr(" | ".join(f"IF(2 * s{b} > n, shiftleft(1L, {b}), 0L)" for b in range(64)))
    return rows.join(sums.select(*keys, fp.alias(name)), keys)


def hamming_blocks(radius: int) -> list[int]:
    """Masks of radius + 1 disjoint blocks of the 64 bits: within the radius one block is equal."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def weighted_likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays as multisets: shingles weigh as often as they occur.

    Where ``a`` repeats nothing, that is the plain intersection.
    """
    repeats = F.expr(f"aggregate(array_distinct({a}), 0, (s, h) -> s + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))")
    shared = F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))).otherwise(repeats)
    return let(shared, lambda n: n / (F.size(a) + F.size(b) - n))


def radius_of(threshold: float) -> int:
    """The radius within which a window at the threshold lies: the bits that differ on average, and 3.6 standard
    deviations, which one window in several thousand at the threshold exceeds and hardly any above it."""
    share = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return round(64 * share + 3.6 * math.sqrt(64 * share * (1 - share)))


def _seeds(own: DataFrame, threshold: float) -> DataFrame:
    """(h, item, size): of each item those shingles of which any window at the threshold holds one, the rarest first."""
    each = own.select("item", F.size("shingles").alias("size"), F.posexplode("shingles").alias("at", "h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"))
    placed = each.join(often, "h").withColumn("place", F.expr("row_number() OVER (PARTITION BY item ORDER BY often, h, at)"))
    enough = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    return placed.where(F.col("place") <= enough).select("h", "item", "size").distinct()


def _windows(found: DataFrame, threshold: float) -> DataFrame:
    """(key, doc_id, size, start, win) from ``found`` (key, doc_id, m, low, region, shingles): the stretches of the size of
    an item, or all ``m`` shingles of a shorter document, that hold enough of its ``shingles``."""
    length = F.least(F.col("size"), F.col("m"))
    rows = found.withColumns({"z": length, "least": F.ceil((length + F.col("size")) * (threshold / (1 + threshold)) - 1e-9).cast("int")})
    rows = rows.withColumn("held", F.expr("transform(region, h -> IF(array_contains(shingles, h), 1, 0))")).where("aggregate(held, 0, (n, x) -> n + x) >= least")
    at = F.expr("explode(filter(sequence(0, size(region) - z), j -> aggregate(slice(held, j + 1, z), 0, (n, x) -> n + x) >= least))")
    cut = rows.select("key", "doc_id", "size", "low", "region", "z", at.alias("j")).select("key", "doc_id", "size", (F.col("low") + F.col("j")).alias("start"), F.expr("slice(region, j + 1, z)").alias("win"))
    return cut.dropDuplicates(["key", "size", "start"])


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int | None = None, width: int = 5) -> DataFrame:
    """(key, doc_id, item_id, similarity, start_word, n_words): every window of a document that an item is like.

    ``key`` is a hash of doc_id and text; ``radius`` is that of the threshold if None.  Items of equal words are
    compared once.  The places of seeds are found first, without the texts, and written to the shared folder (a
    document has at most as many as its words times the items that share a rare shingle); Spark then joins them to
    the texts by their size, broadcast or not.
    """
    radius = radius_of(threshold) if radius is None else radius
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
    named = words.select("item_id", F.xxhash64("words").alias("item")).distinct()
    items = words.select(F.xxhash64("words").alias("item"), F.size("words").alias("n"), "words").dropDuplicates(["item"])
    sizes = items.groupBy(F.least(F.lit(width), F.col("n")).alias("w")).agg(F.sum("n").alias("shingles")).collect()  # at most `width` rows
    hint = F.broadcast if sum(r["shingles"] for r in sizes) <= MOST_BROADCAST_SHINGLES else lambda df: df
    none = docs.sparkSession.range(0).selectExpr("id AS key", "id AS doc_id", "id AS item", "CAST(0 AS DOUBLE) AS similarity", "0 AS start_word", "0 AS n_words")
    found = [none]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    masks = hamming_blocks(radius)
    for w in sorted(r["w"] for r in sizes):
        own = items.where(F.least(F.lit(width), F.col("n")) == w).select("item", "n", _shingles(F.col("words"), w).alias("shingles"))
        places = keyed.select("key", F.posexplode(_shingles(_word_hashes(F.col("text")), w)).alias("p", "h"))
        hits = places.join(hint(_seeds(own, threshold)), "h").groupBy("key").agg(F.collect_set(F.struct("item", "size", "p")).alias("places"))
        hits = materialize(hits, "decontamination-places")
        region = lambda x: F.struct(
            x["item"].alias("item"), x["size"].alias("size"), F.greatest(F.lit(0), x["p"] - x["size"] + 1).alias("low"),
            F.slice(F.col("of_doc"), F.greatest(F.lit(0), x["p"] - x["size"] + 1) + 1, 2 * x["size"] - 1 + F.least(F.lit(0), x["p"] - x["size"] + 1)).alias("region"),
        )
        around = (
            keyed.join(hits, "key")
            .select("key", "doc_id", "places", _shingles(_word_hashes(F.col("text")), w).alias("of_doc"))
            .select("key", "doc_id", F.size("of_doc").alias("m"), F.explode(F.transform("places", region)).alias("x"))
            .select("key", "doc_id", "m", "x.*")
        )
        windows = materialize(_windows(around.join(hint(own.select("item", "shingles")), "item"), threshold), "decontamination-windows")
        windows = with_simhash(windows, ["key", "size", "start"], "win", "fp")
        blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(_long(m)).alias("bits")) for i, m in enumerate(masks)))
        probe = windows.select("*", F.explode(blocks).alias("b")).select("*", "b.block", "b.bits").drop("b")
        of_items = with_simhash(own, ["item"], "shingles", "fp")
        index = of_items.select("item", "n", "shingles", F.size("shingles").alias("size"), F.col("fp").alias("item_fp"), F.explode(blocks).alias("b")).select("*", "b.block", "b.bits").drop("b")
        differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
        # A pair is taken at the first of its equal blocks only.
        earlier = reduce(lambda x, y: x | y, ((F.col("block") > i) & (differ.bitwiseAND(_long(m)) == 0) for i, m in enumerate(masks)))
        near = probe.join(hint(index), ["size", "block", "bits"]).where((F.bit_count(differ) <= radius) & ~earlier)
        # Unfolded, so that the likeness isn't computed once for the condition and once for the column.
        similar = F.explode(F.filter(F.array(weighted_likeness("win", "shingles")), lambda x: x >= threshold))
        found.append(near.select("key", "doc_id", "item", similar.alias("similarity"), F.col("start").alias("start_word"), F.col("n").alias("n_words")))
    return reduce(DataFrame.unionByName, found).join(hint(named), "item").drop("item")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int | None = None, width: int = 5) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): where a document holds a benchmark item.

    One row for each document and item, with its most similar window (the first of ties).  Words
    are runs of letters and digits in lower case; items of fewer than ``width`` words are one
    shingle.  Null or empty texts and items match nothing; rows that repeat a ``doc_id`` give one row.
    """
    hits = matches(docs, benchmark, threshold, radius, width)
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.s")).alias("start_word"), "m.n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; their columns as they are.  Rows are told apart by id and text."""
    found = materialize(matches(docs, benchmark, **options).select(F.col("key").alias("_key")).distinct(), "decontamination-found")
    return docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(found, "_key", "left_anti").select(docs.columns)
