"""One-permutation MinHash fingerprints (operator 1), in DataFrame functions only.

Every five-word shingle is hashed once; the top bits of the hash choose one of 128 bins and each
bin keeps its least hash.  An empty bin borrows from a full one chosen by a hash of the pair of
bins that does not depend on the document (optimal densification), so likeness stays unbiased.
Of each bin the lowest 8 bits are packed.  Two bins agree by chance once in 256, which the
likeness estimate subtracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import SPACE, let

BINS = 128
_SHIFT = 57  # 64 - log2(BINS)
KEPT_BITS = 8
WIDTH = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the shingles; a text of fewer words has one shingle, an empty one none."""

    def shingles(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - width),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))),
        )
        return F.when(F.size(h) >= width, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(_words(text), lambda w: F.xxhash64(w)), shingles)


def _bin(h: Column) -> Column:
    return (F.shiftright(h, _SHIFT) + BINS // 2).cast("int")


def _least_of_bins(sorted_hashes: Column) -> Column:
    """The least hash of every bin that has any, in the order of the bins."""
    return let(
        sorted_hashes,
        lambda s: F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT))),
    )


def _densified(least: Column) -> Column:
    """The kept bits of all bins; an empty array for a document without shingles."""
    low = (1 << KEPT_BITS) - 1

    def borrowed(i: Column, full: Column) -> Column:
        rank = lambda h: F.xxhash64(i, F.shiftright(h, _SHIFT)).bitwiseAND(F.lit(~low)).bitwiseOR(h.bitwiseAND(F.lit(low)))
        return F.array_min(F.transform(full, rank))

    def sketch(full: Column, bins: Column) -> Column:
        own = F.transform(full, lambda h: h.bitwiseAND(F.lit(low)).cast("smallint"))
        fill = F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)),
            lambda i: let(F.array_position(bins, i), lambda at: F.when(at > 0, F.get(full, at.cast("int") - 1)).otherwise(borrowed(i, full))).bitwiseAND(F.lit(low)).cast("smallint"),
        )
        return F.when(F.size(full) == BINS, own).when(F.size(full) == 0, F.array().cast("array<smallint>")).otherwise(fill)

    return let(least, lambda full: let(F.transform(full, _bin), lambda bins: sketch(full, bins)))


def sketch(text: Column) -> Column:
    """array<smallint> of 128 values of 8 bits, or an empty array.  A null text counts as empty."""
    return _densified(_least_of_bins(F.sort_array(shingle_hashes(F.coalesce(text, F.lit(""))))))


def packed(values: Column) -> Column:
    """The sketch as lowercase hex, two digits a bin; empty for a document without words."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1.  Two documents without words are alike."""
    chance = 1.0 / (1 << KEPT_BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    estimate = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(estimate)
    )


def id_ranges(docs: DataFrame, rows_per_bucket: int, most_buckets: int) -> Column:
    """The number of the range of a ``doc_id``, never falling with it; -1 for null.

    Up to 257 quantiles (all that reaches the driver) cut the ids into stretches of as many rows, and
    each stretch is cut into ranges of equal width.
    """
    n = docs.count()
    buckets = max(1, min(most_buckets, n // rows_per_bucket))
    cuts = min(256, buckets)
    found = docs.agg(F.percentile_approx("doc_id", [k / cuts for k in range(cuts + 1)], 100_000)).first()[0]
    bounds = sorted({b for b in found or [0] if b is not None}) or [0]
    each = -(-buckets // max(1, len(bounds) - 1))
    at = F.array(*(F.lit(b).cast("long") for b in bounds))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    stretch = F.aggregate(halves, F.lit(0), lambda k, step: F.when(F.get(at, k + step) <= F.col("doc_id"), k + step).otherwise(k))

    def within(k: Column) -> Column:
        low, high = F.get(at, k).cast("double"), F.get(at, k + 1).cast("double")
        share = F.when(high > low, F.floor((F.col("doc_id").cast("double") - low) / (high - low) * each)).otherwise(F.lit(0))
        return (k.cast("long") * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), share))).cast("long")

    return F.when(F.col("doc_id").isNotNull(), let(stretch, within)).otherwise(F.lit(-1).cast("long"))


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, most_buckets: int = 200_000) -> DataFrame:
    """``docs`` (doc_id, text) with the sketch of the text, and next_text and next_sketch of the next row by descending doc_id.

    The ids are cut into ranges of about equally many rows, however they are spread, so neighbours meet
    in one shuffle of the rows and no task sorts everything; the head of each range is also sent to
    the range above it, which ends with it.  There are at most ``most_buckets`` ranges, which bounds
    what is broadcast (16 bytes each).  Rows that share an id follow each other in order of their text; null
    ids come last.
    """
    rows = docs.withColumn("bucket", id_ranges(docs, rows_per_bucket, most_buckets))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    # One row for each range: few enough for one task by the bound above.
    order = "ORDER BY bucket"
    targets = heads.select(
        F.col("bucket").alias("from"), "head",
        F.expr(f"coalesce(lead(bucket) OVER ({order}), first(bucket) OVER ({order}))").alias("target"),
    )
    guests = (
        rows.join(F.broadcast(targets), (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head")))
        .select("doc_id", "text", F.col("target").alias("bucket"), F.lit(1).alias("guest"))
    )
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).union(guests).withColumn("sketch", sketch(F.col("text")))
    over = "OVER (PARTITION BY bucket ORDER BY guest, doc_id DESC, text)"
    return both.select(
        "doc_id", "text", "sketch", "guest",
        F.expr(f"lead(text) {over}").alias("next_text"), F.expr(f"lead(sketch) {over}").alias("next_sketch"),
    ).where("guest = 0").drop("guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of every text and of its edited text, and how alike the next ones are.

    One row for each row of ``docs`` (columns doc_id and text; others are ignored).  A null text
    counts as empty; an empty text has the fingerprint ''.  A single row is its own next document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = with_next(base)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"), packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
