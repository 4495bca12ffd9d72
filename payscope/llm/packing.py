"""Packing by optimal length buckets (operator 4).

The lengths of all documents are counted in one histogram; a dynamic program chooses the bucket
boundaries that waste the fewest padding tokens; inside each bucket documents are numbered across
the cluster and cut into batches of a token budget.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import SPACE, materialize

ROWS_PER_SHARD = 20_000


def optimal_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding; of equal ones the fewest buckets.

    ``lengths``: ascending, each with its count.  A bucket from i + 1 to j pads to lengths[j], so its cost is
    lengths[j] * (n[j] - n[i]) - (t[j] - t[i]) over the prefix counts n and tokens t.  For fixed i that is a line in
    lengths[j] whose slope falls with i: each added bucket is one walk along the lower hull of those lines, in exact
    integers.
    """
    m = len(lengths)
    if not m:
        return []
    lengths = [int(x) for x in lengths]
    n = [0, *itertools.accumulate(int(c) for c in counts)]
    t = [0, *itertools.accumulate(x * int(c) for x, c in zip(lengths, counts, strict=True))]
    best = [lengths[j] * n[j + 1] - t[j + 1] for j in range(m)]  # one bucket up to each length
    back: list[list[int]] = []
    for _ in range(min(buckets, m) - 1):
        after, choice = best.copy(), [-1] * m
        hull: list[tuple[int, int, int]] = []  # slope, height and i of each line, from the left
        at = 0
        for j in range(1, m):
            slope, height = -n[j], best[j - 1] + t[j]
            # A line goes if its neighbours meet below it.
            while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - slope) >= (height - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((slope, height, j - 1))
            at = min(at, len(hull) - 1)
            x = lengths[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            low = lengths[j] * n[j + 1] - t[j + 1] + hull[at][0] * x + hull[at][1]
            if low < after[j]:
                after[j], choice[j] = low, hull[at][2]
        if after[-1] == best[-1]:
            break
        back.append(choice)
        best = after
    bounds, j = [lengths[-1]], m - 1
    for choice in reversed(back):
        if choice[j] < 0:
            break
        j = choice[j]
        bounds.append(lengths[j])
    return bounds[::-1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1))), F.lit(0)).cast("long")


def pack_documents(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, tokens: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_tokens, batch, slot): one row for each row of ``docs``.

    ``tokens``: the length of a document (its words if None; a null text or length has none).  Every document
    is padded to ``padded_tokens``, the greatest length of its bucket; a batch of a bucket holds
    max(1, token_budget // padded_tokens) documents and only a bucket's last batch holds fewer.
    All distinct lengths reach the driver with their counts, as many rows as the longest document has tokens at
    most, whatever the number of documents.  Nothing is cut or dropped: a document over the budget is a
    batch of its own.  Null ids are one more id; rows that repeat get a place each.
    """
    n = (word_count(F.col("text").cast("string")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("n_tokens")
    each = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n), "packing-lengths")
    rows = sorted((r["n_tokens"], r["count"]) for r in each.groupBy("n_tokens").count().collect())
    bounds = optimal_bounds(*zip(*rows, strict=True), buckets) if rows else []
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    padded = F.element_at(F.array(*map(F.lit, bounds or [0])), F.col("bucket") + 1).cast("long")
    shards = max(1, -(-sum(n for _, n in rows) // ROWS_PER_SHARD))
    # Rows of equal id and length are one row with a count until their places are known.
    alike = each.groupBy("doc_id", "n_tokens").count()
    dealt = alike.withColumns({"bucket": bucket.cast("int"), "shard": F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int")})
    # One row for each bucket and shard; the shards of a bucket follow each other.
    ahead = dealt.groupBy("bucket", "shard").agg(F.sum("count").alias("own")).select(
        "bucket", "shard", F.expr("sum(own) OVER (PARTITION BY bucket ORDER BY shard) - own").alias("ahead")
    )
    within = F.expr("sum(count) OVER (PARTITION BY bucket, shard ORDER BY doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - count")
    numbered = dealt.withColumn("within", within).join(ahead, ["bucket", "shard"])
    place = F.explode(F.sequence(F.col("ahead") + F.col("within"), F.col("ahead") + F.col("within") + F.col("count") - 1))
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_tokens"), F.lit(1)))).cast("long")
    return (
        numbered.withColumn("padded_tokens", padded)
        .withColumn("room", room)
        .select("*", place.alias("place"))
        .select("doc_id", "n_tokens", "bucket", "padded_tokens", F.floor(F.col("place") / F.col("room")).cast("long").alias("batch"), (F.col("place") % F.col("room")).cast("int").alias("slot"))
    )
