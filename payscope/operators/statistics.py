"""Statistics of a population: quantiles, histograms, modes, correlation, regression, overlaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.operators.ranking import CELL, cell_of, positions


def population(rows: DataFrame, group: Sequence[str] = ("basis",), value: str = "salary") -> DataFrame:
    """Count, mean (half up) and population standard deviation of each group."""
    return rows.groupBy(*group).agg(
        F.count(value).alias("n"), model.half_up(F.avg(value)).alias("mean"), F.round(F.stddev_pop(value), 3).alias("sd")
    )


def nearest_rank(rows: DataFrame, shares: dict[str, float], group: Sequence[str] = ("basis",), value: str = "salary", width: float = CELL, weight: str | None = None) -> DataFrame:
    """For each share p the member at place floor(n * p) from below, counted from 0; n - 1 at most.

    Distinct values are counted, then cells of ``width`` of them (a few thousand for each group); only
    the cells that hold a wanted place are looked into, so no group is ever sorted as a whole.  ``weight``: how
    many rows each one stands for.
    """
    values = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(weight) if weight else F.count("*")).alias("_c")).withColumn("_cell", cell_of(F.col(value), width))
    over = f"PARTITION BY {', '.join(group)}" if group else ""
    cells = values.groupBy(*group, "_cell").agg(F.sum("_c").alias("_m"))
    placed = cells.withColumns({"_n": F.expr(f"sum(_m) OVER ({over})"), "_below": F.expr(f"sum(_m) OVER ({over} ORDER BY _cell) - _m")})
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p)))
    wanted = reduce(lambda x, y: x | y, ((at(p) >= F.col("_below")) & (at(p) < F.col("_below") + F.col("_m")) for p in shares.values()))
    inside = values.join(placed.where(wanted).drop("_m"), [*group, "_cell"])
    upto = inside.withColumn("_upto", F.expr(f"_below + sum(_c) OVER (PARTITION BY {', '.join((*group, '_cell'))} ORDER BY {value})"))
    return upto.groupBy(*group).agg(*(F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()))


def scale_of(ends: DataFrame, group: Sequence[str] = ("basis",)) -> DataFrame:
    """(group, low, width) from the quantiles q02 and q95; see ``histogram_scale``."""
    span = F.col("q95") - F.col("q02")
    width = F.lit(C.BIN_LADDER[-1] * 10_000)
    for w in reversed(C.BIN_LADDER[:-1]):
        width = F.when(span <= F.lit(C.BINS * w * 10_000), F.lit(w * 10_000)).otherwise(width)
    return ends.withColumn("width", width.cast("long")).select(*group, (F.floor(F.col("q02") / F.col("width")) * F.col("width")).cast("long").alias("low"), "width")


def histogram_scale(rows: DataFrame, group: Sequence[str] = ("basis",), value: str = "salary") -> DataFrame:
    """(group, low, width) of the adaptive histogram: the narrowest of the fixed widths of which nine hold
    the span from the 2nd to the 95th percentile; the lowest bin starts at a multiple of it."""
    return scale_of(nearest_rank(rows, {"q02": 0.02, "q95": 0.95}, group, value), group)


def histogram(rows: DataFrame, group: Sequence[str] = ("basis",), value: str = "salary") -> DataFrame:
    """(group, bin, low, width, n) for all nine bins, empty ones too."""
    scale = histogram_scale(rows, group, value)
    counted = rows.where(F.col(value).isNotNull()).join(scale, [*group]).groupBy(*group, model.bin_of(F.col(value), F.col("low"), F.col("width")).alias("bin")).agg(F.count("*").alias("n"))
    full = scale.select("*", F.explode(F.sequence(F.lit(0), F.lit(C.BINS - 1))).alias("bin"))
    return full.join(counted, [*group, "bin"], "left").select(*group, "bin", "low", "width", F.coalesce("n", F.lit(0)).alias("n"))


def majority(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, total) of the most frequent value, the greater of ties; an error unless it is over half."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct("n", value)).alias("m"), F.sum("n").alias("total")).where("m IS NOT NULL")
    half = F.when(2 * F.col("m.n") > F.col("total"), F.col("m.n")).otherwise(F.raise_error(F.lit("no value makes the majority")).cast("long"))
    return best.select(F.col(f"m.{value}").alias(value), half.alias("n"), "total")


def dense_counts(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of each member of ``dimension``, zero where there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spearman(rows: DataFrame, a: str, b: str, ties: Sequence[str]) -> DataFrame:
    """Rank correlation (rho, n) of two columns by places without ties; null for fewer than two rows."""
    placed = positions(positions(rows.select(a, b, *ties), a, ties, name="_a"), b, ties, name="_b")
    d = (F.col("_a") - F.col("_b")).cast("double")
    n = F.col("n").cast("double")
    return placed.agg(F.sum(d * d).alias("s"), F.count("*").alias("n")).select(
        F.when(n > 1, F.round(1 - 6 * F.col("s") / (n * (n * n - 1)), 9)).alias("rho"), "n"
    )


def top_overlap(rows: DataFrame, a: str, b: str, ties: Sequence[str], k: int = 50) -> DataFrame:
    """How many of the first k by ``a`` are among the first k by ``b``."""
    top = lambda c: rows.orderBy(F.desc(c), *ties).limit(k).select(*ties)
    return top(a).join(F.broadcast(top(b)), [*ties], "left_semi").agg(F.count("*").alias("shared"))  # k rows


def top_churn(rows: DataFrame, a: str, b: str, ties: Sequence[str], k: int = 50) -> DataFrame:
    """(side, ties): who is among the first k by ``a`` only (left) or by ``b`` only (entered)."""
    top = lambda c: rows.orderBy(F.desc(c), *ties).limit(k).select(*ties)
    only = lambda x, y, side: top(x).join(F.broadcast(top(y)), [*ties], "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "entered"))  # k rows each


def local_linear(points: DataFrame, x: str, y: str, first: int = C.FIT_AGES[0], last: int = C.FIT_AGES[1], bandwidth: float = C.FIT_BANDWIDTH) -> DataFrame:
    """(age, level): local linear regression with a Gaussian kernel of ln(y) at each whole age; no rows
    for fewer than 50 points.  One pass: each grid age is a set of sums with partial aggregation."""
    ages = range(first, last + 1)
    logs = points.select(F.col(x).cast("double").alias("x"), F.log(F.col(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    each = logs.select("x", "y", F.explode(F.array(*map(F.lit, ages))).alias("age"))
    u = F.col("x") - F.col("age")
    w = F.exp(-0.5 * (u / bandwidth) * (u / bandwidth))
    s = each.groupBy("age").agg(
        F.sum(w).alias("s0"), F.sum(w * u).alias("s1"), F.sum(w * u * u).alias("s2"), F.sum(w * F.col("y")).alias("t0"), F.sum(w * u * F.col("y")).alias("t1"), F.count("*").alias("n")
    )
    den = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    level = F.when(F.abs(den) < 1e-12, F.col("t0") / F.col("s0")).otherwise((F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / den)
    return s.where(F.col("n") >= C.FIT_LEAST_POINTS).select("age", F.round(level, 6).alias("level"))


def fitted_factors(levels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (from_age, to_age) with exp of the difference of their fitted levels; ages are moved into the fitted range."""
    inside = lambda c: F.greatest(F.lit(C.FIT_AGES[0]), F.least(F.lit(C.FIT_AGES[1]), F.round(c))).cast("int")
    at = lambda name: levels.select(F.col("age").alias(f"_{name}"), F.col("level").alias(f"_level_{name}"))
    # thirty rows each
    keyed = pairs.withColumns({"_a": inside(F.col("from_age")), "_b": inside(F.col("to_age"))}).join(F.broadcast(at("a")), "_a").join(F.broadcast(at("b")), "_b")
    return keyed.withColumn("factor", F.round(F.exp(F.col("_level_b") - F.col("_level_a")), 6)).drop("_a", "_b", "_level_a", "_level_b")


def _sides(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted numbers of ``y``, and the sets of its least 0, 1, ... members as bits; what is no number is in none."""
    order = np.argsort(y, kind="stable")[: np.count_nonzero(~np.isnan(y))]
    one = np.zeros((len(order) + 1, -(-len(y) // 64) * 8), np.uint8)
    one[np.arange(1, len(order) + 1), order >> 3] = 1 << (order & 7)
    return y[order], np.bitwise_or.accumulate(one.view(np.uint64), axis=0)


def _swapped(x: np.ndarray, y: np.ndarray, same: bool, step: int = 1024) -> tuple[int, int]:
    """Pairs of a row of ``x`` and one of ``y`` (order, values...), and how many of them are swapped; ``same``: each two rows once."""
    pairs = swapped = 0
    for low in range(0, len(y), step):
        part = y[low : low + step]
        sides = [_sides(part[:, k]) for k in range(part.shape[1])]
        every = _sides(np.zeros(len(part)))[1][-1]
        for at in range(0, len(x), step):
            own = x[at : at + step]

            def below_and_above(k: int, own: np.ndarray = own, sides: list = sides) -> tuple[np.ndarray, np.ndarray]:
                numbers, sets = sides[k]
                nan = np.isnan(own[:, k])
                first, last = (np.searchsorted(numbers, own[:, k], side) for side in ("left", "right"))
                first[nan], last[nan] = 0, len(numbers)
                return sets[first], sets[-1] ^ sets[last]

            earlier = below_and_above(0)[1]  # the row of x comes first by the order
            below, above = below_and_above(1)
            all_below, any_below, all_above, any_above = below, below.copy(), above, above.copy()
            for k in range(2, part.shape[1]):
                below, above = below_and_above(k)
                all_below &= below
                any_below |= below
                all_above &= above
                any_above |= above
            differs = (earlier & any_below & ~all_below) | (~earlier & any_above & ~all_above)
            counted = earlier if same else every
            pairs += int(np.bitwise_count(counted).sum()) * (1 if same else len(own))
            swapped += int(np.bitwise_count(differs & counted).sum())
    return pairs, swapped


def swapped_pairs(rows: DataFrame, values: Sequence[str], group: str, order: str) -> DataFrame:
    """(pairs, swapped, percent): pairs of one group whose order by any of ``values`` differs from that by the first.

    All pairs of a group are the feature here.  They are made in blocks of about 8192 by 8192 rows, so a large group spreads over
    many tasks and only counts leave them.  Whom a row is above is a set of bits, taken by its place among the sorted
    rows of the other side; sets are compared, not pairs.
    """
    block, width = 8192, 1 + len(values)
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    tile = F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int")
    base = rows.join(sizes, group).withColumn("_tile", tile)
    cells = F.array(*(F.col(c).cast("double") for c in (order, *values)))
    packed = base.groupBy(group, "_tile", "_blocks").agg(F.flatten(F.collect_list(cells)).alias("_rows"))  # about `block` rows
    left = packed.select(group, "_tile", "_rows", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    right = packed.select(group, F.col("_tile").alias("_other"), F.col("_rows").alias("_others"))
    both = left.where("_tile <= _other").join(right, [group, "_other"]).select((F.col("_tile") == F.col("_other")).alias("same"), "_rows", "_others")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(*(batch.column(k) for k in range(3)), strict=True):
                x, y = (np.asarray(v.values).reshape(-1, width) for v in (a, b))
                pairs, swapped = _swapped(x, y, same.as_py())
                yield pa.record_batch([pa.array([pairs]), pa.array([swapped])], names=["pairs", "swapped"])

    out = both.mapInArrow(compare, "pairs long, swapped long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("swapped"), F.lit(0)).alias("swapped"))
    return out.select("pairs", "swapped", F.when(F.col("pairs") > 0, F.round(F.col("swapped") / F.col("pairs") * 100, 6)).otherwise(F.lit(0.0)).alias("percent"))


def movement(rows: DataFrame, before: str = "rank_raw", after: str = "rank_adj", far: int = 50) -> DataFrame:
    """(n, mean_move, median_move, far, risen, fallen): how places move between two orders."""
    moved = rows.select(F.abs(F.col(before) - F.col(after)).alias("d"), (F.col(before) - F.col(after)).alias("up"))
    return moved.agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_move"), F.median("d").alias("median_move"), F.count_if(F.col("d") >= far).alias("far"),
        F.count_if(F.col("up") > 0).alias("risen"), F.count_if(F.col("up") < 0).alias("fallen"),
    )


def movers(rows: DataFrame, k: int = 15, before: str = "rank_raw", after: str = "rank_adj") -> DataFrame:
    """The ``k`` that rise most and the ``k`` that fall most: (side, place, id, move), ties by id."""
    moved = rows.select("id", (F.col(before) - F.col(after)).alias("move"))
    top = lambda side, order: moved.orderBy(order, "id").limit(k).withColumns({"side": F.lit(side), "place": F.expr(f"row_number() OVER (ORDER BY {'-move' if side == 'up' else 'move'}, id)")})
    return top("up", F.desc("move")).unionByName(top("down", F.asc("move")))  # k rows each
