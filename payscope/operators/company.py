"""What is shown of one company: neighbours, milestones, jumps, sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope import constants as C
from payscope.functions import model
from payscope.functions.text import ten_thousands
from payscope.operators.ranking import competition_ranks, rows_ahead
from payscope.operators.statistics import nearest_rank, population, scale_of

#: Pays of an industry that are ordered together.
CHUNK = 4096


def neighbours(rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, basis, neighbour_id, neighbour_salary, gap, industry_rank, place): the k companies of the industry and
    basis with the nearest pay; of ties the higher paid, then the first by row_idx.

    The rows of an industry are ordered once by pay; the nearest k lie within k distinct pays above
    and k below, so each row is compared with those and never with its whole industry.  An id has one row in a basis.
    """
    ranked = competition_ranks(rows, "salary", ["basis", "tse33"], "industry_rank")
    # Of rows with equal pay only the first k + 1 by row_idx can be someone's neighbours.
    pays = ranked.groupBy("basis", "tse33", "salary", "industry_rank").agg(F.slice(F.sort_array(F.collect_set(F.struct("row_idx", "id"))), 1, k + 1).alias("own"))
    # Chunks of a group by the places of its pays, with k pays of both sides beside them.
    placed = rows_ahead(pays.select("basis", "tse33", "salary"), "salary", ["basis", "tse33"])
    at, chunk = F.col("_ahead") % CHUNK, F.floor(F.col("_ahead") / CHUNK)
    chunks = F.array_compact(F.array(chunk, F.when(at < k, chunk - 1), F.when(at >= CHUNK - k, chunk + 1)))
    dealt = pays.join(placed, ["basis", "tse33", "salary"]).withColumn("_own", chunk).withColumn("_chunk", F.explode(chunks))
    order = "PARTITION BY basis, tse33, _chunk ORDER BY salary"
    near = F.expr(f"collect_list(struct(salary, industry_rank, own)) OVER ({order} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)")
    each = "flatten(transform(near, n -> transform(n.own, o -> struct(abs(n.salary - salary) AS gap, -n.salary AS less, o.row_idx AS i, o.id AS id, n.salary AS s, n.industry_rank AS r))))"
    # One more than k, as a row may be among them itself.
    around = dealt.withColumn("near", near).where("_own = _chunk").select("basis", "tse33", "salary", F.expr(f"slice(array_sort({each}), 1, {k + 1})").alias("near"))
    joined = rows.select("id", "basis", "tse33", "salary").join(around, ["basis", "tse33", "salary"])
    nearest = F.expr(f"slice(filter(near, n -> n.id <> id), 1, {k})")
    return joined.select("id", "basis", F.posexplode(nearest).alias("at", "n")).select(
        "id", "basis", F.col("n.id").alias("neighbour_id"), F.col("n.s").alias("neighbour_salary"), F.col("n.gap").alias("gap"), F.col("n.r").alias("industry_rank"), (F.col("at") + 1).alias("place")
    )


def view(rows: DataFrame) -> DataFrame:
    """Each company and basis with its ranks, shares, deviation, difference from the mean and histogram bin."""
    # The distinct pays of an industry with their counts, shuffled once: ranks, sizes and quantiles are all of them.
    pays = rows.groupBy("basis", "tse33", "salary").agg(F.count("*").alias("_rows"))
    rank = lambda group, name: rows_ahead(pays, "salary", group, "_rows").select(*group, "salary", (F.col("_ahead") + 1).cast("long").alias(name))
    sizes = pays.groupBy("basis", "tse33").agg(F.sum("_rows").alias("industry_n"))
    quantiles = nearest_rank(pays, {"q02": 0.02, "q95": 0.95, "median": 0.5}, weight="_rows")
    people = population(rows).join(quantiles.select("basis", "median"), "basis").join(scale_of(quantiles), "basis")
    places = rank(["basis", "tse33"], "rank_industry").join(rank(["basis"], "rank_all"), ["basis", "salary"]).join(sizes, ["basis", "tse33"])
    out = rows.join(places, ["basis", "tse33", "salary"]).join(F.broadcast(people), "basis")  # nine rows
    return out.select(
        "id", "basis", "salary", "rank_all", "rank_industry", "industry_n", "mean", "median",
        F.round(model.top_percent(F.col("rank_all"), F.col("n")), 6).alias("top_percent"),
        F.round(model.position_percent(F.col("rank_all"), F.col("n")), 6).alias("position_percent"),
        F.round(model.deviation(F.col("salary"), F.col("mean"), F.col("sd")), 6).alias("deviation"),
        (F.col("salary") - F.col("mean")).alias("from_mean"),
        model.bin_of(F.col("salary"), F.col("low"), F.col("width")).alias("bin"),
    )


def milestones(rows: DataFrame, most: int = 3) -> DataFrame:
    """(id, basis, milestone): the highest round sum first reached at each age, of which the first, the
    middle and the last are kept.  The first age sets the level and crosses nothing."""
    value = rows.where("basis > 0").withColumn("v", ten_thousands(F.col("salary")))
    steps = F.array(*map(F.lit, C.MILESTONES))
    before = value.withColumn("before", F.expr("max(v) OVER (PARTITION BY id ORDER BY basis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).withColumn("steps", steps)
    crossed = before.withColumn("milestone", F.expr("array_max(filter(steps, s -> s > before AND s <= v))")).where("milestone IS NOT NULL")
    placed = crossed.withColumns({"place": F.expr("row_number() OVER (PARTITION BY id ORDER BY basis) - 1"), "n": F.expr("count(*) OVER (PARTITION BY id)")})
    return placed.where(F.expr(f"n <= {most} OR place IN (0, (n - 1) DIV 2, n - 1)")).select("id", "basis", "milestone")


def largest_jump(rows: DataFrame) -> DataFrame:
    """(id, from_age, jump): the largest rise from one target age to the next, the first of ties."""
    following = rows.where("basis > 0").withColumn("jump", F.expr("lead(salary) OVER (PARTITION BY id ORDER BY basis) - salary")).where("jump IS NOT NULL")
    return following.groupBy("id").agg(F.max(F.struct("jump", (-F.col("basis")).alias("b"))).alias("m")).select("id", (-F.col("m.b")).alias("from_age"), F.col("m.jump").alias("jump"))


def fit_summary(companies: DataFrame) -> DataFrame:
    """How far pay lies above its curve: quantiles of pay / curve at the mean age, and who is highest."""
    level = model.with_curve_values(companies, {"level": F.col("avg_age")})
    rounded = level.withColumn("premium", F.round(F.col("avg_salary") / F.col("level"), 6))
    quantiles = nearest_rank(rounded.withColumn("basis", F.lit(0)), {"median": 0.5, "p90": 0.9}, ["basis"], "premium", 0.001)
    top = rounded.agg(F.max(F.struct("premium", (-F.col("row_idx")).alias("r"), "id")).alias("m")).select(F.col("m.premium").alias("most"), F.col("m.id").alias("most_id"))
    return quantiles.drop("basis").crossJoin(F.broadcast(top))  # one row each


def extrapolation(companies: DataFrame) -> DataFrame:
    """(age, distance): the mean distance of the target age from the companies' mean ages."""
    each = companies.select("avg_age", F.explode(F.array(*map(F.lit, C.TARGET_AGES))).alias("age"))
    return each.groupBy("age").agg(F.round(F.avg(F.abs(F.col("age") - F.col("avg_age"))), 6).alias("distance"))
