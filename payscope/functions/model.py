"""Column expressions of the pay model.  All stay in the JVM and in whole-stage code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope import constants as C


def half_up(x: Column) -> Column:
    """Rounded to a long, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def clamped(x: Column, points: Sequence[float] = C.AGE_POINTS) -> Column:
    """``x`` moved inside the points; null for a null ``x``."""
    return F.when(x < points[0], F.lit(float(points[0]))).when(x > points[-1], F.lit(float(points[-1]))).otherwise(x.cast("double"))


def segment(x: Column, points: Sequence[float] = C.AGE_POINTS) -> Column:
    """Between which two points a clamped ``x`` lies: the number of the lower one."""
    return sum((F.when(x >= p, 1).otherwise(0) for p in points[1:-1]), F.lit(0))


def on_segment(x: Column, k: Column, values: Column, points: Sequence[float] = C.AGE_POINTS) -> Column:
    """The value at a clamped ``x`` of the ``k``-th segment of the line through (points, values: an array)."""
    at = F.array(*(F.lit(float(p)) for p in points))
    low = F.get(values, k)
    slope = (F.get(values, k + 1) - low) * (x - F.get(at, k)) / (F.get(at, k + 1) - F.get(at, k))
    return F.when(x >= points[-1], F.get(values, F.lit(len(points) - 1))).otherwise(low + slope)


def with_curve_values(rows: DataFrame, ages: Mapping[str, Column], values: str = "curve", points: Sequence[float] = C.AGE_POINTS) -> DataFrame:
    """``rows`` with the value of the curve (an array column) at each of ``ages``, under its name: piecewise
    linear, level beyond both ends.  Steps that are used more than once are columns of their own, which
    keeps the generated code small."""
    inside = rows.withColumns({f"_x_{name}": clamped(age, points) for name, age in ages.items()})
    placed = inside.withColumns({f"_k_{name}": segment(F.col(f"_x_{name}"), points) for name in ages})
    out = placed.withColumns({name: on_segment(F.col(f"_x_{name}"), F.col(f"_k_{name}"), F.col(values), points) for name in ages})
    return out.drop(*(f"_{s}_{name}" for s in "xk" for name in ages))


def in_yen(curve: Column) -> Column:
    return F.transform(curve, lambda v: v * F.lit(1000.0))


def age_factor(base: Column, target: Column) -> Column:
    """target / base; null unless the base is positive."""
    return F.when(base > 0, target / base)


def estimate_pay(salary: Column, age: Column, target: Column, at_age: Column, at_target: Column, anchor: Column) -> Column:
    """Pay at age ``target`` of a firm that pays ``salary`` at its mean ``age``, half up, as a long.

    ``at_age``, ``at_target`` and ``anchor`` are the curve's values at the mean age, the target and 22.
    Above the mean age pay grows as the curve does.  Below, the line from the anchor to the firm's
    pay is followed, unless the firm pays no more than the anchor.  Null without a positive ``at_age``.
    """
    ratio = salary * (at_target / at_age)
    span = at_age - anchor
    line = anchor + (salary - anchor) * (at_target - anchor) / span
    pay = F.when((target > age) | (span <= 0) | (salary <= anchor), ratio).otherwise(line)
    return F.when(at_age > 0, half_up(pay))


def with_estimates(rows: DataFrame, targets: Mapping[str, Column]) -> DataFrame:
    """``rows`` (avg_salary, avg_age, curve) with a column of pay for each target age.

    The curve's values are columns of their own first, so they are computed once for all targets.
    """
    salary, age = F.col("avg_salary"), F.col("avg_age")
    known = with_curve_values(rows, {"_age": age} | {f"_at_{name}": target for name, target in targets.items()})
    known = known.withColumn("_anchor", F.get(F.col("curve"), F.lit(0)))
    pays = {name: estimate_pay(salary, age, target, F.col("_age"), F.col(f"_at_{name}"), F.col("_anchor")) for name, target in targets.items()}
    return known.withColumns(pays).drop("_age", "_anchor", *(f"_at_{name}" for name in targets))


def industry_of(sector: Column) -> Column:
    """The wage survey's industry of a sector of the exchange."""
    table = F.create_map(*(F.lit(x) for pair in C.SECTOR_INDUSTRY.items() for x in pair))
    return F.coalesce(F.element_at(table, F.trim(sector)), F.lit(C.ALL_INDUSTRIES))


def employee_bucket(employees: Column) -> Column:
    return F.when(employees < 300, "-300").when(employees < 1000, "300-1000").otherwise("1000-")


def tenure_bucket(tenure: Column) -> Column:
    return F.when(tenure < 13, "-13").when(tenure < 17, "13-17").otherwise("17-")


def age_bucket(age: Column) -> Column:
    return F.when(age < 40, "-40").when(age < 43, "40-43").otherwise("43-")


def staff_ratio(alone: Column, group: Column) -> Column:
    """Share of the group's people in the firm itself, four decimals; null without a group."""
    return F.when(group > 0, F.round(alone / group, 4))


def badge(ratio: Column) -> Column:
    return F.when(ratio.isNull() | (ratio >= 0.1), "").otherwise("本社のみ")


def holding_flag(ratio: Column, group: Column) -> Column:
    return F.coalesce((ratio < 0.1) & (group >= 500), F.lit(False))


def age_outlier(age: Column) -> Column:
    return ~age.between(28, 55)


def deviation(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, F.lit(50.0) + F.lit(10.0) * (x - mean) / sd).otherwise(F.lit(50.0))


def top_percent(rank: Column, count: Column) -> Column:
    return F.when(count > 0, rank / count * 100).otherwise(F.lit(0.0))


def position_percent(rank: Column, count: Column) -> Column:
    return F.when(count > 1, (count - rank) / (count - 1) * 100).otherwise(F.lit(0.0))


def estimate_range(x: Column) -> tuple[Column, Column]:
    """Twenty percent below and above."""
    return x * 0.8, x * 1.2


def bin_of(x: Column, low: Column, width: Column) -> Column:
    """0 to 8; what lies outside goes to the end bins."""
    return F.greatest(F.lit(0), F.least(F.lit(C.BINS - 1), F.floor((x - low) / width))).cast("int")


def bar_percent(x: Column, most: Column) -> Column:
    """Length of a bar, 0 to 100 with one decimal; null without a positive maximum."""
    return F.when(most > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x / most * 100)), 1))


def mean_marker(mean: Column, most: Column) -> Column:
    """Where the mean lies on a bar whose end is ``most``, as ``bar_percent``; null beyond its end."""
    return F.when(mean <= most, bar_percent(mean, most))


def repaired_pay(salary: Column, employees: Column) -> Column:
    """Pay that is off by a power of ten, brought into bounds; null if no power does."""
    ceiling = F.when(F.coalesce(employees, F.lit(0)) >= C.REPAIR_STAFF, C.REPAIR_CEILING).otherwise(C.REPAIR_CEILING_SMALL)
    fits = lambda x: x.between(F.lit(C.REPAIR_FLOOR), ceiling)
    up = F.coalesce(*(F.when(fits(salary * f), salary * f) for f in C.REPAIR_FACTORS))
    down = F.coalesce(*(F.when(fits(salary / f), salary / f) for f in C.REPAIR_FACTORS))
    return F.when(fits(salary), salary).when(salary < C.REPAIR_FLOOR, up).otherwise(down)


def plausible(salary: Column, age: Column) -> Column:
    return F.coalesce(age.between(20, 65) & (salary > 1_000_000), F.lit(False))


def nearest_candidate(candidates: Column, reference: Column) -> Column:
    """The candidate whose logarithm is nearest to the reference's; the first of ties."""
    ranked = F.transform(candidates, lambda v, i: F.struct(F.abs(F.log(v / reference)).alias("d"), i.alias("i"), v.alias("v")))
    return F.array_min(ranked)["v"]
