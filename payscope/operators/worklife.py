"""The work-life register: typed rows from positional text, what was dropped, and the join to companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.functions.text import number
from payscope.operators.resolution import join_by_key

#: Places of the wanted columns, from 1 (fixed values).
POSITIONS = {
    "name": 1, "corporate_number": 2, "overtime_scope": 128, "overtime_all": 129,
    **{f"overtime_unit{k + 1}": 132 + 2 * k for k in range(5)}, **{f"overtime_unit{k + 1}_value": 133 + 2 * k for k in range(5)},
    "leave_all": 143, **{f"leave_unit{k + 1}": 145 + 2 * k for k in range(5)}, **{f"leave_unit{k + 1}_value": 146 + 2 * k for k in range(5)},
    "gap_all": 206, "gap_regular": 207, "gap_nonregular": 208, "gap_note": 219, "gap_period": 220, "as_of": 223, "updated_at": 236,
}


def _units(kind: str) -> Column:
    """Up to five (unit, value); those with neither a name nor a number are left out."""
    all_ = F.array(*(F.struct(F.trim(F.col(f"{kind}_unit{k}")).alias("unit"), number(F.col(f"{kind}_unit{k}_value")).alias("value")) for k in range(1, 6)))
    return F.filter(all_, lambda u: (u["unit"] != "") | u["value"].isNotNull())


def normalized(raw: DataFrame, *keep: str) -> DataFrame:
    """Typed rows of the register, with the columns ``keep`` as they are.  Negative overtime can only be a slip and becomes null (see ``dropped``);
    leave above 100 percent and extreme wage gaps stay."""
    hours = number(F.col("overtime_all"))
    sane = lambda u: F.struct(u["unit"].alias("unit"), F.when(u["value"] >= 0, u["value"]).alias("value"))
    text = lambda c: F.trim(F.col(c)).alias(c)
    return raw.select(
        text("corporate_number"), text("name"), F.when(hours >= 0, hours).alias("overtime_all"), text("overtime_scope"),
        F.transform(_units("overtime"), sane).alias("overtime_units"), number(F.col("leave_all")).alias("leave_all"), _units("leave").alias("leave_units"),
        *(number(F.col(c)).alias(c) for c in ("gap_all", "gap_regular", "gap_nonregular")), *map(text, ("gap_period", "gap_note", "as_of", "updated_at")), *keep,
    )


def dropped(raw: DataFrame) -> DataFrame:
    """(corporate_number, name, field, raw) of the values that ``normalized`` takes out."""
    hours = F.struct(F.lit("overtime_all").alias("field"), F.trim("overtime_all").alias("raw"), number(F.col("overtime_all")).alias("v"))
    units = F.transform(_units("overtime"), lambda u: F.struct(F.concat(F.lit("overtime_unit:"), u["unit"]).alias("field"), u["value"].cast("string").alias("raw"), u["value"].alias("v")))
    bad = F.filter(F.concat(F.array(hours), units), lambda x: x["v"] < 0)
    return raw.select(F.trim("corporate_number").alias("corporate_number"), F.trim("name").alias("name"), F.explode(bad).alias("x")).select("corporate_number", "name", "x.field", "x.raw")


def has_metric() -> Column:
    """Whether a row has any of the three figures; zero counts."""
    some = lambda units: F.exists(units, lambda u: u["value"].isNotNull())
    return F.col("overtime_all").isNotNull() | some("overtime_units") | F.col("leave_all").isNotNull() | some("leave_units") | F.col("gap_all").isNotNull()


def joined(companies: DataFrame, raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Companies with the newest register row of their number, if it has any figure.  ``raw`` has ``seq``, its order."""
    rows = normalized(raw, seq).withColumnRenamed("name", "register_name")
    return join_by_key(companies, rows, "corporate_number", "updated_at", seq).where(has_metric()).drop(seq)


def fill_rates(rows: DataFrame) -> DataFrame:
    """How many rows have each figure, in total or for some unit."""
    some = lambda c, units: F.count_if(F.col(c).isNotNull() | F.exists(units, lambda u: u["value"].isNotNull()))
    return rows.agg(
        some("overtime_all", "overtime_units").alias("overtime"), some("leave_all", "leave_units").alias("leave"), F.count("gap_all").alias("gap"),
        F.count_if(F.col("gap_note") != "").alias("note"), F.count("*").alias("n"),
    )
