"""From the facts of a filing to one typed record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.functions.employee_block import employee_block
from payscope.operators.resolution import first_per_slot

# --- fixed values: elements of a filing and the contexts of the current year ---------------------
_ABOUT = "InformationAboutReportingCompanyInformationAboutEmployees"
ELEMENTS = {
    f"jpcrp_cor:AverageAnnualSalary{_ABOUT}": "avg_salary",
    f"jpcrp_cor:AverageAgeYears{_ABOUT}": "avg_age",
    f"jpcrp_cor:AverageLengthOfServiceYears{_ABOUT}": "avg_tenure",
    "jpcrp_cor:NumberOfEmployees": "employees",
    "jpdei_cor:SecurityCodeDEI": "sec_code",
    "jpdei_cor:EDINETCodeDEI": "edinet_code",
    "jpdei_cor:FilerNameInJapaneseDEI": "name",
    "jpdei_cor:CurrentFiscalYearEndDateDEI": "fy_end",
    "jpcrp_cor:InformationAboutEmployeesTextBlock": "text",
}
PAY_PHRASE = "平均年間給与"
_GROUP = ("CurrentYearInstant", "CurrentYearDuration", "FilingDateInstant")
_ALONE = ("CurrentYearInstant_NonConsolidatedMember", "CurrentYearDuration_NonConsolidatedMember")
# -------------------------------------------------------------------------------------------------
_FIGURES = ("avg_salary", "avg_age", "avg_tenure", "employees")
SLOTS = tuple(slot for name in ELEMENTS.values() for slot in ((name, f"{name}__nc") if name in _FIGURES else (name,)))


def slot_of(element: Column, context: Column, value: Column) -> Column:
    """Where a fact belongs: its name, with ``__nc`` if it is of the firm alone; null for other years and segments.
    A text block counts in any context, but only if it speaks of pay: a filing may have others before that."""
    name = F.element_at(F.create_map(*(F.lit(x) for pair in ELEMENTS.items() for x in pair)), element)
    return F.when(name == "text", F.when(value.contains(PAY_PHRASE), name)).when(context.isin(*_GROUP), name).when(context.isin(*_ALONE), F.concat(name, F.lit("__nc")))


def _figure(slot: Column) -> Column:
    return F.replace(slot, F.lit(","), F.lit("")).try_cast("double")


def records(facts: DataFrame) -> DataFrame:
    """One typed record for each filing of ``facts`` (path, seq, element, context, value).

    Figures of the firm alone go before those of the group.  What tags do not say is read from the
    text block, and ``candidates`` lists its readings of pay where it can be read in several ways.
    """
    slots = first_per_slot(facts.withColumn("slot", slot_of(F.col("element"), F.col("context"), F.col("value"))), "path", "slot", "value", "seq", SLOTS)
    either = lambda name: _figure(F.coalesce(F.col(f"{name}__nc"), F.col(name)))
    typed = slots.select(
        "path", "sec_code", "edinet_code", "name", "fy_end", "text", *(either(n).alias(n) for n in _FIGURES[:3]),
        _figure(F.col("employees__nc")).alias("alone"), _figure(F.col("employees")).alias("everybody"),
    )
    needed = (F.col("avg_salary").isNull() | (F.col("avg_salary") == 0) | F.col("avg_age").isNull() | (F.col("avg_age") == 0)) & F.col("text").isNotNull()
    read = typed.withColumn("b", employee_block(F.when(needed, F.col("text")), F.col("alone")))
    given = lambda name: F.when(F.col(name) != 0, F.col(name))
    found = F.col("b.avg_salary").isNotNull()
    return read.select(
        "path", F.substring("sec_code", 1, 4).alias("sec_code"), "edinet_code", "name", "fy_end",
        *(F.when(found, F.coalesce(given(n), F.col(f"b.{n}"))).otherwise(F.col(n)).alias(n) for n in _FIGURES[:3]),
        F.when(found, F.coalesce(given("alone"), F.col("b.employees"))).otherwise(F.col("alone")).alias("employees_nonconsolidated"), F.col("everybody").alias("employees_consolidated"),
        F.when(found, "textblock").otherwise("tag").alias("source"), F.col("b.candidates").alias("candidates"),
    )
