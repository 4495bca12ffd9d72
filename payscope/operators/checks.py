"""Checks and counts of a build, taken while its rows are written: one job, however many rules there are.

Rules are declared once.  Each adds what it must know to the rows (a partner, how often a key stands there), and all of them, with the
counts of the manifest, are metrics that Spark gathers as the rows pass by.  Afterwards nothing is read again.  The manifest is written last
and only if all rules hold, so rows without a manifest are those of a build that failed.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from payscope.operators.resolution import QualityError


@dataclasses.dataclass(frozen=True)
class Holds:
    """A condition of each row; null counts as broken."""

    name: str
    condition: Column


@dataclasses.dataclass(frozen=True)
class Unique:
    """No two rows share ``key``, nulls included."""

    name: str
    key: str


@dataclasses.dataclass(frozen=True)
class Matched:
    """``key`` stands in ``other`` as well; a null matches nothing."""

    name: str
    other: DataFrame
    key: str


@dataclasses.dataclass(frozen=True)
class Between:
    """An aggregate over all rows is within bounds, both included; None: no bound.  Null, as of no rows, counts as 0."""

    name: str
    value: Column
    least: float | None = None
    most: float | None = None


Rule = Holds | Unique | Matched | Between


class Build:
    """The counts and checks of one build; its rows are written once with ``write``."""

    def __init__(self) -> None:
        self._counts: dict[str, Observation] = {}
        self._checks: list[tuple[Observation, list[Rule]]] = []
        self.metrics: dict[str, int | float | str | None] = {}

    def counted(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows``, whose number will stand in the manifest under ``name``."""
        self._counts[name] = Observation(f"count-{name}-{id(self)}")
        return rows.observe(self._counts[name], F.count(F.lit(1)).alias("n"))

    def checked(self, rows: DataFrame, key: str, *rules: Rule) -> DataFrame:
        """``rows``, to be checked as they pass; ``key`` names a row in what is said of the first that is at fault."""
        columns, marked, broken = rows.columns, rows, []
        for k, rule in enumerate(rules):
            if isinstance(rule, Holds):
                marked = marked.withColumn(f"_fault{k}", ~F.coalesce(rule.condition, F.lit(False)))
            elif isinstance(rule, Unique):
                marked = marked.withColumn(f"_fault{k}", F.expr(f"count(*) OVER (PARTITION BY `{rule.key}`)") > 1)
            elif isinstance(rule, Matched):
                known = rule.other.select(F.col(rule.key)).where(F.col(rule.key).isNotNull()).distinct().withColumn(f"_known{k}", F.lit(True))
                marked = marked.join(known, rule.key, "left").withColumn(f"_fault{k}", F.col(f"_known{k}").isNull()).drop(f"_known{k}")
        for k, rule in enumerate(rules):
            if isinstance(rule, Between):
                broken.append(F.coalesce(rule.value, F.lit(0)).cast("double").alias(f"v{k}"))
            else:
                fault = F.col(f"_fault{k}")
                broken += [F.count_if(fault).alias(f"n{k}"), F.min(F.when(fault, F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias(f"first{k}")]
        seen = Observation(f"checks-{len(self._checks)}-{id(self)}")
        self._checks.append((seen, list(rules)))
        return marked.observe(seen, *broken).select(*columns)

    def faults(self, written: DataFrame) -> dict[str, str]:
        """What the rules found, once the rows have been ``written``; fills ``metrics`` with the counts and every rule's figure.

        Of a plan that Spark knows to be empty before it runs no metrics are gathered: its counts are 0.
        """
        found: dict[str, str] = {}
        none = {f"{c}{k}": 0 for c in "nv" for k in range(max([1, *(len(rules) for _, rules in self._checks)]))} | {"n": 0}

        def gathered(seen: Observation) -> Mapping:
            try:
                return seen.get
            except Exception:
                if written.isEmpty():
                    return none
                raise

        self.metrics = {name: gathered(seen)["n"] for name, seen in self._counts.items()}
        for seen, rules in self._checks:
            got = gathered(seen)
            for k, rule in enumerate(rules):
                if isinstance(rule, Between):
                    value = self.metrics[rule.name] = got[f"v{k}"]
                    if (rule.least is not None and value < rule.least) or (rule.most is not None and value > rule.most):
                        found[rule.name] = f"{value:g} is not within {rule.least} and {rule.most}"
                else:
                    self.metrics[rule.name] = got[f"n{k}"]
                    if got[f"n{k}"]:
                        found[rule.name] = f"{got[f'n{k}']} rows, the first is {got[f'first{k}']}"
        return found

    def write(self, rows: DataFrame, path: str) -> Mapping[str, int | float | str | None]:
        """Writes ``rows`` (Parquet) to ``path``/rows in one job, then the manifest to ``path``/manifest; an error that names all faults, and no
        manifest, if a rule is broken."""
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark = rows.sparkSession
        if found := self.faults(spark.read.schema(rows.schema).parquet(f"{path}/rows")):
            raise QualityError("; ".join(f"{name}: {what}" for name, what in found.items()))
        spark.createDataFrame([(name, float(value)) for name, value in self.metrics.items()], "name string, value double").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
        return self.metrics
