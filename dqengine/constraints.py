"""Constraints: an analyzer, an assertion on its metric, and what it says of single rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.assertions import IS_ONE, as_column
from dqengine.errors import EmptyStateError
from dqengine.metrics import Distribution, Metric
from dqengine.operators import scan
from dqengine.operators.base import Analyzer, AnalyzerOptions, FilteredRow, NullBehavior
from dqengine.operators.frequency import FrequencyAnalyzer


class ConstraintStatus(str, Enum):
    SUCCESS = "Success"
    FAILURE = "Failure"


class ConstrainableDataTypes(str, Enum):
    NULL = "Null"
    FRACTIONAL = "Fractional"
    INTEGRAL = "Integral"
    BOOLEAN = "Boolean"
    STRING = "String"
    NUMERIC = "Numeric"


@dataclass
class ConstraintResult:
    constraint: Constraint
    status: ConstraintStatus
    message: str | None = None
    metric: Metric | None = None


class RowLevel(str, Enum):
    """How rows are judged: by a boolean column, by the assertion on a value, or by the row's group."""

    NONE = "none"
    BOOLEAN = "boolean"
    ASSERTED = "asserted"
    GROUPED = "grouped"


# What failed constraints say.
MISSING_ANALYSIS = "Missing Analysis, can't run the constraint!"
PROBLEMATIC_PICKER = "Can't retrieve the value to assert on"
ASSERTION_EXCEPTION = "Can't execute the assertion"


@dataclass(frozen=True)
class Constraint:
    """Evaluated on the metric of its analyzer; name is how results show it."""

    analyzer: Analyzer
    assertion: Callable[[Any], bool]
    name: str
    picker: Callable[[Any], Any] | None = None
    hint: str | None = None
    row_level: RowLevel = RowLevel.NONE
    row_column: str | None = None
    options: AnalyzerOptions | None = field(default=None, compare=False)

    def __str__(self) -> str:
        return self.name

    def evaluate(self, metrics: Mapping[Analyzer, Metric]) -> ConstraintResult:
        metric = metrics.get(self.analyzer)
        if metric is None:
            return ConstraintResult(self, ConstraintStatus.FAILURE, MISSING_ANALYSIS)
        if not metric.ok:
            # a condition that leaves no row in scope leaves none that fails
            nothing_in_scope = isinstance(metric.error, EmptyStateError) and self.analyzer.condition is not None
            return ConstraintResult(self, ConstraintStatus.SUCCESS, None, metric) if nothing_in_scope else ConstraintResult(self, ConstraintStatus.FAILURE, str(metric.error), metric)
        try:
            value = metric.value if self.picker is None else self.picker(metric.value)
        except Exception as e:  # noqa: BLE001
            return ConstraintResult(self, ConstraintStatus.FAILURE, f"{PROBLEMATIC_PICKER}: {e}!", metric)
        try:
            held = bool(self.assertion(value))
        except Exception as e:  # noqa: BLE001
            return ConstraintResult(self, ConstraintStatus.FAILURE, f"{ASSERTION_EXCEPTION}: {e}!", metric)
        if held:
            return ConstraintResult(self, ConstraintStatus.SUCCESS, None, metric)
        message = f"Value: {value} does not meet the constraint requirement!" + (f" {self.hint}" if self.hint else "")
        return ConstraintResult(self, ConstraintStatus.FAILURE, message, metric)

    def rows(self, df: DataFrame, metric: Metric | None) -> Column | None:
        """A boolean for each row; None if the constraint has none. A metric that failed fails all rows."""
        if self.row_level is RowLevel.NONE:
            return None
        usable = metric is not None and (metric.ok or isinstance(metric.error, EmptyStateError))
        if not usable:
            return None if self.row_level is RowLevel.GROUPED else F.lit(False)
        column = self.analyzer.row_level(df)
        if column is None:
            return None
        if self.row_level is not RowLevel.ASSERTED:
            return column
        options = self.options or getattr(self.analyzer, "options", None) or AnalyzerOptions()
        value, inside = column["value"], column["in_scope"]
        missing = F.lit(False) if options.null_behavior is NullBehavior.FAIL else F.lit(None).cast("boolean")
        judged = F.when(value.isNull(), missing).otherwise(as_column(self.assertion, value))
        outside = F.lit(True) if options.filtered_row is FilteredRow.TRUE else F.lit(None).cast("boolean")
        return F.when(inside, judged).otherwise(outside)


def of(analyzer: Analyzer, assertion: Callable[[Any], bool], hint: str | None = None, *, kind: str | None = None, picker: Callable[[Any], Any] | None = None) -> Constraint:
    """The constraint of an analyzer, with the row-level outcome that its kind has."""
    if isinstance(analyzer, (scan.Completeness, scan.Compliance, scan.PatternMatch)):
        level, column = RowLevel.BOOLEAN, {scan.Completeness: "Completeness", scan.Compliance: "ColumnsCompliance", scan.PatternMatch: "ColumnPattern"}[type(analyzer)] + f"-{analyzer.instance}"
    elif isinstance(analyzer, (scan.Minimum, scan.Maximum, scan.MinLength, scan.MaxLength)):
        level, column = RowLevel.ASSERTED, f"{type(analyzer).__name__}-{analyzer.instance}"
    elif isinstance(analyzer, FrequencyAnalyzer) and type(analyzer).__name__ in ("Uniqueness", "UniqueValueRatio", "DuplicateRowCount") and analyzer.columns:
        level, column = RowLevel.GROUPED, f"{type(analyzer).__name__}-{analyzer.instance}"
    else:
        level, column = RowLevel.NONE, None
    return Constraint(analyzer, assertion, f"{kind or type(analyzer).__name__}Constraint({analyzer})", picker, hint, level, column)


def data_type(analyzer: scan.DataType, kind: ConstrainableDataTypes, assertion: Callable[[float], bool] = IS_ONE, hint: str | None = None) -> Constraint:
    """On the share of values of a type; nulls count only for the type Null."""

    def share(d: Distribution) -> float:
        n = {k: v.absolute for k, v in d.values.items()}
        total = sum(n.values())
        if kind is ConstrainableDataTypes.NULL:
            return n["Unknown"] / total if total else 0.0
        found = n["Fractional"] + n["Integral"] if kind is ConstrainableDataTypes.NUMERIC else n[kind.value]
        return found / (total - n["Unknown"]) if total > n["Unknown"] else 0.0

    return of(analyzer, assertion, hint, kind="DataType", picker=share)
