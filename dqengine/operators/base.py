"""Analyzers: value objects that say which aggregates they need and how these become a metric."""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import Enum
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine import errors
from dqengine.functions.expr import data_type, is_nested, is_numeric, when
from dqengine.metrics import DoubleMetric, Entity, Metric, failed
from dqengine.operators.states import State


class NullBehavior(str, Enum):
    """What a null counts as where a value is asserted on."""

    IGNORE = "Ignore"
    EMPTY_STRING = "EmptyString"
    FAIL = "Fail"


class FilteredRow(str, Enum):
    """Row-level outcome of rows that the where clause leaves out."""

    TRUE = "TRUE"
    NULL = "NULL"


@dataclass(frozen=True)
class AnalyzerOptions:
    null_behavior: NullBehavior = NullBehavior.IGNORE
    filtered_row: FilteredRow = FilteredRow.TRUE

    def __str__(self) -> str:
        return f"AnalyzerOptions({self.null_behavior.value},{self.filtered_row.value})"


def shown(value: Any, optional: bool) -> str:
    """A parameter as it is written in the names of constraints."""
    if value is None:
        return "None"
    if isinstance(value, (list, tuple)):
        text = f"List({', '.join(map(str, value))})"
    elif isinstance(value, bool):
        text = str(value).lower()
    elif isinstance(value, Enum):
        text = value.value
    else:
        text = str(value)
    return f"Some({text})" if optional else text


@dataclass(frozen=True)
class Analyzer:
    """Equal analyzers share one computation. Subclasses are frozen dataclasses."""

    metric_name: ClassVar[str] = ""
    metric_kind: ClassVar[type[Metric]] = DoubleMetric
    optional: ClassVar[tuple[str, ...]] = ("where", "options")

    def __str__(self) -> str:
        return f"{type(self).__name__}({','.join(shown(getattr(self, f.name), f.name in self.optional) for f in fields(self))})"

    @property
    def name(self) -> str:
        return self.metric_name or type(self).__name__

    @property
    def entity(self) -> Entity:
        return Entity.COLUMN

    @property
    def instance(self) -> str:
        return getattr(self, "column", "*")

    @property
    def condition(self) -> str | None:
        """The where clause, for analyzers that take one."""
        return getattr(self, "where", None)

    def columns_used(self) -> list[str] | None:
        """Columns referenced; None if unknown, which keeps all of them."""
        return None if self.condition else [self.column] if hasattr(self, "column") else []

    def check(self, df: DataFrame) -> None:
        """Raises a PreconditionError if the data or parameters don't fit."""

    def failure(self, error: Exception, **more: Any) -> Metric:
        return failed(self.metric_kind, self.entity, self.instance, self.name, error, **more)

    def success(self, value: Any, **more: Any) -> Metric:
        return self.metric_kind(self.entity, self.instance, self.name, value, **more)

    def calculate(self, df: DataFrame, **options: Any) -> Metric:
        """The metric of this analyzer alone."""
        from dqengine.plans.runner import run_analyzers

        return run_analyzers(df, [self], **options)[self]


@dataclass(frozen=True)
class ScanAnalyzer(Analyzer):
    """Needs only aggregates over rows, so that many share one pass."""

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def state_aggregates(self, df: DataFrame) -> dict[str, Column]:
        """Further aggregates, needed only when the state is to be merged later."""
        return {}

    def state(self, values: dict[str, Any]) -> State | None:
        """The mergeable state; None over no values."""
        raise NotImplementedError

    def row_level(self, df: DataFrame) -> Column | None:
        return None

    def metric(self, state: State | None, df: DataFrame | None = None) -> Metric:
        row = None
        if df is not None:
            try:
                row = self.row_level(df)
            except Exception:  # noqa: BLE001  the metric itself still counts
                row = None
        more = {"row_level": row} if self.metric_kind is DoubleMetric else {}
        if state is None:
            return self.failure(errors.empty_state(self), **more)
        try:
            return self.success(state.metric_value(), **more)
        except Exception as e:  # noqa: BLE001
            return self.failure(e, **more)


# preconditions


def has_column(df: DataFrame, name: str) -> None:
    if data_type(df, name) is None:
        raise errors.NoSuchColumnError(f"Input data does not include column {name}!")


def not_nested(df: DataFrame, name: str) -> None:
    has_column(df, name)
    if is_nested(kind := data_type(df, name)):
        raise errors.WrongColumnTypeError(f"Unsupported nested column type of column {name}: {kind.simpleString()}!")


def numeric(df: DataFrame, name: str) -> None:
    has_column(df, name)
    if not is_numeric(kind := data_type(df, name)):
        raise errors.WrongColumnTypeError(f"Expected type of column {name} to be one of (tinyint, smallint, int, bigint, float, double, decimal), but found {kind.simpleString()} instead!")


def string(df: DataFrame, name: str) -> None:
    has_column(df, name)
    if (kind := data_type(df, name)).typeName() not in ("string", "varchar", "char"):
        raise errors.WrongColumnTypeError(f"Expected type of column {name} to be string, but found {kind.simpleString()} instead!")


def some_columns(columns: tuple[str, ...]) -> None:
    if not columns:
        raise errors.NoColumnsSpecifiedError("At least one column needs to be specified!")


def exactly(columns: tuple[str, ...], n: int) -> None:
    if len(columns) != n:
        raise errors.NumberOfSpecifiedColumnsError(f"{n} columns have to be specified! Currently, columns contains only {len(columns)} column(s): {', '.join(columns)}!")


def row_outcome(value: Column, where: str | None, options: AnalyzerOptions | None) -> Column:
    """The value of rows in scope; true or null for the others."""
    if where is None:
        return value
    left_out = F.lit(True) if (options or AnalyzerOptions()).filtered_row is FilteredRow.TRUE else F.lit(None).cast("boolean")
    return F.when(F.coalesce(~F.expr(where), F.lit(True)), left_out).otherwise(value)


def scoped(value: Column, where: str | None) -> Column:
    """A struct of whether a row is in scope and its value, for row-level assertions."""
    inside = F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))
    return F.struct(inside.alias("in_scope"), when(where, value).alias("value"))


def as_tuple(columns: Any) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)
