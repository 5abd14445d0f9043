"""Analyzers that are neither a scan nor a grouping."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dqengine import errors
from dqengine.functions.expr import quote
from dqengine.metrics import AttributeDoubleMetric, Entity, Metric
from dqengine.operators.base import Analyzer


@dataclass(frozen=True)
class ColumnCount(Analyzer):
    @property
    def entity(self) -> Entity:
        return Entity.DATASET

    def columns_used(self) -> list[str] | None:
        return []

    def run(self, df: DataFrame) -> Metric:
        return self.success(float(len(df.columns)))


@dataclass(frozen=True)
class ColumnExists(Analyzer):
    """1 if there is a column of exactly this name, else 0."""

    column: str

    def columns_used(self) -> list[str] | None:
        return []

    def run(self, df: DataFrame) -> Metric:
        return self.success(1.0 if self.column in df.columns else 0.0)


@dataclass(frozen=True)
class CustomSql(Analyzer):
    """Any SQL that returns one number."""

    expression: str
    disambiguator: str = "*"
    metric_name = "CustomSQL"

    @property
    def entity(self) -> Entity:
        return Entity.DATASET

    @property
    def instance(self) -> str:
        return self.disambiguator

    def columns_used(self) -> list[str] | None:
        return None

    def run(self, df: DataFrame) -> Metric:
        rows = df.sparkSession.sql(self.expression)
        if len(rows.columns) != 1:
            return self.failure(errors.MetricCalculationRuntimeError("Custom SQL did not return exactly 1 column"))
        found = rows.select(rows[quote(rows.columns[0])].try_cast("double").alias("x")).limit(2).collect()
        if len(found) != 1:
            return self.failure(errors.MetricCalculationRuntimeError("Custom SQL did not return exactly 1 row"))
        if found[0]["x"] is None:
            return self.failure(errors.MetricCalculationRuntimeError("Custom SQL did not return a number"))
        return self.success(found[0]["x"])


@dataclass(frozen=True)
class AggregatedState:
    """Counts by key, of a total."""

    counts: Mapping[str, int]
    total: int


@dataclass(frozen=True)
class CustomAggregator(Analyzer):
    """A function of the data that returns counts; the metric has the share of each key."""

    function: Callable[[DataFrame], AggregatedState]
    label: str
    of: str = "Dataset"
    metric_kind = AttributeDoubleMetric

    @property
    def entity(self) -> Entity:
        return Entity.DATASET

    @property
    def name(self) -> str:
        return self.label

    @property
    def instance(self) -> str:
        return self.of

    def columns_used(self) -> list[str] | None:
        return None

    def run(self, df: DataFrame) -> Metric:
        state = self.function(df)
        return self.success({k: v / state.total if state.total else 0.0 for k, v in state.counts.items()})


@dataclass(frozen=True)
class DatasetMatch(Analyzer):
    """Share of rows that another dataset has with the same keys and values."""

    other: DataFrame = field(compare=False, hash=False)
    key_columns: tuple[tuple[str, str], ...]
    match_columns: tuple[tuple[str, str], ...] | None = None
    metric_name = "DataSynchronization"

    def __post_init__(self) -> None:
        for name in ("key_columns", "match_columns"):
            v = getattr(self, name)
            if isinstance(v, Mapping):
                object.__setattr__(self, name, tuple(v.items()))

    @property
    def entity(self) -> Entity:
        return Entity.DATASET

    @property
    def instance(self) -> str:
        return ""

    def columns_used(self) -> list[str] | None:
        return None

    def run(self, df: DataFrame) -> Metric:
        from dqengine import comparison

        result = comparison.column_match(df, self.other, dict(self.key_columns), dict(self.match_columns) if self.match_columns else None, lambda _: True)
        if isinstance(result, comparison.Failed) and result.ratio is None:
            return self.failure(errors.MetricCalculationRuntimeError(result.message))
        return self.success(result.ratio)


