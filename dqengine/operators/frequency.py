"""Analyzers over the frequencies of the values of columns.

Analyzers on the same columns with the same condition share one grouped frame,
and what they need of it is one row: frequencies are aggregated where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqengine import errors
from dqengine.functions.expr import ref, some, unquote
from dqengine.metrics import Entity, Metric
from dqengine.operators.base import Analyzer, AnalyzerOptions, as_tuple, exactly, not_nested, row_outcome, some_columns

COUNT = "__count"


@dataclass(frozen=True)
class FrequencyAnalyzer(Analyzer):
    columns: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", as_tuple(self.columns))

    @property
    def entity(self) -> Entity:
        return Entity.COLUMN if len(self.grouping()) == 1 else Entity.MULTICOLUMN

    @property
    def instance(self) -> str:
        return ",".join(self.grouping())

    def grouping(self, df: DataFrame | None = None) -> tuple[str, ...]:
        return self.columns

    def columns_used(self) -> list[str] | None:
        return None if self.condition else list(self.columns)

    def check(self, df: DataFrame) -> None:
        some_columns(self.columns)
        for c in self.columns:
            not_nested(df, c)

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        """Over rows of (columns, COUNT)."""
        raise NotImplementedError

    def value(self, v: dict[str, Any]) -> float:
        raise NotImplementedError

    empty: ClassVar[float | None] = None

    def metric(self, v: dict[str, Any], df: DataFrame | None = None) -> Metric:
        """v: the aggregates by name, with groups and rows."""
        row = self.row_level(df) if df is not None else None
        if not v["groups"]:
            return self.failure(errors.empty_state(self), row_level=row) if self.empty is None else self.success(self.empty, row_level=row)
        return self.success(float(self.value(v)), row_level=row)

    def row_level(self, df: DataFrame) -> Column | None:
        return None

    def times(self, df: DataFrame) -> Column:
        """How often the row's values occur among rows in scope."""
        w = W.partitionBy(*(ref(df, c) for c in self.grouping(df)))
        return F.count(F.lit(1) if self.condition is None else F.when(F.expr(self.condition), 1)).over(w)


def frequencies(df: DataFrame, columns: tuple[str, ...], where: str | None) -> DataFrame:
    """(columns..., COUNT); rows with only nulls in the columns are left out, and those for which the condition doesn't hold."""
    refs = [ref(df, c) for c in columns]
    kept = df.where(some([c.isNotNull() for c in refs]))
    if where is not None:
        kept = kept.where(F.expr(where))
    names = [unquote(c) for c in columns]
    return kept.groupBy(*(c.alias(n) for c, n in zip(refs, names, strict=True))).agg(F.count(F.lit(1)).alias(COUNT))


def merge_frequencies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of the counts of the same values, nulls alike."""
    names = [c for c in a.columns if c != COUNT]
    return a.unionByName(b).groupBy(*(f"`{n}`" for n in names)).agg(F.sum(COUNT).alias(COUNT))


def base_aggregates() -> dict[str, Column]:
    return {"groups": F.count(F.lit(1)), "rows": F.sum(COUNT)}


_once = lambda: F.sum((F.col(COUNT) == 1).cast("long"))


@dataclass(frozen=True)
class Uniqueness(FrequencyAnalyzer):
    """Share of rows whose values occur once."""

    where: str | None = None
    options: AnalyzerOptions | None = None

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        return {"once": _once()}

    def value(self, v: dict[str, Any]) -> float:
        return v["once"] / v["rows"]

    def row_level(self, df: DataFrame) -> Column:
        return row_outcome(self.times(df) == 1, self.where, self.options)


@dataclass(frozen=True)
class Distinctness(FrequencyAnalyzer):
    """Distinct values per row."""

    where: str | None = None

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        return {}

    def value(self, v: dict[str, Any]) -> float:
        return v["groups"] / v["rows"]


@dataclass(frozen=True)
class UniqueValueRatio(FrequencyAnalyzer):
    """Share of distinct values that occur once."""

    where: str | None = None
    options: AnalyzerOptions | None = None

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        return {"once": _once()}

    def value(self, v: dict[str, Any]) -> float:
        return v["once"] / v["groups"]

    def row_level(self, df: DataFrame) -> Column:
        return row_outcome(self.times(df) == 1, self.where, self.options)


@dataclass(frozen=True)
class CountDistinct(FrequencyAnalyzer):
    empty = 0.0

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        return {}

    def value(self, v: dict[str, Any]) -> float:
        return v["groups"]


@dataclass(frozen=True)
class DuplicateRowCount(FrequencyAnalyzer):
    """Rows whose values occur more than once; over all columns if none is named."""

    columns: tuple[str, ...] = ()
    where: str | None = None
    options: AnalyzerOptions | None = None
    empty = 0.0

    @property
    def entity(self) -> Entity:
        return Entity.DATASET if not self.columns else super().entity

    @property
    def instance(self) -> str:
        return "*" if not self.columns else super().instance

    def grouping(self, df: DataFrame | None = None) -> tuple[str, ...]:
        return self.columns or (tuple(f"`{c}`" for c in df.columns) if df is not None else ())

    def columns_used(self) -> list[str] | None:
        return None if not self.columns else super().columns_used()

    def check(self, df: DataFrame) -> None:
        for c in self.grouping(df):
            not_nested(df, c)

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        return {"again": F.sum(F.when(F.col(COUNT) > 1, F.col(COUNT)).otherwise(0))}

    def value(self, v: dict[str, Any]) -> float:
        return v["again"]

    def row_level(self, df: DataFrame) -> Column | None:
        return row_outcome(self.times(df) <= 1, self.where, self.options) if self.columns else None


@dataclass(frozen=True)
class Entropy(FrequencyAnalyzer):
    """In nats, over rows with a value."""

    where: str | None = None

    def __str__(self) -> str:
        return f"Entropy({self.columns[0]},{'None' if self.where is None else f'Some({self.where})'})"

    def check(self, df: DataFrame) -> None:
        exactly(self.columns, 1)
        super().check(df)

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        c = F.col(COUNT).cast("double")
        return {"nlogn": F.sum(c * F.log(c))}

    def value(self, v: dict[str, Any]) -> float:
        return max(0.0, math.log(v["rows"]) - v["nlogn"] / v["rows"])


@dataclass(frozen=True)
class MutualInformation(FrequencyAnalyzer):
    """Of two columns, in nats."""

    where: str | None = None

    def check(self, df: DataFrame) -> None:
        exactly(self.columns, 2)
        super().check(df)

    def aggregates(self, grouped: DataFrame) -> dict[str, Column]:
        return {}

    def from_grouped(self, grouped: DataFrame) -> DataFrame:
        """One row: value. The marginals are sums over the joint frequencies; pairs with a null have no part in the sum."""
        a, b = (F.col(f"`{unquote(c)}`") for c in self.columns)
        n = grouped.agg(F.sum(COUNT).cast("double").alias("__n"))
        first = grouped.groupBy(a.alias("__a")).agg(F.sum(COUNT).alias("__x"))
        second = grouped.groupBy(b.alias("__b")).agg(F.sum(COUNT).alias("__y"))
        joint = grouped.select(a.alias("__a"), b.alias("__b"), COUNT).join(first, "__a").join(second, "__b").crossJoin(F.broadcast(n))
        p = F.col(COUNT) / F.col("__n")
        return joint.agg(F.sum(p * F.log(F.col(COUNT) * F.col("__n") / (F.col("__x").cast("double") * F.col("__y")))).alias("value"))
