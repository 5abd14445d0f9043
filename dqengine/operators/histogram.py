"""Histograms: of values, and of numbers in bins."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine import errors
from dqengine.functions.expr import ref
from dqengine.metrics import BinData, BinnedDistribution, Distribution, DistributionValue, HistogramBinnedMetric, HistogramMetric
from dqengine.operators.base import Analyzer, has_column, numeric
from dqengine.operators.frequency import COUNT

#: What a null counts as.
NULL_VALUE = "NullValue"
#: Most bins whose details are returned.
DETAIL_BINS = 1000


@dataclass(frozen=True)
class Histogram(Analyzer):
    """The most frequent values, as text, by count and then value; number and sum of all others.

    With sum_column, values are weighed by the sum of that column instead of
    their rows. binning maps the column to what is counted.
    """

    column: str
    binning: Callable[[Column], Column] | None = None
    max_detail_bins: int = DETAIL_BINS
    where: str | None = None
    as_ratio: bool = True
    sum_column: str | None = None
    metric_kind = HistogramMetric
    optional = ("where", "binning")

    def __str__(self) -> str:
        binned = "None" if self.binning is None else "Some(<function1>)"
        where = "None" if self.where is None else f"Some({self.where})"
        how = "Count" if self.sum_column is None else f"Sum({self.sum_column})"
        return f"Histogram({self.column},{binned},{self.max_detail_bins},{where},{str(self.as_ratio).lower()},{how})"

    def columns_used(self) -> list[str] | None:
        return None if self.where else [self.column, *([self.sum_column] if self.sum_column else [])]

    def check(self, df: DataFrame) -> None:
        if self.max_detail_bins > DETAIL_BINS:
            raise errors.IllegalAnalyzerParameterError(f"Cannot return histogram values for more than {DETAIL_BINS} values")
        has_column(df, self.column)
        if self.sum_column:
            has_column(df, self.sum_column)

    def grouped(self, df: DataFrame) -> DataFrame:
        """(value, COUNT), one row for each value."""
        value = ref(df, self.column)
        if self.binning is not None:
            value = self.binning(value)
        kept = df if self.where is None else df.where(F.expr(self.where))
        how = F.count(F.lit(1)) if self.sum_column is None else F.sum(ref(df, self.sum_column).cast("long"))
        return kept.groupBy(F.coalesce(value.cast("string"), F.lit(NULL_VALUE)).alias("value")).agg(how.alias(COUNT))

    def total(self, df: DataFrame) -> Column:
        """The denominator of ratios: of all rows, whatever the condition."""
        return F.count(F.lit(1)) if self.sum_column is None else F.sum(ref(df, self.sum_column).cast("long"))

    def from_grouped(self, grouped: DataFrame, total: int | None) -> HistogramMetric:
        """total: the denominator; None for a ratio to one."""
        sums = grouped.agg(F.count(F.lit(1)).alias("bins"), F.sum(COUNT).alias("n")).first()
        top = grouped.orderBy(F.col(COUNT).desc(), F.col("value").asc()).limit(self.max_detail_bins).collect()
        under = (total or 0) if self.as_ratio else 1
        details = {r["value"]: DistributionValue(int(r[COUNT] or 0), (r[COUNT] or 0) / under if under else math.nan) for r in top}
        rest = int(sums["n"] or 0) - sum(v.absolute for v in details.values())
        return self.success(Distribution(details, int(sums["bins"]), rest))


@dataclass(frozen=True)
class HistogramBinned(Analyzer):
    """Numbers in bins of equal width, or between given edges; the last bin includes its end.

    Nulls are counted apart. What lies outside given edges counts only with
    overflow bins. A column of one value has one bin.
    """

    column: str
    bin_count: int | None = None
    edges: tuple[float, ...] | None = None
    overflow_bins: bool = False
    where: str | None = None
    as_ratio: bool = True
    sum_column: str | None = None
    metric_kind = HistogramBinnedMetric
    optional = ("bin_count", "edges", "where")
    default_bins: ClassVar[int] = 10

    def __post_init__(self) -> None:
        if self.edges is not None:
            object.__setattr__(self, "edges", tuple(float(e) for e in self.edges))

    def columns_used(self) -> list[str] | None:
        return None if self.where else [self.column, *([self.sum_column] if self.sum_column else [])]

    def check(self, df: DataFrame) -> None:
        if (self.bin_count is None) == (self.edges is None):
            raise errors.IllegalAnalyzerParameterError("Exactly one of the number of bins and the edges has to be given")
        if self.bin_count is not None and not 0 < self.bin_count <= DETAIL_BINS:
            raise errors.IllegalAnalyzerParameterError(f"The number of bins must be from 1 to {DETAIL_BINS}")
        if self.edges is not None and (len(self.edges) < 2 or any(a >= b for a, b in zip(self.edges, self.edges[1:], strict=False)) or len(self.edges) > DETAIL_BINS + 1):
            raise errors.IllegalAnalyzerParameterError("Edges must be two at least, and ascend")
        numeric(df, self.column)

    def run(self, df: DataFrame) -> HistogramBinnedMetric:
        x = ref(df, self.column).cast("double")
        kept = df if self.where is None else df.where(F.expr(self.where))
        weight = F.lit(1) if self.sum_column is None else ref(df, self.sum_column).cast("long")
        if self.edges is None:
            ends = kept.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
            if ends["a"] is None:
                edges: list[float] = []
            elif ends["a"] == ends["b"]:
                edges = [ends["a"], ends["b"]]
            else:
                width = (ends["b"] - ends["a"]) / self.bin_count
                edges = [ends["a"] + i * width for i in range(self.bin_count)] + [ends["b"]]
        else:
            edges = list(self.edges)
        if not edges:
            raise errors.empty_state(self)
        last = len(edges) - 2
        if self.edges is None and edges[0] != edges[-1]:
            width = (edges[-1] - edges[0]) / self.bin_count
            number = F.least(F.floor((x - edges[0]) / F.lit(width)), F.lit(last))
        else:
            number = F.when(x == edges[-1], F.lit(last)).when((x >= edges[0]) & (x < edges[-1]), _between(x, edges, 0, last))
        number = F.when(x.isNull(), -3).when(x < edges[0], -1).when(x > edges[-1], last + 1).otherwise(number).cast("int")
        # one row for each bin that has values: as many as bins, at most
        found = {r["bin"]: int(r["n"] or 0) for r in kept.groupBy(number.alias("bin")).agg(F.sum(weight).alias("n")).collect()}
        bins = [(edges[i], edges[i + 1], found.get(i, 0)) for i in range(last + 1)]
        if self.overflow_bins and self.edges is not None:
            bins = [(-math.inf, edges[0], found.get(-1, 0)), *bins, (edges[-1], math.inf, found.get(last + 1, 0))]
        under = (df.agg(F.sum(weight)).first()[0] or 0) if self.as_ratio else 1
        data = [BinData(a, b, n, n / under if under else math.nan) for a, b, n in bins]
        return self.success(BinnedDistribution(data, len(data), found.get(-3, 0)))


def _between(x: Column, edges: list[float], low: int, high: int) -> Column:
    """The number of the bin by halving, so that the expression is as deep as the logarithm of the bins."""
    if low == high:
        return F.lit(low)
    middle = (low + high + 1) // 2
    return F.when(x < edges[middle], _between(x, edges, low, middle - 1)).otherwise(_between(x, edges, middle, high))


def grouped_total(df: DataFrame, analyzer: Histogram) -> int | None:
    """The denominator of a histogram's ratios."""
    return df.agg(analyzer.total(df)).first()[0] if analyzer.as_ratio else None


