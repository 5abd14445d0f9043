"""Metrics: what analyzers return. A metric has a value or an error."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column

from dqengine.errors import wrap


class Entity(str, Enum):
    DATASET = "Dataset"
    COLUMN = "Column"
    MULTICOLUMN = "Multicolumn"


@dataclass
class Metric:
    entity: Entity
    instance: str
    name: str
    value: Any = None
    error: Exception | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    def get(self) -> Any:
        """The value; raises the error of a failed metric."""
        if self.error is not None:
            raise self.error
        return self.value

    def flatten(self) -> list[DoubleMetric]:
        return [self]


@dataclass
class DoubleMetric(Metric):
    """One number; row_level is its column for single rows, where there is one."""

    row_level: Column | None = field(default=None, compare=False, repr=False)


@dataclass
class KeyedDoubleMetric(Metric):
    """A number for each key; flattens to name-key."""

    def flatten(self) -> list[DoubleMetric]:
        if not self.ok:
            return [DoubleMetric(self.entity, self.instance, self.name, error=self.error)]
        return [DoubleMetric(self.entity, self.instance, f"{self.name}-{k}", float(v)) for k, v in self.value.items()]


@dataclass
class AttributeDoubleMetric(Metric):
    """A number for each attribute; flattens to name.attribute."""

    def flatten(self) -> list[DoubleMetric]:
        if not self.ok:
            return [DoubleMetric(self.entity, self.instance, self.name, error=self.error)]
        return [DoubleMetric(self.entity, self.instance, f"{self.name}.{k}", float(v)) for k, v in self.value.items()]


@dataclass(frozen=True)
class DistributionValue:
    absolute: int
    ratio: float


@dataclass
class Distribution:
    """The most frequent values; number_of_bins counts all, tail_count is what the others sum up to."""

    values: dict[str, DistributionValue]
    number_of_bins: int
    tail_count: int = 0

    def __getitem__(self, key: str) -> DistributionValue:
        return self.values[key]

    def argmax(self) -> str:
        return max(self.values.items(), key=lambda kv: kv[1].absolute)[0]


@dataclass
class HistogramMetric(Metric):
    def flatten(self) -> list[DoubleMetric]:
        if not self.ok:
            return [DoubleMetric(self.entity, self.instance, f"{self.name}.bins", error=self.error)]
        d: Distribution = self.value
        found = [("bins", d.number_of_bins)]
        for k, v in d.values.items():
            found += [(f"abs.{k}", v.absolute), (f"ratio.{k}", v.ratio)]
        if d.tail_count > 0:
            found.append(("tailCount", d.tail_count))
        return [DoubleMetric(self.entity, self.instance, f"{self.name}.{k}", float(v)) for k, v in found]


@dataclass(frozen=True)
class BinData:
    bin_start: float
    bin_end: float
    frequency: int
    ratio: float


@dataclass
class BinnedDistribution:
    bins: list[BinData]
    number_of_bins: int
    null_count: int = 0

    def interval(self, i: int) -> str:
        b = self.bins[i]
        return f"[{b.bin_start}, {b.bin_end}{']' if i == len(self.bins) - 1 else ')'}"

    def argmax(self) -> int:
        return max(range(len(self.bins)), key=lambda i: self.bins[i].frequency)


@dataclass
class HistogramBinnedMetric(Metric):
    def flatten(self) -> list[DoubleMetric]:
        if not self.ok:
            return [DoubleMetric(self.entity, self.instance, f"{self.name}.bins", error=self.error)]
        d: BinnedDistribution = self.value
        found = [("bins", d.number_of_bins)]
        for i, b in enumerate(d.bins):
            found += [(f"abs.{d.interval(i)}", b.frequency), (f"ratio.{d.interval(i)}", b.ratio)]
        if d.null_count:
            found.append(("nullCount", d.null_count))
        return [DoubleMetric(self.entity, self.instance, f"{self.name}.{k}", float(v)) for k, v in found]


@dataclass(frozen=True)
class BucketValue:
    low: float
    high: float
    count: int


@dataclass
class BucketDistribution:
    """Equal-width buckets of a quantile sketch, its parameters and the sketch itself."""

    buckets: list[BucketValue]
    parameters: tuple[float, float]  # shrinking factor, sketch size
    sketch: bytes = field(default=b"", repr=False, compare=False)
    percentiles: list[float] = field(default_factory=list, repr=False, compare=False)

    def argmax(self) -> int:
        return max(range(len(self.buckets)), key=lambda i: self.buckets[i].count)

    def __getitem__(self, i: int) -> BucketValue:
        return self.buckets[i]


@dataclass
class KLLMetric(Metric):
    def flatten(self) -> list[DoubleMetric]:
        if not self.ok:
            return [DoubleMetric(self.entity, self.instance, f"{self.name}.buckets", error=self.error)]
        d: BucketDistribution = self.value
        found: list[tuple[str, float]] = [("buckets", len(d.buckets))]
        for b in d.buckets:
            found += [("low", b.low), ("high", b.high), ("count", b.count)]
        return [DoubleMetric(self.entity, self.instance, f"{self.name}.{k}", float(v)) for k, v in found]


def failed(kind: type[Metric], entity: Entity, instance: str, name: str, error: Exception, **more: Any) -> Metric:
    return kind(entity, instance, name, error=wrap(error), **more)
