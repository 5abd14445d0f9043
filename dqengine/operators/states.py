"""Mergeable states: plain numbers whose sums give the metrics of the whole."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from typing import Any, ClassVar

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

KINDS: dict[str, type] = {}


@dataclass(frozen=True)
class State:
    """merge() is associative and commutative."""

    def __init_subclass__(cls) -> None:
        KINDS[cls.__name__] = cls

    def merge(self, other: State) -> State:
        raise NotImplementedError

    def metric_value(self) -> Any:
        raise NotImplementedError

    def to_dict(self) -> dict[str, Any]:
        return {"kind": type(self).__name__, **{k: v.hex() if isinstance(v, bytes) else v for k, v in asdict(self).items()}}

    @staticmethod
    def from_dict(d: dict[str, Any]) -> State:
        kind = KINDS[d["kind"]]
        values = {k: State.from_dict(v) if isinstance(v, dict) and "kind" in v else v for k, v in d.items() if k != "kind"}
        for name, annotation in kind.__annotations__.items():
            if "bytes" in str(annotation) and isinstance(values.get(name), str):
                values[name] = bytes.fromhex(values[name])
            if "tuple" in str(annotation) and isinstance(values.get(name), list):
                values[name] = tuple(values[name])
        return kind(**values)


@dataclass(frozen=True)
class Count(State):
    n: int

    def merge(self, other):
        return Count(self.n + other.n)

    def metric_value(self):
        return float(self.n)


@dataclass(frozen=True)
class Share(State):
    """Matches of a number of rows."""

    hits: int
    n: int

    def merge(self, other):
        return Share(self.hits + other.hits, self.n + other.n)

    def metric_value(self):
        return self.hits / self.n if self.n else math.nan


@dataclass(frozen=True)
class Least(State):
    value: float

    def merge(self, other):
        return Least(min(self.value, other.value))

    def metric_value(self):
        return self.value


@dataclass(frozen=True)
class Most(State):
    value: float

    def merge(self, other):
        return Most(max(self.value, other.value))

    def metric_value(self):
        return self.value


@dataclass(frozen=True)
class Span(State):
    least: float
    most: float

    def merge(self, other):
        return Span(min(self.least, other.least), max(self.most, other.most))

    def metric_value(self):
        return self.most - self.least


@dataclass(frozen=True)
class Total(State):
    value: float

    def merge(self, other):
        return Total(self.value + other.value)

    def metric_value(self):
        return self.value


@dataclass(frozen=True)
class Average(State):
    total: float
    n: int

    def merge(self, other):
        return Average(self.total + other.total, self.n + other.n)

    def metric_value(self):
        return self.total / self.n if self.n else math.nan


@dataclass(frozen=True)
class Quotient(State):
    over: float
    under: float

    def merge(self, other):
        return Quotient(self.over + other.over, self.under + other.under)

    def metric_value(self):
        if self.under == 0:
            return math.nan if self.over == 0 else math.copysign(math.inf, self.over)
        return self.over / self.under


@dataclass(frozen=True)
class Moments(State):
    """Number, mean and sums of powers of the deviations from it; which says what the metric is."""

    which: str
    n: float
    mean: float
    m2: float
    m3: float = 0.0
    m4: float = 0.0

    def merge(self, other):
        if not other.n or not self.n:
            return self if self.n else other
        a, b, n = self.n, other.n, self.n + other.n
        d = other.mean - self.mean
        m2 = self.m2 + other.m2 + d**2 * a * b / n
        m3 = self.m3 + other.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * other.m2 - b * self.m2) / n
        m4 = self.m4 + other.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3 + 6 * d**2 * (a * a * other.m2 + b * b * self.m2) / n**2 + 4 * d * (a * other.m3 - b * self.m3) / n
        return Moments(self.which, n, self.mean + d * b / n, m2, m3, m4)

    def metric_value(self):
        if self.which == "variance":
            return self.m2 / self.n
        if self.which == "stddev":
            return math.sqrt(self.m2 / self.n)
        if self.m2 == 0:
            return 0.0
        if self.which == "skewness":
            return math.sqrt(self.n) * self.m3 / self.m2**1.5
        return self.n * self.m4 / self.m2**2 - 3.0


@dataclass(frozen=True)
class CoMoments(State):
    n: float
    x_mean: float
    y_mean: float
    xy: float
    xx: float
    yy: float

    def merge(self, other):
        if not other.n or not self.n:
            return self if self.n else other
        n = self.n + other.n
        dx, dy, w = other.x_mean - self.x_mean, other.y_mean - self.y_mean, self.n * other.n / n
        return CoMoments(n, self.x_mean + dx * other.n / n, self.y_mean + dy * other.n / n, self.xy + other.xy + dx * dy * w, self.xx + other.xx + dx * dx * w, self.yy + other.yy + dy * dy * w)

    def metric_value(self):
        under = math.sqrt(self.xx * self.yy)
        return self.xy / under if under else math.nan


@dataclass(frozen=True)
class TypeCounts(State):
    """Values by the type of their text; nulls are Unknown."""

    unknown: int
    fractional: int
    integral: int
    boolean: int
    string: int

    names: ClassVar[tuple[str, ...]] = ("Unknown", "Fractional", "Integral", "Boolean", "String")

    def counts(self) -> dict[str, int]:
        return dict(zip(self.names, (self.unknown, self.fractional, self.integral, self.boolean, self.string), strict=True))

    def merge(self, other):
        return TypeCounts(*(a + b for a, b in zip(self.counts().values(), other.counts().values(), strict=True)))

    def metric_value(self):
        from dqengine.metrics import Distribution, DistributionValue

        total = sum(self.counts().values())
        return Distribution({k: DistributionValue(v, v / total if total else math.nan) for k, v in self.counts().items()}, 5)


def _sketches(function: str, *sketches: bytes) -> bytes:
    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(bytearray(s),) for s in sketches], "s binary")
    return bytes(frame.agg(getattr(F, function)("s")).first()[0])


@dataclass(frozen=True)
class DistinctSketch(State):
    """Estimate of one pass; the sketch, where it was asked for, lets states be merged."""

    estimate: int
    sketch: bytes | None = None

    def merge(self, other):
        if self.sketch is None or other.sketch is None:
            raise ValueError("an estimate without its sketch can't be merged")
        union = _sketches("hll_union_agg", self.sketch, other.sketch)
        spark = SparkSession.getActiveSession()
        estimate = spark.createDataFrame([(bytearray(union),)], "s binary").select(F.hll_sketch_estimate("s")).first()[0]
        return DistinctSketch(int(estimate), union)

    def metric_value(self):
        return float(self.estimate)


@dataclass(frozen=True)
class QuantileSketch(State):
    """Approximate quantiles; values are those asked for."""

    quantiles: tuple
    values: tuple
    sketch: bytes | None = None

    def merge(self, other):
        if self.sketch is None or other.sketch is None:
            raise ValueError("quantiles without their sketch can't be merged")
        merged = _sketches("kll_merge_agg_double", self.sketch, other.sketch)
        spark = SparkSession.getActiveSession()
        frame = spark.createDataFrame([(bytearray(merged),)], "s binary")
        row = frame.select(*(F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(f"q{i}") for i, q in enumerate(self.quantiles))).first()
        return QuantileSketch(self.quantiles, tuple(row), merged)

    def metric_value(self):
        return self.values[0] if len(self.values) == 1 else dict(zip(map(str, self.quantiles), self.values, strict=True))


@dataclass(frozen=True)
class Keyed(State):
    """Several approximate quantiles, as a dict."""

    inner: QuantileSketch

    def to_dict(self):
        return {"kind": "Keyed", "inner": self.inner.to_dict()}

    def merge(self, other):
        return Keyed(self.inner.merge(other.inner))

    def metric_value(self):
        return dict(zip(map(str, self.inner.quantiles), self.inner.values, strict=True))


@dataclass(frozen=True)
class Fixed(State):
    """A value that has no mergeable state."""

    value: float

    def merge(self, other):
        raise ValueError("states of this analyzer can't be merged")

    def metric_value(self):
        return self.value


@dataclass(frozen=True)
class KLLState(State):
    least: float
    most: float
    n: int
    buckets: int
    shrinking: float
    size: int
    sketch: bytes
    ranks: tuple = ()
    percentiles: tuple = ()

    def merge(self, other):
        merged = _sketches("kll_merge_agg_double", self.sketch, other.sketch)
        return KLLState(min(self.least, other.least), max(self.most, other.most), self.n + other.n, self.buckets, self.shrinking, self.size, merged)

    def edges(self) -> list[float]:
        return [self.least + (self.most - self.least) * i / self.buckets for i in range(self.buckets + 1)]

    def ranked(self) -> KLLState:
        """With the numbers of values below each edge (of the last: up to it), and the percentiles 1 to 100, read from the sketch."""
        if self.ranks:
            return self
        spark = SparkSession.getActiveSession()
        frame = spark.createDataFrame([(bytearray(self.sketch),)], "s binary")
        edges = self.edges()
        # the number of values below an edge: ranks are inclusive, so ask for the number just below
        below = [math.nextafter(e, -math.inf) for e in edges[:-1]] + [edges[-1]]
        asked = [F.kll_sketch_get_rank_double("s", F.lit(e)).alias(f"r{i}") for i, e in enumerate(below)]
        asked += [F.kll_sketch_get_quantile_double("s", F.lit(q / 100)).alias(f"q{q}") for q in range(1, 101)]
        row = list(frame.select(*asked).first())
        return KLLState(self.least, self.most, self.n, self.buckets, self.shrinking, self.size, self.sketch, tuple(r * self.n for r in row[: len(edges)]), tuple(row[len(edges) :]))

    def metric_value(self):
        from dqengine.metrics import BucketDistribution, BucketValue

        s = self.ranked()
        edges = s.edges()
        buckets = [BucketValue(edges[i], edges[i + 1], round(s.ranks[i + 1] - s.ranks[i])) for i in range(s.buckets)]
        return BucketDistribution(buckets, (s.shrinking, float(s.size)), s.sketch, list(s.percentiles))
