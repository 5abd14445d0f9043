"""Analyzers that share one pass over the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine import errors
from dqengine.functions import patterns
from dqengine.functions.expr import hits, ref, rows, when
from dqengine.metrics import Entity, HistogramMetric, KeyedDoubleMetric, KLLMetric
from dqengine.operators import states as S
from dqengine.operators.base import AnalyzerOptions, NullBehavior, ScanAnalyzer, has_column, not_nested, numeric, row_outcome, scoped, string


@dataclass(frozen=True)
class Size(ScanAnalyzer):
    """Number of rows."""

    where: str | None = None

    @property
    def entity(self) -> Entity:
        return Entity.DATASET

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"n": rows(self.where)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return S.Count(int(v["n"] or 0))


@dataclass(frozen=True)
class _Predicate(ScanAnalyzer):
    """Share of rows, of those in scope, for which a predicate holds."""

    def predicate(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"hits": hits(self.predicate(df), self.condition), "n": rows(self.condition)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        if v["n"] is None or v["hits"] is None and (self.condition or v["n"] == 0):
            return None
        if v["hits"] is None:
            return None
        return S.Share(int(v["hits"]), int(v["n"]))

    def row_level(self, df: DataFrame) -> Column:
        return row_outcome(self.predicate(df), self.condition, self.options)


@dataclass(frozen=True)
class Completeness(_Predicate):
    """Share of values that aren't null."""

    column: str
    where: str | None = None
    options: AnalyzerOptions | None = None

    def check(self, df: DataFrame) -> None:
        not_nested(df, self.column)

    def predicate(self, df: DataFrame) -> Column:
        return ref(df, self.column).isNotNull()


@dataclass(frozen=True)
class Compliance(_Predicate):
    """Share of rows that satisfy a SQL predicate; a predicate that is null isn't satisfied."""

    label: str
    expression: str
    where: str | None = None
    columns: tuple[str, ...] = ()
    options: AnalyzerOptions | None = None

    @property
    def instance(self) -> str:
        return self.label

    def columns_used(self) -> list[str] | None:
        return None

    def check(self, df: DataFrame) -> None:
        for c in self.columns:
            has_column(df, c)

    def predicate(self, df: DataFrame) -> Column:
        return F.expr(self.expression)


@dataclass(frozen=True)
class PatternMatch(_Predicate):
    """Share of values in which the pattern finds a text that isn't empty; nulls don't match."""

    column: str
    pattern: str
    where: str | None = None
    options: AnalyzerOptions | None = None

    def check(self, df: DataFrame) -> None:
        string(df, self.column)

    def predicate(self, df: DataFrame) -> Column:
        return F.coalesce(F.regexp_extract(ref(df, self.column), self.pattern, 0) != "", F.lit(False))


class Patterns:
    EMAIL = patterns.EMAIL
    URL = patterns.URL
    SOCIAL_SECURITY_NUMBER_US = patterns.SOCIAL_SECURITY_NUMBER_US
    CREDITCARD = patterns.CREDIT_CARD


@dataclass(frozen=True)
class _Numeric(ScanAnalyzer):
    """One aggregate of a numeric column."""

    column: str
    where: str | None = None

    def check(self, df: DataFrame) -> None:
        numeric(df, self.column)

    def value(self, df: DataFrame) -> Column:
        return when(self.where, ref(df, self.column).cast("double"))


@dataclass(frozen=True)
class Minimum(_Numeric):
    options: AnalyzerOptions | None = None

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"x": F.min(self.value(df))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["x"] is None else S.Least(v["x"])

    def row_level(self, df: DataFrame) -> Column:
        return scoped(ref(df, self.column).cast("double"), self.where)


@dataclass(frozen=True)
class Maximum(_Numeric):
    options: AnalyzerOptions | None = None

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"x": F.max(self.value(df))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["x"] is None else S.Most(v["x"])

    def row_level(self, df: DataFrame) -> Column:
        return scoped(ref(df, self.column).cast("double"), self.where)


@dataclass(frozen=True)
class Range(_Numeric):
    """Maximum less minimum."""

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"least": F.min(self.value(df)), "most": F.max(self.value(df))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["least"] is None else S.Span(v["least"], v["most"])


@dataclass(frozen=True)
class Sum(_Numeric):
    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"x": F.sum(self.value(df))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["x"] is None else S.Total(v["x"])


@dataclass(frozen=True)
class Mean(_Numeric):
    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"x": F.sum(self.value(df)), "n": F.count(self.value(df))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["x"] is None else S.Average(v["x"], int(v["n"]))


@dataclass(frozen=True)
class RatioOfSums(ScanAnalyzer):
    numerator: str
    denominator: str
    where: str | None = None

    @property
    def entity(self) -> Entity:
        return Entity.MULTICOLUMN

    @property
    def instance(self) -> str:
        return f"{self.numerator},{self.denominator}"

    def columns_used(self) -> list[str] | None:
        return None if self.where else [self.numerator, self.denominator]

    def check(self, df: DataFrame) -> None:
        numeric(df, self.numerator)
        numeric(df, self.denominator)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {k: F.sum(when(self.where, ref(df, c).cast("double"))) for k, c in (("over", self.numerator), ("under", self.denominator))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["over"] is None or v["under"] is None else S.Quotient(v["over"], v["under"])


@dataclass(frozen=True)
class _Moments(_Numeric):
    which: ClassVar[str] = ""
    order: ClassVar[int] = 2

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        x = self.value(df)
        found = {"n": F.count(x), "mean": F.avg(x), "var": F.var_pop(x)}
        if self.order >= 3:
            found["skew"] = F.skewness(x)
        if self.order >= 4:
            found["kurt"] = F.kurtosis(x)
        return found

    def state(self, v: dict[str, Any]) -> S.State | None:
        n = v["n"]
        if not n or v["mean"] is None:
            return None
        m2 = v["var"] * n
        m3 = (v.get("skew") or 0.0) * m2**1.5 / math.sqrt(n) if self.order >= 3 else 0.0
        m4 = ((v.get("kurt") or 0.0) + 3.0) * m2**2 / n if self.order >= 4 else 0.0
        if m2 == 0:
            m3 = m4 = 0.0
        return S.Moments(self.which, float(n), v["mean"], m2, m3, m4)


@dataclass(frozen=True)
class StandardDeviation(_Moments):
    """Of the population."""

    which = "stddev"


@dataclass(frozen=True)
class Variance(_Moments):
    """Of the population."""

    which = "variance"


@dataclass(frozen=True)
class Skewness(_Moments):
    """Of the population; 0 for constant values."""

    which = "skewness"
    order = 3


@dataclass(frozen=True)
class Kurtosis(_Moments):
    """Excess, of the population; 0 for constant values. Merging needs the third moment too."""

    which = "kurtosis"
    order = 4


@dataclass(frozen=True)
class Correlation(ScanAnalyzer):
    """Pearson's, over rows with both values; not a number for constant values."""

    first: str
    second: str
    where: str | None = None

    @property
    def entity(self) -> Entity:
        return Entity.MULTICOLUMN

    @property
    def instance(self) -> str:
        return f"{self.first},{self.second}"

    def columns_used(self) -> list[str] | None:
        return None if self.where else [self.first, self.second]

    def check(self, df: DataFrame) -> None:
        numeric(df, self.first)
        numeric(df, self.second)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        x, y = (when(self.where, ref(df, c).cast("double")) for c in (self.first, self.second))
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        return {"n": F.count(x), "x": F.avg(x), "y": F.avg(y), "xy": F.covar_pop(x, y), "xx": F.var_pop(x), "yy": F.var_pop(y)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        n = v["n"]
        return S.CoMoments(float(n), v["x"], v["y"], v["xy"] * n, v["xx"] * n, v["yy"] * n) if n else None


@dataclass(frozen=True)
class _Length(ScanAnalyzer):
    column: str
    where: str | None = None
    options: AnalyzerOptions | None = None

    def check(self, df: DataFrame) -> None:
        string(df, self.column)

    def length(self, df: DataFrame) -> Column:
        c = F.length(ref(df, self.column)).cast("double")
        how = (self.options or AnalyzerOptions()).null_behavior
        if how is NullBehavior.EMPTY_STRING:
            c = F.coalesce(c, F.lit(0.0))
        elif how is NullBehavior.FAIL:
            c = F.coalesce(c, F.lit(self.beyond))
        return c

    def row_level(self, df: DataFrame) -> Column:
        return scoped(self.length(df), self.where)


@dataclass(frozen=True)
class MinLength(_Length):
    beyond: ClassVar[float] = -1.7976931348623157e308

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"x": F.min(when(self.where, self.length(df)))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["x"] is None else S.Least(v["x"])


@dataclass(frozen=True)
class MaxLength(_Length):
    beyond: ClassVar[float] = 1.7976931348623157e308

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"x": F.max(when(self.where, self.length(df)))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["x"] is None else S.Most(v["x"])


@dataclass(frozen=True)
class ZerosCount(_Numeric):
    """Values that are zero."""

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"n": F.sum(when(self.where, (ref(df, self.column) == 0).cast("long"))), "rows": rows(self.where)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["n"] is None else S.Count(int(v["n"]))


def type_of_text(text: Column) -> Column:
    """The type that a value's text has."""
    named = F.when(text.isNull(), "Unknown").when(text.rlike(patterns.FRACTIONAL), "Fractional").when(text.rlike(patterns.INTEGRAL), "Integral").when(text.rlike(patterns.BOOLEAN), "Boolean")
    return named.otherwise("String")


def inferred_type(counts: dict[str, int]) -> str:
    """What a column is whose values have these types."""
    if counts["String"] or (counts["Boolean"] and (counts["Integral"] or counts["Fractional"])):
        return "String"
    if counts["Boolean"]:
        return "Boolean"
    if counts["Fractional"]:
        return "Fractional"
    return "Integral" if counts["Integral"] else "Unknown"


@dataclass(frozen=True)
class DataType(ScanAnalyzer):
    """Distribution of the types of the values' texts."""

    column: str
    where: str | None = None
    metric_name = "Histogram"
    metric_kind = HistogramMetric

    def check(self, df: DataFrame) -> None:
        not_nested(df, self.column)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        kind = type_of_text(ref(df, self.column).cast("string"))
        if self.where is not None:  # rows out of scope count as unknown, as nulls do
            kind = F.when(F.expr(self.where), kind).otherwise("Unknown")
        return {k: F.sum((kind == k).cast("long")) for k in S.TypeCounts.names}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["Unknown"] is None else S.TypeCounts(*(int(v[k]) for k in S.TypeCounts.names))


@dataclass(frozen=True)
class ApproxCountDistinct(ScanAnalyzer):
    """Estimate of the distinct values, relative standard deviation 0.05."""

    column: str
    where: str | None = None

    def check(self, df: DataFrame) -> None:
        has_column(df, self.column)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"n": F.approx_count_distinct(when(self.where, ref(df, self.column)), 0.05)}

    def state_aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"sketch": F.hll_sketch_agg(when(self.where, ref(df, self.column).cast("string")))}

    def state(self, v: dict[str, Any]) -> S.State | None:
        sketch = v.get("sketch")
        return S.DistinctSketch(int(v["n"]), None if sketch is None else bytes(sketch))


def _quantiles(column: Column, asked: tuple[float, ...], error: float) -> Column:
    return F.percentile_approx(column, [float(q) for q in asked], max(1, round(1.0 / error)) if error > 0 else 2_147_483_647)


@dataclass(frozen=True)
class ApproxQuantile(ScanAnalyzer):
    column: str
    quantile: float
    relative_error: float = 0.01
    where: str | None = None

    @property
    def name(self) -> str:
        return f"ApproxQuantile-{self.quantile}"

    def check(self, df: DataFrame) -> None:
        in_unit_interval(self.quantile, self.relative_error)
        numeric(df, self.column)

    def _value(self, df: DataFrame) -> Column:
        return when(self.where, ref(df, self.column).cast("double"))

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"q": _quantiles(self._value(df), (self.quantile,), self.relative_error)}

    def state_aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"sketch": F.kll_sketch_agg_double(self._value(df), 400)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if not v["q"] else S.QuantileSketch((self.quantile,), tuple(v["q"]), bytes(v["sketch"]) if v.get("sketch") is not None else None)


@dataclass(frozen=True)
class ApproxQuantiles(ScanAnalyzer):
    column: str
    quantiles: tuple[float, ...]
    relative_error: float = 0.01
    metric_kind = KeyedDoubleMetric

    def __post_init__(self) -> None:
        object.__setattr__(self, "quantiles", tuple(self.quantiles))

    def check(self, df: DataFrame) -> None:
        for q in self.quantiles:
            in_unit_interval(q, self.relative_error)
        numeric(df, self.column)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"q": _quantiles(ref(df, self.column).cast("double"), self.quantiles, self.relative_error)}

    def state_aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"sketch": F.kll_sketch_agg_double(ref(df, self.column).cast("double"), 400)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if not v["q"] else S.Keyed(S.QuantileSketch(self.quantiles, tuple(v["q"]), bytes(v["sketch"]) if v.get("sketch") is not None else None))


@dataclass(frozen=True)
class ExactQuantile(ScanAnalyzer):
    """Interpolated between neighbouring values."""

    column: str
    quantile: float
    where: str | None = None

    @property
    def name(self) -> str:
        return f"ExactQuantile-{self.quantile}"

    def check(self, df: DataFrame) -> None:
        in_unit_interval(self.quantile)
        numeric(df, self.column)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"q": F.percentile(when(self.where, ref(df, self.column).cast("double")), self.quantile)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["q"] is None else S.Fixed(v["q"])


@dataclass(frozen=True)
class InterquartileRange(_Numeric):
    """Exact; has no mergeable state."""

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        return {"q": F.percentile(self.value(df), [0.25, 0.75])}

    def state(self, v: dict[str, Any]) -> S.State | None:
        return None if v["q"] is None else S.Fixed(v["q"][1] - v["q"][0])


@dataclass(frozen=True)
class KLLParameters:
    sketch_size: int = 2048
    shrinking_factor: float = 0.64
    number_of_buckets: int = 100

    def __str__(self) -> str:
        return f"KLLParameters({self.sketch_size},{self.shrinking_factor},{self.number_of_buckets})"


@dataclass(frozen=True)
class KLLSketch(ScanAnalyzer):
    """Equal-width buckets between the extremes, counted from a quantile sketch.

    The sketch's levels shrink by a fixed factor; the parameter is kept for its place in results.
    """

    column: str
    parameters: KLLParameters | None = None
    metric_name = "KLL"
    metric_kind = KLLMetric
    optional = ("parameters",)
    most_buckets: ClassVar[int] = 100

    def check(self, df: DataFrame) -> None:
        if (self.parameters or KLLParameters()).number_of_buckets > self.most_buckets:
            raise errors.IllegalAnalyzerParameterError(f"Cannot return KLL Sketch related values for more than {self.most_buckets} values")
        numeric(df, self.column)

    def aggregates(self, df: DataFrame) -> dict[str, Column]:
        x = ref(df, self.column).cast("double")
        size = min(65535, max(8, (self.parameters or KLLParameters()).sketch_size))
        return {"least": F.min(x), "most": F.max(x), "n": F.count(x), "sketch": F.kll_sketch_agg_double(x, size)}

    def state(self, v: dict[str, Any]) -> S.State | None:
        p = self.parameters or KLLParameters()
        return S.KLLState(v["least"], v["most"], int(v["n"]), p.number_of_buckets, p.shrinking_factor, p.sketch_size, bytes(v["sketch"])) if v["n"] else None


def in_unit_interval(quantile: float, error: float = 0.0) -> None:
    if not 0.0 <= quantile <= 1.0:
        raise errors.IllegalAnalyzerParameterError(f"Quantile must be in the interval [0, 1]. Currently, the value is: {quantile}!")
    if not 0.0 <= error <= 1.0:
        raise errors.IllegalAnalyzerParameterError(f"Relative error parameter must be in the interval [0, 1]. Currently, the value is: {error}!")

