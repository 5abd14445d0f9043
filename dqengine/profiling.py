"""Column profiles in three passes: generic statistics, numeric statistics, exact histograms."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine import operators as O
from dqengine.checks import CamelCase
from dqengine.functions.expr import quote, ref
from dqengine.metrics import BucketDistribution, Distribution, DistributionValue
from dqengine.operators.base import AnalyzerOptions, NullBehavior
from dqengine.operators.histogram import NULL_VALUE
from dqengine.operators.scan import inferred_type
from dqengine.plans.runner import AnalyzerContext, run_analyzers

#: Columns with at most so many (approximately) distinct values get a histogram.
LOW_CARDINALITY = 120


@dataclass
class ColumnProfile:
    column: str
    completeness: float
    approximate_num_distinct_values: int
    data_type: str
    is_data_type_inferred: bool
    type_counts: dict[str, int] = field(default_factory=dict)
    histogram: Distribution | None = None

    def to_dict(self) -> dict[str, Any]:
        d: dict[str, Any] = {
            "column": self.column,
            "dataType": self.data_type,
            "isDataTypeInferred": str(self.is_data_type_inferred).lower(),
            "completeness": self.completeness,
            "approximateNumDistinctValues": self.approximate_num_distinct_values,
        }
        if self.type_counts:
            d["typeCounts"] = self.type_counts
        if self.histogram is not None:
            d["histogram"] = [{"value": k, "count": v.absolute, "ratio": v.ratio} for k, v in self.histogram.values.items()]
        return d


@dataclass
class StandardColumnProfile(ColumnProfile):
    pass


@dataclass
class StringColumnProfile(ColumnProfile):
    min_length: float | None = None
    max_length: float | None = None

    def to_dict(self) -> dict[str, Any]:
        return super().to_dict() | {k: v for k, v in (("minLength", self.min_length), ("maxLength", self.max_length)) if v is not None}


@dataclass
class NumericColumnProfile(ColumnProfile):
    kll: BucketDistribution | None = None
    mean: float | None = None
    maximum: float | None = None
    minimum: float | None = None
    range: float | None = None
    interquartile_range: float | None = None
    sum: float | None = None
    std_dev: float | None = None
    variance: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    zeros_count: int | None = None
    approx_percentiles: list[float] | None = None

    def to_dict(self) -> dict[str, Any]:
        names = {"zerosCount": self.zeros_count, "mean": self.mean, "maximum": self.maximum, "minimum": self.minimum, "range": self.range, "interquartileRange": self.interquartile_range, "sum": self.sum, "stdDev": self.std_dev, "variance": self.variance, "skewness": self.skewness, "kurtosis": self.kurtosis}
        d = super().to_dict() | {k: v for k, v in names.items() if v is not None}
        if self.kll is not None:
            d["kll"] = {"buckets": [{"low_value": b.low, "high_value": b.high, "count": b.count} for b in self.kll.buckets], "sketch": {"parameters": {"c": self.kll.parameters[0], "k": self.kll.parameters[1]}}}
        if self.approx_percentiles is not None:
            d["approxPercentiles"] = self.approx_percentiles
        return d


@dataclass
class ColumnProfiles:
    profiles: dict[str, ColumnProfile]
    num_records: int

    def to_json(self) -> str:
        return json.dumps({"columns": [p.to_dict() for p in self.profiles.values()]})


_KNOWN = {T.ShortType: "Integral", T.IntegerType: "Integral", T.LongType: "Integral", T.DecimalType: "Fractional", T.FloatType: "Fractional", T.DoubleType: "Fractional", T.BooleanType: "Boolean", T.TimestampType: "String", T.TimestampNTZType: "String"}


def profile(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    *,
    low_cardinality: int = LOW_CARDINALITY,
    kll: bool = False,
    kll_parameters: O.KLLParameters | None = None,
    predefined_types: Mapping[str, str] | None = None,
    print_status: bool = False,
    **options: Any,
) -> ColumnProfiles:
    """options: repository, reuse_key, fail_if_missing and save_key of run_analyzers."""
    names = list(columns) if columns is not None else list(df.columns)
    if lost := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(lost)}")
    data = df.select(*(F.col(quote(c)) for c in names))
    predefined = dict(predefined_types or {})
    strings = [c for c in names if isinstance(df.schema[c].dataType, T.StringType) and c not in predefined]
    nested = {c for c in names if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))}

    def say(text: str) -> None:
        if print_status:
            print(text)

    say("profile: types, completeness and distinct values of all columns")
    empty = AnalyzerOptions(NullBehavior.EMPTY_STRING)
    first: list[Any] = [O.Size()]
    for c in names:
        first += [] if c in nested else [O.Completeness(quote(c)), O.ApproxCountDistinct(quote(c))]
        if c in strings:
            first += [O.DataType(quote(c)), O.MinLength(quote(c), options=empty), O.MaxLength(quote(c), options=empty)]
    context = run_analyzers(data, first, **options)
    n = int(context.metrics[O.Size()].get())

    def value(analyzer: Any) -> Any:
        m = context.metrics.get(analyzer)
        return m.value if m is not None and m.ok else None

    types: dict[str, str] = {}
    counts: dict[str, dict[str, int]] = {}
    for c in names:
        if c in strings:
            d = value(O.DataType(quote(c)))
            counts[c] = {k: v.absolute for k, v in d.values.items()} if d else {}
            types[c] = inferred_type(counts[c]) if d else "Unknown"
        else:
            types[c] = predefined.get(c) or _KNOWN.get(type(df.schema[c].dataType), "Unknown")
    inferred_numbers = {c: {"Integral": "long", "Fractional": "double"}[types[c]] for c in names if (c in strings or c in predefined) and isinstance(df.schema[c].dataType, T.StringType) and types[c] in ("Integral", "Fractional")}
    cast = data.select(*(F.col(quote(c)).try_cast(inferred_numbers[c]).alias(c) if c in inferred_numbers else F.col(quote(c)) for c in names))

    say("profile: statistics of numbers")
    numbers = [c for c in names if types[c] in ("Integral", "Fractional")]
    kinds = (O.Minimum, O.Maximum, O.Range, O.InterquartileRange, O.Mean, O.StandardDeviation, O.Variance, O.Skewness, O.Kurtosis, O.Sum, O.ZerosCount)
    second = [k(quote(c)) for c in numbers for k in kinds] + [O.KLLSketch(quote(c), kll_parameters) for c in numbers if kll]
    if second:
        context = context + run_analyzers(cast, second, **options)

    say("profile: counts of the values of columns with few")
    few = [c for c in names if types[c] in ("String", "Boolean", "Integral", "Fractional") and c not in nested and (value(O.ApproxCountDistinct(quote(c))) or 0) <= low_cardinality]
    histograms = value_counts(cast, few)

    profiles: dict[str, ColumnProfile] = {}
    for c in names:
        h = None
        if c in histograms:
            h = Distribution({k: DistributionValue(v, v / n if n else 0.0) for k, v in histograms[c].items()}, len(histograms[c]))
        base: dict[str, Any] = {"column": c, "completeness": value(O.Completeness(quote(c))) if n else 1.0, "approximate_num_distinct_values": int(value(O.ApproxCountDistinct(quote(c))) or 0), "data_type": types[c], "is_data_type_inferred": c in strings, "type_counts": counts.get(c, {}), "histogram": h}
        if c in numbers:
            x = {k: value(k(quote(c))) for k in kinds}
            sketch = value(O.KLLSketch(quote(c), kll_parameters)) if kll else None
            profiles[c] = NumericColumnProfile(
                **base, kll=sketch, mean=x[O.Mean], maximum=x[O.Maximum], minimum=x[O.Minimum], range=x[O.Range], interquartile_range=x[O.InterquartileRange], sum=x[O.Sum], std_dev=x[O.StandardDeviation],
                variance=x[O.Variance], skewness=x[O.Skewness], kurtosis=x[O.Kurtosis], zeros_count=None if x[O.ZerosCount] is None else int(x[O.ZerosCount]), approx_percentiles=sketch.percentiles if sketch else None,
            )
        elif types[c] == "String" and c in strings:
            profiles[c] = StringColumnProfile(**base, min_length=value(O.MinLength(quote(c), options=empty)), max_length=value(O.MaxLength(quote(c), options=empty)))
        else:
            profiles[c] = StandardColumnProfile(**base)
    return ColumnProfiles(profiles, n)


def value_counts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Exact counts of the values, as text, of all these columns, from one job.

    Only for columns of few values: their number bounds the result.
    """
    if not columns:
        return {}
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(ref(df, quote(c)).cast("string"), F.lit(NULL_VALUE)).alias("v")) for c in columns))
    rows = df.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n")).orderBy("c", F.desc("n"), "v").collect()
    found: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in rows:
        found[r["c"]][r["v"]] = r["n"]
    return found


class ColumnProfilerRun(CamelCase):
    """Builder: ColumnProfilerRunner.on_data(df).with_kll_profiling().run()."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._options: dict[str, Any] = {}
        self._cache = False
        self._json: tuple[str, bool] | None = None
        self._overwrite = False

    def _set(self, **values: Any) -> ColumnProfilerRun:
        self._options |= values
        return self

    def print_status_updates(self, on: bool = True) -> ColumnProfilerRun:
        return self._set(print_status=on)

    def cache_inputs(self, on: bool = True) -> ColumnProfilerRun:
        self._cache = on
        return self

    def with_low_cardinality_histogram_threshold(self, n: int) -> ColumnProfilerRun:
        return self._set(low_cardinality=n)

    def restrict_to_columns(self, columns: Iterable[str]) -> ColumnProfilerRun:
        return self._set(columns=list(columns))

    def with_kll_profiling(self) -> ColumnProfilerRun:
        return self._set(kll=True)

    def set_kll_parameters(self, parameters: O.KLLParameters | None) -> ColumnProfilerRun:
        return self._set(kll_parameters=parameters)

    def set_predefined_types(self, types: Mapping[str, str]) -> ColumnProfilerRun:
        return self._set(predefined_types=types)

    def use_repository(self, repository: Any) -> ColumnProfilerRun:
        return self._set(repository=repository)

    def reuse_existing_results_for_key(self, key: Any, fail_if_missing: bool = False) -> ColumnProfilerRun:
        return self._set(reuse_key=key, fail_if_missing=fail_if_missing)

    def save_or_append_result(self, key: Any) -> ColumnProfilerRun:
        return self._set(save_key=key)

    def use_spark_session(self, spark: Any) -> ColumnProfilerRun:
        """The data's session is used in any case."""
        return self

    def save_column_profiles_json_to_path(self, path: str, overwrite: bool = False) -> ColumnProfilerRun:
        self._json = (path, overwrite)
        return self

    def run(self) -> ColumnProfiles:
        df = self._df.persist(StorageLevel.MEMORY_AND_DISK) if self._cache else self._df
        try:
            result = profile(df, **self._options)
        finally:
            if self._cache:
                df.unpersist()
        if self._json:
            from dqengine.sources.files import write_text

            write_text(self._df.sparkSession, self._json[0], result.to_json(), self._json[1])
        return result


class ColumnProfilerRunner:
    @staticmethod
    def on_data(df: DataFrame) -> ColumnProfilerRun:
        return ColumnProfilerRun(df)

    onData = on_data  # noqa: N815


__all__ = ["AnalyzerContext", "ColumnProfile", "ColumnProfilerRunner", "ColumnProfiles", "NumericColumnProfile", "StandardColumnProfile", "StringColumnProfile", "profile", "value_counts"]
