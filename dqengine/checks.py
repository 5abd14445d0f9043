"""Checks: named lists of constraints, built fluently. Camel-case names of the methods work too."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame

from dqengine import constraints as C
from dqengine import operators as O
from dqengine.assertions import IS_ONE
from dqengine.constraints import ConstrainableDataTypes, Constraint, ConstraintResult, ConstraintStatus, RowLevel
from dqengine.functions.expr import quote
from dqengine.metrics import Metric
from dqengine.operators.base import Analyzer, AnalyzerOptions
from dqengine.operators.scan import Patterns

Test = Callable[[Any], bool]


class CheckLevel(str, Enum):
    ERROR = "Error"
    WARNING = "Warning"


class CheckStatus(str, Enum):
    SUCCESS = "Success"
    WARNING = "Warning"
    ERROR = "Error"

    @property
    def severity(self) -> int:
        return ["Success", "Warning", "Error"].index(self.value)


@dataclass
class CheckResult:
    check: Check
    status: CheckStatus
    constraint_results: list[ConstraintResult]


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", re.sub(r"URL|SQL", lambda m: m.group().capitalize(), name)).lower()


class CamelCase:
    """Lets methods be called by their camel-case names."""

    def __getattr__(self, name: str) -> Any:
        other = snake(name)
        if other == name or name.startswith("_"):
            raise AttributeError(name)
        return getattr(self, other)


def sql_text(value: Any) -> str:
    """A value as a SQL literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


@dataclass(frozen=True)
class Check(CamelCase):
    """Immutable: every method returns a new check. where() applies to the last constraint."""

    level: CheckLevel
    description: str
    constraints: tuple[Constraint, ...] = ()
    _last: Callable[[str | None], Constraint] | None = field(default=None, compare=False, repr=False)

    # building

    def add_constraint(self, constraint: Constraint) -> Check:
        return replace(self, constraints=(*self.constraints, constraint), _last=None)

    def add_constraints(self, constraints: Iterable[Constraint]) -> Check:
        return replace(self, constraints=(*self.constraints, *constraints), _last=None)

    def _add(self, make: Callable[[str | None], Constraint]) -> Check:
        return replace(self, constraints=(*self.constraints, make(None)), _last=make)

    def where(self, condition: str | None) -> Check:
        """Only rows for which the condition holds count for the constraint added last."""
        if self._last is None:
            raise ValueError("the last constraint takes no condition")
        return replace(self, constraints=(*self.constraints[:-1], self._last(condition)), _last=None)

    # sizes and columns

    def has_size(self, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.Size(w), assertion, hint, picker=int))

    def has_column_count(self, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.ColumnCount(), assertion, hint, picker=int))

    def has_column(self, column: str, hint: str | None = None) -> Check:
        return self.add_constraint(replace(C.of(O.ColumnExists(column), IS_ONE, hint), name=f"ColumnExistsConstraint({column})"))

    def has_zeros_count(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.ZerosCount(column, w), assertion, hint, picker=int))

    def has_duplicate_row_count(self, columns: Sequence[str], assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.DuplicateRowCount(tuple(columns), w, analyzer_options), assertion, hint, picker=int))

    # completeness

    def is_complete(self, column: str, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self.has_completeness(column, IS_ONE, hint, analyzer_options)

    def has_completeness(self, column: str, assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.Completeness(column, w, analyzer_options), assertion, hint))

    def _complete(self, label: str, joined: str, columns: Sequence[str], assertion: Test, hint: str | None) -> Check:
        return self.satisfies(joined.join(f"{quote(c)} IS NOT NULL" for c in columns), label, assertion, hint, tuple(columns))

    def are_complete(self, columns: Sequence[str], hint: str | None = None) -> Check:
        return self.have_completeness(columns, IS_ONE, hint)

    def have_completeness(self, columns: Sequence[str], assertion: Test, hint: str | None = None) -> Check:
        return self._complete("Combined Completeness", " AND ", columns, assertion, hint)

    def are_any_complete(self, columns: Sequence[str], hint: str | None = None) -> Check:
        return self.have_any_completeness(columns, IS_ONE, hint)

    def have_any_completeness(self, columns: Sequence[str], assertion: Test, hint: str | None = None) -> Check:
        return self._complete("Any Completeness", " OR ", columns, assertion, hint)

    # uniqueness

    def is_unique(self, column: str, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self.has_uniqueness(column, IS_ONE, hint, analyzer_options)

    def are_unique(self, columns: Sequence[str], hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self.has_uniqueness(columns, IS_ONE, hint, analyzer_options)

    def is_primary_key(self, column: str, *columns: str, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self.has_uniqueness((column, *columns), IS_ONE, hint, analyzer_options)

    def has_uniqueness(self, columns: str | Sequence[str], assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.Uniqueness(columns, w, analyzer_options), assertion, hint))

    def has_distinctness(self, columns: str | Sequence[str], assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.Distinctness(columns, w), assertion, hint))

    def has_unique_value_ratio(self, columns: str | Sequence[str], assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.UniqueValueRatio(columns, w, analyzer_options), assertion, hint))

    # other data and free forms

    def does_dataset_match(self, other: DataFrame, key_map: Mapping[str, str], assertion: Test, match_map: Mapping[str, str] | None = None, hint: str | None = None) -> Check:
        analyzer = O.DatasetMatch(other, tuple(key_map.items()), tuple(match_map.items()) if match_map else None)
        return self.add_constraint(replace(C.of(analyzer, assertion, hint), name="DatasetMatchConstraint"))

    def custom_sql(self, expression: str, assertion: Test, disambiguator: str = "*", hint: str | None = None) -> Check:
        return self.add_constraint(C.of(O.CustomSql(expression, disambiguator), assertion, hint))

    def has_aggregate(self, analyzer: O.CustomAggregator, assertion: Test, hint: str | None = None) -> Check:
        return self.add_constraint(C.of(analyzer, assertion, hint))

    def satisfies(self, predicate: str, name: str, assertion: Test = IS_ONE, hint: str | None = None, columns: Sequence[str] = (), analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.Compliance(name, predicate, w, tuple(columns), analyzer_options), assertion, hint))

    # distributions

    def has_number_of_distinct_values(self, column: str, assertion: Test, binning: Callable[[Column], Column] | None = None, max_bins: int = 1000, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.Histogram(column, binning, max_bins, w, False), assertion, hint, kind="HistogramBin", picker=lambda d: d.number_of_bins))

    def has_histogram_values(self, column: str, assertion: Test, binning: Callable[[Column], Column] | None = None, max_bins: int = 1000, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.Histogram(column, binning, max_bins, w), assertion, hint))

    def has_histogram_binned_values(self, column: str, assertion: Test, bin_count: int | None = None, edges: Sequence[float] | None = None, hint: str | None = None) -> Check:
        n = 10 if bin_count is None and edges is None else bin_count
        return self._add(lambda w: C.of(O.HistogramBinned(column, n, edges, where=w), assertion, hint))

    def has_histogram_binned_bins(self, column: str, assertion: Test, bin_count: int | None = None, edges: Sequence[float] | None = None, hint: str | None = None) -> Check:
        n = 10 if bin_count is None and edges is None else bin_count
        return self._add(lambda w: C.of(O.HistogramBinned(column, n, edges, where=w), assertion, hint, kind="HistogramBinnedBin", picker=lambda d: d.number_of_bins))

    def kll_sketch_satisfies(self, column: str, assertion: Test, parameters: O.KLLParameters | None = None, hint: str | None = None) -> Check:
        return self.add_constraint(C.of(O.KLLSketch(column, parameters), assertion, hint, kind="kllSketch"))

    def has_entropy(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.Entropy(column, w), assertion, hint))

    def has_mutual_information(self, a: str, b: str, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.MutualInformation((a, b), w), assertion, hint))

    def has_approx_quantile(self, column: str, quantile: float, assertion: Test, relative_error: float = 0.01, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.ApproxQuantile(column, quantile, relative_error, w), assertion, hint))

    def has_exact_quantile(self, column: str, quantile: float, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.ExactQuantile(column, quantile, w), assertion, hint))

    # numbers and lengths

    def has_min_length(self, column: str, assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.MinLength(column, w, analyzer_options), assertion, hint))

    def has_max_length(self, column: str, assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.MaxLength(column, w, analyzer_options), assertion, hint))

    def has_min(self, column: str, assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.Minimum(column, w, analyzer_options), assertion, hint))

    def has_max(self, column: str, assertion: Test, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        return self._add(lambda w: C.of(O.Maximum(column, w, analyzer_options), assertion, hint))

    def _number(self, kind: type[Analyzer], column: str, assertion: Test, hint: str | None) -> Check:
        return self._add(lambda w: C.of(kind(column, w), assertion, hint))

    def has_range(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.Range, column, assertion, hint)

    def has_interquartile_range(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.InterquartileRange, column, assertion, hint)

    def has_mean(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.Mean, column, assertion, hint)

    def has_sum(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.Sum, column, assertion, hint)

    def has_standard_deviation(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.StandardDeviation, column, assertion, hint)

    def has_variance(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.Variance, column, assertion, hint)

    def has_skewness(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.Skewness, column, assertion, hint)

    def has_kurtosis(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.Kurtosis, column, assertion, hint)

    def has_approx_count_distinct(self, column: str, assertion: Test, hint: str | None = None) -> Check:
        return self._number(O.ApproxCountDistinct, column, assertion, hint)

    def has_correlation(self, a: str, b: str, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.Correlation(a, b, w), assertion, hint))

    def has_ratio_of_sums(self, a: str, b: str, assertion: Test, hint: str | None = None) -> Check:
        return self._add(lambda w: C.of(O.RatioOfSums(a, b, w), assertion, hint))

    # patterns and types

    def has_pattern(self, column: str, pattern: str, assertion: Test = IS_ONE, name: str | None = None, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        def make(w: str | None) -> Constraint:
            made = C.of(O.PatternMatch(column, pattern, w, analyzer_options), assertion, hint)
            return replace(made, name=name or f"PatternMatchConstraint({column}, {pattern})")

        return self._add(make)

    def contains_credit_card_number(self, column: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self.has_pattern(column, Patterns.CREDITCARD, assertion, f"containsCreditCardNumber({column})", hint)

    def contains_email(self, column: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self.has_pattern(column, Patterns.EMAIL, assertion, f"containsEmail({column})", hint)

    def contains_url(self, column: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self.has_pattern(column, Patterns.URL, assertion, f"containsURL({column})", hint)

    def contains_social_security_number(self, column: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self.has_pattern(column, Patterns.SOCIAL_SECURITY_NUMBER_US, assertion, f"containsSocialSecurityNumber({column})", hint)

    def has_data_type(self, column: str, kind: ConstrainableDataTypes, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self._add(lambda w: C.data_type(O.DataType(column, w), kind, assertion, hint))

    # comparisons

    def is_non_negative(self, column: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self.satisfies(f"COALESCE(CAST({quote(column)} AS DECIMAL(20,10)), 0.0) >= 0", f"{column} is non-negative", assertion, hint, (column,))

    def is_positive(self, column: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self.satisfies(f"COALESCE(CAST({quote(column)} AS DECIMAL(20,10)), 1.0) > 0", f"{column} is positive", assertion, hint, (column,))

    def _compare(self, a: str, sign: str, words: str, b: str, assertion: Test, hint: str | None) -> Check:
        return self.satisfies(f"{quote(a)} {sign} {quote(b)}", f"{a} is {words} {b}", assertion, hint, (a, b))

    def is_less_than(self, a: str, b: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self._compare(a, "<", "less than", b, assertion, hint)

    def is_less_than_or_equal_to(self, a: str, b: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self._compare(a, "<=", "less than or equal to", b, assertion, hint)

    def is_greater_than(self, a: str, b: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self._compare(a, ">", "greater than", b, assertion, hint)

    def is_greater_than_or_equal_to(self, a: str, b: str, assertion: Test = IS_ONE, hint: str | None = None) -> Check:
        return self._compare(a, ">=", "greater than or equal to", b, assertion, hint)

    def is_contained_in(self, column: str, allowed: Sequence[Any] | float, assertion: Test | float = IS_ONE, *more: Any, hint: str | None = None, analyzer_options: AnalyzerOptions | None = None) -> Check:
        """In a list of values, or, given two numbers, between them (see is_contained_in_range). Nulls are allowed."""
        if isinstance(allowed, (int, float)):
            return self.is_contained_in_range(column, allowed, assertion, *more, hint=hint)
        hint = more[0] if more else hint
        values = ",".join(sql_text(v) for v in allowed)
        predicate = f"{quote(column)} IS NULL OR {quote(column)} IN ({values})"
        return self.satisfies(predicate, f"{column} contained in {','.join(map(str, allowed))}", assertion, hint, (column,), analyzer_options)

    def is_contained_in_range(self, column: str, lower: float, upper: float, include_lower: bool = True, include_upper: bool = True, hint: str | None = None) -> Check:
        """Nulls are allowed."""
        left, right = ">=" if include_lower else ">", "<=" if include_upper else "<"
        c = quote(column)
        return self.satisfies(f"{c} IS NULL OR ({c} {left} {lower} AND {c} {right} {upper})", f"{column} between {lower} and {upper}", IS_ONE, hint, (column,))

    def is_newest_point_non_anomalous(self, repository: Any, strategy: Any, analyzer: Analyzer, with_tag_values: Mapping[str, str] | None = None, after: int | None = None, before: int | None = None, hint: str | None = None) -> Check:
        from dqengine.anomaly import is_newest_point_non_anomalous

        test = is_newest_point_non_anomalous(repository, strategy, analyzer, dict(with_tag_values or {}), after, before)
        return self.add_constraint(Constraint(analyzer, test, f"AnomalyConstraint({analyzer})", hint=hint))

    # evaluating

    def evaluate(self, metrics: Mapping[Analyzer, Metric]) -> CheckResult:
        results = [c.evaluate(metrics) for c in self.constraints]
        failed = any(r.status is ConstraintStatus.FAILURE for r in results)
        return CheckResult(self, CheckStatus(self.level.value) if failed else CheckStatus.SUCCESS, results)

    def required_analyzers(self) -> list[Analyzer]:
        return list(dict.fromkeys(c.analyzer for c in self.constraints))

    def row_level_constraints(self) -> list[Constraint]:
        return [c for c in self.constraints if c.row_level is not RowLevel.NONE]

    def get_row_level_constraint_column_names(self) -> list[str]:
        return [c.row_column for c in self.row_level_constraints()]
