"""Constraint suggestion: rules look at column profiles and propose constraints, as objects and as code."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import ROUND_DOWN, ROUND_UP, Decimal
from statistics import NormalDist
from typing import Any, Protocol

from pyspark.sql import DataFrame

from dqengine import constraints as C
from dqengine import operators as O
from dqengine.assertions import IS_ONE, Is
from dqengine.checks import CamelCase, Check, CheckLevel, sql_text
from dqengine.constraints import ConstrainableDataTypes, Constraint
from dqengine.functions.expr import quote
from dqengine.metrics import DistributionValue
from dqengine.operators.histogram import NULL_VALUE
from dqengine.profiling import ColumnProfile, ColumnProfilerRun, ColumnProfiles, NumericColumnProfile, StringColumnProfile
from dqengine.verification import VerificationResult, verify

# confidence intervals


@dataclass(frozen=True)
class ConfidenceInterval:
    lower_bound: float
    upper_bound: float


class IntervalStrategy(Protocol):
    def calculate(self, p: float, n: int, confidence: float = 0.95) -> ConfidenceInterval: ...


def _valid(p: float, confidence: float) -> float:
    if not 0.0 <= p <= 1.0 or not 0.0 <= confidence <= 1.0:
        raise ValueError("the share and the confidence must be between 0 and 1")
    return NormalDist().inv_cdf(1.0 - (1.0 - confidence) / 2)


def _places(x: float, how: str) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), rounding=how))


@dataclass(frozen=True)
class WaldInterval:
    """Normal approximation; bounds widened to two decimals."""

    def calculate(self, p: float, n: int, confidence: float = 0.95) -> ConfidenceInterval:
        margin = _valid(p, confidence) * math.sqrt(p * (1 - p) / n)
        return ConfidenceInterval(_places(p - margin, ROUND_DOWN), _places(p + margin, ROUND_UP))


@dataclass(frozen=True)
class WilsonScoreInterval:
    """Wilson's score interval; bounds widened to two decimals."""

    def calculate(self, p: float, n: int, confidence: float = 0.95) -> ConfidenceInterval:
        z = _valid(p, confidence)
        centre, under = p + z * z / (2 * n), 1 + z * z / n
        margin = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return ConfidenceInterval(_places((centre - margin) / under, ROUND_DOWN), _places((centre + margin) / under, ROUND_UP))


# suggestions


@dataclass
class ConstraintSuggestion:
    constraint: Constraint
    column: str
    current_value: str
    description: str
    rule: ConstraintRule
    code: str

    def to_dict(self) -> dict[str, str]:
        return {"constraint_name": self.constraint.name, "column_name": self.column, "current_value": self.current_value, "description": self.description, "suggesting_rule": str(self.rule), "rule_description": self.rule.description, "code_for_constraint": self.code}


class ConstraintRule:
    description: str = ""

    def applies(self, profile: ColumnProfile, n: int) -> bool:
        raise NotImplementedError

    def candidate(self, profile: ColumnProfile, n: int) -> ConstraintSuggestion:
        raise NotImplementedError

    def __str__(self) -> str:
        return f"{type(self).__name__}()"


class CompleteIfComplete(ConstraintRule):
    description = "No value is missing: none may be from now on"

    def applies(self, profile, n):
        return profile.completeness == 1.0

    def candidate(self, profile, n):
        c = profile.column
        return ConstraintSuggestion(C.of(O.Completeness(c), IS_ONE), c, f"Completeness: {profile.completeness}", f"{c} has a value in each row", self, f".is_complete({c!r})")


@dataclass(eq=False)
class RetainCompleteness(ConstraintRule):
    min_completeness: float = 0.2
    max_completeness: float = 1.0
    interval: IntervalStrategy = WaldInterval()
    description = "Some values are missing: their share may not grow beyond what sampling explains (lower end of a confidence interval)"

    __str__ = ConstraintRule.__str__

    def applies(self, profile, n):
        return self.min_completeness < profile.completeness < self.max_completeness

    def candidate(self, profile, n):
        c, least = profile.column, self.interval.calculate(profile.completeness, n).lower_bound
        test = Is(">=", least)
        return ConstraintSuggestion(C.of(O.Completeness(c), test), c, f"Completeness: {profile.completeness}", f"at least {100 * least:.4g} % of {c} are present", self, f'.has_completeness({c!r}, Is(">=", {least}), "at least {least} is expected")')


class RetainType(ConstraintRule):
    description = "The values read as numbers or booleans: they should go on doing so"

    def applies(self, profile, n):
        return profile.is_data_type_inferred and profile.data_type in ("Integral", "Fractional", "Boolean")

    def candidate(self, profile, n):
        c, kind = profile.column, ConstrainableDataTypes(profile.data_type)
        return ConstraintSuggestion(C.data_type(O.DataType(c), kind), c, f"DataType: {profile.data_type}", f"{c} holds {profile.data_type} values", self, f".has_data_type({c!r}, ConstrainableDataTypes.{kind.name})")


Categories = list[tuple[str, DistributionValue]]


def by_popularity(categories: Categories) -> Categories:
    return sorted(categories, key=lambda kv: -kv[1].absolute)


def _singles(profile: ColumnProfile) -> float | None:
    """Share of values that occur once; None without a histogram of text or integers."""
    if profile.histogram is None or profile.data_type not in ("String", "Integral") or not profile.histogram.values:
        return None
    values = profile.histogram.values
    return sum(v.absolute == 1 for v in values.values()) / len(values)


def _within(column: str, categories: list[str], label: str, test: Callable[[float], bool], hint: str | None = None) -> Constraint:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in categories)
    # the label shows plain SQL; the predicate escapes as Spark's own literals do
    return C.of(O.Compliance(label.format(listed), f"{quote(column)} IN ({', '.join(map(sql_text, categories))})", columns=(column,)), test, hint)


@dataclass(eq=False)
class CategoricalRange(ConstraintRule):
    sorter: Callable[[Categories], Categories] = by_popularity
    description = "Few different values: no others are expected"
    __str__ = ConstraintRule.__str__

    def applies(self, profile, n):
        share = _singles(profile)
        return share is not None and share <= 0.1

    def candidate(self, profile, n):
        c = profile.column
        values = [k for k, _ in self.sorter([kv for kv in profile.histogram.values.items() if kv[0] != NULL_VALUE])]
        constraint = _within(c, values, f"{c} is one of {{0}}", IS_ONE)
        return ConstraintSuggestion(constraint, c, "Compliance: 1", constraint.analyzer.instance, self, f".is_contained_in({c!r}, {values!r})")


@dataclass(eq=False)
class FractionalCategoricalRange(ConstraintRule):
    target_coverage: float = 0.9
    sorter: Callable[[Categories], Categories] = by_popularity
    interval: IntervalStrategy = WaldInterval()
    description = "A few values make up most rows: about that share should stay among them"
    __str__ = ConstraintRule.__str__

    def _top(self, profile: ColumnProfile) -> Categories:
        covered, top = 0.0, []
        for kv in sorted(profile.histogram.values.items(), key=lambda kv: -kv[1].ratio):
            if covered >= self.target_coverage:
                break
            covered += kv[1].ratio
            top.append(kv)
        return top

    def applies(self, profile, n):
        share = _singles(profile)
        return share is not None and share <= 0.4 and sum(v.ratio for _, v in self._top(profile)) < 1

    def candidate(self, profile, n):
        c, top = profile.column, self._top(profile)
        covered = sum(v.ratio for _, v in top)
        values = [k for k, _ in self.sorter([kv for kv in top if kv[0] != NULL_VALUE])]
        least = self.interval.calculate(min(1.0, covered), n).lower_bound
        hint = f"at least {least} is expected"
        constraint = _within(c, values, f"{c} is one of {{0}} in {100 * least:.4g} % of rows or more", Is(">=", least), hint)
        return ConstraintSuggestion(constraint, c, f"Compliance: {covered}", constraint.analyzer.instance, self, f'.is_contained_in({c!r}, {values!r}, Is(">=", {least}), {hint!r})')


class NonNegativeNumbers(ConstraintRule):
    description = "No number is below zero: none should be"

    def applies(self, profile, n):
        return isinstance(profile, NumericColumnProfile) and profile.minimum is not None and profile.minimum >= 0.0

    def candidate(self, profile, n):
        c = profile.column
        constraint = Check(CheckLevel.WARNING, "").is_non_negative(c).constraints[0]
        return ConstraintSuggestion(constraint, c, f"Minimum: {profile.minimum}", f"{c} is zero or more", self, f".is_non_negative({c!r})")


class UniqueIfApproximatelyUnique(ConstraintRule):
    description = "About as many different values as rows, within the error of the sketch: they should be unique"

    def applies(self, profile, n):
        return profile.completeness == 1.0 and n > 0 and abs(1.0 - profile.approximate_num_distinct_values / n) <= 0.08

    def candidate(self, profile, n):
        c = profile.column
        return ConstraintSuggestion(C.of(O.Uniqueness((c,)), IS_ONE), c, f"ApproxDistinctness: {profile.approximate_num_distinct_values / n}", f"{c} repeats no value", self, f".is_unique({c!r})")


@dataclass(eq=False)
class _Bound(ConstraintRule):
    """A statistic of the profile as a constraint."""

    label: str
    attribute: str
    analyzer: type
    test: str
    method: str
    kind: type = NumericColumnProfile

    def __str__(self) -> str:
        return f"{self.label}()"

    @property
    def description(self) -> str:
        return f"The {self.attribute.replace('_', ' ')} seen now bounds later data"

    def applies(self, profile, n):
        return isinstance(profile, self.kind) and getattr(profile, self.attribute) is not None

    def candidate(self, profile, n):
        c, value = profile.column, getattr(profile, self.attribute)
        name = self.attribute.replace("_", " ")
        words = {"==": "is", ">=": "is at least", "<=": "is at most"}[self.test]
        return ConstraintSuggestion(C.of(self.analyzer(c), Is(self.test, value)), c, f"{self.label.removeprefix('Has')}: {value}", f"'{c}' {name} {words} {value}", self, f'.{self.method}({c!r}, Is("{self.test}", {value}))')


def HasMin() -> ConstraintRule:  # noqa: N802
    return _Bound("HasMin", "minimum", O.Minimum, "==", "has_min")


def HasMax() -> ConstraintRule:  # noqa: N802
    return _Bound("HasMax", "maximum", O.Maximum, "==", "has_max")


def HasMean() -> ConstraintRule:  # noqa: N802
    return _Bound("HasMean", "mean", O.Mean, "==", "has_mean")


def HasStandardDeviation() -> ConstraintRule:  # noqa: N802
    return _Bound("HasStandardDeviation", "std_dev", O.StandardDeviation, "==", "has_standard_deviation")


def HasMinLength() -> ConstraintRule:  # noqa: N802
    return _Bound("HasMinLength", "min_length", O.MinLength, ">=", "has_min_length", StringColumnProfile)


def HasMaxLength() -> ConstraintRule:  # noqa: N802
    return _Bound("HasMaxLength", "max_length", O.MaxLength, "<=", "has_max_length", StringColumnProfile)


class Rules:
    DEFAULT = (CompleteIfComplete(), RetainCompleteness(), RetainType(), CategoricalRange(), FractionalCategoricalRange(), NonNegativeNumbers())
    STRING = (HasMinLength(), HasMaxLength())
    NUMERICAL = (HasMin(), HasMax(), HasMean(), HasStandardDeviation())
    COMMON = (UniqueIfApproximatelyUnique(),)
    EXTENDED = (*DEFAULT, *STRING, *NUMERICAL, *COMMON)


@dataclass
class ConstraintSuggestionResult:
    column_profiles: ColumnProfiles
    suggestions: dict[str, list[ConstraintSuggestion]]
    verification: VerificationResult | None = None

    def all_suggestions(self) -> list[ConstraintSuggestion]:
        return [s for found in self.suggestions.values() for s in found]

    def suggestions_as_json(self) -> str:
        return json.dumps({"constraint_suggestions": [s.to_dict() for s in self.all_suggestions()]})

    def evaluation_as_json(self) -> str:
        status = {}
        if self.verification is not None:
            for r in self.verification.check_results.values():
                status = {x.constraint: x.status.value for x in r.constraint_results}
        return json.dumps({"constraint_suggestions": [s.to_dict() | {"constraint_result_on_test_set": status.get(s.constraint, "Unknown")} for s in self.all_suggestions()]})


def suggest(df: DataFrame, rules: Iterable[ConstraintRule] = Rules.DEFAULT, *, test_ratio: float | None = None, seed: int | None = None, **options: Any) -> ConstraintSuggestionResult:
    """Profiles (the training part of) df, applies the rules, and verifies what they suggest on the test part.

    options: those of profiling.profile.
    """
    if test_ratio is not None and not 0.0 < test_ratio < 1.0:
        raise ValueError("Testset ratio must be in ]0, 1[")
    from dqengine.profiling import profile

    train, test = (df, None) if test_ratio is None else df.randomSplit([1 - test_ratio, test_ratio], seed)
    profiles = profile(train, **options)
    rules = list(rules)
    found = {c: [r.candidate(p, profiles.num_records) for r in rules if r.applies(p, profiles.num_records)] for c, p in profiles.profiles.items()}
    found = {c: s for c, s in found.items() if s}
    verification = None
    if test is not None:
        check = Check(CheckLevel.WARNING, "generated constraints", tuple(dict.fromkeys(s.constraint for ss in found.values() for s in ss)))
        verification = verify(test, [check])
    return ConstraintSuggestionResult(profiles, found, verification)


class ConstraintSuggestionRun(CamelCase):
    """Builder: ConstraintSuggestionRunner.on_data(df).add_constraint_rules(Rules.DEFAULT).run()."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._rules: list[ConstraintRule] = []
        self._profiler = ColumnProfilerRun(df)
        self._split: dict[str, Any] = {}
        self._files: dict[str, tuple[str, bool]] = {}

    def add_constraint_rule(self, rule: ConstraintRule) -> ConstraintSuggestionRun:
        self._rules.append(rule)
        return self

    def add_constraint_rules(self, rules: Iterable[ConstraintRule]) -> ConstraintSuggestionRun:
        self._rules += list(rules)
        return self

    def use_train_test_split_with_testset_ratio(self, ratio: float, seed: int | None = None) -> ConstraintSuggestionRun:
        self._split = {"test_ratio": ratio, "seed": seed}
        return self

    def save_constraint_suggestions_json_to_path(self, path: str, overwrite: bool = False) -> ConstraintSuggestionRun:
        self._files["suggestions"] = (path, overwrite)
        return self

    def save_evaluation_results_json_to_path(self, path: str, overwrite: bool = False) -> ConstraintSuggestionRun:
        self._files["evaluation"] = (path, overwrite)
        return self

    def __getattr__(self, name: str) -> Any:
        """Options of the profiler."""
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return super().__getattr__(name)
        except AttributeError:
            method = getattr(self._profiler, name)

        def chained(*args: Any, **kwargs: Any) -> ConstraintSuggestionRun:
            method(*args, **kwargs)
            return self

        return chained

    def run(self) -> ConstraintSuggestionResult:
        df = self._df.cache() if self._profiler._cache else self._df
        try:
            result = suggest(df, self._rules, **self._split, **self._profiler._options)
        finally:
            if self._profiler._cache:
                df.unpersist()
        from dqengine.sources.files import write_text

        spark = self._df.sparkSession
        if self._profiler._json:
            write_text(spark, self._profiler._json[0], result.column_profiles.to_json(), self._profiler._json[1])
        for kind, (path, overwrite) in self._files.items():
            write_text(spark, path, result.suggestions_as_json() if kind == "suggestions" else result.evaluation_as_json(), overwrite)
        return result


class ConstraintSuggestionRunner:
    @staticmethod
    def on_data(df: DataFrame) -> ConstraintSuggestionRun:
        return ConstraintSuggestionRun(df)

    onData = on_data  # noqa: N815
