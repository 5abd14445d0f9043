"""Verification: compute what the checks need, evaluate them, report."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from dqengine.checks import CamelCase, Check, CheckLevel, CheckResult, CheckStatus
from dqengine.constraints import ConstraintStatus
from dqengine.metrics import Metric
from dqengine.operators.base import Analyzer
from dqengine.plans.runner import AnalyzerContext, run_analyzers, run_on_aggregated_states

CHECK_SCHEMA = "`check` string, check_level string, check_status string, constraint string, constraint_status string, constraint_message string"


@dataclass
class VerificationResult(CamelCase):
    status: CheckStatus
    check_results: dict[Check, CheckResult]
    metrics: dict[Analyzer, Metric]

    def context(self) -> AnalyzerContext:
        return AnalyzerContext(self.metrics)

    def rows(self, checks: Iterable[Check] | None = None) -> list[tuple[str, ...]]:
        asked = None if checks is None else list(checks)
        return [
            (c.description, c.level.value, r.status.value, x.constraint.name, x.status.value, x.message or "")
            for c, r in self.check_results.items()
            if asked is None or c in asked
            for x in r.constraint_results
        ]

    def check_results_as_dataframe(self, spark: SparkSession, checks: Iterable[Check] | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows(checks), CHECK_SCHEMA)

    def check_results_as_json(self, checks: Iterable[Check] | None = None) -> str:
        names = ("check", "check_level", "check_status", "constraint", "constraint_status", "constraint_message")
        return json.dumps([dict(zip(names, r, strict=True)) for r in self.rows(checks)])

    def success_metrics_as_dataframe(self, spark: SparkSession, analyzers: Iterable[Analyzer] | None = None) -> DataFrame:
        return self.context().success_metrics_as_dataframe(spark, analyzers)

    def success_metrics_as_json(self, analyzers: Iterable[Analyzer] | None = None) -> str:
        return self.context().success_metrics_as_json(analyzers)

    def row_level_results_as_dataframe(self, df: DataFrame) -> DataFrame:
        """df with one boolean column for each check that judges rows: all its constraints hold for the row."""
        added = {}
        for check in self.check_results:
            columns = [x for c in check.constraints if (x := c.rows(df, self.metrics.get(c.analyzer))) is not None]
            if columns:
                added[check.description] = reduce(and_, columns)
        return df.select("*", *(c.alias(name) for name, c in added.items()))

    def failed_constraints(self) -> list[tuple[str, str]]:
        return [(r[3], r[5]) for r in self.rows() if r[4] == ConstraintStatus.FAILURE.value]


def evaluate(checks: list[Check], context: AnalyzerContext) -> VerificationResult:
    results = {c: c.evaluate(context.metrics) for c in checks}
    status = max((r.status for r in results.values()), key=lambda s: s.severity, default=CheckStatus.SUCCESS)
    return VerificationResult(status, results, context.metrics)


def _needed(checks: list[Check], analyzers: Iterable[Analyzer]) -> list[Analyzer]:
    return list(dict.fromkeys([*analyzers, *(a for c in checks for a in c.required_analyzers())]))


def verify(df: DataFrame, checks: Iterable[Check], required_analyzers: Iterable[Analyzer] = (), **options: Any) -> VerificationResult:
    """options: those of run_analyzers. Metrics are saved after the checks, so anomaly checks see the history only."""
    checks = list(checks)
    save_key, repository = options.pop("save_key", None), options.get("repository")
    context = run_analyzers(df, _needed(checks, required_analyzers), **options)
    result = evaluate(checks, context)
    if repository is not None and save_key is not None:
        earlier = repository.load_by_key(save_key)
        repository.save(save_key, (earlier + context) if earlier is not None else context)
    return result


@dataclass(frozen=True)
class AnomalyCheckConfig:
    level: CheckLevel
    description: str
    with_tag_values: Mapping[str, str] | None = None
    after_date: int | None = None
    before_date: int | None = None


class VerificationRun(CamelCase):
    """Builder: VerificationSuite.on_data(df).add_check(check).run()."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._checks: list[Check] = []
        self._analyzers: list[Analyzer] = []
        self._options: dict[str, Any] = {}
        self._files: dict[str, tuple[str, bool]] = {}

    def add_check(self, check: Check) -> VerificationRun:
        self._checks.append(check)
        return self

    def add_checks(self, checks: Iterable[Check]) -> VerificationRun:
        self._checks += list(checks)
        return self

    def add_required_analyzer(self, analyzer: Analyzer) -> VerificationRun:
        self._analyzers.append(analyzer)
        return self

    def add_required_analyzers(self, analyzers: Iterable[Analyzer]) -> VerificationRun:
        self._analyzers += list(analyzers)
        return self

    def aggregate_with(self, store: Any) -> VerificationRun:
        self._options["aggregate_with"] = store
        return self

    def save_states_with(self, store: Any) -> VerificationRun:
        self._options["save_states_with"] = store
        return self

    def use_repository(self, repository: Any) -> VerificationRun:
        self._options["repository"] = repository
        return self

    def reuse_existing_results_for_key(self, key: Any, fail_if_missing: bool = False) -> VerificationRun:
        self._options |= {"reuse_key": key, "fail_if_missing": fail_if_missing}
        return self

    def save_or_append_result(self, key: Any) -> VerificationRun:
        self._options["save_key"] = key
        return self

    def add_anomaly_check(self, strategy: Any, analyzer: Analyzer, config: AnomalyCheckConfig | None = None) -> VerificationRun:
        """The newest value of the metric must not be an anomaly in the repository's history."""
        if "repository" not in self._options:
            raise ValueError("use_repository() comes first")
        config = config or AnomalyCheckConfig(CheckLevel.WARNING, f"Anomaly check for {analyzer}")
        check = Check(config.level, config.description)
        return self.add_check(check.is_newest_point_non_anomalous(self._options["repository"], strategy, analyzer, config.with_tag_values, config.after_date, config.before_date))

    def use_spark_session(self, spark: SparkSession) -> VerificationRun:
        """The data's session is used in any case."""
        return self

    def save_check_results_json_to_path(self, path: str, overwrite: bool = False) -> VerificationRun:
        self._files["checks"] = (path, overwrite)
        return self

    def save_success_metrics_json_to_path(self, path: str, overwrite: bool = False) -> VerificationRun:
        self._files["metrics"] = (path, overwrite)
        return self

    def run(self) -> VerificationResult:
        result = verify(self._df, self._checks, self._analyzers, **self._options)
        from dqengine.sources.files import write_text

        for kind, (path, overwrite) in self._files.items():
            write_text(self._df.sparkSession, path, result.check_results_as_json() if kind == "checks" else result.success_metrics_as_json(), overwrite)
        return result


class VerificationSuite:
    @staticmethod
    def on_data(df: DataFrame) -> VerificationRun:
        return VerificationRun(df)

    onData = on_data  # noqa: N815

    @staticmethod
    def run_on_aggregated_states(schema_of: DataFrame, checks: Iterable[Check], stores: Iterable[Any], required_analyzers: Iterable[Analyzer] = (), **options: Any) -> VerificationResult:
        """Checks on the union of the data whose states the stores hold."""
        checks = list(checks)
        return evaluate(checks, run_on_aggregated_states(schema_of, _needed(checks, required_analyzers), stores, **options))

    @staticmethod
    def is_check_applicable_to_data(check: Check, df: DataFrame) -> Any:
        from dqengine.applicability import is_check_applicable

        return is_check_applicable(check, df.schema, df.sparkSession)

    @staticmethod
    def are_analyzers_applicable_to_data(analyzers: Iterable[Analyzer], df: DataFrame) -> Any:
        from dqengine.applicability import are_analyzers_applicable

        return are_analyzers_applicable(analyzers, df.schema, df.sparkSession)


