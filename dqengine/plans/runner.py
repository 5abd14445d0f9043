"""Runs analyzers in as few passes as their aggregates allow.

All scan analyzers share one aggregation, whatever their conditions. Analyzers
on the same grouping share one grouped frame, and their aggregates of it are one
job, which also yields the number of rows. Errors stay with the analyzer that
caused them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession


from dqengine import errors
from dqengine.functions.expr import find, quote
from dqengine.metrics import Metric
from dqengine.operators.base import Analyzer, ScanAnalyzer
from dqengine.operators.frequency import FrequencyAnalyzer, MutualInformation, base_aggregates, frequencies, merge_frequencies
from dqengine.operators.histogram import Histogram
from dqengine.operators.special import ColumnCount, ColumnExists

if TYPE_CHECKING:
    from dqengine.sources.repository import MetricsRepository, ResultKey
    from dqengine.sources.state_store import StateStore

METRIC_SCHEMA = "entity string, instance string, name string, value double"


@dataclass
class AnalyzerContext:
    """Metrics by analyzer."""

    metrics: dict[Analyzer, Metric] = field(default_factory=dict)

    def __add__(self, other: AnalyzerContext) -> AnalyzerContext:
        return AnalyzerContext(self.metrics | other.metrics)

    def __getitem__(self, analyzer: Analyzer) -> Metric:
        return self.metrics[analyzer]

    def metric(self, analyzer: Analyzer) -> Metric | None:
        return self.metrics.get(analyzer)

    def all_metrics(self) -> list[Metric]:
        return list(self.metrics.values())

    def rows(self, analyzers: Iterable[Analyzer] | None = None) -> list[tuple[str, str, str, float]]:
        """(entity, instance, name, value) of successful metrics; a condition is part of the name."""
        asked = None if analyzers is None else set(analyzers)
        found = []
        for a, m in self.metrics.items():
            if m.ok and (asked is None or a in asked):
                suffix = f" (where: {a.condition})" if a.condition else ""
                found += [(x.entity.value, x.instance, x.name + suffix, float(x.value)) for x in m.flatten()]
        return found

    def success_metrics_as_dataframe(self, spark: SparkSession, analyzers: Iterable[Analyzer] | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows(analyzers), METRIC_SCHEMA)

    def success_metrics_as_json(self, analyzers: Iterable[Analyzer] | None = None) -> str:
        return json.dumps([dict(zip(("entity", "instance", "name", "value"), r, strict=True)) for r in self.rows(analyzers)])


def _pruned(df: DataFrame, analyzers: list[Analyzer]) -> DataFrame:
    """Only the columns needed, where all analyzers say which."""
    needed: set[str] = set()
    for a in analyzers:
        used = a.columns_used()
        if used is None:
            return df
        for c in used:
            found = find(df, c)
            if found is None:  # a field path
                return df
            needed.add(found)
    return df.select(*(quote(c) for c in df.columns if c in needed)) if needed else df


def _scan(df: DataFrame, analyzers: list[ScanAnalyzer], with_states: bool) -> dict[Analyzer, dict[str, Any] | Exception]:
    """The aggregates of each analyzer, from one pass; equal aggregates are computed once."""
    plan: list[Column] = []
    places: dict[str, str] = {}
    wanted: dict[Analyzer, dict[str, str]] = {}
    results: dict[Analyzer, dict[str, Any] | Exception] = {}
    for a in analyzers:
        try:
            named = a.aggregates(df) | (a.state_aggregates(df) if with_states else {})
            wanted[a] = {}
            for name, column in named.items():
                text = str(column)
                if text not in places:
                    places[text] = f"c{len(places)}"
                    plan.append(column.alias(places[text]))
                wanted[a][name] = places[text]
        except Exception as e:  # noqa: BLE001  stays with this analyzer
            wanted.pop(a, None)
            results[a] = e
    if not wanted:
        return results
    try:
        row = _pruned(df, list(wanted)).agg(*plan).first()
        return results | {a: {n: row[c] for n, c in names.items()} for a, names in wanted.items()}
    except Exception as e:  # noqa: BLE001
        if len(wanted) == 1:
            return results | {next(iter(wanted)): e}
        # one bad expression fails the whole plan: halve to find it
        half = list(wanted)
        middle = len(half) // 2
        return results | _scan(df, half[:middle], with_states) | _scan(df, half[middle:], with_states)


def _grouped(df: DataFrame, columns: tuple[str, ...], where: str | None, analyzers: list[FrequencyAnalyzer], states: DataFrame | None, save: Any) -> dict[Analyzer, Metric]:
    """The metrics of analyzers that share a grouping; states: frequencies of earlier data to add."""
    results: dict[Analyzer, Metric] = {}
    try:
        grouped = frequencies(df, columns, where)
        if states is not None:
            grouped = merge_frequencies(grouped, states)
        shared = [a for a in analyzers if not isinstance(a, MutualInformation)]
        joint = [a for a in analyzers if isinstance(a, MutualInformation)]
        several = bool(joint) or save is not None
        if several:
            grouped = grouped.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            results |= frequency_metrics(grouped, shared, joint, df)
            if save is not None:
                save(grouped)
        finally:
            if several:
                grouped.unpersist()
    except Exception as e:  # noqa: BLE001
        results = {a: a.failure(e) for a in analyzers} | results
    return results


def frequency_metrics(grouped: DataFrame, shared: list[FrequencyAnalyzer], joint: list[MutualInformation], df: DataFrame | None = None) -> dict[Analyzer, Metric]:
    """Metrics from a grouped frame: one job for all but mutual information, which needs the marginals."""
    results: dict[Analyzer, Metric] = {}
    plan = dict(base_aggregates())
    for i, a in enumerate(shared):
        plan |= {f"{i}:{n}": c for n, c in a.aggregates(grouped).items()}
    if shared:
        row = grouped.agg(*(c.alias(n) for n, c in plan.items())).first().asDict()
        for i, a in enumerate(shared):
            own = {n.split(":", 1)[1]: v for n, v in row.items() if n.startswith(f"{i}:")}
            results[a] = a.metric({"groups": row["groups"], "rows": row["rows"]} | own, df)
    for a in joint:
        value = a.from_grouped(grouped).first()["value"]
        results[a] = a.failure(errors.empty_state(a)) if value is None else a.success(float(value))
    return results


def run_analyzers(
    df: DataFrame,
    analyzers: Iterable[Analyzer],
    *,
    aggregate_with: StateStore | None = None,
    save_states_with: StateStore | None = None,
    repository: MetricsRepository | None = None,
    reuse_key: ResultKey | None = None,
    fail_if_missing: bool = False,
    save_key: ResultKey | None = None,
) -> AnalyzerContext:
    """The metrics of all analyzers.

    aggregate_with: states of earlier data, merged with those of df.
    save_states_with: where the merged states go. With a repository, metrics of
    reuse_key are not computed again and all are saved under save_key.
    """
    wanted = list(analyzers)
    if len(set(wanted)) != len(wanted):
        twice = [str(a) for i, a in enumerate(wanted) if a in wanted[:i]]
        raise ValueError(f"Duplicate analyzers found: {', '.join(twice)}")
    known = AnalyzerContext()
    if repository is not None and reuse_key is not None:
        loaded = repository.load_by_key(reuse_key)
        if loaded is not None:
            known = AnalyzerContext({a: m for a, m in loaded.metrics.items() if a in set(wanted)})
        missing = [a for a in wanted if a not in known.metrics]
        if missing and fail_if_missing:
            raise RuntimeError("Could not find all necessary results in the MetricsRepository, the calculation of the metrics for these analyzers would be needed: " + ", ".join(map(str, missing)))
    todo = [a for a in wanted if a not in known.metrics]

    results: dict[Analyzer, Metric] = {}
    fit: list[Analyzer] = []
    for a in todo:
        try:
            a.check(df)
            fit.append(a)
        except Exception as e:  # noqa: BLE001
            results[a] = a.failure(e)

    scans = [a for a in fit if isinstance(a, ScanAnalyzer)]
    with_states = aggregate_with is not None or save_states_with is not None
    if scans:
        for a, values in _scan(df, scans, with_states).items():
            results[a] = _from_scan(a, values, df, aggregate_with, save_states_with)

    groups: dict[tuple, list[FrequencyAnalyzer]] = {}
    for a in fit:
        if isinstance(a, FrequencyAnalyzer):
            groups.setdefault((tuple(sorted(a.grouping(df))), a.condition), []).append(a)
    for (columns, where), members in groups.items():
        earlier = aggregate_with.load_frequencies(df.sparkSession, columns, where) if aggregate_with is not None else None
        save = (lambda g, c=columns, w=where: save_states_with.save_frequencies(c, w, g)) if save_states_with is not None else None
        results |= _grouped(df, columns, where, members, earlier, save)

    rest = [a for a in fit if not isinstance(a, (ScanAnalyzer, FrequencyAnalyzer))]
    totals: dict[tuple, int | None] = {}
    for a in rest:
        try:
            if isinstance(a, Histogram):
                results[a] = _histogram(df, a, totals, aggregate_with, save_states_with)
            else:
                results[a] = a.run(df)
        except Exception as e:  # noqa: BLE001
            results[a] = a.failure(e)

    context = known + AnalyzerContext({a: results[a] for a in todo})
    context = AnalyzerContext({a: context.metrics[a] for a in wanted})
    if repository is not None and save_key is not None:
        earlier = repository.load_by_key(save_key)
        repository.save(save_key, (earlier + context) if earlier is not None else context)
    return context


def _from_scan(a: ScanAnalyzer, values: dict[str, Any] | Exception, df: DataFrame | None, load: StateStore | None, save: StateStore | None) -> Metric:
    if isinstance(values, Exception):
        return a.failure(values)
    try:
        state = a.state(values)
        earlier = load.load(a) if load is not None else None
        if earlier is not None:
            state = earlier if state is None else earlier.merge(state)
        if save is not None and state is not None:
            save.save(a, state)
        return a.metric(state, df)
    except Exception as e:  # noqa: BLE001
        return a.failure(e)


def _histogram(df: DataFrame, a: Histogram, totals: dict[tuple, int | None], load: StateStore | None, save: StateStore | None) -> Metric:
    grouped = a.grouped(df)
    key = (a.sum_column, a.as_ratio)
    if key not in totals:
        totals[key] = df.agg(a.total(df)).first()[0] if a.as_ratio else None
    total = totals[key]
    label = (f"histogram:{a}",)
    earlier = load.load_frequencies(df.sparkSession, label, None) if load is not None else None
    if earlier is not None:
        grouped = merge_frequencies(grouped, earlier)
        total = None if total is None else total + (load.load_total(label) or 0)
    grouped = grouped.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        metric = a.from_grouped(grouped, total)
        if save is not None:
            save.save_frequencies(label, None, grouped, total or 0)
        return metric
    finally:
        grouped.unpersist()


def run_on_aggregated_states(schema_of: DataFrame, analyzers: Iterable[Analyzer], stores: Iterable[StateStore], *, save_states_with: StateStore | None = None, repository: MetricsRepository | None = None, save_key: ResultKey | None = None) -> AnalyzerContext:
    """Metrics of the union of the data whose states the stores hold; the data itself is not read.

    schema_of: any frame with the schema of the data.
    """
    stores = list(stores)
    results: dict[Analyzer, Metric] = {}
    spark = schema_of.sparkSession
    for a in analyzers:
        try:
            a.check(schema_of)
            if isinstance(a, ScanAnalyzer):
                state = None
                for s in stores:
                    if (part := s.load(a)) is not None:
                        state = part if state is None else state.merge(part)
                if state is not None and save_states_with is not None:
                    save_states_with.save(a, state)
                results[a] = a.metric(state)
            elif isinstance(a, (FrequencyAnalyzer, Histogram)):
                columns, where = ((f"histogram:{a}",), None) if isinstance(a, Histogram) else (tuple(sorted(a.grouping(schema_of))), a.condition)
                parts = [p for s in stores if (p := s.load_frequencies(spark, columns, where)) is not None]
                if not parts:
                    results[a] = a.failure(errors.empty_state(a))
                    continue
                grouped = parts[0]
                for p in parts[1:]:
                    grouped = merge_frequencies(grouped, p)
                total = sum(s.load_total(columns) or 0 for s in stores)
                if save_states_with is not None:
                    save_states_with.save_frequencies(columns, where, grouped, total)
                if isinstance(a, Histogram):
                    results[a] = a.from_grouped(grouped, total)
                elif isinstance(a, MutualInformation):
                    results |= frequency_metrics(grouped, [], [a])
                else:
                    results |= frequency_metrics(grouped, [a], [])
            elif isinstance(a, (ColumnCount, ColumnExists)):
                results[a] = a.run(schema_of)
            else:
                results[a] = a.failure(errors.MetricCalculationRuntimeError(f"{a} has no mergeable state"))
        except Exception as e:  # noqa: BLE001
            results[a] = a.failure(e)
    context = AnalyzerContext(results)
    if repository is not None and save_key is not None:
        repository.save(save_key, context)
    return context


@dataclass
class Analysis:
    """A list of analyzers to run on any data."""

    analyzers: list[Analyzer] = field(default_factory=list)

    def add_analyzer(self, analyzer: Analyzer) -> Analysis:
        return Analysis([*self.analyzers, analyzer])

    def add_analyzers(self, analyzers: Iterable[Analyzer]) -> Analysis:
        return Analysis([*self.analyzers, *analyzers])

    def run(self, df: DataFrame, **options: Any) -> AnalyzerContext:
        return run_analyzers(df, self.analyzers, **options)


class AnalysisRun:
    """Builder: AnalysisRun(df).add_analyzer(Size()).run()."""

    def __init__(self, df: DataFrame):
        self._df, self._analyzers, self._options = df, [], {}
        self._files: dict[str, Any] = {}

    def add_analyzer(self, analyzer: Analyzer) -> AnalysisRun:
        self._analyzers.append(analyzer)
        return self

    def add_analyzers(self, analyzers: Iterable[Analyzer]) -> AnalysisRun:
        self._analyzers += list(analyzers)
        return self

    def use_repository(self, repository: MetricsRepository) -> AnalysisRun:
        self._options["repository"] = repository
        return self

    def reuse_existing_results_for_key(self, key: ResultKey, fail_if_missing: bool = False) -> AnalysisRun:
        self._options |= {"reuse_key": key, "fail_if_missing": fail_if_missing}
        return self

    def save_or_append_result(self, key: ResultKey) -> AnalysisRun:
        self._options["save_key"] = key
        return self

    def aggregate_with(self, store: StateStore) -> AnalysisRun:
        self._options["aggregate_with"] = store
        return self

    def save_states_with(self, store: StateStore) -> AnalysisRun:
        self._options["save_states_with"] = store
        return self

    def use_spark_session(self, spark: SparkSession) -> AnalysisRun:
        """The data's session is used in any case."""
        return self

    def save_success_metrics_json_to_path(self, path: str, overwrite: bool = False) -> AnalysisRun:
        self._files = {"path": path, "overwrite": overwrite}
        return self

    def run(self) -> AnalyzerContext:
        context = run_analyzers(self._df, self._analyzers, **self._options)
        if self._files:
            from dqengine.sources.files import write_text

            write_text(self._df.sparkSession, self._files["path"], context.success_metrics_as_json(), self._files["overwrite"])
        return context


class AnalysisRunner:
    """Entry point: AnalysisRunner.on_data(df)."""

    @staticmethod
    def on_data(df: DataFrame) -> AnalysisRun:
        return AnalysisRun(df)

    run = staticmethod(run_analyzers)
    run_on_aggregated_states = staticmethod(run_on_aggregated_states)


