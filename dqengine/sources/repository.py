"""Repositories of metrics over time: in memory, in a JSON file, in a table."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.operators.base import Analyzer
from dqengine.plans.runner import AnalyzerContext
from dqengine.sources import files, serde


@dataclass(frozen=True)
class ResultKey:
    """When the data is from (milliseconds), and tags."""

    dataset_date: int
    tags: dict[str, str] = field(default_factory=dict, hash=False)

    @staticmethod
    def current_milli_time() -> int:
        return int(time.time() * 1000)


@dataclass
class AnalysisResult:
    key: ResultKey
    context: AnalyzerContext


class MetricsRepository(Protocol):
    def save(self, key: ResultKey, context: AnalyzerContext) -> None: ...
    def load_by_key(self, key: ResultKey) -> AnalyzerContext | None: ...
    def load(self) -> ResultsLoader: ...


def tag_columns(tags: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """A column name for each tag: lower case, only letters, digits and underscores, numbered where it clashes."""
    used, found = set(taken), {}
    for tag in tags:
        name = re.sub(r"[^A-Za-z0-9_]", "", tag).lower()
        n, unique = 2, name
        while unique in used:
            unique, n = f"{name}_{n}", n + 1
        used.add(unique)
        found[tag] = unique
    return found


class ResultsLoader:
    """A query over stored results: with_tag_values, for_analyzers, after, before, then get or a frame or JSON."""

    def __init__(self, source: Any, exclusive: bool = False):
        self._source, self._exclusive = source, exclusive
        self._tags: dict[str, str] | None = None
        self._analyzers: list[Analyzer] | None = None
        self._after: int | None = None
        self._before: int | None = None

    def with_tag_values(self, tags: dict[str, str]) -> ResultsLoader:
        self._tags = dict(tags)
        return self

    def for_analyzers(self, analyzers: Iterable[Analyzer]) -> ResultsLoader:
        self._analyzers = list(analyzers)
        return self

    def after(self, date: int) -> ResultsLoader:
        self._after = date
        return self

    def before(self, date: int) -> ResultsLoader:
        self._before = date
        return self

    def _fits(self, key: ResultKey) -> bool:
        d = key.dataset_date
        if self._after is not None and (d <= self._after if self._exclusive else d < self._after):
            return False
        if self._before is not None and (d >= self._before if self._exclusive else d > self._before):
            return False
        return self._tags is None or all(key.tags.get(k) == v for k, v in self._tags.items())

    def get(self) -> list[AnalysisResult]:
        found = []
        for r in self._source(self._after, self._before):
            if self._fits(r.key):
                asked = None if self._analyzers is None else set(self._analyzers)
                found.append(AnalysisResult(r.key, AnalyzerContext({a: m for a, m in r.context.metrics.items() if asked is None or a in asked})))
        return found

    def _rows(self, with_tags: Iterable[str] | None) -> tuple[list[dict[str, Any]], list[str]]:
        results = self.get()
        tags = sorted({t for r in results for t in r.key.tags if with_tags is None or t in set(with_tags)})
        names = tag_columns(tags, ("entity", "instance", "name", "value", "dataset_date"))
        rows = [dict(zip(("entity", "instance", "name", "value"), x, strict=True)) | {"dataset_date": r.key.dataset_date} | {names[t]: r.key.tags.get(t) for t in tags} for r in results for x in r.context.rows()]
        return rows, [names[t] for t in tags]

    def get_success_metrics_as_dataframe(self, spark: SparkSession, with_tags: Iterable[str] | None = None) -> DataFrame:
        rows, tags = self._rows(with_tags)
        columns = ["entity", "instance", "name", "value", "dataset_date", *tags]
        schema = "entity string, instance string, name string, value double, dataset_date long" + "".join(f", `{t}` string" for t in tags)
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)

    def get_success_metrics_as_json(self, with_tags: Iterable[str] | None = None) -> str:
        return json.dumps(self._rows(with_tags)[0])


class InMemoryMetricsRepository:
    """Only successful metrics are kept. Bounds of queries are inclusive."""

    def __init__(self) -> None:
        self._results: dict[tuple, AnalysisResult] = {}

    @staticmethod
    def _id(key: ResultKey) -> tuple:
        return key.dataset_date, tuple(sorted(key.tags.items()))

    def save(self, key: ResultKey, context: AnalyzerContext) -> None:
        self._results[self._id(key)] = AnalysisResult(key, AnalyzerContext({a: m for a, m in context.metrics.items() if m.ok}))

    def load_by_key(self, key: ResultKey) -> AnalyzerContext | None:
        found = self._results.get(self._id(key))
        return found.context if found else None

    def load(self) -> ResultsLoader:
        return ResultsLoader(lambda *_: list(self._results.values()))


class FileMetricsRepository:
    """The whole history in one JSON file. Bounds of queries are inclusive."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def _read(self) -> list[AnalysisResult]:
        if not files.exists(self._spark, self._path):
            return []
        return [AnalysisResult(ResultKey(d, t), c) for d, t, c in serde.results_from_json(files.read_text(self._spark, self._path))]

    def save(self, key: ResultKey, context: AnalyzerContext) -> None:
        kept = [r for r in self._read() if r.key != key]
        everything = [*kept, AnalysisResult(key, context)]
        files.write_text(self._spark, self._path, serde.results_to_json([(r.key.dataset_date, r.key.tags, r.context) for r in everything]), True)

    def load_by_key(self, key: ResultKey) -> AnalyzerContext | None:
        return next((r.context for r in self._read() if r.key == key), None)

    def load(self) -> ResultsLoader:
        return ResultsLoader(lambda *_: self._read())


class TableMetricsRepository:
    """Rows of a catalog table; saving appends, the latest row of a key counts. Bounds of queries are exclusive."""

    SCHEMA = "dataset_date long, tags map<string,string>, saved_at long, context string"

    def __init__(self, spark: SparkSession, table: str):
        self._spark, self._table = spark, table

    def save(self, key: ResultKey, context: AnalyzerContext) -> None:
        text = json.dumps(serde.context_to_list(serde.storable(context)))
        row = (key.dataset_date, key.tags, time.time_ns(), text)
        self._spark.createDataFrame([row], self.SCHEMA).write.mode("append").saveAsTable(self._table)

    def _read(self, after: int | None = None, before: int | None = None, key: ResultKey | None = None) -> list[AnalysisResult]:
        if not self._spark.catalog.tableExists(self._table):
            return []
        df = self._spark.table(self._table)
        if after is not None:
            df = df.where(F.col("dataset_date") > after)
        if before is not None:
            df = df.where(F.col("dataset_date") < before)
        if key is not None:
            df = df.where(F.col("dataset_date") == key.dataset_date)
        latest: dict[tuple, AnalysisResult] = {}
        for r in df.orderBy("dataset_date", "saved_at").collect():  # one row for each saved result
            k = ResultKey(r["dataset_date"], dict(r["tags"]))
            latest[k.dataset_date, tuple(sorted(k.tags.items()))] = AnalysisResult(k, serde.context_from_list(json.loads(r["context"])))
        return list(latest.values())

    def load_by_key(self, key: ResultKey) -> AnalyzerContext | None:
        return next((r.context for r in self._read(key=key) if r.key == key), None)

    def load(self) -> ResultsLoader:
        return ResultsLoader(self._read, exclusive=True)
