"""Stores of mergeable states, in memory and as files."""

from __future__ import annotations

import hashlib
import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from dqengine.operators.base import Analyzer
from dqengine.operators.states import State
from dqengine.sources import files


class StateStore(Protocol):
    def save(self, analyzer: Analyzer, state: State) -> None: ...
    def load(self, analyzer: Analyzer) -> State | None: ...
    def save_frequencies(self, columns: tuple[str, ...], where: str | None, grouped: DataFrame, total: int = 0) -> None: ...
    def load_frequencies(self, spark: SparkSession, columns: tuple[str, ...], where: str | None) -> DataFrame | None: ...
    def load_total(self, columns: tuple[str, ...]) -> int | None: ...


class InMemoryStateStore:
    """States in this process; frequencies stay in the cluster, checkpointed by their own caching."""

    def __init__(self) -> None:
        self._states: dict[Analyzer, State] = {}
        self._frames: dict[tuple, DataFrame] = {}
        self._totals: dict[tuple, int] = {}

    def save(self, analyzer: Analyzer, state: State) -> None:
        self._states[analyzer] = state

    def load(self, analyzer: Analyzer) -> State | None:
        return self._states.get(analyzer)

    def save_frequencies(self, columns: tuple[str, ...], where: str | None, grouped: DataFrame, total: int = 0) -> None:
        self._frames[columns, where] = grouped
        self._totals[columns] = total

    def load_frequencies(self, spark: SparkSession, columns: tuple[str, ...], where: str | None) -> DataFrame | None:
        return self._frames.get((columns, where))

    def load_total(self, columns: tuple[str, ...]) -> int | None:
        return self._totals.get(columns)


class FileStateStore:
    """One small JSON file for each state, one parquet table for each grouping, below a folder."""

    def __init__(self, spark: SparkSession, folder: str, overwrite: bool = False):
        self._spark, self._folder, self._overwrite = spark, folder.rstrip("/"), overwrite

    def _name(self, *parts: object) -> str:
        return f"{self._folder}/{hashlib.sha256(json.dumps([str(p) for p in parts]).encode()).hexdigest()[:24]}"

    def save(self, analyzer: Analyzer, state: State) -> None:
        files.write_text(self._spark, f"{self._name(analyzer)}.json", json.dumps(state.to_dict()), self._overwrite)

    def load(self, analyzer: Analyzer) -> State | None:
        path = f"{self._name(analyzer)}.json"
        return State.from_dict(json.loads(files.read_text(self._spark, path))) if files.exists(self._spark, path) else None

    def save_frequencies(self, columns: tuple[str, ...], where: str | None, grouped: DataFrame, total: int = 0) -> None:
        grouped.write.mode("overwrite" if self._overwrite else "errorifexists").parquet(f"{self._name(columns, where)}.parquet")
        files.write_text(self._spark, f"{self._name(columns)}-total.json", json.dumps(total), True)

    def load_frequencies(self, spark: SparkSession, columns: tuple[str, ...], where: str | None) -> DataFrame | None:
        path = f"{self._name(columns, where)}.parquet"
        return spark.read.parquet(path) if files.exists(spark, path) else None

    def load_total(self, columns: tuple[str, ...]) -> int | None:
        path = f"{self._name(columns)}-total.json"
        return json.loads(files.read_text(self._spark, path)) if files.exists(self._spark, path) else None
