"""Structured Streaming: each micro-batch's states are merged with those of all batches before."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

from dqengine.checks import Check
from dqengine.operators.base import Analyzer
from dqengine.plans.runner import AnalyzerContext, run_analyzers
from dqengine.sources.state_store import InMemoryStateStore, StateStore
from dqengine.verification import VerificationResult, evaluate


class IncrementalMetrics:
    """Metrics (and checks) over everything a stream has brought so far.

    Only states are kept between batches, never rows. stores makes the store of
    a batch from its number; a batch that is replayed reads the states of the
    batch before it again, so that it counts once.
    """

    def __init__(self, analyzers: Iterable[Analyzer], checks: Iterable[Check] = (), stores: Callable[[int], StateStore] | None = None):
        self.checks = list(checks)
        self.analyzers = list(dict.fromkeys([*analyzers, *(a for c in self.checks for a in c.required_analyzers())]))
        self._memory: dict[int, StateStore] = {}
        self._stores = stores or (lambda n: self._memory.setdefault(n, InMemoryStateStore()))
        self.last: tuple[int, AnalyzerContext] | None = None

    def process(self, batch: DataFrame, number: int) -> AnalyzerContext:
        earlier = self._stores(number - 1) if number > 0 else None
        if number in self._memory:
            self._memory[number] = InMemoryStateStore()
        batch = batch.persist()
        try:
            context = run_analyzers(batch, self.analyzers, aggregate_with=earlier, save_states_with=self._stores(number))
        finally:
            batch.unpersist()
        self._memory.pop(number - 2, None)
        self.last = (number, context)
        return context

    def verification(self) -> VerificationResult:
        return evaluate(self.checks, self.last[1] if self.last else AnalyzerContext())

    def attach(self, stream: DataFrame, then: Callable[[int, AnalyzerContext], Any] | None = None, **options: str) -> Any:
        """Starts a query on the stream; then sees the metrics after each batch. options: of the writer, such as checkpointLocation."""

        def each(batch: DataFrame, number: int) -> None:
            context = self.process(batch, number)
            if then is not None:
                then(number, context)

        return stream.writeStream.foreachBatch(each).options(**options).start()
