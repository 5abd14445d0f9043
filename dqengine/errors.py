"""Exceptions of the engine. Analyzer errors never propagate: they become failed metrics."""

from __future__ import annotations


class MetricCalculationError(Exception):
    """Any error while a metric is calculated."""


class MetricCalculationRuntimeError(MetricCalculationError):
    """An error of the calculation itself."""


class EmptyStateError(MetricCalculationRuntimeError):
    """No value to calculate on."""


class PreconditionError(MetricCalculationError):
    """The data or the parameters don't fit the analyzer."""


class NoSuchColumnError(PreconditionError):
    pass


class WrongColumnTypeError(PreconditionError):
    pass


class NoColumnsSpecifiedError(PreconditionError):
    pass


class NumberOfSpecifiedColumnsError(PreconditionError):
    pass


class IllegalAnalyzerParameterError(PreconditionError):
    pass


def wrap(error: Exception) -> MetricCalculationError:
    """The error itself if it is one of ours, else wrapped as a runtime error with the same message."""
    if isinstance(error, MetricCalculationError):
        return error
    wrapped = MetricCalculationRuntimeError(str(error))
    wrapped.__cause__ = error
    return wrapped


def empty_state(analyzer: object) -> EmptyStateError:
    return EmptyStateError(f"Empty state for analyzer {analyzer}, all input values were NULL.")
