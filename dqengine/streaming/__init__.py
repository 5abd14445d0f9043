"""Metrics of growing data: micro-batches merged into stored states."""

from dqengine.streaming.incremental import IncrementalMetrics

__all__ = ["IncrementalMetrics"]
