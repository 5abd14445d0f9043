"""Analyzers and metrics as JSON."""

from __future__ import annotations

import json
from dataclasses import fields
from enum import Enum
from typing import Any

from dqengine import metrics as M
from dqengine import operators as O
from dqengine.operators.base import Analyzer, AnalyzerOptions, FilteredRow, NullBehavior
from dqengine.plans.runner import AnalyzerContext

#: Analyzers that hold code or data, or say nothing but the schema, are not stored.
NOT_STORED = (O.CustomSql, O.ColumnCount, O.ColumnExists, O.CustomAggregator, O.DatasetMatch)


def analyzer_to_dict(a: Analyzer) -> dict[str, Any]:
    if isinstance(a, NOT_STORED):
        raise ValueError(f"Unable to serialize analyzer {a}.")
    if isinstance(a, O.Histogram) and a.binning is not None:
        raise ValueError("Unable to serialize Histogram with binning function!")
    found: dict[str, Any] = {"analyzerName": type(a).__name__}
    for f in fields(a):
        v = getattr(a, f.name)
        if isinstance(v, AnalyzerOptions):
            v = {"null_behavior": v.null_behavior.value, "filtered_row": v.filtered_row.value}
        elif isinstance(v, O.KLLParameters):
            v = {x.name: getattr(v, x.name) for x in fields(v)}
        elif isinstance(v, tuple):
            v = list(v)
        elif isinstance(v, Enum):
            v = v.value
        if v is not None:
            found[f.name] = v
    return found


def analyzer_from_dict(d: dict[str, Any]) -> Analyzer:
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "analyzerName"}
    if "options" in values:
        values["options"] = AnalyzerOptions(NullBehavior(values["options"]["null_behavior"]), FilteredRow(values["options"]["filtered_row"]))
    if "parameters" in values:
        values["parameters"] = O.KLLParameters(**values["parameters"])
    kind = getattr(O, d["analyzerName"], None)
    if kind is None or d["analyzerName"] not in O.__all__:
        raise ValueError(f"Unable to deserialize analyzer {d['analyzerName']}.")
    return kind(**values)


def _number(v: float) -> float | str:
    """Numbers that JSON lacks go by name."""
    return v if not isinstance(v, float) or v - v == 0 else repr(v)


def metric_to_dict(m: M.Metric) -> dict[str, Any]:
    if not m.ok:
        raise ValueError("Unable to serialize failed metrics.")
    head = {"metricName": type(m).__name__, "entity": m.entity.value, "instance": m.instance, "name": m.name}
    v = m.value
    if isinstance(m, (M.KeyedDoubleMetric, M.AttributeDoubleMetric)):
        return head | {"value": {k: _number(x) for k, x in v.items()}}
    if isinstance(m, M.HistogramMetric):
        return head | {"value": {"numberOfBins": v.number_of_bins, "tailCount": v.tail_count, "values": {k: {"absolute": x.absolute, "ratio": _number(x.ratio)} for k, x in v.values.items()}}}
    if isinstance(m, M.HistogramBinnedMetric):
        bins = [{"binStart": _number(b.bin_start), "binEnd": _number(b.bin_end), "frequency": b.frequency, "ratio": _number(b.ratio)} for b in v.bins]
        return head | {"value": {"numberOfBins": v.number_of_bins, "nullCount": v.null_count, "bins": bins}}
    if isinstance(m, M.KLLMetric):
        return head | {"value": {"buckets": [{"low": b.low, "high": b.high, "count": b.count} for b in v.buckets], "parameters": list(v.parameters), "sketch": v.sketch.hex(), "percentiles": list(v.percentiles)}}
    return head | {"value": _number(v)}


def metric_from_dict(d: dict[str, Any]) -> M.Metric:
    kind, v = getattr(M, d["metricName"]), d["value"]
    if kind in (M.KeyedDoubleMetric, M.AttributeDoubleMetric):
        v = {k: float(x) for k, x in v.items()}
    elif kind is M.HistogramMetric:
        v = M.Distribution({k: M.DistributionValue(x["absolute"], float(x["ratio"])) for k, x in v["values"].items()}, v["numberOfBins"], v["tailCount"])
    elif kind is M.HistogramBinnedMetric:
        v = M.BinnedDistribution([M.BinData(float(b["binStart"]), float(b["binEnd"]), b["frequency"], float(b["ratio"])) for b in v["bins"]], v["numberOfBins"], v["nullCount"])
    elif kind is M.KLLMetric:
        v = M.BucketDistribution([M.BucketValue(b["low"], b["high"], b["count"]) for b in v["buckets"]], tuple(v["parameters"]), bytes.fromhex(v["sketch"]), v["percentiles"])
    else:
        v = float(v)
    return kind(M.Entity(d["entity"]), d["instance"], d["name"], v)


def storable(context: AnalyzerContext) -> AnalyzerContext:
    """Successful metrics of analyzers that can be stored."""
    return AnalyzerContext({a: m for a, m in context.metrics.items() if m.ok and not isinstance(a, NOT_STORED) and not (isinstance(a, O.Histogram) and a.binning is not None)})


def context_to_list(context: AnalyzerContext) -> list[dict[str, Any]]:
    return [{"analyzer": analyzer_to_dict(a), "metric": metric_to_dict(m)} for a, m in context.metrics.items()]


def context_from_list(rows: list[dict[str, Any]]) -> AnalyzerContext:
    return AnalyzerContext({analyzer_from_dict(r["analyzer"]): metric_from_dict(r["metric"]) for r in rows})


def results_to_json(results: list[tuple[int, dict[str, str], AnalyzerContext]]) -> str:
    return json.dumps([{"resultKey": {"dataSetDate": date, "tags": tags}, "analyzerContext": {"metricMap": context_to_list(storable(c))}} for date, tags, c in results])


def results_from_json(text: str) -> list[tuple[int, dict[str, str], AnalyzerContext]]:
    return [(r["resultKey"]["dataSetDate"], r["resultKey"]["tags"], context_from_list(r["analyzerContext"]["metricMap"])) for r in json.loads(text)]
