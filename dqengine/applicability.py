"""Do checks and analyzers fit a schema? Tried on generated rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.checks import Check
from dqengine.constraints import Constraint
from dqengine.operators.base import Analyzer
from dqengine.plans.runner import run_analyzers

#: Generated rows, and the share of nulls in fields that may be null.
ROWS, NULLS = 1000, 0.01


@dataclass
class CheckApplicability:
    is_applicable: bool
    failures: list[tuple[str, Exception]]
    constraint_applicabilities: dict[Constraint, bool]


@dataclass
class AnalyzersApplicability:
    is_applicable: bool
    failures: list[tuple[str, Exception]]


def _values(kind: T.DataType, seed: int) -> Column:
    r = F.rand(seed)
    if isinstance(kind, T.BooleanType):
        return r < 0.5
    if isinstance(kind, T.ByteType):
        return F.floor(r * 127).cast(kind)
    if isinstance(kind, T.ShortType):
        return F.floor(r * 32_000).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (r * 10.0 ** max(0, min(15, kind.precision - kind.scale) - 1)).cast(kind)
    if isinstance(kind, T.NumericType):
        return (r * 2_000_000_000).cast(kind)
    if isinstance(kind, T.StringType):
        return F.substring(F.sha2(r.cast("string"), 256), F.lit(1), F.floor(F.rand(seed + 1) * 20).cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_seconds(F.floor(r * 1_700_000_000)).cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.sha2(r.cast("string"), 256).cast("binary")
    raise ValueError(f"Applicability check can only handle basic datatypes for columns (not {kind.simpleString()})")


def random_data(schema: T.StructType, spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """Rows that fit the schema, the same on every call."""
    columns = []
    for i, f in enumerate(schema.fields):
        value = _values(f.dataType, 1000 + 7 * i)
        if f.nullable:
            value = F.when(F.rand(2000 + 7 * i) >= NULLS, value)
        columns.append(value.alias(f.name))
    return spark.range(rows + 1).select(*columns)


def is_check_applicable(check: Check, schema: T.StructType, spark: SparkSession) -> CheckApplicability:
    context = run_analyzers(random_data(schema, spark), check.required_analyzers())
    fits = {c: context.metrics[c.analyzer].ok for c in check.constraints}
    failures = [(c.name, context.metrics[c.analyzer].error) for c in check.constraints if not fits[c]]
    return CheckApplicability(not failures, failures, fits)


def are_analyzers_applicable(analyzers: Iterable[Analyzer], schema: T.StructType, spark: SparkSession) -> AnalyzersApplicability:
    context = run_analyzers(random_data(schema, spark), list(dict.fromkeys(analyzers)))
    failures = [(str(a), m.error) for a, m in context.metrics.items() if not m.ok]
    return AnalyzersApplicability(not failures, failures)


