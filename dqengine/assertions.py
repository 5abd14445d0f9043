"""Assertions that are both Python predicates and Column predicates.

Any callable is an assertion; these also compile to expressions, so that
row-level results need no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TESTS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda x, v: x == v,
    "!=": lambda x, v: x != v,
    "<": lambda x, v: x < v,
    "<=": lambda x, v: x <= v,
    ">": lambda x, v: x > v,
    ">=": lambda x, v: x >= v,
    "in": lambda x, v: x.isin(*v) if isinstance(x, Column) else x in v,
    "not in": lambda x, v: ~x.isin(*v) if isinstance(x, Column) else x not in v,
    "between": lambda x, v: (x > v[0]) & (x < v[1]),
    "not between": lambda x, v: (x <= v[0]) | (x >= v[1]),
    "within": lambda x, v: (x >= v[0]) & (x <= v[1]),
}


@dataclass(frozen=True)
class Is:
    """Is(">=", 5): works on numbers and on columns. between excludes both ends, within includes them."""

    test: str
    value: Any

    def __call__(self, x: Any) -> bool:
        return bool(_TESTS[self.test](x, self.value))

    def column(self, x: Column) -> Column:
        return _TESTS[self.test](x, self.value)

    def __str__(self) -> str:
        return f"{self.test} {self.value}"


def is_one(x: float) -> bool:
    return x == 1.0


IS_ONE = Is("==", 1.0)


def as_column(assertion: Callable[[Any], bool], value: Column) -> Column:
    """The assertion on a column of doubles; callables without a column form run as an Arrow-batched function."""
    if hasattr(assertion, "column"):
        return assertion.column(value)
    import pandas as pd

    def held(values):
        return values.map(lambda v: None if pd.isna(v) else bool(assertion(v)))

    held.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(held, "boolean")(value)
