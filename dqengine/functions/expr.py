"""Building blocks of columns: references, conditional selection, casts that don't raise under ANSI."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    """The name in backticks, as one identifier."""
    return name if name.startswith("`") and name.endswith("`") else "`" + name.replace("`", "``") + "`"


def unquote(name: str) -> str:
    return name[1:-1].replace("``", "`") if len(name) > 1 and name.startswith("`") and name.endswith("`") else name


def find(df: DataFrame, name: str) -> str | None:
    """The column of df with this name, as df spells it; case counts only if the session says so."""
    name = unquote(name)
    if name in df.columns:
        return name
    if df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true":
        return None
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def ref(df: DataFrame, name: str) -> Column:
    """A top-level column, whatever characters its name has, or else a field path such as state.code."""
    found = find(df, name)
    return F.col(quote(found)) if found is not None else F.col(name)


def data_type(df: DataFrame, name: str) -> T.DataType | None:
    """Type of a column or field path; None if there is none."""
    found = find(df, name)
    if found is not None:
        return df.schema[found].dataType
    kind: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType):
            return None
        field = next((f for f in kind.fields if f.name.lower() == unquote(part).lower()), None)
        if field is None:
            return None
        kind = field.dataType
    return kind


def when(condition: str | None, value: Column) -> Column:
    """The value where the condition holds, else null; the value itself without a condition."""
    return value if condition is None else F.when(F.expr(condition), value)


def rows(condition: str | None) -> Column:
    """Rows for which the condition holds; null over no rows with a condition, as a sum is."""
    return F.count(F.lit(1)) if condition is None else F.sum(F.expr(condition).cast("long"))


def hits(predicate: Column, condition: str | None = None) -> Column:
    """Rows in scope for which the predicate holds; null if no row is in scope or none has a value of it."""
    return F.sum(when(condition, predicate).cast("long"))


def every(columns: list[Column]) -> Column:
    return reduce(and_, columns)


def some(columns: list[Column]) -> Column:
    return reduce(or_, columns)


def number(column: Column) -> Column:
    """As double; null where that can't be."""
    return column.try_cast("double")


def is_numeric(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType | None) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def is_temporal(kind: T.DataType | None) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
