"""Comparing datasets: synchronisation, referential integrity, row counts, schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions.expr import every, find, quote

Assertion = Callable[[float], bool]


@dataclass(frozen=True)
class Succeeded:
    ratio: float
    passed: int | None = None
    total: int | None = None


@dataclass(frozen=True)
class Failed:
    message: str
    ratio: float | None = None
    passed: int | None = None
    total: int | None = None


Result = Succeeded | Failed


def _judge(ratio: float, assertion: Assertion, passed: int | None = None, total: int | None = None) -> Result:
    if assertion(ratio):
        return Succeeded(ratio, passed, total)
    return Failed(f"Value: {ratio} does not meet the constraint requirement.", ratio, passed, total)


def _missing(df: DataFrame, columns: Iterable[str], what: str) -> str | None:
    lost = [c for c in columns if find(df, c) is None]
    return f"the {what} lacks {', '.join(lost)}" if lost else None


def _checked(ds1: DataFrame, ds2: DataFrame, keys: dict[str, str], values: dict[str, str]) -> str | None:
    if not keys:
        return "At least one key column has to be given"
    return _missing(ds1, [*keys, *values], "first dataset") or _missing(ds2, [*keys.values(), *values.values()], "second dataset")


def _renamed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return df.select(*(F.col(quote(find(df, c))).alias(f"{prefix}{i}") for i, c in enumerate(columns)))


def _same(a: str, b: str, n: int) -> list[Column]:
    return [F.col(f"{a}{i}") == F.col(f"{b}{i}") for i in range(n)]


def column_match(ds1: DataFrame, ds2: DataFrame, key_map: dict[str, str], compared: dict[str, str] | None, assertion: Assertion) -> Result:
    """Share of rows of ds1 that ds2 has with the same keys and values; nulls match nothing.

    Without compared columns, all that are not keys are, and must have the same
    names. Keys must be unique in both, and the row counts equal.
    """
    if compared is None:
        names = [c for c in ds1.columns if c not in key_map]
        theirs = {c for c in ds2.columns if c not in set(key_map.values())}
        if set(names) != theirs:
            return Failed("without compared columns, both sides need the same columns besides the keys")
        compared = {c: c for c in names}
    if lost := _checked(ds1, ds2, key_map, compared):
        return Failed(lost)
    left = _renamed(ds1, [*key_map, *compared], "l")
    right = _renamed(ds2, [*key_map.values(), *compared.values()], "r")
    n = len(key_map)
    counts = []
    for df, p in ((left, "l"), (right, "r")):
        # rows and repeated keys in one job for each side
        groups = df.groupBy(*(f"{p}{i}" for i in range(n))).agg(F.count(F.lit(1)).alias("n"))
        counts.append(groups.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first())
    rows1, rows2 = (int(c["rows"] or 0) for c in counts)
    lost = [w for c, w in zip(counts, ("first", "second"), strict=True) if (c["most"] or 0) > 1]
    if lost:
        return Failed(f"keys repeat in the {' and the '.join(lost)} dataset, so its rows can't be told apart")
    if rows1 != rows2:
        return Failed(f"{rows1} rows against {rows2}", None, 0, rows1)
    if not rows1:
        return _judge(1.0, assertion, 0, 0)
    matched = left.join(right, every(_same("l", "r", n + len(compared)))).count()
    return _judge(matched / rows1, assertion, matched, rows1)


def column_match_rows(ds1: DataFrame, ds2: DataFrame, key_map: dict[str, str], compared: dict[str, str] | None = None, outcome: str = "outcome") -> DataFrame | Failed:
    """ds1 with a boolean column: does ds2 have the row's key with the same values? Here nulls of values match nulls."""
    if compared is None:
        compared = {c: c for c in ds1.columns if c not in key_map and find(ds2, c) is not None}
    if lost := _checked(ds1, ds2, key_map, compared):
        return Failed(lost)
    n = len(key_map)
    right = _renamed(ds2, [*key_map.values(), *compared.values()], "__r").dropDuplicates([f"__r{i}" for i in range(n)]).withColumn("__there", F.lit(True))
    left = [F.col(quote(find(ds1, c))) for c in [*key_map, *compared]]
    keys = [left[i] == F.col(f"__r{i}") for i in range(n)]
    values = [left[n + i].eqNullSafe(F.col(f"__r{n + i}")) for i in range(len(compared))]
    joined = ds1.join(right, every(keys), "left")
    met = F.col("__there").isNotNull()
    return joined.select(*(F.col(quote(c)) for c in ds1.columns if c != outcome), (every([met, *values]) if values else met).alias(outcome))


def subset_check(primary: DataFrame, columns: list[str], reference: DataFrame, reference_columns: list[str], assertion: Assertion) -> Result:
    """Share of rows of primary, less the distinct values that reference lacks, of all rows."""
    if lost := _columns_fit(primary, columns, reference, reference_columns):
        return Failed(lost)
    total = primary.count()
    if not total:
        return _judge(1.0, assertion, 0, 0)
    lacking = _renamed(primary, columns, "c").subtract(_renamed(reference, reference_columns, "c")).count()
    return _judge((total - lacking) / total, assertion, total - lacking, total)


def _columns_fit(primary: DataFrame, columns: list[str], reference: DataFrame, reference_columns: list[str]) -> str | None:
    if not columns or len(columns) != len(reference_columns):
        return "name as many columns of one dataset as of the other, at least one"
    return _missing(primary, columns, "primary dataset") or _missing(reference, reference_columns, "reference dataset")


def subset_check_rows(primary: DataFrame, columns: list[str], reference: DataFrame, reference_columns: list[str], outcome: str = "outcome") -> DataFrame | Failed:
    """primary with a boolean column: does reference have the row's values? Nulls have no match."""
    if lost := _columns_fit(primary, columns, reference, reference_columns):
        return Failed(lost)
    there = _renamed(reference, reference_columns, "__r").distinct().withColumn("__there", F.lit(True))
    keys = [F.col(quote(find(primary, c))) == F.col(f"__r{i}") for i, c in enumerate(columns)]
    return primary.join(there, every(keys), "left").select(*(F.col(quote(c)) for c in primary.columns if c != outcome), F.col("__there").isNotNull().alias(outcome))


def row_count_match(primary: DataFrame, reference: DataFrame, assertion: Assertion) -> Result:
    """Rows of primary per row of reference."""
    a, b = primary.count(), reference.count()
    ratio = a / b if b else (1.0 if not a else float("inf"))
    return _judge(ratio, assertion, a, b)


def schema_match(primary: DataFrame, reference: DataFrame, assertion: Assertion) -> Result:
    """Share of columns with the same name and type; 0 if the numbers of columns differ."""
    if len(primary.columns) != len(reference.columns):
        return _judge(0.0, assertion, 0, len(primary.columns))
    theirs = {(f.name.lower(), f.dataType.typeName()) for f in reference.schema.fields}
    same = sum((f.name.lower(), f.dataType.typeName()) in theirs for f in primary.schema.fields)
    return _judge(same / len(primary.columns) if primary.columns else 1.0, assertion, same, len(primary.columns))
