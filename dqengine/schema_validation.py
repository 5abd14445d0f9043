"""Validating the rows of text tables against a declared schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions.expr import every, ref


@dataclass(frozen=True)
class ColumnSpec:
    """A column of text and what it must be read as; kind is string, int, decimal or timestamp."""

    name: str
    kind: str
    nullable: bool = True
    min_length: int | None = None
    max_length: int | None = None
    matches: str | None = None
    min_value: int | None = None
    max_value: int | None = None
    precision: int = 10
    scale: int = 0
    mask: str | None = None

    def cast(self, c: Column) -> Column:
        if self.kind == "int":
            return c.try_cast("int")
        if self.kind == "decimal":
            return c.try_cast(f"decimal({self.precision},{self.scale})")
        if self.kind == "timestamp":
            return F.try_to_timestamp(c, F.lit(self.mask))
        return c

    def valid(self, c: Column) -> Column:
        """True or false, never null: a null is valid where it may be one."""
        value = self.cast(c)
        tests: list[Column] = []
        if self.kind != "string":
            tests.append(value.isNotNull())
        if self.min_value is not None:
            tests.append(value >= self.min_value)
        if self.max_value is not None:
            tests.append(value <= self.max_value)
        if self.min_length is not None:
            tests.append(F.length(c) >= self.min_length)
        if self.max_length is not None:
            tests.append(F.length(c) <= self.max_length)
        if self.matches is not None:
            tests.append(F.regexp_extract(c, self.matches, 0) != "")
        fits = F.coalesce(every(tests), F.lit(False)) if tests else F.lit(True)
        return F.when(c.isNull(), F.lit(self.nullable)).otherwise(fits)


@dataclass(frozen=True)
class RowLevelSchema:
    columns: tuple[ColumnSpec, ...] = field(default=())

    def _with(self, spec: ColumnSpec) -> RowLevelSchema:
        return replace(self, columns=(*self.columns, spec))

    def with_string_column(self, name: str, is_nullable: bool = True, min_length: int | None = None, max_length: int | None = None, matches: str | None = None) -> RowLevelSchema:
        return self._with(ColumnSpec(name, "string", is_nullable, min_length, max_length, matches))

    def with_int_column(self, name: str, is_nullable: bool = True, min_value: int | None = None, max_value: int | None = None) -> RowLevelSchema:
        return self._with(ColumnSpec(name, "int", is_nullable, min_value=min_value, max_value=max_value))

    def with_decimal_column(self, name: str, precision: int, scale: int, is_nullable: bool = True) -> RowLevelSchema:
        return self._with(ColumnSpec(name, "decimal", is_nullable, precision=precision, scale=scale))

    def with_timestamp_column(self, name: str, mask: str, is_nullable: bool = True) -> RowLevelSchema:
        return self._with(ColumnSpec(name, "timestamp", is_nullable, mask=mask))


@dataclass
class ValidationResult:
    """valid_rows are cast to the schema, invalid_rows as they were."""

    valid_rows: DataFrame
    num_valid_rows: int
    invalid_rows: DataFrame
    num_invalid_rows: int


def validate(df: DataFrame, schema: RowLevelSchema, storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> ValidationResult:
    """Splits the rows; both counts come from one job over the persisted data and verdicts."""
    verdict = every([s.valid(ref(df, s.name)) for s in schema.columns]) if schema.columns else F.lit(True)
    marked = df.withColumn("__valid", verdict).persist(storage_level)
    counts = marked.agg(F.count_if(F.col("__valid")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    by_name = {s.name: s for s in schema.columns}
    cast = [by_name[c].cast(ref(df, c)).alias(c) if c in by_name else ref(df, c) for c in df.columns]
    return ValidationResult(marked.where("__valid").select(*cast), counts["v"], marked.where("not __valid").drop("__valid"), counts["n"] - counts["v"])
