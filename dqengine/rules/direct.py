"""Rules over several datasets, SQL and names: each with an evaluation of its own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine import comparison
from dqengine.assertions import IS_ONE
from dqengine.functions.expr import every, find, quote
from dqengine.operators.special import CustomSql
from dqengine.rules.parser import Rule
from dqengine.rules.translate import CheckRule, DirectRule, Unsupported, number_test

Outcome = tuple[bool, str | None, dict[str, float]]
Sources = dict[str, DataFrame]


def _test(rule: Rule) -> Callable[[float], bool]:
    cond = rule.condition or rule.threshold
    return number_test(cond) if cond else IS_ONE


def _source(sources: Sources, alias: str) -> DataFrame:
    if alias not in sources:
        raise LookupError(f"{alias} not found in additional sources")
    return sources[alias]


def register(df: DataFrame, sources: Sources) -> None:
    """The views that SQL rules read: primary and each other source by its alias."""
    df.createOrReplaceTempView("primary")
    for alias, other in sources.items():
        other.createOrReplaceTempView(alias)


def _judged(ratio: float, rule: Rule, key: str, said: str | None = None) -> Outcome:
    passed = _test(rule)(ratio)
    return passed, None if passed else said or f"Value: {ratio} does not meet the constraint requirement.", {key: ratio}


def custom_sql(rule: Rule) -> DirectRule | CheckRule:
    sql = rule.parameters[0]
    if rule.condition is not None:

        def run(df: DataFrame, sources: Sources) -> Outcome:
            register(df, sources)
            metric = CustomSql(sql).run(df)
            if not metric.ok:
                return False, str(metric.error), {}
            passed = number_test(rule.condition)(metric.value)
            return passed, None if passed else f"Value: {metric.value} does not meet the constraint requirement!", {"Dataset.*.CustomSQL": metric.value}

        return DirectRule(rule, run)

    def matched(df: DataFrame, sources: Sources) -> DataFrame:
        """df with outcome: is the row among those the SQL returns? Nulls match nulls; the join stays a hash join."""
        register(df, sources)
        found = df.sparkSession.sql(sql)
        if not found.columns:
            raise ValueError("Custom SQL did not return any columns")
        if lost := [c for c in found.columns if find(df, c) is None]:
            raise ValueError(f"The output from CustomSQL must subset of the columns in the primary data source, but has {', '.join(lost)}")
        there = found.select(*(F.col(quote(c)).alias(f"__s{i}") for i, c in enumerate(found.columns))).distinct().withColumn("__there", F.lit(True))
        on = [df[quote(find(df, c))].eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(found.columns)]
        return df.join(there, every(on), "left").select(*(df[quote(c)] for c in df.columns), F.col("__there").isNotNull().alias("outcome"))

    def run_rows(df: DataFrame, sources: Sources) -> Outcome:
        rows = matched(df, sources)
        row = rows.agg(F.count_if(F.col("outcome")).alias("hits"), F.count(F.lit(1)).alias("n")).first()
        if not row["n"]:
            return False, "No rows in the primary dataset", {}
        return _judged(row["hits"] / row["n"], rule, "Dataset.*.CustomSQL.Compliance", "Custom SQL response failed to satisfy the threshold")

    return DirectRule(rule, run_rows, matched)


def row_count_match(rule: Rule) -> DirectRule:
    alias = rule.parameters[0]

    def run(df: DataFrame, sources: Sources) -> Outcome:
        result = comparison.row_count_match(df, _source(sources, alias), _test(rule))
        return _judged(result.ratio, rule, f"Dataset.{alias}.RowCountMatch")

    return DirectRule(rule, run)


def schema_match(rule: Rule) -> DirectRule:
    alias = rule.parameters[0]

    def run(df: DataFrame, sources: Sources) -> Outcome:
        result = comparison.schema_match(df, _source(sources, alias), _test(rule))
        return _judged(result.ratio, rule, f"Dataset.{alias}.SchemaMatch")

    return DirectRule(rule, run)


def referential_integrity(rule: Rule) -> DirectRule:
    columns = [c.strip() for c in rule.parameters[0].split(",")]
    m = re.fullmatch(r"([^.]+)\.(?:\{(.*)\}|(.*))", rule.parameters[1])
    if not m:
        raise Unsupported(f"{rule.parameters[1]} isn't alias.column or alias.{{columns}}")
    alias, theirs = m[1], [c.strip() for c in (m[2] if m[2] is not None else m[3]).split(",")]

    def rows(df: DataFrame, sources: Sources) -> DataFrame:
        result = comparison.subset_check_rows(df, columns, _source(sources, alias), theirs)
        if isinstance(result, comparison.Failed):
            raise ValueError(result.message)
        return result

    def run(df: DataFrame, sources: Sources) -> Outcome:
        row = rows(df, sources).agg(F.count_if(F.col("outcome")).alias("hits"), F.count(F.lit(1)).alias("n")).first()
        return _judged(row["hits"] / row["n"] if row["n"] else 1.0, rule, f"Column.{alias}.ReferentialIntegrity")

    return DirectRule(rule, run, rows)


def _mapping(text: str) -> dict[str, str]:
    found = {}
    for part in text.split(","):
        left, _, right = part.partition("->")
        found[left.strip()] = right.strip() or left.strip()
    return found


def dataset_match(rule: Rule) -> DirectRule:
    alias, keys = rule.parameters[0], _mapping(rule.parameters[1])
    values = _mapping(rule.parameters[2]) if len(rule.parameters) > 2 else None

    def rows(df: DataFrame, sources: Sources) -> DataFrame:
        result = comparison.column_match_rows(df, _source(sources, alias), keys, values)
        if isinstance(result, comparison.Failed):
            raise ValueError(result.message)
        return result

    def run(df: DataFrame, sources: Sources) -> Outcome:
        row = rows(df, sources).agg(F.count_if(F.col("outcome")).alias("hits"), F.count(F.lit(1)).alias("n")).first()
        return _judged(row["hits"] / row["n"] if row["n"] else 1.0, rule, f"Dataset.{alias}.DatasetMatch")

    return DirectRule(rule, run, rows)


def aggregate_match(rule: Rule) -> DirectRule:
    parts = []
    for text in rule.parameters[:2]:
        m = re.fullmatch(r"\s*(sum|avg)\s*\(\s*(?:([^.()]+)\.)?([^()]+?)\s*\)\s*", text, re.I)
        if not m:
            raise Unsupported(f"{text} isn't sum(column) or avg(alias.column)")
        parts.append((m[1].lower(), m[2], m[3]))

    def value(df: DataFrame, sources: Sources, how: str, alias: str | None, column: str) -> float:
        data = df if alias in (None, "primary") else _source(sources, alias)
        found = find(data, column)
        if found is None:
            raise LookupError(f"Column {column} not found")
        x = F.col(quote(found)).cast("double")
        return data.agg(F.sum(x) if how == "sum" else F.avg(x)).first()[0] or 0.0

    def run(df: DataFrame, sources: Sources) -> Outcome:
        a, b = (value(df, sources, *p) for p in parts)
        ratio = a / b if b else (1.0 if a == 0 else 0.0)
        columns = list(dict.fromkeys(p[2] for p in parts))
        return _judged(ratio, rule, f"Column.{','.join(columns)}.AggregateMatch")

    return DirectRule(rule, run)


def column_names_match(rule: Rule) -> DirectRule:
    pattern = re.compile(rule.parameters[0])

    def run(df: DataFrame, sources: Sources) -> Outcome:
        lacking = [c for c in df.columns if not pattern.search(c)]
        ratio = 1 - len(lacking) / len(df.columns) if df.columns else 1.0
        return _judged(ratio, rule, "Dataset.*.ColumnNamesPatternMatchRatio", f"Columns that do not match the pattern: {', '.join(lacking)}")

    return DirectRule(rule, run)


RULES: dict[str, Callable[[Rule], DirectRule]] = {
    "CustomSql": custom_sql,
    "RowCountMatch": row_count_match,
    "SchemaMatch": schema_match,
    "ReferentialIntegrity": referential_integrity,
    "DatasetMatch": dataset_match,
    "AggregateMatch": aggregate_match,
    "ColumnNamesMatchPattern": column_names_match,
}
