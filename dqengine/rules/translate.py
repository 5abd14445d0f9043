"""From parsed rules to what is executed: checks with metric names, or rules with their own evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.assertions import IS_ONE
from dqengine.checks import Check, CheckLevel, sql_text
from dqengine.functions.expr import quote
from dqengine.rules.parser import Condition, Operand, Rule


class Unsupported(ValueError):
    """A rule that can't be executed; the message says why."""


@dataclass(frozen=True)
class NumberTest:
    """A condition on numbers, for values and for columns. between excludes its ends; NULL equals no number."""

    test: str
    values: tuple[float | None, ...]
    negated: bool = False

    def __call__(self, x: Any) -> bool:
        x = float(x)
        if self.test == "between":
            return (self.values[0] < x < self.values[1]) != self.negated
        if self.test == "in":
            return (x in self.values) != self.negated
        v = self.values[0]
        if v is None:
            return self.test == "!="
        return {"=": x == v, "!=": x != v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[self.test]

    def column(self, x: Column) -> Column:
        if self.test == "between":
            held = (x > self.values[0]) & (x < self.values[1])
        elif self.test == "in":
            held = x.isin(*[v for v in self.values if v is not None])
        elif self.values[0] is None:
            held = F.lit(self.test == "!=")
        else:
            v = self.values[0]
            held = {"=": x == v, "!=": x != v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[self.test]
        return ~held if self.negated else held


def number_test(c: Condition) -> NumberTest:
    values = tuple(None if o.kind == "keyword" else o.value for o in c.operands)
    if any(isinstance(v, str) for v in values):
        raise Unsupported(f"a number was expected, not {c.operands[0].text}")
    return NumberTest(c.test, values, c.negated)


@dataclass
class CheckRule:
    """Evaluated as a check; names give each metric's key by its name in the engine."""

    rule: Rule
    check: Check
    names: dict[str, str] = field(default_factory=dict)


@dataclass
class RowRule:
    """Evaluated on a boolean column of the data: the share of rows for which it holds, and the rows themselves.

    threshold: what the share must satisfy; column: what must exist.
    """

    rule: Rule
    predicate: Callable[[DataFrame], Column]
    metric: str
    column: str | None = None
    threshold: Callable[[float], bool] = IS_ONE


@dataclass
class DirectRule:
    """Evaluated by a function of the data and the other sources: passed, reason, metrics, row-level frame column."""

    rule: Rule
    run: Callable[[DataFrame, dict[str, DataFrame]], tuple[bool, str | None, dict[str, float]]]
    rows: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None  # adds a boolean column named outcome


@dataclass
class CompositeRule:
    rule: Rule
    parts: list[Executable]


@dataclass
class UnsupportedRule:
    rule: Rule
    reason: str


Executable = CheckRule | RowRule | DirectRule | CompositeRule | UnsupportedRule


def _check(rule: Rule, build: Callable[[Check], Check], names: dict[str, str], every: bool = False) -> CheckRule:
    check = build(Check(CheckLevel.ERROR, str(rule)))
    if rule.where is not None and not every:
        check = check.where(rule.where)
    return CheckRule(rule, check, names)


def _condition(rule: Rule) -> Condition:
    if rule.condition is None:
        raise Unsupported(f"{rule.kind} needs a condition")
    return rule.condition


def _column(rule: Rule) -> str:
    if not rule.parameters:
        raise Unsupported(f"{rule.kind} needs a column")
    return rule.parameters[0]


def _ref(name: str) -> str:
    """Columns with odd characters, which can't be references as they stand, in backticks."""
    return name if name.replace("_", "").isalnum() or name.startswith("`") else quote(name)


def _simple(method: str, metric: str | None = None, engine_name: str | None = None) -> Callable[[Rule], CheckRule]:
    """A column, a condition, one metric."""

    def make(rule: Rule) -> CheckRule:
        c, test = _ref(_column(rule)), number_test(_condition(rule))
        name = metric or rule.kind
        return _check(rule, lambda k: getattr(k, method)(c, test), {engine_name or name: name})

    return make


def _uniqueness(rule: Rule) -> CheckRule:
    _column(rule)
    test = number_test(_condition(rule)) if rule.kind == "Uniqueness" else IS_ONE
    return _check(rule, lambda k: k.has_uniqueness(tuple(map(_ref, rule.parameters)), test), {"Uniqueness": "Uniqueness"})


def _primary_key(rule: Rule) -> CheckRule:
    columns = [_ref(c) for c in rule.parameters]
    _column(rule)

    def build(k: Check) -> Check:
        k = k.is_primary_key(*columns)
        k = k.where(rule.where) if rule.where else k
        for c in columns:
            k = k.is_complete(c)
            k = k.where(rule.where) if rule.where else k
        return k

    return _check(rule, build, {"Uniqueness": "Uniqueness", "Completeness": "Completeness"}, every=True)


def _lengths(rule: Rule) -> CheckRule:
    c, cond = _ref(_column(rule)), _condition(rule)
    test, names = number_test(cond), {"MinLength": "MinimumLength", "MaxLength": "MaximumLength", "Compliance": "LengthCompliance"}
    if cond.test in (">", ">="):
        return _check(rule, lambda k: k.has_min_length(c, test), names)
    if cond.test in ("<", "<="):
        return _check(rule, lambda k: k.has_max_length(c, test), names)
    if cond.test == "between" and not cond.negated or cond.test == "=":
        def both(k: Check) -> Check:
            k = k.has_min_length(c, test)
            k = k.where(rule.where) if rule.where else k
            k = k.has_max_length(c, test)
            return k.where(rule.where) if rule.where else k

        return _check(rule, both, names, every=True)
    # a null has the length 0 where lengths are listed
    n = f"LENGTH({quote(c)})"
    values = [o.value for o in cond.operands]
    listed = ", ".join(str(int(v)) for v in values)
    if cond.test == "in":
        inside = f"{n} IN ({listed})" + (f" OR {quote(c)} IS NULL" if 0 in values else "")
        sql = f"NOT COALESCE({inside}, FALSE)" + (f" AND {quote(c)} IS NOT NULL" if 0 in values else "") if cond.negated else inside
    elif cond.test == "!=":
        sql = f"{n} != {listed}"
    else:
        sql = f"{n} <= {int(values[0])} OR {n} >= {int(values[1])}"
    return _check(rule, lambda k: k.satisfies(sql, str(rule), columns=(c,)), names)


def _values(rule: Rule) -> Executable:
    c, cond = _ref(_column(rule)), _condition(rule)
    kinds = cond.kinds - {"keyword"}
    if kinds & {"date", "now"}:
        return _dates(rule, c, cond)
    if kinds <= {"number"} and not ({"EMPTY", "WHITESPACES_ONLY"} & {o.value for o in cond.operands}):
        return _numbers(rule, c, cond)
    return _strings(rule, c, cond)


def _numbers(rule: Rule, c: str, cond: Condition) -> Executable:
    test, names = number_test(cond), {"Minimum": "Minimum", "Maximum": "Maximum", "Completeness": "Completeness", "Compliance": "ColumnValues.Compliance"}
    nulls = any(o.kind == "keyword" for o in cond.operands)

    def with_complete(*methods: str) -> CheckRule:
        def build(k: Check) -> Check:
            for m in methods:
                k = getattr(k, m)(c, test)
                k = k.where(rule.where) if rule.where else k
            k = k.is_complete(c)
            return k.where(rule.where) if rule.where else k

        return _check(rule, build, names, every=True)

    if rule.threshold is None and not nulls:
        if cond.test in (">", ">="):
            return with_complete("has_min")
        if cond.test in ("<", "<="):
            return with_complete("has_max")
        if cond.test == "=":
            return with_complete("has_min", "has_max")
    q = quote(c)
    numbers = [o.value for o in cond.operands if o.kind == "number"]
    if cond.test == "between":
        inside = f"{q} > {numbers[0]} AND {q} < {numbers[1]}"
        sql = f"{q} <= {numbers[0]} OR {q} >= {numbers[1]}" if cond.negated else inside
        sql = f"{q} IS NOT NULL AND ({sql})"
    elif cond.test == "in":
        listed = f"{q} IN ({', '.join(map(str, numbers))})" if numbers else "FALSE"
        if cond.negated:
            sql = f"({q} IS NOT NULL AND NOT {listed})" if nulls else f"{q} IS NULL OR NOT {listed}"
        else:
            sql = f"{q} IS NULL OR {listed}" if nulls else f"{q} IS NOT NULL AND {listed}"
    elif nulls:
        sql = f"{q} IS NULL" if cond.test == "=" else f"{q} IS NOT NULL"
    elif cond.test == "!=":
        sql = f"{q} IS NULL OR {q} != {numbers[0]}"
    else:
        sql = f"{q} IS NOT NULL AND {q} {cond.test} {numbers[0]}"
    return _satisfied(rule, c, sql, names)


def _satisfied(rule: Rule, c: str, sql: str, names: dict[str, str]) -> CheckRule:
    share = number_test(rule.threshold) if rule.threshold else IS_ONE
    return _check(rule, lambda k: k.satisfies(sql, str(rule), share, columns=(c,)), names)


def _strings(rule: Rule, c: str, cond: Condition) -> Executable:
    q, names = quote(c), {"Compliance": "ColumnValues.Compliance", "PatternMatch": "PatternMatch"}
    if cond.test == "matches":
        pattern = str(cond.operands[0].value)
        share = number_test(rule.threshold) if rule.threshold else IS_ONE
        if cond.negated:
            pattern = rf"^(?!\b{pattern}\b).*$"
        else:
            pattern = f"^{pattern}$"
        return _check(rule, lambda k: k.has_pattern(c, pattern, share), names)
    if cond.test not in ("in", "=", "!="):
        raise Unsupported(f"{cond.test} has no meaning for strings")
    tests = []
    literals = [o for o in cond.operands if o.kind != "keyword"]
    if literals:
        tests.append(f"{q} IN ({', '.join(sql_text(o.value) for o in literals)})")
    for o in cond.operands:
        if o.kind == "keyword":
            tests.append({"NULL": f"{q} IS NULL", "EMPTY": f"{q} = ''", "WHITESPACES_ONLY": f"(LENGTH(TRIM({q})) = 0 AND LENGTH({q}) > 0)"}[o.value])
    # what isn't listed as NULL: a null satisfies neither a list nor its negation, but for "not" it isn't in the list
    inside = " OR ".join(f"COALESCE({t}, FALSE)" for t in tests)
    negated = cond.negated != (cond.test == "!=")
    return _satisfied(rule, c, f"NOT ({inside})" if negated else f"({inside})", names)


def moment(o: Operand) -> str:
    """A date literal, or that of now and a duration, as ISO text."""
    if o.kind == "now":
        return (datetime.now(timezone.utc) + timedelta(hours=o.value)).strftime("%Y-%m-%d")
    return str(o.value)


def _dates(rule: Rule, c: str, cond: Condition) -> Executable:
    q = f"CAST(try_to_timestamp(CAST({quote(c)} AS STRING)) AS DATE)"
    values = [f"DATE'{moment(o)}'" for o in cond.operands if o.kind != "keyword"]
    nulls = any(o.kind == "keyword" for o in cond.operands)
    if cond.test == "between":
        sql = f"{q} > {values[0]} AND {q} < {values[1]}"
        sql = f"({q} <= {values[0]} OR {q} >= {values[1]})" if cond.negated else sql
    elif cond.test == "in":
        sql = f"{q} IN ({', '.join(values)})"
        sql = f"NOT ({sql})" if cond.negated else sql
    else:
        sql = f"{q} {cond.test} {values[0]}"
    sql = f"COALESCE({sql}, FALSE)" + (f" OR {quote(c)} IS NULL" if nulls and not cond.negated else "")
    return _satisfied(rule, c, sql, {"Compliance": "ColumnValues.Compliance"})


# The types that values can be asked to be.
TYPES = {"BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "LONG": "bigint"}


def _padded(format_: str, c: Column) -> tuple[str, Column]:
    """A format of a whole date, and the text to go with it: parts that are missing are the first of their kind, in 2000."""
    for part, first in (("y", "2000"), ("M", "01"), ("d", "01")):
        if part not in format_:
            format_, c = f"{format_} {part * len(first)}", F.concat(c, F.lit(f" {first}"))
    return format_, c


def _data_type(rule: Rule) -> RowRule:
    column, cond = _column(rule), _condition(rule)
    if cond.test not in ("=", "!=") or cond.operands[0].kind != "string":
        raise Unsupported("ColumnDataType needs = and a type")
    kind = str(cond.operands[0].value).upper().replace(" ", "")
    formats = rule.tag("format")
    formats = [formats] if isinstance(formats, str) else list(formats or [])
    if kind.startswith("DECIMAL"):
        kind = "decimal" + kind[7:]
    elif kind in TYPES:
        kind = TYPES[kind]
    else:
        raise Unsupported(f"there is no type {cond.operands[0].value}")

    def predicate(df: DataFrame) -> Column:
        from dqengine.functions.expr import ref

        c = ref(df, column)
        if formats and kind in ("date", "timestamp"):
            fits = F.lit(False)
            for f in formats:
                whole, text = _padded(f, c.cast("string"))
                fits = fits | F.try_to_timestamp(text, F.lit(whole)).isNotNull()
        else:
            value = c.cast("string").try_cast(kind) if kind in ("int", "bigint") else c.try_cast(kind)
            fits = value.isNotNull()
        fits = F.coalesce(fits, F.lit(False))
        return ~fits if cond.test == "!=" else fits

    return RowRule(rule, predicate, f"Column.{column}.ColumnDataType.Compliance", column, number_test(rule.threshold) if rule.threshold else IS_ONE)


def _freshness(rule: Rule) -> RowRule:
    column, cond = _column(rule), _condition(rule)

    def predicate(df: DataFrame) -> Column:
        from dqengine.functions.expr import data_type, is_temporal, ref

        c = ref(df, column)
        at = c.cast("timestamp") if is_temporal(data_type(df, column)) else F.try_to_timestamp(c.cast("string"))
        age = F.round((F.current_timestamp().cast("double") - at.cast("double")) / 3600, 2)
        hours = [o.value for o in cond.operands]
        if cond.test == "between":
            held = (age > hours[0]) & (age < hours[1])
        elif cond.test == "in":
            held = age.isin(*hours)
        else:
            held = {"=": age == hours[0], "!=": age != hours[0], ">": age > hours[0], ">=": age >= hours[0], "<": age < hours[0], "<=": age <= hours[0]}[cond.test]
        return F.coalesce(~held if cond.negated else held, F.lit(False))

    return RowRule(rule, predicate, f"Column.{column}.DataFreshness.Compliance", column, number_test(rule.threshold) if rule.threshold else IS_ONE)


CHECKS: dict[str, Callable[[Rule], Executable]] = {
    "RowCount": lambda r: _check(r, lambda k: k.has_size(number_test(_condition(r))), {"Size": "RowCount"}),
    "ColumnCount": lambda r: _check(r, lambda k: k.has_column_count(number_test(_condition(r))), {"ColumnCount": "ColumnCount"}, every=True),
    "ColumnExists": lambda r: _check(r, lambda k: k.has_column(_column(r)), {}, every=True),
    "Completeness": _simple("has_completeness"),
    "IsComplete": lambda r: _check(r, lambda k: k.is_complete(_ref(_column(r))), {"Completeness": "Completeness"}),
    "Uniqueness": _uniqueness,
    "IsUnique": _uniqueness,
    "IsPrimaryKey": _primary_key,
    "UniqueValueRatio": _simple("has_unique_value_ratio"),
    "DistinctValuesCount": _simple("has_number_of_distinct_values", "DistinctValuesCount", "Histogram.bins"),
    "ColumnCorrelation": lambda r: _check(r, lambda k: k.has_correlation(*map(_ref, r.parameters[:2]), number_test(_condition(r))), {"Correlation": "ColumnCorrelation"}),
    "ZerosCount": _simple("has_zeros_count"),
    "DuplicateRowCount": lambda r: _check(r, lambda k: k.has_duplicate_row_count(tuple(map(_ref, r.parameters)), number_test(_condition(r))), {"DuplicateRowCount": "DuplicateRowCount"}),
    "Entropy": _simple("has_entropy"),
    "Mean": _simple("has_mean"),
    "Sum": _simple("has_sum"),
    "StandardDeviation": _simple("has_standard_deviation"),
    "Variance": _simple("has_variance"),
    "Skewness": _simple("has_skewness"),
    "Kurtosis": _simple("has_kurtosis"),
    "Range": _simple("has_range"),
    "InterquartileRange": _simple("has_interquartile_range"),
    "ColumnLength": _lengths,
    "ColumnValues": _values,
    "ColumnDataType": _data_type,
    "DataFreshness": _freshness,
}


def translate(rule: Rule) -> Executable:
    from dqengine.rules import direct

    try:
        if rule.operator is not None:
            parts = [translate(r) for r in rule.nested]
            flat: list[Executable] = []
            for p in parts:
                flat += p.parts if isinstance(p, CompositeRule) and p.rule.operator == rule.operator else [p]
            return CompositeRule(rule, flat)
        if rule.kind in CHECKS:
            return CHECKS[rule.kind](rule)
        if rule.kind in direct.RULES:
            return direct.RULES[rule.kind](rule)
        return UnsupportedRule(rule, f"there is no rule {rule.kind}")
    except (Unsupported, ValueError, IndexError) as e:
        return UnsupportedRule(rule, str(e))
