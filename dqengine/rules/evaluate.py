"""Evaluating a ruleset: all checks of all rules in one run, then the other rules, then composites."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.checks import CamelCase
from dqengine.constraints import ConstraintStatus
from dqengine.functions.expr import data_type, quote
from dqengine.plans.runner import run_analyzers
from dqengine.rules.parser import parse
from dqengine.rules.translate import CheckRule, CompositeRule, DirectRule, Executable, RowRule, UnsupportedRule, translate

SCHEMA = "Rule string, Outcome string, FailureReason string, EvaluatedMetrics map<string,double>, EvaluatedRule string"
PASSED, FAILED = "Passed", "Failed"


@dataclass
class Outcome:
    passed: bool
    reason: str | None = None
    metrics: dict[str, float] = field(default_factory=dict)


def leaves(e: Executable) -> list[Executable]:
    return [x for p in e.parts for x in leaves(p)] if isinstance(e, CompositeRule) else [e]


class Evaluation:
    """The executables of a ruleset with their outcomes on a dataset."""

    def __init__(self, df: DataFrame, ruleset: str, sources: Mapping[str, DataFrame]):
        self.df, self.sources = df, dict(sources)
        seen: dict[str, Executable] = {}
        for r in parse(ruleset).rules:  # equal rules count once
            seen.setdefault(str(r), translate(r))
        self.executables = list(seen.values())
        self.outcomes: dict[int, Outcome] = {}
        self._run()

    def _run(self) -> None:
        every = [x for e in self.executables for x in leaves(e)]
        checks = [x for x in every if isinstance(x, CheckRule)]
        analyzers = list(dict.fromkeys(a for x in checks for a in x.check.required_analyzers()))
        self.context = run_analyzers(self.df, analyzers)
        for x in checks:
            self.outcomes[id(x)] = self._check(x)
        self._row_rules([x for x in every if isinstance(x, RowRule)])
        for x in every:
            if isinstance(x, DirectRule):
                try:
                    self.outcomes[id(x)] = Outcome(*x.run(self.df, self.sources))
                except Exception as e:  # noqa: BLE001  a rule that can't be evaluated fails
                    self.outcomes[id(x)] = Outcome(False, str(e).strip("'\""))
            elif isinstance(x, UnsupportedRule):
                self.outcomes[id(x)] = Outcome(False, f"Rule (or nested rule) not supported due to: {x.reason}")

    def _check(self, x: CheckRule) -> Outcome:
        result = x.check.evaluate(self.context.metrics)
        metrics: dict[str, float] = {}
        reasons = []
        for r in result.constraint_results:
            if r.metric is not None and r.metric.ok:
                for m in r.metric.flatten():
                    if m.name in x.names:
                        instance = m.instance if x.names[m.name] not in ("ColumnValues.Compliance", "LengthCompliance") else x.rule.parameters[0]
                        metrics[f"{m.entity.value}.{instance.replace('`', '')}.{x.names[m.name]}"] = float(m.value)
            if r.status is ConstraintStatus.FAILURE:
                reasons.append(r.message or "")
        if reasons and x.rule.condition is not None and any(o.value == "NULL" and o.kind == "keyword" for o in x.rule.condition.operands) and x.rule.condition.test in ("=", "!="):
            reasons = ["Value: NULL does not meet the constraint requirement!"]
        return Outcome(not reasons, " ".join(reasons) or None, metrics)

    def _row_rules(self, rules: list[RowRule]) -> None:
        """The shares of all of them from one pass."""
        plan: dict[str, Column] = {}
        asked = []
        for i, x in enumerate(rules):
            if x.column is not None and data_type(self.df, x.column) is None:
                self.outcomes[id(x)] = Outcome(False, f"Column {x.column} not found in the dataset")
                continue
            try:
                inside = F.lit(True) if x.rule.where is None else F.coalesce(F.expr(x.rule.where), F.lit(False))
                own = {f"n{i}": F.count_if(inside), f"h{i}": F.count_if(inside & x.predicate(self.df))}
                self.df.select(*(c.alias(k) for k, c in own.items()))  # resolves now, so that one bad rule fails alone
            except Exception as e:  # noqa: BLE001
                self.outcomes[id(x)] = Outcome(False, f"Invalid filter or column: {str(e).splitlines()[0]}")
                continue
            plan |= own
            asked.append((i, x))
        if not plan:
            return
        row = self.df.agg(*(c.alias(k) for k, c in plan.items())).first()
        for i, x in asked:
            n, h = row[f"n{i}"], row[f"h{i}"]
            if not n:
                self.outcomes[id(x)] = Outcome(True, "No rows matched the filter") if x.rule.where is not None else Outcome(x.threshold(1.0), None, {x.metric: 1.0})
                continue
            share = h / n
            passed = x.threshold(share)
            self.outcomes[id(x)] = Outcome(passed, None if passed else f"Value: {share} does not meet the constraint requirement.", {x.metric: share})

    def outcome(self, e: Executable) -> Outcome:
        if not isinstance(e, CompositeRule):
            return self.outcomes[id(e)]
        parts = [self.outcome(p) for p in e.parts]
        passed = all(p.passed for p in parts) if e.rule.operator == "and" else any(p.passed for p in parts)
        reasons = [p.reason for p in parts if not p.passed and p.reason]
        return Outcome(passed, None if passed else "\n".join(reasons) or None, {k: v for p in parts for k, v in p.metrics.items()})

    def as_dataframe(self) -> DataFrame:
        rows = []
        for e in self.executables:
            o = self.outcome(e)
            rows.append((str(e.rule), PASSED if o.passed else FAILED, o.reason, o.metrics, str(e.rule)))
        return self.df.sparkSession.createDataFrame(rows, SCHEMA)

    # rows

    def _with_direct(self, df: DataFrame) -> tuple[DataFrame, dict[int, Column]]:
        """df with the row outcomes of rules that join other data, and their columns."""
        found: dict[int, Column] = {}
        out = df
        for n, x in enumerate(x for e in self.executables for x in leaves(e) if isinstance(x, DirectRule) and x.rows is not None):
            try:
                joined = x.rows(out, self.sources)
            except Exception:  # noqa: BLE001  a rule that failed as a whole says nothing of rows
                continue
            out = joined.withColumnRenamed("outcome", f"__rule{n}")
            found[id(x)] = F.col(f"__rule{n}")
        return out, found

    def row_column(self, e: Executable, df: DataFrame, direct: dict[int, Column]) -> Column | None:
        """A boolean of each row, null where it is out of scope; None if the rule doesn't judge rows."""
        if isinstance(e, CompositeRule):
            parts = [self.row_column(p, df, direct) for p in e.parts]
            return None if any(p is None for p in parts) else reduce(and_ if e.rule.operator == "and" else or_, parts)
        if isinstance(e, DirectRule):
            return direct.get(id(e))
        if isinstance(e, RowRule):
            if e.column is not None and data_type(df, e.column) is None:
                return None
            held = e.predicate(df)
            return held if e.rule.where is None else F.when(F.coalesce(F.expr(e.rule.where), F.lit(False)), held)
        if isinstance(e, CheckRule):
            columns = []
            for c in e.check.constraints:
                column = c.rows(df, self.context.metrics.get(c.analyzer))
                if column is None:
                    return None
                where = c.analyzer.condition
                columns.append(column if where is None else F.when(F.coalesce(F.expr(where), F.lit(False)), column))
            return reduce(and_, columns) if columns else None
        return None

    def rows_as_dataframe(self) -> DataFrame:
        """The data with arrays of the rules that pass, fail and skip each row, and the row's result."""
        df, direct = self._with_direct(self.df)
        judged = [(str(e.rule), self.row_column(e, df, direct)) for e in self.executables]
        named = [(n, c) for n, c in judged if c is not None]
        skipped = [n for n, c in judged if c is None]

        def listed(test) -> Column:
            items = [F.when(test(c), F.lit(n)) for n, c in named]
            return F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")

        always = F.array(*map(F.lit, skipped)) if skipped else F.array().cast("array<string>")
        return df.select(
            *(F.col(quote(c)) for c in self.df.columns),
            listed(lambda c: F.coalesce(c, F.lit(False))).alias("DataQualityRulesPass"),
            listed(lambda c: F.coalesce(~c, F.lit(False))).alias("DataQualityRulesFail"),
            F.concat(listed(lambda c: c.isNull()), always).alias("DataQualityRulesSkip"),
        ).withColumn("DataQualityEvaluationResult", F.when(F.size("DataQualityRulesFail") > 0, FAILED).otherwise(PASSED))


class EvaluateDataQuality(CamelCase):
    ORIGINAL_DATA, RULE_OUTCOMES, ROW_LEVEL_OUTCOMES = "originalData", "ruleOutcomes", "rowLevelOutcomes"

    @staticmethod
    def process(df: DataFrame, ruleset: str, additional_data_sources: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """One row for each rule: Rule, Outcome, FailureReason, EvaluatedMetrics, EvaluatedRule."""
        return Evaluation(df, ruleset, additional_data_sources or {}).as_dataframe()

    @staticmethod
    def process_rows(df: DataFrame, ruleset: str, additional_data_sources: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The data, the outcomes of the rules, and the data with the outcomes of each row."""
        e = Evaluation(df, ruleset, additional_data_sources or {})
        return {EvaluateDataQuality.ORIGINAL_DATA: df, EvaluateDataQuality.RULE_OUTCOMES: e.as_dataframe(), EvaluateDataQuality.ROW_LEVEL_OUTCOMES: e.rows_as_dataframe()}

    processRows = process_rows  # noqa: N815


