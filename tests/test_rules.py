import pytest

from dqengine.rules import EvaluateDataQuality, ParsingError, parse
from tests import fixtures as X


def outcomes(df, *rules, sources=None):
    rows = EvaluateDataQuality.process(df, f"Rules = [ {', '.join(rules)} ]", sources).collect()
    return [r["Outcome"] for r in rows]


def one(df, rule, sources=None):
    return EvaluateDataQuality.process(df, f"Rules = [ {rule} ]", sources).collect()[0]


def test_parsing():
    r = parse('Rules = [ ColumnValues "a" between -1 and 2*(3+4) where "b > 1" with threshold > 0.5, (IsComplete "x") and ((RowCount > 1) or (IsUnique "y")) # note\n]').rules
    assert r[0].condition.operands[1].value == 14 and r[0].where == "b > 1" and r[0].threshold.test == ">"
    assert r[1].operator == "and" and r[1].nested[1].operator == "or" and str(r[1]).startswith("(IsComplete")
    for bad in ("", "Rules = []", "Rules = [ RowCount > ]", "Rules = [ RowCount > 1", 'Rules = [ RowCount > 1 ] x', "Rules = [ ?? ]"):
        with pytest.raises(ParsingError, match="Parsing Error"):
            parse(bad)


def test_check_rules(spark):
    n, f, u = X.numeric(spark), X.incomplete(spark), X.unique(spark)
    assert outcomes(n, "RowCount = 6", "RowCount > 6", "ColumnCount = 5", 'ColumnExists "att1"', 'ColumnExists "x"', 'ZerosCount "att2" = 3', 'Mean "att1" = 3.5', 'Sum "att1" between 20 and 22', 'Sum "att1" between 21 and 22', 'StandardDeviation "att1" < 2', 'Variance "att1" < 3', 'Skewness "att1" = 0', 'Kurtosis "att1" < 0', 'Range "att1" = 5', 'InterquartileRange "att1" = 2.5', 'ColumnCorrelation "att1" "att2" > 0.8') == ["Passed", "Failed", "Passed", "Passed", "Failed", "Passed", "Passed", "Passed", "Failed", *["Passed"] * 7]
    assert outcomes(f, 'Completeness "att2" > 0.6', 'IsComplete "att2"', 'IsComplete "att2" where "att1 = \'a\' and item < 3"', 'DistinctValuesCount "att1" = 2', 'Entropy "att1" > 0.5', 'UniqueValueRatio "att2" > 0.4', 'DuplicateRowCount "att1" = 6', "DuplicateRowCount = 0") == ["Passed", "Failed", "Passed", "Passed", "Passed", "Passed", "Passed", "Passed"]
    assert outcomes(u, 'IsUnique "uniq"', 'IsUnique "nonUnique"', 'Uniqueness "halfUnique" = 0.5', 'IsPrimaryKey "uniq"', 'IsPrimaryKey "uniq" "uniqueWithNulls"') == ["Passed", "Failed", "Passed", "Passed", "Failed"]


def test_metrics_and_reasons(spark):
    r = one(X.incomplete(spark), 'Completeness "att2" > 0.8')
    assert r["EvaluatedMetrics"] == {"Column.att2.Completeness": 4 / 6} and r["FailureReason"] == "Value: 0.6666666666666666 does not meet the constraint requirement!"
    assert one(X.numeric(spark), "RowCount = 6")["EvaluatedMetrics"] == {"Dataset.*.RowCount": 6.0}
    assert one(X.numeric(spark), 'ColumnValues "att1" > 0')["EvaluatedMetrics"] == {"Column.att1.Minimum": 1.0, "Column.att1.Completeness": 1.0}
    assert "not supported" in one(X.numeric(spark), "Nonsense > 1")["FailureReason"]
    assert EvaluateDataQuality.process(X.numeric(spark), "Rules = [ RowCount = 6, RowCount = 6 ]").count() == 1


def test_column_values(spark):
    n, f = X.numeric(spark), X.incomplete(spark)
    assert outcomes(n, 'ColumnValues "att1" > 0', 'ColumnValues "att1" <= 5', 'ColumnValues "att1" between 0 and 7', 'ColumnValues "att1" between 1 and 7', 'ColumnValues "att1" in [1,2,3,4,5,6]', 'ColumnValues "att1" not in [9]', 'ColumnValues "attNull" in [5,6,7]', 'ColumnValues "attNull" in [5,6,7,NULL]', 'ColumnValues "attNull" != NULL', 'ColumnValues "att1" between 2 and 7 with threshold > 0.5') == ["Passed", "Failed", "Passed", "Failed", "Passed", "Passed", "Failed", "Passed", "Failed", "Passed"]
    assert outcomes(f, 'ColumnValues "att1" in ["a", "b"]', 'ColumnValues "att2" in ["d", "f"]', 'ColumnValues "att2" in ["d", "f", NULL]', 'ColumnValues "att1" matches "[ab]"', 'ColumnValues "att1" matches "a"', 'ColumnValues "att1" matches "a" with threshold > 0.6', 'ColumnValues "att1" not in ["a"]', 'ColumnValues "att1" != "z"', 'ColumnValues "att1" = "a" where "item = 1"', 'ColumnValues "att1" not matches "z.*"') == ["Passed", "Failed", "Passed", "Passed", "Failed", "Passed", "Failed", "Passed", "Passed", "Passed"]
    blanks = spark.createDataFrame([("",), ("  ",), ("x",)], "s string")
    assert outcomes(blanks, 'ColumnValues "s" in [EMPTY, WHITESPACES_ONLY, "x"]', 'ColumnValues "s" in [EMPTY, "x"]', 'ColumnValues "s" != EMPTY') == ["Passed", "Failed", "Failed"]


def test_dates_types_freshness(spark):
    d = spark.sql("select cast(current_date() - cast(id as int) as string) as day, current_timestamp() - make_interval(0,0,0,0,cast(id as int)) as at, struct(current_timestamp() as t) as s from range(1, 5)")
    assert outcomes(d, 'ColumnValues "day" > "2001-01-01"', 'ColumnValues "day" > 2001-01-01', 'ColumnValues "day" > (now() - 3 days)', 'ColumnValues "day" > (now() - 30 days)', 'ColumnValues "day" between 2001-01-01 and 2999-01-01') == ["Failed", "Passed", "Failed", "Passed", "Passed"]
    assert outcomes(d, 'DataFreshness "at" < 5 hours', 'DataFreshness "at" < 2 hours', 'DataFreshness "day" <= 6 days', 'DataFreshness "s.t" between -1 hours and 30 minutes') == ["Passed", "Failed", "Passed", "Passed"]
    t = spark.createDataFrame([("11.5", "2024-01-02", "03/2024"), ("12.0", "2024-02-03", "04/2024"), ("not_a_number", "x", "05/2024"), ("14.5", None, "99/2024")], "n string, d string, m string")
    r = one(t, 'ColumnDataType "n" = "DOUBLE" with threshold > 0.7')
    assert r["Outcome"] == "Passed" and r["EvaluatedMetrics"] == {"Column.n.ColumnDataType.Compliance": 0.75}
    assert outcomes(t, 'ColumnDataType "n" = "INTEGER"', 'ColumnDataType "n" = "DECIMAL(10,2)" where "n <> \'not_a_number\'"', 'ColumnDataType "d" = "DATE" with threshold = 0.5', 'ColumnDataType "m" = "DATE" with format = "MM/yyyy" with threshold = 0.75', 'ColumnDataType "nope" = "DATE"', 'ColumnDataType "n" = "BLOB"') == ["Failed", "Passed", "Passed", "Passed", "Failed", "Failed"]
    assert one(t, 'ColumnDataType "n" = "DOUBLE" where "n = \'none\'"')["FailureReason"] == "No rows matched the filter"


def test_lengths(spark):
    s = spark.createDataFrame([("ab",), ("abc",), (None,)], "s string")
    assert outcomes(s, 'ColumnLength "s" > 1', 'ColumnLength "s" <= 2', 'ColumnLength "s" between 1 and 4', 'ColumnLength "s" in [2,3]', 'ColumnLength "s" in [0,2,3]', 'ColumnLength "s" not in [0]', 'ColumnLength "s" = 2 where "s = \'ab\'"') == ["Passed", "Failed", "Passed", "Failed", "Passed", "Failed", "Passed"]


def test_other_datasets(spark):
    p = spark.createDataFrame([(1, "CA", 5), (2, "NY", 6), (3, "NY", 7), (4, "TX", 8)], "id int, st string, v int")
    r = spark.createDataFrame([(1, "CA", 5), (2, "NY", 6), (3, "FL", 7)], "id int, state string, v int")
    src = {"ref": r, "same": p}
    assert outcomes(p, 'ReferentialIntegrity "st" "ref.state" = 0.75', 'ReferentialIntegrity "id,v" "ref.{id,v}" >= 0.75', 'RowCountMatch "ref" > 1.3', 'SchemaMatch "same" = 1.0', 'SchemaMatch "ref" > 0.6', 'DatasetMatch "ref" "id->id" "v->v" >= 0.75', 'AggregateMatch "sum(v)" "sum(same.v)" = 1.0', 'AggregateMatch "avg(v)" "avg(ref.v)" > 1.0', 'ColumnNamesMatchPattern "^[a-z]+$"', 'RowCountMatch "lost" = 1.0', sources=src) == ["Passed"] * 9 + ["Failed"]
    assert "lost" in one(p, 'RowCountMatch "lost" = 1.0')["FailureReason"]


def test_custom_sql(spark):
    p = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, s string")
    assert outcomes(p, 'CustomSql "select count(*) from primary" = 3', 'CustomSql "select id from primary where id < 3" with threshold > 0.5', 'CustomSql "select id from primary where id < 3"', 'CustomSql "select s from primary where s is null or s = \'a\'" with threshold > 0.6', 'CustomSql "select 1 as other"', 'CustomSql "select nope"') == ["Passed", "Passed", "Failed", "Passed", "Failed", "Failed"]


def test_composites(spark):
    f = X.incomplete(spark)
    r = one(f, '(RowCount = 6) and ((IsComplete "att2") or (IsComplete "att1"))')
    assert r["Outcome"] == "Passed" and set(r["EvaluatedMetrics"]) == {"Dataset.*.RowCount", "Column.att2.Completeness", "Column.att1.Completeness"}
    assert outcomes(f, '(RowCount = 7) or (IsComplete "att2")', '(IsComplete "att1") and (Nonsense "x")') == ["Failed", "Failed"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6), (None, "c", 50)], "id int, name string, v int")
    out = EvaluateDataQuality.process_rows(df, 'Rules = [ IsComplete "id", IsComplete "name" where "v < 10", ColumnValues "v" < 10, RowCount = 3, (IsComplete "id") and (IsComplete "name"), CustomSql "select id from primary where v > 5" ]')
    rows = out["rowLevelOutcomes"].orderBy("v").collect()
    assert [r["DataQualityEvaluationResult"] for r in rows] == ["Failed", "Failed", "Failed"]
    first, second, third = rows
    assert 'IsComplete "id"' in first["DataQualityRulesPass"] and first["DataQualityRulesFail"] == ['CustomSql "select id from primary where v > 5"']
    assert "RowCount = 3" in first["DataQualityRulesSkip"]
    assert 'IsComplete "name" where "v < 10"' in second["DataQualityRulesFail"]
    assert 'IsComplete "name" where "v < 10"' in third["DataQualityRulesSkip"] and 'ColumnValues "v" < 10' in third["DataQualityRulesFail"]
    assert out["ruleOutcomes"].count() == 6 and out["originalData"] is df
