"""Comparison, schema validation, profiling, suggestion, anomalies, distances, streaming."""

import math
import random

import pytest

from dqengine import anomaly as A
from dqengine import comparison as K
from dqengine import distance as D
from dqengine import operators as O
from dqengine.metrics import BucketValue
from dqengine.profiling import ColumnProfilerRunner, NumericColumnProfile, StringColumnProfile, profile
from dqengine.schema_validation import RowLevelSchema, validate
from dqengine.suggestions import ConstraintSuggestionRunner, Rules, WaldInterval, WilsonScoreInterval, suggest
from tests import fixtures as X

ANY = lambda _: True


def test_dataset_match(spark):
    a = spark.createDataFrame([(1, "John", "NY"), (2, "Javier", "WI"), (3, "Helena", "TX"), (4, "Helena", "TX"), (5, "Nick", "FL"), (6, "Molly", "TX")], "id int, name string, state string")
    b = spark.createDataFrame([(1, "John", "NY"), (2, "Javier", "WI"), (3, "Helena", "TX"), (4, "Helena", "CA"), (5, "Nicholas", "FL"), (6, "Ms Molly", "TX")], "new_id int, name string, state string")
    assert K.column_match(a, b, {"id": "new_id"}, {"name": "name"}, lambda r: r >= 0.6).ratio == 4 / 6
    assert isinstance(K.column_match(a, b, {"id": "new_id"}, {"name": "name"}, lambda r: r >= 0.9), K.Failed)
    assert K.column_match(a, b, {"id": "new_id"}, None, ANY).ratio == 3 / 6
    assert "repeat" in K.column_match(a, b, {"name": "name"}, {"state": "state"}, ANY).message
    assert "lacks" in K.column_match(a, b, {"id": "id"}, {"name": "name"}, ANY).message
    assert "rows against" in K.column_match(a, b.limit(5), {"id": "new_id"}, {"name": "name"}, ANY).message
    rows = {r["id"]: r["outcome"] for r in K.column_match_rows(a, b, {"id": "new_id"}, {"name": "name", "state": "state"}).collect()}
    assert rows == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    nulls = spark.createDataFrame([(1, None)], "id int, name string")
    assert K.column_match_rows(nulls, nulls, {"id": "id"}, {"name": "name"}).first()["outcome"] is True
    assert K.column_match(nulls, nulls, {"id": "id"}, {"name": "name"}, ANY).ratio == 0.0


def test_referential_integrity_and_counts(spark):
    p = spark.createDataFrame([("CA",), ("NY",), ("NY",), ("TX",)], "st string")
    r = spark.createDataFrame([("CA",), ("NY",), ("FL",)], "state string")
    assert K.subset_check(p, ["st"], r, ["state"], ANY).ratio == 0.75
    assert [x["outcome"] for x in K.subset_check_rows(p, ["st"], r, ["state"]).orderBy("st").collect()] == [True, True, True, False]
    assert isinstance(K.subset_check(p, ["nope"], r, ["state"], ANY), K.Failed)
    assert K.row_count_match(p, r, ANY).ratio == 4 / 3
    assert K.schema_match(p, r, ANY).ratio == 0.0 and K.schema_match(p, p, ANY).ratio == 1.0


def test_schema_validation(spark):
    df = spark.createDataFrame([("123", "Product A", "2012-07-22 22:59:59"), ("N/A", "Product B", None), ("456", None, "2012-07-22 22:59:59"), (None, "Product C", "2012-07-22 22:59:59")], "id string, name string, event_time string")
    schema = RowLevelSchema().with_int_column("id", is_nullable=False).with_string_column("name", max_length=10).with_timestamp_column("event_time", "yyyy-MM-dd HH:mm:ss", is_nullable=False)
    v = validate(df, schema)
    assert (v.num_valid_rows, v.num_invalid_rows) == (2, 2)
    assert dict(v.valid_rows.dtypes)["id"] == "int" and dict(v.invalid_rows.dtypes)["id"] == "string" and v.valid_rows.count() == 2
    names = spark.createDataFrame([("Hello",), ("H.",), ("Hello World",), ("Spark is great and very long",), (None,)], "name string")
    assert validate(names, RowLevelSchema().with_string_column("name", False, 3, 11)).num_valid_rows == 2
    numbers = spark.createDataFrame([("1",), ("-5",), (None,), ("1.25",), ("x",)], "n string")
    assert validate(numbers, RowLevelSchema().with_int_column("n", True, min_value=0)).num_valid_rows == 2
    assert validate(numbers, RowLevelSchema().with_decimal_column("n", 10, 2)).num_valid_rows == 4


def test_profiles(spark):
    df = spark.createDataFrame([("1", "a", 1.5, True), ("2", "b", None, False), ("3", "a", 2.5, None), (None, "a", 3.5, True)], "i string, s string, d double, b boolean")
    p = ColumnProfilerRunner.on_data(df).with_kll_profiling().run()
    i, s, d, b = (p.profiles[c] for c in "isdb")
    assert isinstance(i, NumericColumnProfile) and i.data_type == "Integral" and i.is_data_type_inferred and i.mean == 2.0 and i.completeness == 0.75
    assert isinstance(s, StringColumnProfile) and (s.min_length, s.max_length) == (1.0, 1.0) and s.histogram["a"].absolute == 3
    assert (d.minimum, d.maximum, d.sum, d.zeros_count) == (1.5, 3.5, 7.5, 0) and len(d.approx_percentiles) == 100
    assert b.data_type == "Boolean" and b.histogram["NullValue"].absolute == 1
    assert '"column": "i"' in p.to_json() and p.num_records == 4
    assert profile(df, ["i"], predefined_types={"i": "String"}).profiles["i"].data_type == "String"
    with pytest.raises(ValueError):
        profile(df, ["nope"])
    assert profile(df.limit(0)).num_records == 0


def test_suggestions(spark):
    r = random.Random(0)
    rows = [(i, r.choice(["x", "y's", "z"]), str(r.randint(0, 5)), None if i % 10 == 0 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, cat string, num string, part double")
    found = suggest(df, Rules.EXTENDED, test_ratio=0.3, seed=1)
    by = {(s.column, str(s.rule)) for s in found.all_suggestions()}
    assert {("id", "CompleteIfComplete()"), ("cat", "CategoricalRange()"), ("num", "RetainType()"), ("part", "RetainCompleteness()"), ("id", "UniqueIfApproximatelyUnique()"), ("id", "NonNegativeNumbers()"), ("cat", "HasMinLength()")} <= by
    assert found.verification is not None and '"constraint_result_on_test_set"' in found.evaluation_as_json()
    plain = {s.constraint.name: s for s in found.suggestions["cat"]}
    results = {c.constraint.name: c.status.value for c in next(iter(found.verification.check_results.values())).constraint_results}
    assert all(results[n] == "Success" for n in plain)
    # the code of a suggestion is code
    from dqengine.assertions import Is
    from dqengine.checks import Check, CheckLevel
    from dqengine.constraints import ConstrainableDataTypes

    for s in found.all_suggestions():
        made = eval("Check(CheckLevel.ERROR, 'made')" + s.code, {"Check": Check, "CheckLevel": CheckLevel, "Is": Is, "ConstrainableDataTypes": ConstrainableDataTypes})
        assert len(made.constraints) == 1
    run = ConstraintSuggestionRunner.on_data(df).add_constraint_rules(Rules.DEFAULT).restrict_to_columns(["id"]).run()
    assert set(run.suggestions) == {"id"}


def test_intervals():
    assert WaldInterval().calculate(0.5, 100).lower_bound == 0.40 and WaldInterval().calculate(1.0, 10).lower_bound == 1.0
    assert WilsonScoreInterval().calculate(0.5, 100).lower_bound == 0.40 and WilsonScoreInterval().calculate(1.0, 10).lower_bound == 0.72


def test_simple_strategies():
    series = [-1.0, 2.0, 3.0, 0.5]
    assert [i for i, _ in A.SimpleThresholdStrategy(1.0).detect(series)] == [1, 2]
    assert [i for i, _ in A.SimpleThresholdStrategy(1.0, 0.0).detect(series, (0, 2))] == [0, 1]
    change = [1.0 if not 20 <= i <= 30 else float(i if i % 2 else -i) for i in range(51)]
    assert [i for i, _ in A.AbsoluteChangeStrategy(-2.0, 2.0).detect(change)] == list(range(20, 32))
    assert [i for i, _ in A.AbsoluteChangeStrategy(None, 1.0, 2).detect([0.0, 1.0, 3.0, 6.0, 18.0, 72.0], (0, 6))] == [4, 5]
    assert [i for i, _ in A.RelativeRateOfChangeStrategy(0.5, 2.0).detect([1.0, 1.5, 4.0, 4.0, 1.0])] == [2, 4]
    with pytest.raises(ValueError):
        A.AbsoluteChangeStrategy()
    with pytest.raises(ValueError):
        A.SimpleThresholdStrategy(0.0, 1.0)


def spikes(seed=1):
    r = random.Random(seed)
    return [r.gauss(0, 1) + (0 if not 20 <= i <= 30 else (i if i % 2 else -i)) for i in range(51)]


def test_normal_strategies():
    series = spikes()
    assert [i for i, _ in A.BatchNormalStrategy(3.0, 3.0).detect(series, (20, 31))] == list(range(20, 31))
    assert set(range(20, 31)) <= {i for i, _ in A.OnlineNormalStrategy(3.5, 3.5, 0.2).detect(series)}
    assert [i for i, _ in A.BatchNormalStrategy(None, 1.0, True).detect([1.0, 1.0, 1.0, 1000.0], (0, 4))] == [3]
    with pytest.raises(ValueError):
        A.BatchNormalStrategy().detect([1.0, 2.0], (0, 2))


def test_holt_winters():
    r = random.Random(3)
    weeks = [x + r.gauss(0, 0.05) for _ in range(2) for x in (1, 1, 1.2, 1.3, 1.5, 2.1, 1.9)]
    s = A.HoltWinters()
    assert [i for i, _ in s.detect([*weeks, 1.0, 1.0], (14, 16))] == []
    assert [i for i, _ in s.detect([*weeks, 0.0], (14, 15))] == [14]
    with pytest.raises(ValueError, match="two full cycles"):
        s.detect(weeks, (3, 5))
    assert A.HoltWinters(A.MetricInterval.HOURLY, A.SeriesSeasonality.DAILY).period == 24


def test_detector():
    d = A.AnomalyDetector(A.SimpleThresholdStrategy(1.0))
    points = [A.DataPoint(3, 5.0), A.DataPoint(1, 0.0), A.DataPoint(2, None), A.DataPoint(4, 9.0)]
    assert [t for t, _ in d.detect_anomalies_in_history(points).anomalies] == [3, 4]
    assert [t for t, _ in d.detect_anomalies_in_history(points, (4, 9)).anomalies] == [4]
    assert d.is_new_point_anomalous(points[:2], A.DataPoint(4, 9.0)).anomalies
    with pytest.raises(ValueError):
        d.is_new_point_anomalous([], A.DataPoint(1, 1.0))
    with pytest.raises(ValueError):
        d.is_new_point_anomalous(points, A.DataPoint(4, 1.0))


def test_distances(spark):
    a, b = {"a": 10, "b": 20, "c": 25, "d": 10, "e": 5}, {"a": 11, "b": 20, "c": 25, "d": 10, "e": 10}
    assert D.categorical_distance(a, b, True) == pytest.approx(0.06015037593984962)
    assert D.categorical_distance(a, b) == 0.0
    assert D.categorical_distance({"a": 20, "b": 20}, {"a": 20, "b": 20}, method=D.ChisquareMethod()) == pytest.approx(1.0)
    assert D.categorical_distance({"a": 100, "b": 50}, {"a": 50, "b": 50}, True, D.ChisquareMethod()) == pytest.approx(2 * 25**2 / 75)
    assert math.isnan(D.categorical_distance({"a": 1}, {"a": 1}, method=D.ChisquareMethod()))
    for x, k, p in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.5, 4, 0.9735009788)):
        assert D.chi_square_tail(x, k) == pytest.approx(p, abs=1e-9)
    u = [BucketValue(0, 1, n) for n in (10, 20, 70)]
    v = [BucketValue(0, 1, n) for n in (20, 20, 60)]
    assert D.population_stability_index(u, v) == pytest.approx((0.1 - 0.2) * math.log(0.5) + (0.7 - 0.6) * math.log(7 / 6))
    k1 = O.KLLSketch("v", O.KLLParameters(2048, 0.64, 10)).calculate(spark.range(0, 100).selectExpr("cast(id as double) v")).get()
    k2 = O.KLLSketch("v", O.KLLParameters(2048, 0.64, 10)).calculate(spark.range(50, 150).selectExpr("cast(id as double) v")).get()
    assert D.numerical_distance(k1, k1, True) == 0.0
    assert D.numerical_distance(k1, k2, True) == pytest.approx(0.5, abs=0.02)


def test_streaming(spark, tmp_path):
    from dqengine.assertions import Is
    from dqengine.checks import Check, CheckLevel, CheckStatus
    from dqengine.streaming import IncrementalMetrics

    for n in range(3):
        spark.range(n * 10, n * 10 + 10).selectExpr("id", "cast(id as double) v").write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    inc = IncrementalMetrics([O.Mean("v"), O.Uniqueness("id")], [Check(CheckLevel.ERROR, "c").has_size(Is("==", 30))])
    q = inc.attach(stream, lambda n, c: seen.append(c[O.Size()].get()), checkpointLocation=f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == 30.0 and len(seen) > 1
    assert inc.last[1][O.Mean("v")].get() == 14.5 and inc.last[1][O.Uniqueness("id")].get() == 1.0
    assert inc.verification().status is CheckStatus.SUCCESS
    # a replayed batch counts once
    again = inc.process(spark.range(0).selectExpr("id", "cast(id as double) v"), inc.last[0] + 1)
    assert again[O.Size()].get() == 30.0


def test_empty_tables_compare(spark):
    e = X.empty(spark)
    assert K.column_match(e, e, {"column1": "column1"}, {"column2": "column2"}, ANY).ratio == 1.0
    assert K.subset_check(e, ["column1"], e, ["column1"], ANY).ratio == 1.0


def test_email_pattern_takes_quoted_names_and_addresses_in_brackets(spark):
    from dqengine.functions import patterns

    rows = [("someone@example.com", True), ('"john.doe"@example.com', True), ("john@[192.168.0.1]", True), ("someone@", False), ("example.com", False)]
    df = spark.createDataFrame(rows, "s string, good boolean")
    assert all(x.met == x.good for x in df.select("good", df.s.rlike(f"^(?:{patterns.EMAIL})$").alias("met")).collect())
