import math

import pytest

from dqengine import errors
from dqengine import operators as O
from dqengine.operators.base import AnalyzerOptions, NullBehavior
from dqengine.operators.scan import Patterns
from dqengine.plans.runner import Analysis, AnalysisRunner, run_analyzers
from tests import fixtures as X

GOLDEN = [
    (O.Mean("att1"), 3.5), (O.StandardDeviation("att1"), 1.707825127659933), (O.Variance("att1"), 2.9166666666666665), (O.Skewness("att1"), 0.0), (O.Kurtosis("att1"), -1.2685714285714285),
    (O.Minimum("att1"), 1.0), (O.Maximum("att1"), 6.0), (O.Range("att1"), 5.0), (O.InterquartileRange("att1"), 2.5), (O.Sum("att1"), 21.0), (O.RatioOfSums("att1", "att2"), 21 / 18), (O.ZerosCount("att2"), 3.0),
    (O.Size(), 6.0), (O.Size("att1 > 3"), 3.0), (O.Completeness("attNull"), 0.5), (O.Completeness("attNull", "att1 > 3"), 1.0), (O.ExactQuantile("att1", 0.5), 3.5), (O.ApproxQuantile("att1", 0.5), 3.0),
    (O.ApproxCountDistinct("att1"), 6.0), (O.Correlation("att1", "att1"), 1.0), (O.Compliance("rule", "att1 > 2"), 4 / 6), (O.Compliance("rule", "attNull > 5"), 2 / 6), (O.Mean("att1", "att2 = 0"), 2.0),
]


def test_scan_golden_values_in_one_run(spark):
    found = run_analyzers(X.numeric(spark), [a for a, _ in GOLDEN])
    for a, v in GOLDEN:
        assert found[a].get() == pytest.approx(v, abs=1e-12), a


def test_frequency_golden_values(spark):
    df = X.unique(spark)
    cases = {O.Uniqueness("uniq"): 1.0, O.Uniqueness("uniqueWithNulls"): 1.0, O.Uniqueness(("uniq", "nonUnique")): 1.0, O.Uniqueness("halfUnique"): 0.5, O.Uniqueness("nonUnique"): 0.5, O.UniqueValueRatio("nonUnique"): 0.75, O.CountDistinct("nonUnique"): 4.0, O.DuplicateRowCount(("nonUnique",)): 3.0, O.DuplicateRowCount(): 0.0}
    found = run_analyzers(df, list(cases))
    assert {a: found[a].get() for a in cases} == cases
    d = run_analyzers(X.distinct(spark), [O.Distinctness("att1"), O.Distinctness(("att1", "att2"))])
    assert d[O.Distinctness("att1")].get() == 3 / 5
    assert d[O.Distinctness(("att1", "att2"))].get() == 4 / 6
    e = run_analyzers(X.full(spark), [O.Entropy("att1"), O.MutualInformation(("att1", "att2")), O.Uniqueness("att1")])
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert e[O.Entropy("att1")].get() == pytest.approx(h)
    assert e[O.MutualInformation(("att1", "att2"))].get() == pytest.approx(h)
    assert e[O.Uniqueness("att1")].get() == 0.25


def test_frequency_where_and_partial_nulls(spark):
    df = X.distinct(spark)
    assert O.Uniqueness("att1", "att2 = 'x'").calculate(df).get() == 0.0
    assert O.CountDistinct("att2").calculate(df).get() == 2.0


def test_lengths_and_null_behaviour(spark):
    df = X.lengths(spark)
    cases = {O.MinLength("item"): 1.0, O.MaxLength("item"): 6.0, O.MinLength("att2", options=AnalyzerOptions(NullBehavior.EMPTY_STRING)): 0.0, O.MinLength("att2"): 1.0}
    found = run_analyzers(df, list(cases))
    assert {a: found[a].get() for a in cases} == cases
    assert O.MaxLength("att2", options=AnalyzerOptions(NullBehavior.FAIL)).calculate(df).get() > 1e300
    assert O.MinLength("att2", options=AnalyzerOptions(NullBehavior.FAIL)).calculate(df).get() < -1e300


def test_nulls_give_empty_states(spark):
    df = X.all_null(spark)
    for a in (O.Mean("n1"), O.Minimum("n1"), O.Sum("n1"), O.StandardDeviation("n1"), O.Skewness("n1"), O.Range("n1"), O.InterquartileRange("n1"), O.ApproxQuantile("n1", 0.5), O.Entropy("s"), O.Uniqueness("s"), O.MinLength("s"), O.Correlation("n1", "n2"), O.KLLSketch("n1"), O.MutualInformation(("s", "n1"))):
        m = a.calculate(df)
        assert isinstance(m.error, errors.EmptyStateError), a
        assert "all input values were NULL" in str(m.error)
    assert O.CountDistinct("s").calculate(df).get() == 0.0
    assert O.ApproxCountDistinct("s").calculate(df).get() == 0.0
    assert O.Completeness("s").calculate(df).get() == 0.0
    assert O.DuplicateRowCount(("s",)).calculate(df).get() == 0.0


def test_empty_table(spark):
    df = X.empty(spark)
    assert O.Size().calculate(df).get() == 0.0
    assert not O.Completeness("column1").calculate(df).ok
    assert not O.Mean("column2").calculate(df).ok
    assert O.Histogram("column1").calculate(df).get().number_of_bins == 0
    assert not O.HistogramBinned("column2", 3).calculate(df).ok


def test_preconditions(spark):
    df = X.numeric(spark)
    assert isinstance(O.Mean("nope").calculate(df).error, errors.NoSuchColumnError)
    assert isinstance(O.Mean("item").calculate(df).error, errors.WrongColumnTypeError)
    assert isinstance(O.MinLength("att1").calculate(df).error, errors.WrongColumnTypeError)
    assert isinstance(O.Uniqueness(()).calculate(df).error, errors.NoColumnsSpecifiedError)
    assert isinstance(O.MutualInformation(("att1",)).calculate(df).error, errors.NumberOfSpecifiedColumnsError)
    assert isinstance(O.ApproxQuantile("att1", 1.5).calculate(df).error, errors.IllegalAnalyzerParameterError)
    assert isinstance(O.KLLSketch("att1", O.KLLParameters(2048, 0.64, 101)).calculate(df).error, errors.IllegalAnalyzerParameterError)
    nested = spark.createDataFrame([((1,), [1])], "s struct<a:int>, l array<int>")
    assert isinstance(O.Completeness("s").calculate(nested).error, errors.WrongColumnTypeError)
    assert isinstance(O.Uniqueness("l").calculate(nested).error, errors.WrongColumnTypeError)


def test_one_bad_expression_fails_alone(spark):
    bad = O.Compliance("bad", "no_such_column > 1")
    found = run_analyzers(X.numeric(spark), [O.Size(), bad, O.Mean("att1")])
    assert found[O.Size()].get() == 6 and found[O.Mean("att1")].get() == 3.5
    assert isinstance(found[bad].error, errors.MetricCalculationError)


def test_runtime_error_fails_alone(spark):
    bad = O.Compliance("bad", "cast(item as int) / 0 > 1")
    text = O.Compliance("text", "cast('x' as int) > 1")
    found = run_analyzers(X.numeric(spark), [O.Size(), text, bad])
    assert found[O.Size()].get() == 6
    assert not found[text].ok


def test_duplicate_analyzers_are_rejected(spark):
    with pytest.raises(ValueError, match="Duplicate analyzers"):
        run_analyzers(X.numeric(spark), [O.Size(), O.Size()])


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a.b` int, `with space` string")
    assert O.Mean("a.b").calculate(df).get() == 1.5
    assert O.Completeness("with space").calculate(df).get() == 0.5
    assert O.Uniqueness(("a.b",)).calculate(df).get() == 1.0
    assert O.Mean("A.B").calculate(df).get() == 1.5


def jobs(spark, run):
    group = f"counted-{id(run)}-{run.__code__.co_firstlineno}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return n


def test_scans_share_one_pass(spark):
    df = X.numeric(spark).repartition(2).persist()
    df.count()
    a = [O.Minimum("att1"), O.Maximum("att1"), O.Mean("att1"), O.Sum("att1"), O.StandardDeviation("att1"), O.Completeness("att1"), O.Size()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert jobs(spark, lambda: run_analyzers(df, a)) == 1
        assert jobs(spark, lambda: run_analyzers(df, [O.Uniqueness("att1"), O.Entropy("att1")])) == 1
        assert jobs(spark, lambda: run_analyzers(df, [O.Uniqueness("att1"), O.Uniqueness("att2")])) == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_data_type_histogram(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("-3",), ("true",), ("x",), (None,), ("1e5",), ("1.",)], "v string")
    d = O.DataType("v").calculate(df).get()
    assert {k: v.absolute for k, v in d.values.items()} == {"Unknown": 1, "Fractional": 2, "Integral": 2, "Boolean": 1, "String": 2}


def test_histograms(spark):
    df = X.incomplete(spark)
    d = O.Histogram("att2").calculate(df).get()
    assert d["f"].absolute == 3 and d["NullValue"].absolute == 2 and d.number_of_bins == 3 and d["f"].ratio == 0.5
    top = O.Histogram("att2", max_detail_bins=1).calculate(df).get()
    assert list(top.values) == ["f"] and top.tail_count == 3 and top.number_of_bins == 3
    assert O.Histogram("att2", where="att1 = 'b'").calculate(df).get()["d"].ratio == 1 / 6  # of all rows
    values = spark.createDataFrame([(i,) for i in [*range(1, 11), 15, 20, 25, 30, None]], "v int")
    b = O.HistogramBinned("v", 5).calculate(values).get()
    assert [x.frequency for x in b.bins][:3] == [6, 4, 1] and b.null_count == 1 and [round(x.bin_start, 6) for x in b.bins] == [1, 6.8, 12.6, 18.4, 24.2]
    c = O.HistogramBinned("v", edges=(5, 10, 30), overflow_bins=True).calculate(values).get()
    assert [x.frequency for x in c.bins] == [4, 5, 5, 0]
    constant = spark.createDataFrame([(2,), (2,)], "v int")
    assert [x.frequency for x in O.HistogramBinned("v", 4).calculate(constant).get().bins] == [2]


def test_kll_buckets_are_exact_for_few_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 31)], "v double")
    d = O.KLLSketch("v", O.KLLParameters(2048, 0.64, 2)).calculate(df).get()
    assert [(b.low, b.high, b.count) for b in d.buckets] == [(1.0, 15.5, 15), (15.5, 30.0, 15)]


def test_patterns(spark):
    def ratio(pattern, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return O.PatternMatch("v", pattern).calculate(df).get()

    assert ratio(Patterns.EMAIL, "someone@somewhere.org", "someone@else.com") == 1.0
    assert ratio(Patterns.EMAIL, "someone@somewhere.org", "someone@else") == 0.5
    assert ratio(Patterns.URL, "http://foo.com/blah_blah", "ftp://foo.bar/baz", "http://", "//a") == 0.5
    assert ratio(Patterns.SOCIAL_SECURITY_NUMBER_US, "111-05-1130", "111051130", "000-05-1130", "111-00-1000", "999-05-1130", "078-05-1120") == pytest.approx(2 / 6)
    assert ratio(Patterns.CREDITCARD, "378282246310005", "6011111111111117", "6011 1111 1111 1117", "4111111111111111", "0000111122223333") == 0.8
    assert ratio("^$", "", "") == 0.0  # an empty match is none
    assert ratio("a", "ba", None) == 0.5


def test_special(spark):
    df = X.numeric(spark)
    df.createOrReplaceTempView("numbers")
    found = run_analyzers(df, [O.ColumnCount(), O.ColumnExists("att1"), O.ColumnExists("ATT1"), O.CustomSql("select sum(att1) from numbers"), O.CustomSql("select att1 from numbers"), O.CustomSql("select")])
    assert [m.value for m in found.all_metrics()[:4]] == [5.0, 1.0, 0.0, 21.0]
    assert not found.all_metrics()[4].ok and not found.all_metrics()[5].ok
    share = O.CustomAggregator(lambda d: O.AggregatedState({"a": 1, "b": 3}, 4), "mine")
    assert [(m.name, m.value) for m in share.calculate(df).flatten()] == [("mine.a", 0.25), ("mine.b", 0.75)]


def test_analysis(spark):
    assert Analysis().add_analyzer(O.Size()).add_analyzers([O.Mean("att1")]).run(X.numeric(spark))[O.Mean("att1")].get() == 3.5


def test_context_frames(spark):
    context = AnalysisRunner.on_data(X.numeric(spark)).add_analyzer(O.Size("att1 > 3")).add_analyzer(O.ApproxQuantiles("att1", (0.1, 0.9))).add_analyzer(O.Mean("nope")).run()
    rows = context.success_metrics_as_dataframe(spark).collect()
    assert ("Dataset", "*", "Size (where: att1 > 3)", 3.0) in [tuple(r) for r in rows]
    assert {r["name"] for r in rows} == {"Size (where: att1 > 3)", "ApproxQuantiles-0.1", "ApproxQuantiles-0.9"}
    assert '"value": 3.0' in context.success_metrics_as_json()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_ansi_on_and_off(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(1, 1.0), (2, 1.0)], "a int, c double")
        found = run_analyzers(df, [O.Correlation("a", "c"), O.Skewness("c"), O.Kurtosis("c"), O.RatioOfSums("a", "c")])
        values = [m.get() for m in found.all_metrics()]
        assert math.isnan(values[0]) and values[1:3] == [0.0, 0.0] and values[3] == 1.5
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
