import pytest

from dqengine import constraints as C
from dqengine import operators as O
from dqengine.assertions import Is
from dqengine.checks import Check, CheckLevel, CheckStatus
from dqengine.constraints import ConstrainableDataTypes as T
from dqengine.operators.base import AnalyzerOptions, FilteredRow, NullBehavior
from dqengine.verification import AnomalyCheckConfig, VerificationSuite, verify
from tests import fixtures as X


def check(level=CheckLevel.ERROR):
    return Check(level, "check")


def status(df, *checks):
    return verify(df, checks).status


def test_every_method_that_holds(spark):
    n, f, i, u = X.numeric(spark), X.full(spark), X.incomplete(spark), X.unique(spark)
    ok = [
        (n, check().has_size(Is("==", 6)).has_column_count(lambda v: v == 5).has_column("att1").has_zeros_count("att2", Is("==", 3)).has_min("att1", Is("==", 1.0)).has_max("att1", Is("==", 6.0)).has_range("att1", Is("==", 5.0)).has_mean("att1", Is("==", 3.5)).has_sum("att1", Is("==", 21.0))),
        (n, check().has_standard_deviation("att1", Is("within", (1.7, 1.71))).has_variance("att1", Is("<", 3)).has_skewness("att1", Is("==", 0.0)).has_kurtosis("att1", Is("<", -1.2)).has_interquartile_range("att1", Is("==", 2.5)).has_approx_quantile("att1", 0.5, Is("==", 3.0)).has_exact_quantile("att1", 0.5, Is("==", 3.5)).has_correlation("att1", "att2", Is(">", 0.8)).has_approx_count_distinct("att1", Is("==", 6.0)).has_ratio_of_sums("att1", "att2", Is(">", 1))),
        (n, check().is_non_negative("att1").is_positive("att1").is_less_than("att2", "att1", Is(">=", 0.5)).is_greater_than_or_equal_to("att2", "att3").is_less_than_or_equal_to("att3", "att2").is_greater_than("att1", "att3", Is(">=", 0.5)).is_contained_in_range("att1", 0, 6).is_contained_in("att1", 0, 7, False, False).is_contained_in("att1", list(range(1, 7)), Is(">=", 0.9), "hint").is_non_negative("attNull")),
        (f, check().is_complete("att1").are_complete(["att1", "att2"]).are_any_complete(["att1", "att2"]).has_entropy("att1", Is(">", 0.5)).has_mutual_information("att1", "att2", Is(">", 0.5)).has_distinctness("att1", Is("==", 0.5)).has_number_of_distinct_values("att1", Is("==", 2)).has_histogram_values("att1", lambda d: d["a"].absolute == 3)),
        (i, check().has_completeness("att2", Is(">", 0.6)).have_completeness(["att1", "att2"], Is(">", 0.6)).have_any_completeness(["att1", "att2"], Is("==", 1.0)).is_contained_in("att2", ["f", "d"]).has_pattern("att1", "^[ab]$").satisfies("att1 in ('a', 'b')", "rule").has_min_length("att1", Is("==", 1.0)).has_max_length("att1", Is("==", 1.0)).has_data_type("item", T.INTEGRAL).has_data_type("att2", T.NULL, Is("<", 0.4)).has_data_type("item", T.NUMERIC)),
        (u, check().is_unique("uniq").are_unique(["uniq", "nonUnique"]).is_primary_key("uniq").has_uniqueness("halfUnique", Is("==", 0.5)).has_unique_value_ratio("nonUnique", Is("==", 0.75)).has_duplicate_row_count(["nonUnique"], Is("==", 3))),
        (n, check().kll_sketch_satisfies("att1", lambda d: sum(b.count for b in d.buckets) == 6).has_histogram_binned_values("att1", lambda d: sum(b.frequency for b in d.bins) == 6).has_histogram_binned_bins("att1", Is("==", 3), 3).does_dataset_match(n, {"item": "item"}, Is("==", 1.0), {"att1": "att1"})),
    ]
    for df, c in ok:
        result = verify(df, [c])
        assert result.status is CheckStatus.SUCCESS, result.failed_constraints()


def test_camel_case_names_work(spark):
    c = check().isComplete("att1").hasSize(Is("==", 4)).areComplete(["att1"]).containsURL("att1", Is("==", 0.0))
    assert VerificationSuite.on_data(X.full(spark)).addCheck(c).run().status is CheckStatus.SUCCESS


def test_statuses_and_messages(spark):
    df = X.incomplete(spark)
    result = verify(df, [check(CheckLevel.WARNING).is_complete("att2", hint="look!"), check().has_size(Is("==", 6))])
    assert result.status is CheckStatus.WARNING
    assert result.rows()[0] == ("check", "Warning", "Warning", "CompletenessConstraint(Completeness(att2,None,None))", "Failure", "Value: 0.6666666666666666 does not meet the constraint requirement! look!")
    assert verify(df, [check().is_complete("att2"), check(CheckLevel.WARNING).is_complete("att2")]).status is CheckStatus.ERROR
    broken = verify(df, [check().has_size(lambda v: 1 / 0 > v).has_min("att1", Is(">", 0))]).rows()
    assert broken[0][5].startswith("Can't execute the assertion") and "numeric" not in broken[0][5] and "Expected type" in broken[1][5]
    frame = result.check_results_as_dataframe(spark)
    assert frame.columns == ["check", "check_level", "check_status", "constraint", "constraint_status", "constraint_message"]


def test_missing_analysis():
    c = C.of(O.Size(), Is("==", 1))
    assert c.evaluate({}).message == "Missing Analysis, can't run the constraint!"


def test_where_applies_to_the_last_constraint(spark):
    df = X.incomplete(spark)
    c = check().is_complete("att1").is_complete("att2").where("att1 = 'a' and item < 3")
    assert status(df, c) is CheckStatus.SUCCESS
    with pytest.raises(ValueError):
        check().has_column("x").where("a = 1")


def test_a_condition_that_leaves_no_rows_holds(spark):
    df = X.numeric(spark)
    nothing = check().has_min("att1", Is(">", 100)).where("att1 > 1000").is_complete("attNull").where("att1 > 1000")
    assert status(df, nothing) is CheckStatus.SUCCESS
    assert status(X.all_null(spark), check().has_min("n1", Is(">", 0))) is CheckStatus.ERROR


def test_row_level_results(spark):
    df = X.lengths(spark)
    checks = [
        Check(CheckLevel.ERROR, "complete").is_complete("att2"),
        Check(CheckLevel.ERROR, "lengths").has_max_length("item", Is("<=", 3.0)),
        Check(CheckLevel.ERROR, "ranges").has_min("val1", Is(">=", 2.0)).has_max("val1", Is("<=", 5.0)),
        Check(CheckLevel.ERROR, "unique").is_unique("att1"),
        Check(CheckLevel.ERROR, "nulls").has_min_length("att2", Is(">=", 1.0), analyzer_options=AnalyzerOptions(NullBehavior.FAIL)),
        Check(CheckLevel.ERROR, "ignored").has_min_length("att2", Is(">=", 1.0)),
        Check(CheckLevel.ERROR, "filtered").is_complete("att2").where("val1 < 3"),
        Check(CheckLevel.ERROR, "filtered_null").is_complete("att2", analyzer_options=AnalyzerOptions(filtered_row=FilteredRow.NULL)).where("val1 < 4"),
        Check(CheckLevel.ERROR, "lambda").has_max("val1", lambda v: v < 3),
        Check(CheckLevel.ERROR, "size only").has_size(Is("==", 6)),
    ]
    out = verify(df, checks).row_level_results_as_dataframe(df).orderBy("val1").collect()
    column = lambda n: [r[n] for r in out]
    assert column("complete") == [True, True, False, True, False, True]
    assert column("lengths") == [True, True, True, False, False, False]
    assert column("ranges") == [False, True, True, True, True, False]
    assert column("unique") == [False] * 6
    assert column("nulls") == [True, True, False, True, False, True]
    assert column("ignored") == [True, True, None, True, None, True]
    assert column("filtered") == [True, True, True, True, True, True]
    assert column("filtered_null") == [True, True, False, None, None, None]
    assert column("lambda") == [True, True, False, False, False, False]
    assert "size only" not in out[0].asDict()


def test_anomaly_check(spark):
    from dqengine.anomaly import AbsoluteChangeStrategy
    from dqengine.sources.repository import InMemoryMetricsRepository, ResultKey

    repo = InMemoryMetricsRepository()
    run = lambda df, date: VerificationSuite.on_data(df).use_repository(repo).add_anomaly_check(AbsoluteChangeStrategy(-2.0, 2.0), O.Size(), AnomalyCheckConfig(CheckLevel.ERROR, "size")).save_or_append_result(ResultKey(date)).run()
    base = X.numeric(spark)
    assert run(base, 1).status is CheckStatus.ERROR  # no history
    assert run(base.limit(5), 2).status is CheckStatus.SUCCESS
    assert run(base.unionByName(base), 3).status is CheckStatus.ERROR


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/out.json"
    run = VerificationSuite.on_data(X.full(spark)).add_check(check().is_complete("att1")).save_check_results_json_to_path(path)
    run.run()
    assert "CompletenessConstraint" in (tmp_path / "out.json").read_text()
    with pytest.raises(FileExistsError):
        run.run()


def test_applicability(spark):
    df = X.numeric(spark)
    good = VerificationSuite.is_check_applicable_to_data(check().is_complete("att1").has_mean("att1", Is(">", 0)).is_unique("item"), df)
    bad = VerificationSuite.is_check_applicable_to_data(check().is_complete("nope").has_mean("item", Is(">", 0)), df)
    assert good.is_applicable and not bad.is_applicable and len(bad.failures) == 2
    assert not VerificationSuite.are_analyzers_applicable_to_data([O.Mean("item"), O.Size()], df).is_applicable
