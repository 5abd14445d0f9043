import random

import pytest

from dqengine import operators as O
from dqengine.operators.states import State
from dqengine.plans.runner import run_analyzers, run_on_aggregated_states
from dqengine.sources.repository import FileMetricsRepository, InMemoryMetricsRepository, ResultKey, TableMetricsRepository
from dqengine.sources.state_store import FileStateStore, InMemoryStateStore
from tests import fixtures as X

EXACT = [O.Size(), O.Size("a > 3"), O.Completeness("b"), O.Compliance("c", "a > 2"), O.Minimum("a"), O.Maximum("a"), O.Mean("a"), O.Sum("a"), O.Range("a"), O.StandardDeviation("a"), O.Variance("a"), O.RatioOfSums("a", "b"), O.Correlation("a", "b"), O.ZerosCount("b"), O.MinLength("s"), O.MaxLength("s"), O.PatternMatch("s", "a"), O.Uniqueness("s"), O.Distinctness("s"), O.CountDistinct("s"), O.UniqueValueRatio(("s", "b")), O.Entropy("s"), O.MutualInformation(("s", "b")), O.DuplicateRowCount(("s",))]


def data(spark, seed, n=60):
    r = random.Random(seed)
    rows = [(r.randint(0, 9), r.choice([0, 1, 2, None]), "".join(r.choice("ab") for _ in range(r.randint(1, 3)))) for _ in range(n)]
    return spark.createDataFrame(rows, "a int, b int, s string")


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_states_equal_the_whole(spark, seed, tmp_path):
    parts = [data(spark, seed * 10 + i, n) for i, n in enumerate((40, 7, 25))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    stores = [InMemoryStateStore(), FileStateStore(spark, f"file://{tmp_path}/s", True), InMemoryStateStore()]
    for p, s in zip(parts, stores, strict=True):
        run_analyzers(p, EXACT, save_states_with=s)
    merged, direct = run_on_aggregated_states(whole, EXACT, stores), run_analyzers(whole, EXACT)
    for a in EXACT:
        assert merged[a].get() == pytest.approx(direct[a].get(), abs=1e-9), a


def test_higher_moments_of_merged_states(spark):
    a, b = data(spark, 1), data(spark, 2, 31)
    for analyzer in (O.Kurtosis("a"), O.Skewness("a")):
        s = InMemoryStateStore()
        run_analyzers(a, [analyzer], save_states_with=s)
        found = run_analyzers(b, [analyzer], aggregate_with=s)[analyzer].get()
        direct = analyzer.calculate(a.unionByName(b)).get()
        assert found == pytest.approx(direct, abs=1e-9)


def test_sketches_merge(spark):
    a, b = spark.range(0, 1000).selectExpr("cast(id as double) v"), spark.range(500, 1500).selectExpr("cast(id as double) v")
    wanted = [O.ApproxCountDistinct("v"), O.ApproxQuantile("v", 0.5), O.ApproxQuantiles("v", (0.25, 0.75)), O.KLLSketch("v", O.KLLParameters(2048, 0.64, 2))]
    s = InMemoryStateStore()
    run_analyzers(a, wanted, save_states_with=s)
    found = run_analyzers(b, wanted, aggregate_with=s)
    assert found[wanted[0]].get() == pytest.approx(1500, rel=0.05)
    assert found[wanted[1]].get() == pytest.approx(750, abs=30)
    assert found[wanted[2]].get()["0.25"] == pytest.approx(500, abs=30)
    assert sum(x.count for x in found[wanted[3]].get().buckets) == 2000


def test_growing_data_and_histogram(spark):
    h = O.Histogram("att2")
    s = InMemoryStateStore()
    run_analyzers(X.incomplete(spark), [h], save_states_with=s)
    delta = spark.createDataFrame([("7", "a", None), ("8", "b", "d")], "item string, att1 string, att2 string")
    d = run_analyzers(delta, [h], aggregate_with=s)[h].get()
    assert (d["NullValue"].absolute, d["d"].absolute, d["f"].absolute) == (3, 2, 3) and d["f"].ratio == 3 / 8


def test_iqr_has_no_mergeable_state(spark):
    s = InMemoryStateStore()
    a = O.InterquartileRange("att1")
    run_analyzers(X.numeric(spark), [a], save_states_with=s)
    assert not run_analyzers(X.numeric(spark), [a], aggregate_with=s)[a].ok


def test_state_round_trip(spark):
    s = InMemoryStateStore()
    wanted = [O.Mean("a"), O.Correlation("a", "b"), O.ApproxCountDistinct("a"), O.ApproxQuantiles("a", (0.5,)), O.KLLSketch("a"), O.DataType("s")]
    run_analyzers(data(spark, 3), wanted, save_states_with=s)
    for a in wanted:
        assert State.from_dict(s.load(a).to_dict()) == s.load(a)


def repositories(spark, tmp_path):
    return [InMemoryMetricsRepository(), FileMetricsRepository(spark, f"file://{tmp_path}/metrics.json"), TableMetricsRepository(spark, f"metrics_{abs(hash(str(tmp_path)))}")]


STORED = [O.Size(), O.Completeness("att2", "att1 = 'a'"), O.Uniqueness(("att1", "att2")), O.Histogram("att1"), O.ApproxQuantiles("n", (0.25, 0.5)), O.KLLSketch("n"), O.HistogramBinned("n", 2), O.Mean("nope")]


def test_repositories(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    df = X.incomplete(spark).selectExpr("*", "cast(item as double) n")
    for repo in repositories(spark, tmp_path):
        for date, tags in ((1, {"Region": "EU"}), (2, {"Region": "NA", "data version": "1"})):
            run_analyzers(df, STORED, repository=repo, save_key=ResultKey(date, tags))
        loaded = repo.load_by_key(ResultKey(1, {"Region": "EU"}))
        assert loaded[O.Size()].value == 6.0 and O.Mean("nope") not in loaded.metrics
        assert loaded[O.Histogram("att1")].value["a"].absolute == 4
        assert loaded[O.KLLSketch("n")].value.buckets[0].low == 1.0
        assert repo.load_by_key(ResultKey(9)) is None
        assert [r.key.dataset_date for r in repo.load().with_tag_values({"Region": "NA"}).get()] == [2]
        bounded = [r.key.dataset_date for r in repo.load().after(1).get()]
        assert bounded == ([2] if isinstance(repo, TableMetricsRepository) else [1, 2])
        frame = repo.load().for_analyzers([O.Size()]).get_success_metrics_as_dataframe(spark)
        assert {"dataset_date", "region", "dataversion"} <= set(frame.columns) and frame.count() == 2
        # what is stored isn't computed again
        again = run_analyzers(X.numeric(spark), [O.Size()], repository=repo, reuse_key=ResultKey(1, {"Region": "EU"}), fail_if_missing=True)
        assert again[O.Size()].value == 6.0
        with pytest.raises(RuntimeError):
            run_analyzers(df, [O.Distinctness("att1")], repository=repo, reuse_key=ResultKey(1, {"Region": "EU"}), fail_if_missing=True)
