"""The registered queries of the engine, and DuckDB SQL for the same results.

Each query computes over whole tables. A metric query returns (metric, value),
one row for each metric, numbers rounded on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine import comparison, schema_validation
from dqengine import operators as O
from dqengine.assertions import Is
from dqengine.checks import Check, CheckLevel
from dqengine.operators.base import Analyzer
from dqengine.operators.scan import Patterns
from dqengine.plans.runner import run_analyzers, run_on_aggregated_states
from dqengine.rules import EvaluateDataQuality
from dqengine.sources.state_store import InMemoryStateStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def result(spark: SparkSession, rows: list[tuple[str, float, int]]) -> DataFrame:
    return spark.createDataFrame([(m, None if v is None else round(float(v), d) + 0.0) for m, v, d in rows], "metric string, value double")


# Metrics with their SQL: label, analyzer, SQL of one number over the table, decimals.
Spec = tuple[str, Analyzer, str, int]


def metric_query(key: str, name: str, specs: list[Spec], view: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Registers a query that computes all the analyzers in one run. view: SQL that stands for the table, with what prepare does."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        df = prepare(df) if prepare else df
        context = run_analyzers(df, list(dict.fromkeys(a for _, a, _, _ in specs)))
        return result(spark, [(label, context[a].get(), d) for label, a, _, d in specs])

    QUERIES[key] = run
    source = f"({view}) AS t" if view else name
    ORACLES[key] = "\nUNION ALL\n".join(f"SELECT '{label}' AS metric, CAST(ROUND(CAST(({sql}) AS DOUBLE), {d}) AS DOUBLE) AS value FROM {source}" if not sql.lstrip().upper().startswith("WITH ") else f"SELECT '{label}' AS metric, CAST(ROUND(CAST(({sql}) AS DOUBLE), {d}) AS DOUBLE) AS value" for label, _, sql, d in specs)


def share(condition: str, where: str = "TRUE") -> str:
    return f"SUM(CASE WHEN ({where}) AND ({condition}) THEN 1 ELSE 0 END) / CAST(SUM(CASE WHEN {where} THEN 1 ELSE 0 END) AS DOUBLE)"


N_ORDERS = "SELECT *, NULLIF(o_orderstatus, 'F') AS status FROM orders"


def _orders(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.expr("nullif(o_orderstatus, 'F')"))


metric_query("size", "lineitem", [("size", O.Size(), "COUNT(*)", 0), ("size_where", O.Size("l_quantity > 25"), "COUNT(*) FILTER (WHERE l_quantity > 25)", 0)])
metric_query(
    "completeness", "orders",
    [("complete", O.Completeness("status"), share("status IS NOT NULL"), 6), ("complete_where", O.Completeness("status", "o_totalprice > 100000"), share("status IS NOT NULL", "o_totalprice > 100000"), 6)],
    N_ORDERS, _orders,
)
metric_query(
    "compliance", "lineitem",
    [
        ("predicate", O.Compliance("cheap", "l_extendedprice < 20000 AND l_discount <= 0.05"), share("l_extendedprice < 20000 AND l_discount <= 0.05"), 6),
        ("where", O.Compliance("cheap", "l_discount <= 0.05", "l_returnflag = 'A'"), share("l_discount <= 0.05", "l_returnflag = 'A'"), 6),
    ],
)
metric_query(
    "pattern_match", "pages",
    [("url", O.PatternMatch("url", Patterns.URL), share(r"regexp_matches(url, '(?:https?|ftp)://[^\s/$.?#].\S*')"), 6), ("digits", O.PatternMatch("url", r"\d{3}"), share(r"regexp_matches(url, '\d{3}')"), 6)],
)
metric_query(
    "pattern_email", "documents",
    [("email", O.PatternMatch("text", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+"), share(r"regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\.[a-z]+')"), 6), ("where", O.PatternMatch("text", r"\d{4}", "lang = 'en'"), share(r"regexp_matches(text, '[0-9]{4}')", "lang = 'en'"), 6)],
)
Q = "l_extendedprice"
metric_query(
    "numeric_statistics", "lineitem",
    [
        ("min", O.Minimum(Q), f"MIN({Q})", 2), ("max", O.Maximum(Q), f"MAX({Q})", 2), ("mean", O.Mean(Q), f"AVG({Q})", 4), ("sum", O.Sum("l_quantity"), "SUM(l_quantity)", 0), ("range", O.Range(Q), f"MAX({Q}) - MIN({Q})", 2),
        ("stddev", O.StandardDeviation(Q), f"STDDEV_POP({Q})", 4), ("variance", O.Variance("l_quantity"), "VAR_POP(l_quantity)", 6), ("min_where", O.Minimum(Q, "l_returnflag = 'R'"), f"MIN({Q}) FILTER (WHERE l_returnflag = 'R')", 2),
        ("zeros", O.ZerosCount("l_discount"), "SUM(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)", 0), ("ratio_of_sums", O.RatioOfSums("l_discount", "l_tax"), "SUM(l_discount) / SUM(l_tax)", 6),
        ("correlation", O.Correlation("l_quantity", Q), f"CORR(l_quantity, {Q})", 6),
    ],
)
metric_query("higher_moments", "lineitem", [
    ("skewness", O.Skewness(Q), f"WITH a AS (SELECT AVG({Q}) AS m FROM lineitem), d AS (SELECT {Q} - m AS x FROM lineitem, a) SELECT AVG(x * x * x) / POWER(AVG(x * x), 1.5) FROM d", 6),
    ("kurtosis", O.Kurtosis(Q), f"WITH a AS (SELECT AVG({Q}) AS m FROM lineitem), d AS (SELECT {Q} - m AS x FROM lineitem, a) SELECT AVG(x * x * x * x) / POWER(AVG(x * x), 2) - 3 FROM d", 6),
])
metric_query("quantiles_exact", "orders", [
    ("median", O.ExactQuantile("o_totalprice", 0.5), "QUANTILE_CONT(o_totalprice, 0.5)", 4), ("p90_where", O.ExactQuantile("o_totalprice", 0.9, "o_orderstatus = 'O'"), "QUANTILE_CONT(o_totalprice, 0.9) FILTER (WHERE o_orderstatus = 'O')", 4),
    ("iqr", O.InterquartileRange("o_totalprice"), "QUANTILE_CONT(o_totalprice, 0.75) - QUANTILE_CONT(o_totalprice, 0.25)", 4),
])
metric_query("lengths", "documents", [("min", O.MinLength("text"), "MIN(LENGTH(text))", 0), ("max", O.MaxLength("text"), "MAX(LENGTH(text))", 0), ("max_where", O.MaxLength("text", "lang = 'de'"), "MAX(LENGTH(text)) FILTER (WHERE lang = 'de')", 0)])


def groups(columns: str, of: str = "lineitem", where: str = "TRUE") -> str:
    return f"WITH g AS (SELECT COUNT(*) AS c FROM {of} WHERE {where} GROUP BY {columns})"


KEY = "l_orderkey, l_linenumber"
metric_query("uniqueness", "lineitem", [
    ("uniqueness", O.Uniqueness(("l_orderkey", "l_linenumber")), groups(KEY) + " SELECT SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) / CAST(SUM(c) AS DOUBLE) FROM g", 6),
    ("distinctness", O.Distinctness(("l_orderkey", "l_linenumber")), groups(KEY) + " SELECT COUNT(*) / CAST(SUM(c) AS DOUBLE) FROM g", 6),
    ("unique_value_ratio", O.UniqueValueRatio(("l_orderkey", "l_linenumber")), groups(KEY) + " SELECT SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) FROM g", 6),
    ("count_distinct", O.CountDistinct(("l_partkey",)), groups("l_partkey") + " SELECT COUNT(*) FROM g", 0),
    ("duplicate_rows", O.DuplicateRowCount(("l_orderkey", "l_linenumber")), groups(KEY) + " SELECT SUM(CASE WHEN c > 1 THEN c ELSE 0 END) FROM g", 0),
    ("where", O.Uniqueness(("l_partkey",), "l_quantity < 5"), groups("l_partkey", where="l_quantity < 5") + " SELECT SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) / CAST(SUM(c) AS DOUBLE) FROM g", 6),
])
metric_query("entropy", "lineitem", [
    ("entropy", O.Entropy(("l_returnflag",)), groups("l_returnflag") + ", n AS (SELECT SUM(c) AS n FROM g) SELECT -SUM(c / n * LN(c / n)) FROM g, n", 6),
    ("mutual_information", O.MutualInformation(("l_returnflag", "l_linestatus")), "WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(COUNT(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2), x AS (SELECT a, SUM(c) AS x FROM j GROUP BY a), y AS (SELECT b, SUM(c) AS y FROM j GROUP BY b), n AS (SELECT SUM(c) AS n FROM j) SELECT SUM(c / n * LN(c * n / (x * y))) FROM j JOIN x USING (a) JOIN y USING (b), n", 6),
])
metric_query("duplicate_rows_all_columns", "nation", [("duplicates", O.DuplicateRowCount(), "COUNT(*) - COUNT(*)", 0), ("columns", O.ColumnCount(), "MAX(3)", 0), ("exists", O.ColumnExists("n_name"), "MAX(1)", 0), ("lacks", O.ColumnExists("n_none"), "MAX(0)", 0)])


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def registered(f: Query) -> Query:
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return registered


TEXT_TYPE = "CASE WHEN v IS NULL THEN 'Unknown' WHEN regexp_full_match(v, '[-+]? ?[0-9]+(\\.[0-9]+|(\\.[0-9]+)?[Ee][-+]?[0-9]+)') THEN 'Fractional' WHEN regexp_full_match(v, '[-+]? ?[0-9]+') THEN 'Integral' WHEN v IN ('true', 'false') THEN 'Boolean' ELSE 'String' END"


@query("data_type_histogram", f"WITH t AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 5 = 2 THEN CAST(o_orderkey AS VARCHAR) || '.5' WHEN o_orderkey % 5 = 3 THEN 'true' ELSE o_orderstatus END AS v FROM orders), k AS (SELECT {TEXT_TYPE} AS kind FROM t) SELECT kind, CAST(COUNT(*) AS BIGINT) AS n FROM k GROUP BY kind")
def data_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey AS STRING) WHEN o_orderkey % 5 = 2 THEN CONCAT(CAST(o_orderkey AS STRING), '.5') WHEN o_orderkey % 5 = 3 THEN 'true' ELSE o_orderstatus END"
    df = table(spark, sf_dir, "orders").select(F.expr(v).alias("v"))
    d = run_analyzers(df, [O.DataType("v")])[O.DataType("v")].get()
    return spark.createDataFrame([(k, x.absolute) for k, x in d.values.items() if x.absolute], "kind string, n long")


@query("approx_count_distinct")
def approx_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [O.ApproxCountDistinct(c) for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    found = run_analyzers(table(spark, sf_dir, "lineitem"), a)
    return result(spark, [(x.column, found[x].get(), 0) for x in a])


@query("approx_quantiles")
def approx_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = O.ApproxQuantile("l_extendedprice", 0.5), O.ApproxQuantiles("l_extendedprice", (0.1, 0.5, 0.9))
    found = run_analyzers(table(spark, sf_dir, "lineitem"), [a, b])
    return result(spark, [("median", found[a].get(), 2), *((f"q{k}", v, 2) for k, v in found[b].get().items())])


@query("kll_sketch", "WITH e AS (SELECT MIN(l_quantity) AS a, MAX(l_quantity) AS b FROM lineitem), t AS (SELECT LEAST(CAST(FLOOR((l_quantity - a) * 5 / (b - a)) AS INT), 4) AS bucket FROM lineitem, e) SELECT bucket, CAST(COUNT(*) AS BIGINT) AS n FROM t GROUP BY bucket")
def kll_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact where the values are few, as quantities are: the sketch only compacts equal values."""
    a = O.KLLSketch("l_quantity", O.KLLParameters(65535, 0.64, 5))
    d = run_analyzers(table(spark, sf_dir, "lineitem"), [a])[a].get()
    return spark.createDataFrame([(i, b.count) for i, b in enumerate(d.buckets)], "bucket int, n long")


@query("histogram", "WITH g AS (SELECT COALESCE(NULLIF(l_returnflag, 'N'), 'NullValue') AS value, COUNT(*) AS c FROM lineitem GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM lineitem) SELECT value, CAST(c AS BIGINT) AS n, ROUND(c / CAST(n AS DOUBLE), 6) AS ratio FROM g, n")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.expr("nullif(l_returnflag, 'N')").alias("flag"))
    d = run_analyzers(df, [O.Histogram("flag")])[O.Histogram("flag")].get()
    return spark.createDataFrame([(k, v.absolute, round(v.ratio, 6)) for k, v in d.values.items()], "value string, n long, ratio double")


@query("histogram_top", "SELECT CAST(l_partkey AS VARCHAR) AS value, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 20")
def histogram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = O.Histogram("l_partkey", max_detail_bins=20)
    d = run_analyzers(table(spark, sf_dir, "lineitem"), [a])[a].get()
    return spark.createDataFrame([(k, v.absolute) for k, v in d.values.items()], "value string, n long")


@query("histogram_sum", "SELECT l_linestatus AS value, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def histogram_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = O.Histogram("l_linestatus", sum_column="l_quantity")
    d = run_analyzers(table(spark, sf_dir, "lineitem"), [a])[a].get()
    return spark.createDataFrame([(k, v.absolute) for k, v in d.values.items()], "value string, n long")


@query("histogram_binned", "WITH e AS (SELECT MIN(o_totalprice) AS a, MAX(o_totalprice) AS b FROM orders), t AS (SELECT LEAST(CAST(FLOOR((o_totalprice - a) / ((b - a) / 8)) AS INT), 7) AS bin FROM orders, e) SELECT bin, CAST(COUNT(*) AS BIGINT) AS n FROM t GROUP BY bin")
def histogram_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = O.HistogramBinned("o_totalprice", 8)
    d = run_analyzers(table(spark, sf_dir, "orders"), [a])[a].get()
    return spark.createDataFrame([(i, b.frequency) for i, b in enumerate(d.bins) if b.frequency], "bin int, n long")


@query("histogram_edges", "SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity <= 30 THEN 3 ELSE 4 END AS bin, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = O.HistogramBinned("l_quantity", edges=(5, 10, 20, 30), overflow_bins=True)
    d = run_analyzers(table(spark, sf_dir, "lineitem"), [a])[a].get()
    return spark.createDataFrame([(i, b.frequency) for i, b in enumerate(d.bins) if b.frequency], "bin int, n long")


@query("custom_sql", "SELECT 'rows' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM orders WHERE o_totalprice > 150000")
def custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_view")
    a = O.CustomSql("SELECT COUNT(*) FROM orders_view WHERE o_totalprice > 150000")
    return result(spark, [("rows", run_analyzers(spark.range(1).toDF("x"), [a])[a].get(), 0)])


@query("custom_aggregator", "SELECT o_orderstatus AS status, ROUND(COUNT(*) / CAST((SELECT COUNT(*) FROM orders) AS DOUBLE), 6) AS share FROM orders GROUP BY 1")
def custom_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(df: DataFrame) -> O.AggregatedState:
        rows = {r[0]: r[1] for r in df.groupBy("o_orderstatus").count().collect()}
        return O.AggregatedState(rows, sum(rows.values()))

    a = O.CustomAggregator(counts, "StatusShare")
    found = run_analyzers(table(spark, sf_dir, "orders"), [a])[a].get()
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "status string, share double")


# comparison


def _perturbed(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))


@query("dataset_match", "SELECT 'ratio' AS metric, ROUND(SUM(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS value FROM orders")
def dataset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    r = comparison.column_match(df, _perturbed(df), {"o_orderkey": "o_orderkey"}, {"o_totalprice": "o_totalprice"}, lambda _: True)
    return result(spark, [("ratio", r.ratio, 6)])


@query("dataset_match_rows", "SELECT o_orderkey, o_orderkey % 7 <> 0 AS outcome FROM orders")
def dataset_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return comparison.column_match_rows(df, _perturbed(df), {"o_orderkey": "o_orderkey"}, {"o_totalprice": "o_totalprice"}).select("o_orderkey", "outcome")


@query("referential_integrity", "WITH m AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), n AS (SELECT COUNT(*) AS n FROM documents) SELECT 'documents_in_labels' AS metric, ROUND((n - (SELECT COUNT(*) FROM m)) / CAST(n AS DOUBLE), 6) AS value FROM n UNION ALL SELECT 'orders_in_customers', ROUND((n2 - lost) / CAST(n2 AS DOUBLE), 6) FROM (SELECT COUNT(*) AS n2, (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))) AS lost FROM orders)")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = comparison.subset_check(table(spark, sf_dir, "documents"), ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"], lambda _: True)
    b = comparison.subset_check(table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"], lambda _: True)
    return result(spark, [("documents_in_labels", a.ratio, 6), ("orders_in_customers", b.ratio, 6)])


@query("referential_integrity_rows", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS outcome FROM documents")
def referential_integrity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.subset_check_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], table(spark, sf_dir, "labels"), ["doc_id"])


@query("row_count_and_schema_match", "SELECT 'rows' AS metric, ROUND((SELECT COUNT(*) FROM orders) / CAST((SELECT COUNT(*) FROM customer) AS DOUBLE), 6) AS value UNION ALL SELECT 'schema', ROUND(CAST(2 AS DOUBLE) / 3, 6)")
def row_count_and_schema_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comparison.row_count_match(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), lambda _: True)
    nation = table(spark, sf_dir, "nation")
    schema = comparison.schema_match(nation, nation.withColumn("n_nationkey", F.col("n_nationkey").cast("string")), lambda _: True)
    return result(spark, [("rows", rows.ratio, 6), ("schema", schema.ratio, 6)])


# checks, rows, schemas


def _check() -> Check:
    return (
        Check(CheckLevel.ERROR, "lineitem")
        .has_size(Is(">", 0)).is_complete("l_orderkey").is_unique("l_orderkey").is_contained_in("l_returnflag", ["A", "N", "R"])
        .is_non_negative("l_discount").has_max("l_discount", Is("<=", 0.05)).where("l_tax < 0.02").is_less_than("l_discount", "l_quantity").has_min_length("l_linestatus", Is("==", 1))
    )


@query("verification", """SELECT constraint_no, ok FROM (
SELECT 1 AS constraint_no, COUNT(*) > 0 AS ok FROM lineitem UNION ALL SELECT 2, COUNT(*) = COUNT(l_orderkey) FROM lineitem UNION ALL
SELECT 3, COUNT(*) = COUNT(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 4, BOOL_AND(l_returnflag IN ('A','N','R')) FROM lineitem UNION ALL
SELECT 5, BOOL_AND(l_discount >= 0) FROM lineitem UNION ALL SELECT 6, MAX(l_discount) <= 0.05 FROM lineitem WHERE l_tax < 0.02 UNION ALL
SELECT 7, BOOL_AND(l_discount < l_quantity) FROM lineitem UNION ALL SELECT 8, MIN(LENGTH(l_linestatus)) = 1 FROM lineitem)""")
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.verification import VerificationSuite

    found = VerificationSuite.on_data(table(spark, sf_dir, "lineitem")).add_check(_check()).run()
    return spark.createDataFrame([(i + 1, r[4] == "Success") for i, r in enumerate(found.rows())], "constraint_no int, ok boolean")


@query("row_level_results", "SELECT l_orderkey, l_linenumber, l_quantity, (COUNT(*) OVER (PARTITION BY l_orderkey) = 1) AND l_returnflag <> 'N' AND l_quantity <= 40 AS rows_fit FROM lineitem")
def row_level_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.verification import verify

    df = table(spark, sf_dir, "lineitem")
    check = Check(CheckLevel.WARNING, "rows_fit").is_unique("l_orderkey").satisfies("l_returnflag <> 'N'", "flag").has_max("l_quantity", Is("<=", 40.0))
    return verify(df, [check]).row_level_results_as_dataframe(df).select("l_orderkey", "l_linenumber", "l_quantity", "rows_fit")


@query("schema_validation", "WITH t AS (SELECT CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS id, event_type AS kind, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(ROUND(value, 2) AS VARCHAR) END AS v FROM events), k AS (SELECT id IS NOT NULL AND TRY_CAST(id AS INT) IS NOT NULL AND TRY_CAST(id AS INT) >= 10 AND LENGTH(kind) <= 6 AND TRY_CAST(v AS DECIMAL(12,2)) IS NOT NULL AS ok FROM t) SELECT 'valid' AS metric, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM k UNION ALL SELECT 'invalid', CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS DOUBLE) FROM k")
def schema_validation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS id", "event_type AS kind", "CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(ROUND(value, 2) AS STRING) END AS v")
    schema = schema_validation.RowLevelSchema().with_int_column("id", False, min_value=10).with_string_column("kind", max_length=6).with_decimal_column("v", 12, 2)
    r = schema_validation.validate(df, schema)
    return result(spark, [("valid", r.num_valid_rows, 0), ("invalid", r.num_invalid_rows, 0)])


# profiling and suggestion


@query("profile_numeric", "SELECT 'o_totalprice' AS c, COUNT(o_totalprice) / CAST(COUNT(*) AS DOUBLE) AS completeness, ROUND(MIN(o_totalprice), 2) AS minimum, ROUND(MAX(o_totalprice), 2) AS maximum, ROUND(AVG(o_totalprice), 3) AS mean, ROUND(STDDEV_POP(o_totalprice), 3) AS std_dev FROM orders UNION ALL SELECT 'o_custkey', COUNT(o_custkey) / CAST(COUNT(*) AS DOUBLE), CAST(MIN(o_custkey) AS DOUBLE), CAST(MAX(o_custkey) AS DOUBLE), ROUND(AVG(o_custkey), 3), ROUND(STDDEV_POP(o_custkey), 3) FROM orders")
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.profiling import profile

    p = profile(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]).profiles
    return spark.createDataFrame([(c, x.completeness, round(x.minimum, 2), round(x.maximum, 2), round(x.mean, 3), round(x.std_dev, 3)) for c, x in p.items()], "c string, completeness double, minimum double, maximum double, mean double, std_dev double")


@query("profile_histograms", "SELECT 'o_orderstatus' AS c, o_orderstatus AS value, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, CAST(COUNT(*) AS BIGINT) FROM orders GROUP BY 2")
def profile_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.profiling import profile

    p = profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).profiles
    return spark.createDataFrame([(c, k, v.absolute) for c, x in p.items() for k, v in x.histogram.values.items()], "c string, value string, n long")


@query("suggestions")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.suggestions import Rules, suggest

    found = suggest(table(spark, sf_dir, "orders"), Rules.EXTENDED)
    return spark.createDataFrame([(s.column, str(s.rule), s.description, s.code) for s in found.all_suggestions()], "column_name string, rule string, description string, code string")


# incremental


@query("incremental_metrics", "SELECT 'rows' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'mean', ROUND(AVG(l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'stddev', ROUND(STDDEV_POP(l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'correlation', ROUND(CORR(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'uniqueness', ROUND(SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) / CAST(SUM(c) AS DOUBLE), 6) FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY l_orderkey)")
def incremental_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three parts, merged without reading the parts again."""
    df = table(spark, sf_dir, "lineitem")
    named = {"rows": (O.Size(), 0), "mean": (O.Mean(Q), 4), "stddev": (O.StandardDeviation(Q), 4), "correlation": (O.Correlation("l_quantity", Q), 6), "uniqueness": (O.Uniqueness(("l_orderkey",)), 6)}
    stores = []
    for i in range(3):
        stores.append(InMemoryStateStore())
        run_analyzers(df.where(F.pmod("l_partkey", F.lit(3)) == i), [a for a, _ in named.values()], save_states_with=stores[-1])
    found = run_on_aggregated_states(df, [a for a, _ in named.values()], stores)
    return result(spark, [(k, found[a].get(), d) for k, (a, d) in named.items()])


# anomalies


DAILY = "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1), p AS (SELECT day, n, n - LAG(n) OVER (ORDER BY day) AS change FROM d)"


def _history(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    return [(r["day"], r["n"]) for r in rows]


@query("anomaly_change", DAILY + " SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n FROM p WHERE change < -6 OR change > 6")
def anomaly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.anomaly import AbsoluteChangeStrategy

    days = _history(spark, sf_dir)
    found = AbsoluteChangeStrategy(-6.0, 6.0).detect([float(n) for _, n in days], (0, len(days)))
    return spark.createDataFrame([days[i] for i, _ in found], "day string, n long")


@query("anomaly_normal", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1), s AS (SELECT AVG(n) AS m, STDDEV_SAMP(n) AS sd FROM d) SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n FROM d, s WHERE n < m - 2 * sd OR n > m + 2 * sd")
def anomaly_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.anomaly import BatchNormalStrategy

    days = _history(spark, sf_dir)
    found = BatchNormalStrategy(2.0, 2.0, include_interval=True).detect([float(n) for _, n in days], (0, len(days)))
    return spark.createDataFrame([days[i] for i, _ in found], "day string, n long")


@query("anomaly_threshold", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n FROM d WHERE n > 10")
def anomaly_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.anomaly import SimpleThresholdStrategy

    days = _history(spark, sf_dir)
    found = SimpleThresholdStrategy(10.0).detect([float(n) for _, n in days], (0, len(days)))
    return spark.createDataFrame([days[i] for i, _ in found], "day string, n long")


# distances


@query("distance_linf", "WITH a AS (SELECT l_returnflag AS k, COUNT(*) AS c FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_returnflag AS k, COUNT(*) AS c FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), n AS (SELECT (SELECT SUM(c) FROM a) AS n, (SELECT SUM(c) FROM b) AS m) SELECT 'linf' AS metric, ROUND(MAX(ABS(COALESCE(a.c, 0) / CAST(n AS DOUBLE) - COALESCE(b.c, 0) / CAST(m AS DOUBLE))), 6) AS value FROM a FULL JOIN b USING (k), n")
def distance_linf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.distance import categorical_distance

    df = table(spark, sf_dir, "lineitem")
    rows = df.groupBy("l_linestatus", "l_returnflag").count().collect()
    a, b = ({r[1]: r[2] for r in rows if r[0] == s} for s in ("O", "F"))
    return result(spark, [("linf", categorical_distance(a, b, True), 6)])


# the rule language


RULESET = """Rules = [
    RowCount > 100, IsComplete "o_orderkey", IsUnique "o_orderkey", Completeness "status" > 0.9, ColumnValues "o_orderstatus" in ["F", "O", "P"],
    ColumnValues "o_totalprice" > 0, ColumnLength "o_orderstatus" = 1, DistinctValuesCount "o_orderstatus" = 3, Mean "o_totalprice" between 1 and 1000000,
    ColumnDataType "o_orderpriority" = "INTEGER" with threshold > 0.5, (RowCount > 0) and (IsComplete "status"), (RowCount > 0) or (IsComplete "status"),
    CustomSql "select count(*) from primary where o_totalprice < 0" = 0, ReferentialIntegrity "o_custkey" "customers.c_custkey" >= 0.99,
    RowCountMatch "customers" = 1.0, AggregateMatch "sum(o_custkey)" "sum(o_custkey)" = 1.0, ColumnNamesMatchPattern "o_.*", ColumnExists "o_custkey"
]"""


@query("rules", """WITH t AS (SELECT *, NULLIF(o_orderstatus, 'F') AS status FROM orders) SELECT n, CASE WHEN ok THEN 'Passed' ELSE 'Failed' END AS outcome FROM (
SELECT 1 AS n, COUNT(*) > 100 AS ok FROM t UNION ALL SELECT 2, COUNT(o_orderkey) = COUNT(*) FROM t UNION ALL SELECT 3, COUNT(DISTINCT o_orderkey) = COUNT(*) FROM t UNION ALL
SELECT 4, COUNT(status) / CAST(COUNT(*) AS DOUBLE) > 0.9 FROM t UNION ALL SELECT 5, BOOL_AND(o_orderstatus IN ('F','O','P')) FROM t UNION ALL SELECT 6, MIN(o_totalprice) > 0 FROM t UNION ALL
SELECT 7, MIN(LENGTH(o_orderstatus)) = 1 AND MAX(LENGTH(o_orderstatus)) = 1 FROM t UNION ALL SELECT 8, COUNT(DISTINCT o_orderstatus) = 3 FROM t UNION ALL SELECT 9, AVG(o_totalprice) > 1 AND AVG(o_totalprice) < 1000000 FROM t UNION ALL
SELECT 10, AVG(CASE WHEN TRY_CAST(o_orderpriority AS INT) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.5 FROM t UNION ALL SELECT 11, COUNT(*) > 0 AND COUNT(status) = COUNT(*) FROM t UNION ALL SELECT 12, COUNT(*) > 0 FROM t UNION ALL
SELECT 13, COUNT(*) = 0 FROM t WHERE o_totalprice < 0 UNION ALL SELECT 14, AVG(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0.0 END) >= 0.99 FROM t UNION ALL
SELECT 15, COUNT(*) = (SELECT COUNT(*) FROM customer) FROM t UNION ALL SELECT 16, TRUE UNION ALL SELECT 17, FALSE UNION ALL SELECT 18, TRUE)""")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(table(spark, sf_dir, "orders"))
    found = EvaluateDataQuality.process(df, RULESET, {"customers": table(spark, sf_dir, "customer")}).collect()
    return spark.createDataFrame([(i + 1, r["Outcome"]) for i, r in enumerate(found)], "n int, outcome string")


@query("rules_rows", "SELECT o_orderkey, CASE WHEN NULLIF(o_orderstatus, 'F') IS NULL OR o_totalprice <= 50000 THEN 'Failed' ELSE 'Passed' END AS outcome FROM orders")
def rules_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(table(spark, sf_dir, "orders"))
    rows = EvaluateDataQuality.process_rows(df, 'Rules = [ IsComplete "status", ColumnValues "o_totalprice" > 50000, RowCount > 0 ]')[EvaluateDataQuality.ROW_LEVEL_OUTCOMES]
    return rows.select("o_orderkey", F.col("DataQualityEvaluationResult").alias("outcome"))


# every method of a check, with the SQL of what it holds

DISTINCT = "(SELECT COUNT(*) FROM (SELECT DISTINCT {0} FROM lineitem))"
SINGLE = "(SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY {0} HAVING COUNT(*) = 1))"
KEY = ("l_orderkey", "l_linenumber")
CHECK_METHODS: list[tuple[Callable[[Check], Check], str]] = [
    (lambda c: c.has_size(Is(">", 50000)), "COUNT(*) > 50000"),
    (lambda c: c.has_column_count(Is("==", 11)), "TRUE"),
    (lambda c: c.has_column("l_tax"), "TRUE"),
    (lambda c: c.has_zeros_count("l_discount", Is(">", 0)), "COUNT(*) FILTER (WHERE l_discount = 0) > 0"),
    (lambda c: c.has_duplicate_row_count(KEY, Is(">", 0)), f"COUNT(*) > {DISTINCT.format('l_orderkey, l_linenumber')}"),
    (lambda c: c.has_completeness("l_tax", Is(">=", 1.0)), "COUNT(l_tax) = COUNT(*)"),
    (lambda c: c.are_complete(["l_tax", "l_discount"]), "COUNT(l_tax + l_discount) = COUNT(*)"),
    (lambda c: c.have_completeness(["l_tax", "l_discount"], Is("<", 1.0)), "COUNT(l_tax + l_discount) < COUNT(*)"),
    (lambda c: c.are_any_complete(["l_tax", "l_discount"]), "COUNT(COALESCE(l_tax, l_discount)) = COUNT(*)"),
    (lambda c: c.have_any_completeness(["l_tax", "l_discount"], Is("<", 0.5)), "COUNT(COALESCE(l_tax, l_discount)) < 0.5 * COUNT(*)"),
    (lambda c: c.are_unique(KEY), f"COUNT(*) = {SINGLE.format('l_orderkey, l_linenumber')}"),
    (lambda c: c.is_primary_key(*KEY), f"COUNT(*) = {SINGLE.format('l_orderkey, l_linenumber')}"),
    (lambda c: c.has_uniqueness(KEY, Is(">", 0.2)), f"{SINGLE.format('l_orderkey, l_linenumber')} > 0.2 * COUNT(*)"),
    (lambda c: c.has_distinctness("l_partkey", Is("<", 0.1)), f"{DISTINCT.format('l_partkey')} < 0.1 * COUNT(*)"),
    (lambda c: c.has_unique_value_ratio("l_orderkey", Is("<", 0.5)), f"COUNT(*) > 0 AND {SINGLE.format('l_orderkey')} < 0.5 * {DISTINCT.format('l_orderkey')}"),
    (lambda c: c.has_number_of_distinct_values("l_returnflag", Is("==", 3)), "COUNT(DISTINCT l_returnflag) = 3"),
    (lambda c: c.has_entropy("l_returnflag", Is(">", 1.0)), "(SELECT -SUM(p * LN(p)) FROM (SELECT COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag)) > 1.0"),
    (lambda c: c.has_exact_quantile("l_quantity", 0.25, Is(">=", 13.0)), "QUANTILE_CONT(l_quantity, 0.25) >= 13"),
    (lambda c: c.has_approx_quantile("l_quantity", 0.5, Is(">", 20.0)), "MEDIAN(l_quantity) > 20"),
    (lambda c: c.has_min_length("l_returnflag", Is("==", 1)), "MIN(LENGTH(l_returnflag)) = 1"),
    (lambda c: c.has_max_length("l_returnflag", Is(">", 1)), "MAX(LENGTH(l_returnflag)) > 1"),
    (lambda c: c.has_min("l_quantity", Is("==", 1.0)), "MIN(l_quantity) = 1"),
    (lambda c: c.has_max("l_quantity", Is("<", 50.0)), "MAX(l_quantity) < 50"),
    (lambda c: c.has_range("l_quantity", Is("==", 49.0)), "MAX(l_quantity) - MIN(l_quantity) = 49"),
    (lambda c: c.has_interquartile_range("l_quantity", Is("<", 20.0)), "QUANTILE_CONT(l_quantity, 0.75) - QUANTILE_CONT(l_quantity, 0.25) < 20"),
    (lambda c: c.has_mean("l_quantity", Is(">", 25.0)), "AVG(l_quantity) > 25"),
    (lambda c: c.has_sum("l_linenumber", Is(">", 200000.0)), "SUM(l_linenumber) > 200000"),
    (lambda c: c.has_standard_deviation("l_quantity", Is("<", 14.0)), "STDDEV_POP(l_quantity) < 14"),
    (lambda c: c.has_variance("l_quantity", Is(">", 200.0)), "VAR_POP(l_quantity) > 200"),
    (lambda c: c.has_skewness("l_extendedprice", Is("<", 0.0)), "SKEWNESS(l_extendedprice) < 0"),
    (lambda c: c.has_kurtosis("l_quantity", Is("<", -1.0)), "KURTOSIS_POP(l_quantity) < -1"),
    (lambda c: c.has_approx_count_distinct("l_returnflag", Is("==", 3)), "COUNT(DISTINCT l_returnflag) = 3"),
    (lambda c: c.has_correlation("l_quantity", "l_extendedprice", Is(">", 0.5)), "CORR(l_quantity, l_extendedprice) > 0.5"),
    (lambda c: c.has_ratio_of_sums("l_discount", "l_tax", Is(">", 1.1)), "SUM(l_discount) > 1.1 * SUM(l_tax)"),
    (lambda c: c.has_pattern("l_returnflag", "^[AN]$", Is(">", 0.6)), "COUNT(*) FILTER (WHERE l_returnflag IN ('A', 'N')) > 0.6 * COUNT(*)"),
    (lambda c: c.contains_email("l_returnflag", Is("==", 0.0)), "TRUE"),
    (lambda c: c.contains_url("l_returnflag", Is("==", 0.0)), "TRUE"),
    (lambda c: c.contains_credit_card_number("l_returnflag", Is("==", 0.0)), "TRUE"),
    (lambda c: c.contains_social_security_number("l_returnflag", Is(">", 0.0)), "FALSE"),
    (lambda c: c.is_positive("l_discount"), "BOOL_AND(l_discount > 0)"),
    (lambda c: c.is_less_than_or_equal_to("l_discount", "l_tax"), "BOOL_AND(l_discount <= l_tax)"),
    (lambda c: c.is_greater_than("l_quantity", "l_discount"), "BOOL_AND(l_quantity > l_discount)"),
    (lambda c: c.is_greater_than_or_equal_to("l_tax", "l_discount", Is(">", 0.3)), "COUNT(*) FILTER (WHERE l_tax >= l_discount) > 0.3 * COUNT(*)"),
    (lambda c: c.is_contained_in_range("l_quantity", 1, 40), "BOOL_AND(l_quantity BETWEEN 1 AND 40)"),
    (lambda c: c.satisfies("l_quantity > 10 AND l_tax < 0.05", "many", Is(">", 0.4)), "COUNT(*) FILTER (WHERE l_quantity > 10 AND l_tax < 0.05) > 0.4 * COUNT(*)"),
]


@query("check_methods", "\nUNION ALL\n".join(f"SELECT {i + 1} AS constraint_no, {sql} AS ok{'' if sql in ('TRUE', 'FALSE') or sql.startswith('(SELECT -') else ' FROM lineitem'}" for i, (_, sql) in enumerate(CHECK_METHODS)))
def check_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.verification import VerificationSuite

    check = Check(CheckLevel.WARNING, "methods")
    for add, _ in CHECK_METHODS:
        check = add(check)
    found = VerificationSuite.on_data(table(spark, sf_dir, "lineitem")).add_check(check).run()
    return spark.createDataFrame([(i + 1, r[4] == "Success") for i, r in enumerate(found.rows())], "constraint_no int, ok boolean")


# more strategies, distances and bounds


def _days_found(spark: SparkSession, sf_dir: str, strategy: Any) -> DataFrame:
    days = _history(spark, sf_dir)
    found = strategy.detect([float(n) for _, n in days], (0, len(days)))
    return spark.createDataFrame([days[i] for i, _ in found], "day string, n long")


PAST = "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, LAG(n) OVER w AS b, LAG(n, 2) OVER w AS a, AVG(n) OVER w AS m, STDDEV_POP(n) OVER w AS sd, ROW_NUMBER() OVER w - 1 AS i, COUNT(*) OVER () AS days FROM d WINDOW w AS (ORDER BY day)) SELECT CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n FROM p WHERE "


@query("anomaly_relative_change", PAST + "n / CAST(b AS DOUBLE) < 0.4 OR n / CAST(b AS DOUBLE) > 2.6")
def anomaly_relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.anomaly import RelativeRateOfChangeStrategy

    return _days_found(spark, sf_dir, RelativeRateOfChangeStrategy(0.4, 2.6))


@query("anomaly_second_difference", PAST + "n - 2 * b + a < -9 OR n - 2 * b + a > 9")
def anomaly_second_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.anomaly import RateOfChangeStrategy

    return _days_found(spark, sf_dir, RateOfChangeStrategy(-9.0, 9.0, 2))


@query("anomaly_online_normal", PAST + "i >= 0.1 * days AND (n < m - 2 * sd OR n > m + 2 * sd)")
def anomaly_online_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.anomaly import OnlineNormalStrategy

    return _days_found(spark, sf_dir, OnlineNormalStrategy(2.0, 2.0, 0.1, ignore_anomalies=False))


@query("distance_chi_square", "WITH a AS (SELECT l_returnflag AS k, COUNT(*) AS c FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_returnflag AS k, COUNT(*) AS c FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), e AS (SELECT a.c, b.c / CAST(SUM(b.c) OVER () AS DOUBLE) * SUM(a.c) OVER () AS e FROM a JOIN b USING (k)) SELECT 'chi_square' AS metric, ROUND(SUM((c - e) * (c - e) / e), 6) AS value FROM e")
def distance_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.distance import ChisquareMethod, categorical_distance

    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").count().collect()
    a, b = ({r[1]: r[2] for r in rows if r[0] == s} for s in ("O", "F"))
    return result(spark, [("chi_square", categorical_distance(a, b, True, ChisquareMethod()), 6)])


@query("distance_psi", "WITH t AS (SELECT CAST(FLOOR((l_quantity - 1) / 10) AS INT) AS k, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS a, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS b FROM lineitem GROUP BY 1), s AS (SELECT a / CAST(SUM(a) OVER () AS DOUBLE) AS p, b / CAST(SUM(b) OVER () AS DOUBLE) AS q FROM t) SELECT 'psi' AS metric, ROUND(SUM((p - q) * LN(p / q)), 9) AS value FROM s")
def distance_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.distance import population_stability_index
    from dqengine.metrics import BucketValue

    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("k")).pivot("l_linestatus", ["O", "F"]).count().orderBy("k").collect()
    a, b = ([BucketValue(10.0 * r["k"] + 1, 10.0 * r["k"] + 11, r[s] or 0) for r in rows] for s in ("O", "F"))
    return result(spark, [("psi", population_stability_index(a, b), 9)])


@query("approx_bounds", "SELECT metric, TRUE AS within FROM (VALUES ('l_partkey'), ('l_suppkey'), ('l_orderkey'), ('median'), ('q0.1'), ('q0.9')) AS t(metric)")
def approx_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the approximate metrics hold their bounds: three standard errors of 5 % for counts, 1 % of the ranks for quantiles."""
    df, columns, quantiles = table(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey", "l_orderkey"), {"median": 0.5, "q0.1": 0.1, "q0.9": 0.9}
    counts, shares = {c: O.ApproxCountDistinct(c) for c in columns}, {k: O.ApproxQuantile("l_extendedprice", q) for k, q in quantiles.items()}
    found = run_analyzers(df, [*counts.values(), *shares.values()])
    below = [F.avg((F.col("l_extendedprice") <= found[a].get()).cast("double")).alias(k) for k, a in shares.items()]
    exact = df.agg(*(F.countDistinct(c).alias(c) for c in columns), *below).first()
    rows = [(c, abs(found[a].get() / exact[c] - 1) <= 0.15) for c, a in counts.items()] + [(k, abs(exact[k] - q) <= 0.011) for k, q in quantiles.items()]
    return spark.createDataFrame(rows, "metric string, within boolean")


# streams and stored metrics


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; in a temporary one where none is named, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='queries-')}/{uuid.uuid4().hex}"


@query("streaming_metrics", "SELECT 'rows' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'mean', ROUND(AVG(l_quantity), 6) FROM lineitem UNION ALL SELECT 'distinctness', ROUND(COUNT(DISTINCT l_partkey) / CAST(COUNT(*) AS DOUBLE), 6) FROM lineitem")
def streaming_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a stream of the table's files, by merging the states of its batches."""
    from dqengine.streaming.incremental import IncrementalMetrics

    named = {"rows": (O.Size(), 0), "mean": (O.Mean("l_quantity"), 6), "distinctness": (O.Distinctness(("l_partkey",)), 6)}
    metrics = IncrementalMetrics([a for a, _ in named.values()])
    stream = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).option("maxFilesPerTrigger", "1").parquet(f"{sf_dir}/lineitem.parquet*")  # a pattern, for the table may be one file
    running = metrics.attach(stream, checkpointLocation=_folder(spark))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return result(spark, [(k, metrics.last[1][a].get(), d) for k, (a, d) in named.items()])


@query("repository_history", "WITH t AS (SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS dataset_date, CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(o_totalprice), 4) AS m FROM orders GROUP BY 1) SELECT CAST(dataset_date AS BIGINT) AS dataset_date, status, 'Size' AS name, n AS value FROM t WHERE dataset_date >= 2 UNION ALL SELECT dataset_date, status, 'Mean', m FROM t WHERE dataset_date >= 2")
def repository_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three dates, saved to a file and loaded from the second on."""
    from dqengine.sources.repository import FileMetricsRepository, ResultKey

    orders, kept = table(spark, sf_dir, "orders"), FileMetricsRepository(spark, f"{_folder(spark)}/metrics.json")
    for date, status in enumerate(("F", "O", "P"), 1):
        kept.save(ResultKey(date, {"status": status}), run_analyzers(orders.where(F.col("o_orderstatus") == status), [O.Size(), O.Mean("o_totalprice")]))
    return kept.load().after(2).get_success_metrics_as_dataframe(spark).select("dataset_date", "status", "name", F.round("value", 4).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of lineitem and the metrics it took: (entity, instance, name, value)."""
    from dqengine.verification import VerificationSuite

    return VerificationSuite.on_data(table(spark, sf_dir, "lineitem")).add_check(_check()).run().success_metrics_as_dataframe(spark)


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """SELECT 'Dataset' AS entity, '*' AS instance, 'Size' AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem UNION ALL
SELECT 'Column', 'l_orderkey', 'Completeness', COUNT(l_orderkey) / CAST(COUNT(*) AS DOUBLE) FROM lineitem UNION ALL
SELECT 'Column', 'l_orderkey', 'Uniqueness', COUNT(*) FILTER (WHERE c = 1) / CAST(SUM(c) AS DOUBLE) FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY l_orderkey) UNION ALL
SELECT 'Column', 'l_returnflag contained in A,N,R', 'Compliance', AVG(CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL
SELECT 'Column', 'l_discount is non-negative', 'Compliance', AVG(CASE WHEN l_discount >= 0 THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL
SELECT 'Column', 'l_discount', 'Maximum (where: l_tax < 0.02)', MAX(l_discount) FROM lineitem WHERE l_tax < 0.02 UNION ALL
SELECT 'Column', 'l_discount is less than l_quantity', 'Compliance', AVG(CASE WHEN l_discount < l_quantity THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL
SELECT 'Column', 'l_linestatus', 'MinLength', CAST(MIN(LENGTH(l_linestatus)) AS DOUBLE) FROM lineitem"""
