"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.llm.common import id_remainder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    """True for the rows that are never learnt from; a null id is learnt from neither, and not held out."""
    return F.coalesce(id_remainder("doc_id", modulus) == remainder, F.lit(False))


def scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import compression_quality as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = q.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return scored(q.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score"))


def op2_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import chaining as c

    return c.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import toxicity as t

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = t.train(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return scored(t.score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import simhash as s

    rows = s.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", s.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import line_dedup as n

    rows = n.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "lines", "lines_gone", "lines_near", F.sha2("text", 256).alias("kept_sha256"))


def op6_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import suffix_groups as g

    rows = g.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import mixing as m

    return m.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dqengine.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, path).drop("text"), path))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import winnowing as w

    return w.compare_with_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dqengine.llm import decision_list as d

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = d.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return d.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_chaining": op2_chaining,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_groups": op6_suffix_groups,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_winnowing": op9_winnowing,
    "op10_decision_list": op10_decision_list,
}

#: DuckDB SQL of those queries that SQL can express.
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
