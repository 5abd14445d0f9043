"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives each of its documents the same number of
copies, whole part and fraction. The whole part is taken outright. The
fractions are rounded in pairs: two documents exchange probability, weighted by
their sizes, until one of them is certain to be in or out, and the other goes on
to the next pair. Each exchange keeps the expected copies of both documents and
the words of the pair, so a source ends within one document of its target.

A source is dealt out to buckets of bounded size by the hash of the row, equal
rows by their number besides; each bucket ends with at most one unsettled document, and those residuals are
combined in a tree of bounded fan-in until each source has one left, which is
settled by a last draw. All draws come from hashes, so reruns agree.

Null texts have size 0. Null sources are a source of their own, last in order.
Rows that repeat an id are documents of their own, also equal ones. Documents of
size 0 take 0, an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqengine.llm.common import cut, fresh, ship, text_or_empty

#: Rows of a bucket on average, and residuals combined in one step of the tree.
BUCKET, FAN_IN = 1024, 256
#: Sources at most, for they pass through the driver; sources of which a table is broadcast, of some 100 bytes each.
MOST_SOURCES, BROADCAST_SOURCES = 1_000_000, 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white spaces."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Each source's target: share of all words, dealt by weight, at most `most` times the source.

    Sources in code-point order (null last) take the weights in turn. What a
    source cannot take is dealt again by weight to those below their limit.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal = {s: 0.0 for s in order}
    left, free = share * sum(sizes.values()), list(order)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        goal |= {s: goal[s] + left * weight[s] / total for s in free}
        left = 0.0
        for s in [s for s in free if goal[s] >= most * sizes[s]]:
            left += goal[s] - most * sizes[s]
            goal[s] = float(most * sizes[s])
            free.remove(s)
    return goal


def draws(seed: int, n: int) -> np.ndarray:
    """n uniform numbers that depend on the seed alone."""
    return np.random.Generator(np.random.PCG64(seed & (2**63 - 1))).random(n)


def pivot(size: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Settle all but at most one of the probabilities p; returns them and the unsettled place (-1: none)."""
    p = np.where(size > 0, p, 0.0).astype(float)
    u = draws(seed, len(p))
    eps = 1e-9
    held = -1
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # words move from b to a (up) or from a to b (down), as far as one of them allows
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        moved = up if u[i] < down / (up + down) else -down
        p[a] += moved / size[a]
        p[b] -= moved / size[b]
        held = -1
        for j in (a, b):
            if eps < p[j] < 1 - eps:
                held = j
            else:
                p[j] = round(p[j])
    return p, held


def combiner(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One step of the tree over the residuals of one group; the last step leaves none."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b").reset_index(drop=True)
        at = seed * 1_000_003 + level * 7919 + int(pdf["_s"].iloc[0]) * 65_537 + int(pdf["_g"].iloc[0])
        p, held = pivot(pdf["size"].to_numpy(), pdf["_p"].to_numpy(), at)
        if last and held >= 0:
            p[held] = float(draws(at + 1, 1)[0] < p[held])
            held = -1
        pdf["_p"], pdf["_held"] = p, np.arange(len(pdf)) == held
        return pdf[["_s", "_b", "_g", "size", "_p", "_held"]]

    return combine


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """Tells rows apart by id, text and source; equal rows have equal keys."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(1), text_or_empty(text_col), F.lit(2), F.col(source_col).cast("string"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Returns id_col, source_col, size, source_size, target, copies and taken (words: copies times size) for each row; options as of shares()."""
    return shares(docs, **options).drop("_key", "_nth")


def shares(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """What mix() returns, and the row's key and its number among equal rows.

    Sizes and targets of the sources pass through the driver, some 100 bytes a
    source and a million sources at most; nothing of the documents does.
    """
    own = (F.col(id_col).cast("string").alias("_id"), F.col(source_col).cast("string").alias("_src"), word_count(text_or_empty(text_col)).alias("size"), row_key(id_col, text_col, source_col).alias("_key"))
    folded = docs.select(*own).groupBy("_id", "_src", "size", "_key").agg(F.count(F.lit(1)).alias("_m"))
    sized = cut(folded.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))).drop("_m"))
    found = sized.groupBy("_src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by_source = {r["_src"]: (r["n"], r["words"]) for r in found}
    goal = targets({s: w for s, (_, w) in by_source.items()}, weights, share, most)
    spark = docs.sparkSession
    ship(spark)
    table = [(i, s, w, goal[s], goal[s] / w if w else 0.0, -(-n // bucket)) for i, (s, (n, w)) in enumerate(sorted(by_source.items(), key=lambda x: (x[0] is None, x[0] or "")))]
    sources = spark.createDataFrame(table, "_s int, _name string, source_size long, target double, _rate double, _buckets int")
    small = F.broadcast if len(table) <= BROADCAST_SOURCES else (lambda df: df)
    placed = sized.join(small(sources), F.col("_src").eqNullSafe(F.col("_name")))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_key", "_nth", F.lit(seed)), F.col("_buckets")).cast("int"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_key", "_nth"], kind="stable").reset_index(drop=True)
        rate = float(pdf["_rate"].iloc[0])
        whole = int(rate + 1e-9)
        part = rate - whole if rate - whole > 1e-9 else 0.0
        p, held = pivot(pdf["size"].to_numpy(), np.full(len(pdf), part), seed * 1_000_003 + int(pdf["_s"].iloc[0]) * 65_537 + int(pdf["_b"].iloc[0]))
        pdf["_whole"] = np.where(pdf["size"] > 0, whole, 0)
        pdf["_p"] = p
        pdf["_held"] = np.arange(len(pdf)) == held
        return pdf[["_id", "_key", "_nth", "_s", "_b", "size", "_whole", "_p", "_held"]]

    first = placed.select("_id", "_key", "_nth", "_s", "_b", "size", "_rate", F.xxhash64("_key", "_nth", F.lit(seed + 1)).alias("_h")).groupBy("_s", "_b").applyInPandas(settle, "_id string, _key long, _nth long, _s int, _b int, size long, _whole int, _p double, _held boolean")
    first = cut(first)

    # the tree: (source, bucket) of each unsettled document, its size and probability
    open_ = first.where("_held").select("_s", "_b", "size", "_p")
    settled: list[DataFrame] = []
    level = 1
    most_open = max([t[5] for t in table], default=0)
    while most_open > 0:
        last = most_open <= 1

        grouped = open_.withColumn("_g", F.floor(F.col("_b") / F.lit(fan_in**level)).cast("int"))
        done = cut(grouped.groupBy("_s", "_g").applyInPandas(combiner(seed, level, last), "_s int, _b int, _g int, size long, _p double, _held boolean"))
        settled.append(done.where("not _held").select("_s", "_b", F.col("_p").alias("_q")))
        open_ = done.where("_held").select("_s", "_b", "size", "_p")
        most_open = 0 if last else -(-most_open // fan_in)
        level += 1
    result = first
    if settled:
        answers = settled[0]
        for s in settled[1:]:
            answers = answers.unionByName(s)
        result = first.join(answers.withColumn("_held", F.lit(True)), ["_s", "_b", "_held"], "left").withColumn("_p", F.coalesce("_q", "_p"))
    result = result.join(small(sources.select("_s", "_name", "source_size", "target")), "_s")
    copies = (F.col("_whole") + F.round("_p").cast("int")).alias("copies")
    result = result.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("_name").alias(source_col), "size", "source_size", "target", copies, "_key", "_nth")
    return result.withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def repeat(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it. Rows of size 0 stay once, for they take nothing from any target.

    All columns of docs come back as they are, whatever their names.
    """
    taken = shares(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    key, nth, copies = (fresh(docs, f"_mix_{c}") for c in ("key", "nth", "copies"))
    counts = taken.select(F.col("_key").alias("k"), F.col("_nth").alias("n"), times.alias(copies)).where(F.col(copies) > 0)
    held = docs.withColumn(key, row_key(id_col, text_col, source_col))
    held = held.withColumn(nth, F.row_number().over(W.partitionBy(key).orderBy(key)).cast("long"))  # equal in all that the mix looks at
    joined = held.join(counts, (held[key] == counts["k"]) & (held[nth] == counts["n"]))
    return joined.select(*(held[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), counts[copies])).alias(copies)).drop(copies)
