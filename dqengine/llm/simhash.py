"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification.

A fingerprint is cut into `max_distance + shared` blocks. Two fingerprints that
differ in at most `max_distance` bits agree on at least `shared` whole blocks,
so each choice of `shared` blocks gives one key and close pairs meet under some
key. With 7 blocks, 3 shared, a key has 27 or 28 bits, which keeps chance
meetings rare up to very large inputs.

Equal fingerprints are first folded into one row, so copies never meet each
other as rows. A key that many different fingerprints share is dealt out to
pairs of tiles of bounded size, and each tile pair yields a spanning forest of
its links, never all its pairs; no link between components is lost by that.
Components are found by distributed star steps.

Null texts count as empty; texts without words have fingerprint zero and link
like any other. Rows with equal or null ids are kept as they are; a component's
id is the smallest non-null id in it (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import cut, fresh, map_batches
from dqengine.llm.components import apart, connected_components
from dqengine.llm.near_copies import near_copies

#: Shingles hashed at a time, so that very long texts need bounded memory.
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints of one side of a tile pair.
TILE = 1024


def fingerprint(text: bytes, n: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text in UTF-8, unsigned."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - n + 1], ends[n - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        spans = zip(first[at : at + SHINGLES_AT_ONCE].tolist(), last[at : at + SHINGLES_AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fp", n: int = 4, seed: int = 42) -> DataFrame:
    """Replaces the text by out: its SimHash as a signed long. Other columns stay."""
    docs = docs.drop(out) if out != text_col else docs
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    names = docs.columns
    where = names.index(text_col)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).cast(pa.binary()).to_pylist()
            made = np.fromiter((fingerprint(t or b"", n, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made)], schema.names)

    return map_batches(docs, run, schema)


def block_keys(fp: Column, max_distance: int, shared: int) -> Column:
    """One long for each choice of `shared` blocks: the choice's number and the bits of its blocks."""
    n = max_distance + shared
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), shared)):
        key = F.lit(number).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def forest(a: np.ndarray, b: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within a, if b is a, or else between a and b (uint64)."""
    same = a is b
    close = np.bitwise_count(a[:, None] ^ b[None, :]) <= max_distance
    nodes = a if same else np.concatenate([a, b])
    todo = np.ones(len(nodes), bool)
    links = []
    for i in range(len(a)):
        if not todo[i]:
            continue
        todo[i] = False
        front = [i]
        while front:
            at = front.pop()
            if same:
                new = np.flatnonzero(close[at] & todo)
            elif at < len(a):
                new = np.flatnonzero(close[at] & todo[len(a) :]) + len(a)
            else:
                new = np.flatnonzero(close[:, at - len(a)] & todo[: len(a)])
            todo[new] = False
            links += [(int(nodes[at]), int(nodes[j])) for j in new]
            front += new.tolist()
    return links


def links(fps: DataFrame, *, fp: str = "fp", max_distance: int = 4, shared: int = 3, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints -> (a, b): enough links at max_distance or less to connect all that are connected."""
    keyed = fps.select(F.col(fp).alias("_f"), F.explode(block_keys(F.col(fp), max_distance, shared)).alias("_k"))
    live = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    tiles = F.ceil(F.col("_n") / F.lit(tile)).cast("int")
    live = live.select(apart(F.col("_k")).alias("_l"), "_n")
    met = keyed.join(live, apart(F.col("_k")) == F.col("_l")).withColumn("_tiles", tiles).withColumn("_t", F.pmod(F.xxhash64("_f"), F.col("_tiles")).cast("int"))
    # a key of one tile has one cell; of more, a row goes to the cells of its tile with every tile
    cells = met.select("_k", "_f", "_t", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_o"))
    cells = cells.select("_k", F.least("_t", "_o").alias("_i"), F.greatest("_t", "_o").alias("_j"), F.struct("_t", "_f").alias("_x"))
    cells = cells.groupBy("_k", "_i", "_j").agg(F.collect_list("_x").alias("_x")).select("_i", "_j", F.transform("_x", lambda x: x["_t"]).alias("_t"), F.transform("_x", lambda x: x["_f"]).alias("_f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = np.array(f, np.int64).view(np.uint64)
                if len(f) == 2:
                    found = [(int(f[0]), int(f[1]))] if int(f[0] ^ f[1]).bit_count() <= max_distance else []
                elif i == j:
                    found = forest(f, f, max_distance)
                else:
                    t = np.array(t)
                    found = forest(f[t == i], f[t == j], max_distance)
                for x, y in found:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], ["a", "b"])

    found = map_batches(cells, run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, seed: int = 42, max_distance: int = 4, shared: int = 3) -> DataFrame:
    """Returns id_col, fp (signed long) and component_id for each row of docs."""
    own = cut(fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("_text")), text_col="_text", n=n, seed=seed))
    fps = own.groupBy("fp").agg(F.min(id_col).alias("_least"))
    joined = connected_components(links(fps.select("fp"), max_distance=max_distance, shared=shared))
    # the joins below are planned by who reads the result: merge joins, so that none is broadcast
    rooted = fps.join(joined.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id")).select(apart(F.col("root")).alias("_r"), "component_id")
    placed = rooted.join(least.hint("merge"), apart(F.col("root")) == F.col("_r")).select(apart(F.col("fp")).alias("_f"), "component_id")
    return own.join(placed.hint("merge"), apart(F.col("fp")) == F.col("_f")).select(id_col, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, max_distance: int = 4, shared: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of docs without near copies: one document of each component stays, the one with the smallest id.

    With a similarity, components are those of near_copies: exact Jaccard
    similarity of n-word shingles, not bits of fingerprints. A row with a null
    id stays only where its component has no id at all; rows that repeat an id
    are kept or dropped together.
    """
    if similarity is None:
        placed = near_duplicates(docs, id_col=id_col, text_col=text_col, n=n, max_distance=max_distance, shared=shared)
    else:
        placed = near_copies(docs, id_col=id_col, text_col=text_col, n=n, similarity=similarity)
    name = fresh(docs, "_gone")
    gone = placed.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    # a null id equals none, so its rows stay
    return docs.join(gone.hint("merge"), docs[id_col] == gone[name], "left_anti")
