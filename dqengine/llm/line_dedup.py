"""Line deduplication by a deletion-neighbourhood join (edit bound 1).

A line goes if an equal line, or one within one edit (a code point inserted,
deleted or replaced), comes earlier in the corpus; the earliest stays. The
earlier line itself may go for a still earlier one, so of lines that lead to
each other edit by edit the first alone stays. Order is by document id (null
first), then a hash of the document, then line number. Two lines are
neighbours if the longer has `min_chars` code points or more; below that length
only equal lines count, for one edit of a short line makes another line of it.

Lines that can have a neighbour at all are found first: cut into pieces, two
lines one edit apart are equal but for one piece, so a line that shares its rest
with no other needs no variants; beginnings and ends sort out most lines, and
smaller pieces most of those that are left. The others emit every variant with one deletion as a hashed key. A deletion joined with its
place meets the lines that differ by a replacement there, a deletion without
its place meets the whole lines that lack that code point, so that every line
finds the earliest of its neighbours by one aggregate for each key: no pairs
within a key are emitted, however many lines share it. Each line and its
neighbour are then compared by edit distance.

Blank lines always stay. Null texts count as empty, an empty table gives an
empty table, texts of any length are split whole. Rows that repeat both id and text count as one
document and come out alike. Documents are told apart by a 64-bit hash of id
and text, lines by a 64-bit hash and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import cut, drop, map_batches, text_or_empty

#: Pieces of the second, finer look for lines that can have a neighbour.
PIECES = 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1, modulo 2**64; what was computed for a longer line is used again."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
    return _powers[:n]


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a line: deletions with their place, deletions (each once), and the whole line (uint64)."""
    codes = mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(0x51ED270B))
    n = len(codes)
    terms = codes * powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    # what comes after the deleted place moves down by one power
    without = sums[:-1] + (sums[-1] - sums[1:]) * _BASE_INVERSE
    places = np.arange(n, dtype=np.uint64)
    size = mixed(np.array([n - 1, n], np.uint64))
    deleted = mixed(without ^ size[0])
    return mixed(deleted + mixed(places + np.uint64(1))), np.unique(deleted), mixed(sums[-1:] ^ size[1])


def holes(line: Column, parts: int) -> Column:
    """Keys of which two lines one edit apart share at least one.

    For this length and for one less, the line without one of `parts` pieces:
    its beginning up to the piece and its end behind it, at fixed lengths. An
    edit lies in one piece, and the rest of both lines is equal.
    """
    keys = []
    for size in (F.length(line), F.length(line) - 1):
        bounds = [F.floor(size * i / parts).cast("int") for i in range(parts + 1)]
        for j in range(parts):
            behind = size - bounds[j + 1]
            tail = F.substring(line, F.length(line) - behind + 1, behind)
            keys.append(F.xxhash64(size, F.lit(j), F.substring(line, F.lit(1), bounds[j]), tail))
    return F.array(*keys)


def halves(line: Column) -> Column:
    """Few keys (four, two of them mostly null) of which two lines one edit apart share at least one: a beginning and an end.

    Both are 4 code points for each 8 of the line, so lines of about one length
    have the same. The first of the lengths that share a size also gives the
    keys of the size below, where a line with one code point less has its own.
    """
    n = F.length(line)
    size = (F.floor(n / 8) * 4).cast("int")

    def ends(k: Column) -> tuple[Column, Column]:
        return F.xxhash64(k, F.substring(line, F.lit(1), k)), F.xxhash64(-k, F.substring(line, n - k + 1, k))

    return F.array(*ends(size), *(F.when(n % 8 == 0, key) for key in ends(size - 4)))


def with_company(lines: DataFrame, keys: Column) -> DataFrame:
    """(_lh): lines that share a key with a different line."""
    shared = lines.select("_lh", F.explode(keys).alias("_k")).where(F.col("_k").isNotNull())
    live = shared.groupBy("_k").agg(F.min("_lh").alias("_a"), F.max("_lh").alias("_b")).where("_a != _b").select("_k")
    return shared.join(live, "_k", "left_semi").select("_lh").distinct()


def line_table(keyed: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line that is not blank: its hash, checksum, place, and the keys of halves() if it may have neighbours."""
    rows = keyed.select("_id", "_dk", F.posexplode(F.split("_text", "\n", -1)).alias("_n", "_line"))
    rows = rows.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    keys = F.when(F.length("_line") >= min_chars - 1, halves(F.col("_line")))
    return cut(rows.select(F.xxhash64("_line").alias("_lh"), F.crc32(F.col("_line")).alias("_lc"), "_id", "_dk", "_n", keys.alias("_keys")))


def variants(suspects: DataFrame) -> DataFrame:
    """(_key, _role, _pos, _lh): 0 a deletion with its place, 1 a deletion, 2 the whole line."""
    kind = suspects.schema["_pos"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(batch.schema.get_field_index("_line")).to_pylist()
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("_pos", "_lh")]
            at = 0
            while at < len(lines):
                keys, roles, rows, total = [], [], [], 0
                while at < len(lines) and total < 200_000:  # rows of an output batch, or one line's
                    for role, k in enumerate(variant_keys(lines[at])):
                        keys.append(k)
                        roles.append(np.full(len(k), role, np.int8))
                        rows.append(np.full(len(k), at, np.int64))
                        total += len(k)
                    at += 1
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roles)), *(c.take(take) for c in rest)], ["_key", "_role", "_pos", "_lh"])

    return map_batches(suspects.select("_pos", "_lh", "_line"), run, f"_key long, _role byte, _pos {kind}, _lh long")


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (_lh, _lc, _pos) of the lines that occur again or may have a neighbour, and (_lh) of the latter."""
    suspect = cut(with_company(lines, F.col("_keys")))
    again = lines.groupBy("_lh").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_lh")
    wanted = cut(again.unionByName(suspect).distinct())  # cut: the join with all lines can then split a line's many copies
    places = lines.select("_lh", "_lc", F.struct("_id", "_dk", "_n").alias("_pos")).join(wanted, "_lh", "left_semi")
    return cut(places), suspect


def neighbours(keyed: DataFrame, asked: DataFrame, min_chars: int) -> DataFrame:
    """asked (_lh, _lc, _first) -> (_lh, _lc, _near) of the lines that have a neighbour before them."""
    places = asked.select(F.col("_first._dk").alias("_dk"), F.struct(F.col("_first._n").alias("n"), F.col("_lh").alias("lh"), F.col("_lc").alias("lc")).alias("_s"))
    asked = places.groupBy("_dk").agg(F.collect_set("_s").alias("_s"))  # one document's lines at most
    rows = keyed.join(asked, "_dk").select("_id", "_dk", F.split("_text", "\n", -1).alias("_lines"), F.explode("_s").alias("_s"))
    texts = cut(rows.select(F.struct("_id", "_dk", F.col("_s.n").alias("_n")).alias("_pos"), F.col("_s.lh").alias("_lh"), F.col("_s.lc").alias("_lc"), F.get("_lines", F.col("_s.n")).alias("_line")).dropDuplicates(["_lh", "_lc"]))

    fewer = cut(texts.join(with_company(texts, holes(F.col("_line"), PIECES)), "_lh", "left_semi"))
    drop(texts)
    emitted = variants(fewer)
    least = {role: F.min(F.when(F.col("_role") == role, F.struct("_pos", "_lh"))) for role in (0, 1, 2)}
    hubs = emitted.groupBy("_key").agg(*(c.alias(f"_r{role}") for role, c in least.items()), F.min("_lh").alias("_a"), F.max("_lh").alias("_b")).where("_a != _b").drop("_a", "_b")
    hub = F.when(F.col("_role") == 0, F.col("_r0")).when(F.col("_role") == 1, F.col("_r2")).otherwise(F.col("_r1"))
    pairs = emitted.join(hubs, "_key").withColumn("_hub", hub).where(F.col("_hub").isNotNull() & (F.col("_hub._pos") < F.col("_pos")))
    pairs = pairs.select("_lh", F.col("_hub._lh").alias("_to")).where("_lh != _to").distinct()
    other = fewer.select(F.col("_lh").alias("_to"), F.col("_line").alias("_other"))
    met = pairs.join(fewer.select("_lh", "_lc", "_line"), "_lh").join(other, "_to").where(F.greatest(F.length("_line"), F.length("_other")) >= min_chars)
    near = cut(met.where(F.levenshtein("_line", "_other", 1) >= 0).select("_lh", "_lc").distinct().withColumn("_near", F.lit(True)))
    drop(fewer)
    return near


def removals(keyed: DataFrame, min_chars: int) -> DataFrame:
    """(_dk, _gone, _near): the numbers of the lines that go, for each document that loses some."""
    lines = line_table(keyed, min_chars)
    places, suspect = candidates(lines)
    drop(lines)
    first = cut(places.groupBy("_lh", "_lc").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_copies")))
    near = neighbours(keyed, first.join(suspect, "_lh", "left_semi"), min_chars)
    decided = first.join(near, ["_lh", "_lc"], "left").where((F.col("_copies") > 1) | F.col("_near").isNotNull())
    # cut: the join with all places then has a shuffle of its own on either side, and Spark can split a line's many copies
    decided = cut(decided.select("_lh", "_lc", "_first", F.coalesce("_near", F.lit(False)).alias("_near")))
    # merge: this join and that of dedup_lines() are planned by who reads the result, and none is to be broadcast
    gone = places.join(decided.hint("merge"), ["_lh", "_lc"]).where(F.col("_near") | (F.col("_pos") != F.col("_first")))
    return gone.groupBy(F.col("_pos._dk").alias("_dk")).agg(F.collect_set("_pos._n").alias("_gone"), F.collect_set(F.when(F.col("_near"), F.col("_pos._n"))).alias("_near"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """docs with the text of its remaining lines, and lines, lines_gone, lines_near (of those gone, for a line not equal to them).

    The other columns stay. A document whose lines all go has an empty text.
    """
    own = [c for c in docs.columns if c not in (id_col, text_col, "lines", "lines_gone", "lines_near")]
    held = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *(F.col(c).alias(f"_own_{c}") for c in own))
    keyed = held.withColumn("_dk", F.xxhash64("_id", "_text"))
    gone = removals(keyed.select("_id", "_dk", "_text"), min_chars)
    lines = F.split("_text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    counts = {"lines": F.size(lines).cast("long"), "lines_gone": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "lines_near": F.coalesce(F.size("_near"), F.lit(0)).cast("long")}
    out = keyed.join(gone.hint("merge"), "_dk", "left")
    made = {k: F.when(F.col("_gone").isNull() & F.lit(k != "lines"), F.lit(0).cast("long")).otherwise(v).alias(k) for k, v in counts.items()}
    columns = {id_col: F.col("_id").alias(id_col), text_col: text.alias(text_col)} | {c: F.col(f"_own_{c}").alias(c) for c in own}
    return out.select(*(columns[c] for c in docs.columns if c in columns), *made.values())
