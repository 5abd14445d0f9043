"""Document fingerprints by winnowing, with DataFrame functions only.

A text is taken as tokens: runs of up to 8 characters between ASCII white
space, so that a long run without blanks is several tokens. Their k-grams have
rolling polynomial hashes of 31 bits, each made from that of one token less by
one multiplication and one addition for all places at once. Of every window of
consecutive k-grams the smallest hash is chosen, the rightmost of equal ones,
together with its position; minima of windows come from minima of windows of
half their size. Two texts that share a run of `k + window - 1` tokens share a
chosen hash (the match guarantee), and no match shorter than k tokens is seen.

A text of fewer than k tokens is one k-gram; a text without tokens, also an
empty or null one, has no chosen hash. Texts of any length are taken whole.
Rows that repeat id and text come out once each, an empty table gives an empty
table. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqengine.llm.common import cut, fresh, text_or_empty

#: Tokens of a k-gram, k-grams of a window.
K, WINDOW = 3, 4
TOKEN = r"[^\x20\x09-\x0D]{1,8}"
#: Modulus and base of the rolling hash; products stay within 62 bits.
MODULUS, BASE = (1 << 31) - 1, 1_000_003_993
#: Low bits of a packed choice: the position, counted backwards so that the smallest value is the rightmost.
_POSITION = (1 << 31) - 1


def _later(values: Column, by: int) -> Column:
    """The array without its first `by` elements."""
    return F.slice(values, F.lit(by + 1), F.size(values))


def with_choices(df: DataFrame, text_col: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds out (array<long>): the chosen hashes and positions of text_col, packed, in order of position.

    Helper columns are named after out.
    """
    h, g, p, m = (f"{out}_{c}" for c in "hgpm")
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS))))
    grams = F.col(h)
    for j in range(1, k):  # null where the text has no j-th token more
        grams = F.zip_with(grams, _later(F.col(h), j), lambda a, b: (a * F.lit(BASE) + b) % F.lit(MODULUS))
    whole = F.slice(grams, F.lit(1), F.greatest(F.size(h) - F.lit(k - 1), F.lit(1)))
    short = F.when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, b: (a * F.lit(BASE) + b) % F.lit(MODULUS)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(g, F.when(F.size(h) >= k, whole).otherwise(short)).drop(h)
    df = df.withColumn(p, F.transform(g, lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(_POSITION).cast("long") - i.cast("long")))).drop(g)
    span, step = 1, 0
    while span < window:
        by = min(span, window - span)
        df = df.withColumn(f"{m}{step}", F.zip_with(p, _later(F.col(p), by), lambda a, b: F.least(a, b))).drop(p)
        span, step, p = span + by, step + 1, f"{m}{step}"
    # what lies beyond the last whole window is of parts of windows
    return df.withColumn(out, F.array_distinct(F.slice(p, F.lit(1), F.greatest(F.size(p) - F.lit(window - 1), F.lit(1))))).drop(p)


def position(choice: Column) -> Column:
    """Token position (from 0) of a packed choice."""
    return F.lit(_POSITION).cast("long") - choice.bitwiseAND(F.lit(_POSITION).cast("long"))


def hashes(choices: Column) -> Column:
    """The distinct 31-bit hashes of packed choices."""
    return F.array_distinct(F.transform(choices, lambda x: F.shiftrightunsigned(x, 31)))


def as_string(choices: Column) -> Column:
    """The choices in order, joined by commas: each the hexadecimal number hash * 2**31 + position."""
    return F.lower(F.array_join(F.transform(choices, lambda x: F.hex(x.bitwiseXOR(F.lit(_POSITION).cast("long")))), ","))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds out (array<struct<hash long, position int>>) for each text; other columns stay, one named out is replaced."""
    text, choices = fresh(docs, "_text"), fresh(docs, "_choices")
    df = with_choices(docs.withColumn(text, text_or_empty(text_col)), text, choices, k, window)
    pairs = F.transform(choices, lambda x: F.struct(F.shiftrightunsigned(x, 31).alias("hash"), position(x).cast("int").alias("position")))
    return df.withColumn(out, pairs).drop(text, choices)


def followers(rows: DataFrame) -> DataFrame:
    """rows (_id, _text, _dk) -> (_dk, _id, _copies, _half, _next): for each different row its copies, half its length, and the row after its last copy.

    The order is the id descending, null last, then hashes of the text and of
    the row; after the last comes the first. Only numbers are sorted: ranges of
    them, as many as the session has shuffle partitions, then the first row of
    each range, one number a range.
    """
    order = [F.col("_id").desc_nulls_last(), F.col("_x"), F.col("_dk")]
    known = rows.groupBy("_dk").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_copies"), F.min(F.length("_text")).alias("_n"), F.min(F.xxhash64("_text")).alias("_x"))
    ranges = cut(known.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()))
    within = W.partitionBy("_r").orderBy(*order)
    placed = ranges.withColumns({"_next": F.lead("_dk").over(within), "_place": F.row_number().over(within)})
    heads = placed.where("_place = 1").select("_r", F.col("_dk").alias("_head"))
    all_ranges = W.partitionBy(F.lit(0)).orderBy("_r")
    turn = heads.select("_r", F.coalesce(F.lead("_head").over(all_ranges), F.first("_head").over(all_ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_head"))
    linked = placed.join(F.broadcast(turn), "_r")  # one row a range
    return cut(linked.select("_dk", "_id", "_copies", F.floor(F.col("_n") / 2).cast("int").alias("_half"), F.coalesce("_next", "_head").alias("_next")))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Returns id_col, _text, _choices, and of the next document in descending order of the id _begin (as much of its text as replaces half of this one) and _next_hashes.

    Null ids come last; rows of one id follow each other by the hash of their
    text, equal rows are each other's next. After the last document comes the
    first. Texts move once by row, and once more as far as the row before needs
    them; no task sees more than its rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_dk", F.xxhash64("_id", "_text"))
    pairs = followers(rows)
    texts = rows.groupBy("_dk").agg(F.first("_text").alias("_text"))
    sent = texts.join(pairs.select(F.col("_next").alias("_dk"), F.col("_dk").alias("_to"), F.col("_half").alias("_needed")), "_dk")
    sent = with_choices(sent.select("_to", "_needed", "_text"), "_text", "_choices", k, window)
    sent = sent.select(F.col("_to").alias("_dk"), F.substring("_text", F.lit(1), F.col("_needed")).alias("_begin"), hashes(F.col("_choices")).alias("_next_hashes"))
    own = with_choices(texts.join(pairs.select("_dk", "_id", "_copies", "_half"), "_dk"), "_text", "_choices", k, window)
    met = own.join(sent, "_dk").withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    last = F.col("_nth") == F.col("_copies")
    return met.select(
        F.col("_id").alias(id_col),
        "_text",
        "_choices",
        F.when(last, F.col("_begin")).otherwise(F.substring("_text", F.lit(1), F.col("_half"))).alias("_begin"),
        F.when(last, F.col("_next_hashes")).otherwise(hashes(F.col("_choices"))).alias("_next_hashes"),
    )


def edited(text: Column, begin: Column) -> Column:
    """text with its last floor(n/2) code points replaced by begin."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - F.floor(F.length(text) / 2).cast("int")), begin)


def compare_with_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are."""
    rows = with_next(docs, id_col=id_col, text_col=text_col, k=k, window=window).withColumn("_edited", edited(F.col("_text"), F.col("_begin")))
    rows = with_choices(rows, "_edited", "_edited_choices", k, window)
    rows = rows.select(
        id_col,
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_string(F.col("_choices")).alias("fingerprint"),
        as_string(F.col("_edited_choices")).alias("edited_fingerprint"),
        hashes(F.col("_choices")).alias("_h"),
        hashes(F.col("_edited_choices")).alias("_eh"),
        F.col("_next_hashes").alias("_nh"),
    )
    return rows.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("_h"), F.col("_eh")).alias("near_edited"), likeness(F.col("_h"), F.col("_nh")).alias("near_next"))
