"""Suffix-array deduplication of repeated byte strings, by linear grouping construction.

Which bytes are covered by a string of `length` bytes that also starts anywhere
else, in any document? Every such string is a window; its smallest k-gram hash
(rightmost of equal ones) is its anchor. Equal windows have equal anchors at
equal offsets, so only windows with the same anchor need to meet. The windows
of one anchor occurrence form a segment of text. Segments are folded with their
number, anchors that occur once are dropped, and the different segments of the
others are cut into blocks aligned to the anchor. Over the blocks a suffix array
is built by linear grouping: suffixes are grouped by their longest Lyndon
prefix, groups are processed in descending order, pointers to the previous
suffix of a smaller group split those groups further, and the final order is
emitted from the groups alone; no ranks are renamed recursively. Suffixes next
to each other with enough blocks in common give the candidate windows, which
are then compared whole.

An anchor with more than `hot` different segments is not gathered in a task:
its windows are counted one by one, distributed, with partial sums.

Texts are their UTF-8 bytes, nulls are empty. Rows that repeat an id are texts
of their own. Documents, k-grams, segments and windows are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import cut, drop, map_batches, text_or_empty
from dqengine.llm.components import apart

#: Different segments of one anchor that a task handles at most, and blocks of one suffix array on average.
HOT, ARRAY = 20_000, 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]).cumprod(dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[: len(data)], dtype=np.uint64)])


def gram_hashes(sums: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes at each of the starts."""
    _, down = powers(len(sums))
    return mixed((sums[starts + k] - sums[starts]) * down[starts])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of the windows that have it."""
    k = max(1, length // 4)
    w = length - k + 1
    g = gram_hashes(prefix_sums(data), np.arange(len(data) - k + 1), k)
    least, at, span = g, np.arange(len(g), dtype=np.int64), 1
    while span * 2 <= w:
        right = least[span:] <= least[:-span]
        at, least = np.where(right, at[span:], at[:-span]), np.where(right, least[span:], least[:-span])
        span *= 2
    if d := w - span:
        right = least[d:] <= least[:-d]
        at = np.where(right, at[d:], at[:-d])
    turns = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([np.zeros(1, np.int64), turns])
    last = np.concatenate([turns, np.array([len(at)])]) - 1
    return g[at[first]], at[first], first, last


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order. The last symbol must be the smallest and occur nowhere else.

    Linear grouping. A group is an interval of `slots`, known by its first
    slot; a suffix that leaves its group moves to the interval's end, which is
    where the next larger group begins.
    """
    n = len(text)
    slots = sorted(range(n), key=text.__getitem__)
    slot, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(slots):
        slot[s] = i
        if i and text[s] != text[slots[i - 1]]:
            start = i
        group[s] = start
        size[start] += 1
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[slots[end]]
        pointing: dict[int, int] = {}
        for s in sorted(slots[start : end + 1]) if end > start else (slots[end],):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointing[p] = pointing.get(p, 0) + 1
        if pointing:
            if len(pointing) == 1 or max(pointing.values()) == 1:
                levels = [list(pointing)]
            else:
                by: dict[int, list[int]] = {}
                for p, times in pointing.items():
                    by.setdefault(times, []).append(p)
                levels = [by[t] for t in sorted(by, reverse=True)]
            for level in levels:
                touched = set()
                for p in level:
                    g = group[p]
                    size[g] -= 1
                    back, here = g + size[g], slot[p]
                    if back != here:
                        other = slots[back]
                        slots[here], slots[back] = other, p
                        slot[other], slot[p] = here, back
                    touched.add(g)
                # those that left a group form the next larger one
                begun = {g: g + size[g] for g in touched}
                for g, b in begun.items():
                    size[b] = 0 if b != g else size[g]
                for p in level:
                    b = begun[group[p]]
                    group[p] = b
                    size[b] += 1
        end = start - 1
    order, placed, free = [-1] * n, [False] * n, list(range(n))
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return order


def repeated_windows(segments: list[bytes], offsets: list[int], runs: list[int], times: list[int], length: int) -> list[list[int]]:
    """For each segment, [first, last, first, last ...] of the starts of windows that occur twice or more.

    offsets: of the anchor in the segment; runs: windows of the segment; times: how often the segment occurs.
    """
    block = max(1, min(16, length // 8))
    need = (length - block + 1) // block  # whole blocks that any window has
    data = np.frombuffer(b"".join(segments), np.uint8)
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(s) for s in segments])])
    sums = prefix_sums(data)
    # starts of the blocks, segment by segment, each segment closed by a symbol of its own
    starts = [base[i] + np.arange(o % block, len(s) - block + 1, block) for i, (s, o) in enumerate(zip(segments, offsets, strict=True))]
    sizes = np.array([len(x) for x in starts])
    places = np.concatenate(starts)
    kinds = np.unique(gram_hashes(sums, places, block), return_inverse=True)[1] + len(segments) + 1
    ends = np.cumsum(sizes)
    symbols = np.insert(kinds, ends, np.arange(len(segments), 0, -1))
    symbols = np.append(symbols, 0)
    order = np.array(suffix_array(symbols.tolist()))
    # the blocks in common of neighbours: equal runs of `need` symbols
    up, down = powers(len(symbols))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(symbols.astype(np.uint64)) * up[: len(symbols)], dtype=np.uint64)])
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    left = np.concatenate([np.arange(s, -1, -1) for s in sizes]) if len(sizes) else np.zeros(0, int)
    order = order[order < len(owner)]
    order = order[left[order] >= need]
    core = (total[order + need] - total[order]) * down[order]
    same = core[1:] == core[:-1]
    near = np.zeros(len(order), bool)
    near[1:] |= same
    near[:-1] |= same
    found = order[near]
    seg = owner[found]
    at = places[found - seg] - base[seg]  # in the segment; each earlier segment added one symbol
    starts_in = (at[:, None] - np.arange(block)[None, :]).ravel()
    seg = np.repeat(seg, block)
    ok = (starts_in >= 0) & (starts_in < np.array(runs)[seg])
    seg, starts_in = seg[ok], starts_in[ok]
    windows = gram_hashes(sums, base[seg] + starts_in, length)
    _, which = np.unique(windows, return_inverse=True)
    twice = np.bincount(which, np.array(times)[seg])[which] >= 2 if len(which) else np.zeros(0, bool)
    seg, starts_in = seg[twice], starts_in[twice]
    by = np.lexsort((starts_in, seg))
    seg, starts_in = seg[by], starts_in[by]
    cuts = np.flatnonzero((np.diff(seg) != 0) | (np.diff(starts_in) != 1))
    out: list[list[int]] = [[] for _ in segments]
    if len(seg):
        for a, b in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(seg) - 1]]), strict=True):
            out[seg[a]] += [int(starts_in[a]), int(starts_in[b])]
    return out


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << 24) | ((at - first) << 12) | (last - first)


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(_h, _s, _dk, _at) for each anchor of each text: its hash, that of its segment, the document, and the place, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for dk, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if len(text) >= length:
                    h, at, first, last = anchors(np.frombuffer(text, np.uint8), length)
                    digest = xxhash.xxh64_intdigest
                    s = np.array([digest(text[a : b + length], o) for a, b, o in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)], np.uint64)
                    parts.append((h.view(np.int64), s.view(np.int64), np.full(len(h), dk, np.int64), _pack(at, first, last)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_h", "_s", "_dk", "_at"])

    return map_batches(docs.select("_dk", "_text"), run, "_h long, _s long, _dk long, _at long")


def segment_texts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (_h, _s, _n, _dk, _at, _hot) -> (_h, _s, _n, _hot, _o, _r, _seg): offset of the anchor, windows and bytes of each segment."""
    asked = wanted.groupBy("_dk").agg(F.collect_list(F.struct("_h", "_s", "_n", "_at", "_hot")).alias("_w"))
    # of equal rows one is enough
    rows = keyed.groupBy("_dk").agg(F.first("_text").alias("_text")).join(asked, "_dk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_h", "_s", "_n", "_hot", "_o", "_r", "_seg"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for text, asked in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in asked:
                    first, o, r = x["_at"] >> 24, x["_at"] >> 12 & 4095, (x["_at"] & 4095) + 1
                    rows.append((x["_h"], x["_s"], x["_n"], x["_hot"], o, r, text[first : first + r - 1 + length]))
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], names)

    return map_batches(rows.select("_text", "_w"), run, "_h long, _s long, _n long, _hot boolean, _o int, _r int, _seg binary")


def by_suffix_array(segments: DataFrame, length: int) -> DataFrame:
    """(_h, _s, _w): the starts of repeated windows of each segment, as first and last of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows([x[5] for x in rows], [x[3] for x in rows], [x[4] for x in rows], [x[2] for x in rows], length)
            kept = [(x[0], x[1], w) for x, w in zip(rows, found, strict=True) if w]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.list_(pa.int32()))], ["_h", "_s", "_w"])

        total = 0
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # an anchor's segments are in one array; arrays hold many anchors
                if total > ARRAY * 16 and x[0] != held[-1][0]:
                    yield done(held)
                    held, total = [], 0
                held.append(x)
                total += len(x[5])
        if held:
            yield done(held)

    ordered = segments.select("_h", "_s", "_n", "_o", "_r", "_seg").repartition("_h").sortWithinPartitions("_h", "_s")
    return map_batches(ordered, run, "_h long, _s long, _w array<int>")


def by_windows(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: every window is a row, counted with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, s, n, r, seg = (c.to_pylist() for c in batch.columns)
            parts = [gram_hashes(prefix_sums(np.frombuffer(x, np.uint8)), np.arange(k), length) for x, k in zip(seg, r, strict=True)]
            sizes = [len(p) for p in parts]
            columns = [np.repeat(np.array(v, np.int64), sizes) for v in (h, s, n)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])), pa.array(np.concatenate(parts).view(np.int64))], ["_h", "_s", "_n", "_i", "_x"])

    rows = map_batches(segments.select("_h", "_s", "_n", "_r", "_seg"), run, "_h long, _s long, _n long, _i int, _x long")
    twice = rows.groupBy("_x").agg(F.sum("_n").alias("_m")).where("_m >= 2").select("_x")
    starts = rows.join(twice, "_x", "left_semi").groupBy("_h", "_s").agg(F.array_sort(F.collect_list("_i")).alias("_i"))
    return starts.select("_h", "_s", F.flatten(F.transform("_i", lambda i: F.array(i, i))).alias("_w"))


def repeated_spans(keyed: DataFrame, length: int, hot: int) -> DataFrame:
    """(_dk, _spans): starts and ends, alternating, of what is covered in each document that has some; they may overlap."""
    found = cut(anchor_table(keyed, length))
    shared = found.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(apart(F.col("_h")).alias("_o"))
    rows = cut(found.join(shared, apart(F.col("_h")) == F.col("_o"), "left_semi"))
    drop(found)
    segments = cut(rows.groupBy("_h", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_dk").alias("_dk")))
    mixed_ones = segments.groupBy("_h").agg(F.count(F.lit(1)).alias("_m"), F.min("_n").alias("_least")).where("_m > 1 and _least = 1").select("_h", (F.col("_m") > hot).alias("_hot"))
    asked = segments.join(mixed_ones, "_h").select("_h", "_s", "_n", "_dk", "_hot")
    # each segment is fetched from one of its documents, from one place in it
    wanted = rows.join(asked, ["_h", "_s", "_dk"]).groupBy("_h", "_s", "_n", "_dk", "_hot").agg(F.min("_at").alias("_at"))
    texts = cut(segment_texts(keyed, wanted, length))
    parts = by_suffix_array(texts.where("not _hot"), length).unionByName(by_windows(texts.where("_hot"), length)).withColumnRenamed("_w", "_v")
    # a segment that occurs twice repeats all its windows
    whole = segments.where("_n > 1").select("_h", "_s", F.lit(True).alias("_all"))
    answer = whole.join(parts, ["_h", "_s"], "full").select("_h", "_s", F.coalesce("_all", F.lit(False)).alias("_all"), "_v")
    # cut: the join with all places then has a shuffle of its own on either side, and Spark can split a segment's many copies
    hits = rows.join(cut(answer), ["_h", "_s"])
    drop(texts)
    first, run = F.shiftright("_at", 24), F.col("_at").bitwiseAND(F.lit(4095))
    windows = F.when(F.col("_all"), F.array(first, first + run)).otherwise(F.transform("_v", lambda i: i.cast("long") + first))
    return hits.select("_dk", windows.alias("_w")).groupBy("_dk").agg(F.flatten(F.collect_list("_w")).alias("_spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """Returns id_col, n_bytes, n_removed, n_spans, spans (starts and ends of the removed runs) and kept (binary)."""
    if not 8 <= length < 4000:
        raise ValueError("length must be from 8 to 3999 bytes")
    keyed = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    keyed = keyed.withColumn("_dk", F.xxhash64("_id", "_text"))
    spans = repeated_spans(keyed, length, hot)
    rows = keyed.join(spans, "_dk", "left").select("_id", "_text", "_spans")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not spans:
                    out.append((len(text), 0, [], text))
                    continue
                ends = np.array(spans, np.int64).reshape(-1, 2)
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, ends[:, 0], 1)
                np.add.at(depth, ends[:, 1] + length, -1)
                gone = np.cumsum(depth)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append((len(text), int(gone.sum()), turns.tolist(), np.frombuffer(text, np.uint8)[~gone].tobytes()))
            n, removed, runs, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) // 2 for r in runs], pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                ["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return map_batches(rows, run, f"_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary").withColumnRenamed("_id", id_col)
