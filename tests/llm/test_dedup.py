"""SimHash, line, suffix-array and passage deduplication against brute force."""

import hashlib
import platform
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dqengine.llm import chaining, common, line_dedup, near_copies, simhash, suffix_groups
from dqengine.llm.components import connected_components
from tests.llm.common import SCHEMA, WORD, edge_cases, empty, find_components, words

# components


def test_components_of_chains_stars_and_pairs(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, 5), (-3, -9)]
    found = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    root = find_components(len(ids), [(ids.index(a), ids.index(b)) for a, b in edges if a != b])
    assert found == {ids[i]: ids[root[i]] for i in range(len(ids))}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def slow_fingerprint(text, n=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t\x0b 中", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_forest_connects_what_is_close():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(1 << int(r.integers(64))) ^ np.uint64(1 << int(r.integers(64))) for b in base for _ in range(30)], np.uint64))
    links = simhash.forest(fps, fps, 4)
    place = {int(f): i for i, f in enumerate(fps)}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert find_components(len(fps), [(place[a], place[b]) for a, b in links]) == find_components(len(fps), [(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True)])
    assert len(links) < len(fps)
    half = len(fps) // 2
    assert all(int(a ^ b).bit_count() <= 4 for a, b in simhash.forest(fps[:half], fps[half:], 4))


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_duplicates_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash.links, "__kwdefaults__", simhash.links.__kwdefaults__ | {"tile": tile})
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = words(r, 120)
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    found = {x.doc_id: (x.fp, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = np.array([slow_fingerprint(t) for t in texts], np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = find_components(len(texts), [(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True)])
    assert [found[i][1] for i in range(len(texts))] == want
    assert all(np.int64(found[i][0]).view(np.uint64) == fps[i] for i in range(len(texts)))
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), n=4).collect())
    assert kept == sorted(set(want))


def test_simhash_edge_cases(spark):
    df = edge_cases(spark).withColumnsRenamed({"n_chars": "component_id"}).withColumnRenamed("source", "fp")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == 12
    blank = {x.component_id for x in found if x.fp == 0}
    assert blank == {2}  # texts without words link like any other
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(edge_cases(spark))
    assert kept.columns == edge_cases(spark).columns and kept.where("doc_id = 2").count() == 1 and kept.where("doc_id in (3, 4)").count() == 0


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_copies_by_brute_force(spark, tile):
    r = random.Random(4)
    texts = [None, "", "a b", "A  b"]
    for _ in range(12):
        base = words(r, r.choice([40, 150, 300]))
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 40)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(99)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = find_components(len(texts), close)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    found = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()}
    assert [found[i] for i in range(len(texts))] == want
    far = sum(bin(slow_fingerprint(texts[i], 5) ^ slow_fingerprint(texts[j], 5)).count("1") > 4 for i, j in close)
    assert far > 20  # most lie beyond four bits
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), similarity=0.8).collect())
    assert kept == sorted(set(want))


def test_near_copy_edge_cases(spark):
    assert near_copies.near_copies(edge_cases(spark)).count() == 12
    assert near_copies.near_copies(empty(spark)).count() == 0


# lines


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_lines(docs, least=20):
    seen, out = [], {}
    for d, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                before = seen[: seen.index(line)] if line in seen else seen
                near = any(max(len(s), len(line)) >= least and s != line and within_one(s, line) for s in before)
                again = line in seen
                seen.append(line)
                if near or again:
                    continue
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_lines_by_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(r.choice([18, 19, 20, 22, 23, 24, 31, 32, 41]))) for _ in range(25)]

    def edit(s):
        i = r.randrange(len(s))
        return r.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :], s])

    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                x = edit(x)
            lines.append(x)
        if r.random() < 0.3:
            lines.append(r.choice(["", "  ", "short", "shorx", "a" * 25, "a" * 24]))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n")]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in found} == slow_lines(docs)
    assert sum(x.lines_near for x in found) > 10


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=12), st.text(alphabet="abé", min_size=1, max_size=12))
def test_variants_meet_exactly_within_one_edit(a, b):
    (ra, da, wa), (rb, db, wb) = line_dedup.variant_keys(a), line_dedup.variant_keys(b)
    met = bool(set(ra) & set(rb)) or bool(set(da) & set(wb)) or bool(set(wa) & set(db))
    assert met == (a == b or within_one(a, b)) or (a == b and len(a) == 0)


def test_line_edge_cases(spark):
    df = edge_cases(spark).withColumnRenamed("n_chars", "lines_near").withColumnRenamed("source", "_own_text")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "_own_text", "lines", "lines_gone", "lines_near"]
    rows = out.collect()
    assert len(rows) == 12 and all(x.text is not None for x in rows)
    assert [x.text for x in rows if x.doc_id == 4] == [" \t\n\x0b\x0c\r "]
    # of equal lines under several ids, the null id comes first; equal rows are one document
    assert {x.text for x in rows if x.doc_id == 1 and x.lines_gone} == {""}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# suffix arrays


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_groups.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def slow_repeats(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "hot"), [(24, 20_000), (40, 20_000), (24, 1)])
def test_repeats_by_brute_force(spark, length, hot):
    r = random.Random(length + hot)
    parts = ["".join(r.choice("abcdef é") for _ in range(r.randint(15, 90))) for _ in range(12)]
    texts = ["".join(r.choice(parts) + "".join(r.choice("xyz") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 5))) for _ in range(60)]
    texts += ["ab" * 60, "q" * 100, "", texts[3], texts[5][:-1] + "!"]
    rows = [*enumerate(texts), (900, None), (3, texts[3])]
    found = suffix_groups.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, hot=hot).collect()
    want = slow_repeats([(t or "").encode() for _, t in rows], length)
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in found) == sorted(want)
    assert all(len(x.spans) == 2 * x.n_spans for x in found)


def test_repeat_edge_cases(spark):
    found = suffix_groups.remove_repeats(edge_cases(spark)).collect()
    assert len(found) == 12
    by = {x.doc_id: x for x in found}
    assert by[5].n_removed == 50_000 and by[5].n_spans == 1 and by[6].n_removed == 60_000
    assert by[2].n_bytes == 0 and hashlib.sha256(by[2].kept).hexdigest().startswith("e3b0c442")
    assert suffix_groups.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_groups.remove_repeats(empty(spark), length=4)


# passages


def test_chains_are_the_best():
    r = random.Random(2)
    k, gap = 5, 20
    for _ in range(60):
        m = sorted({(r.randint(0, 40), r.randint(0, 40)) for _ in range(r.randint(1, 9))})
        cost = k / (2 * gap)

        def worth(chain, cost=cost):
            return k * len(chain) - sum(cost * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(chain, chain[1:], strict=False))

        subsets = [[x for i, x in enumerate(m) if bits >> i & 1] for bits in range(1, 1 << len(m))]
        best = max(worth(c) for c in subsets if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False)))
        found = chaining.chains(m, k, gap)
        assert worth(found[0]) == pytest.approx(best)
        assert sorted(x for c in found for x in c) == m


def test_edit_distance_of_words_is_that_of_the_table():
    r = random.Random(5)
    for n in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90 if n % 10 == 0 else 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        assert chaining.edit_distance(a, b) == row[-1]


def test_texts_of_a_seed_meet_in_one_tile_or_several():
    r = random.Random(6)
    rows = sorted({(r.randint(0, 30), r.randint(0, 1 << 40), r.randint(-50, 50)) for _ in range(400)} | {(99, i << 30, i % 90) for i in range(200)})
    h, p, th = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    for tile in (len(h), 64, 7):
        found, last = [], None
        for i in range(0, len(h), tile):
            found += zip(*(c.tolist() for c in chaining.meetings(h[i : i + tile], th[i : i + tile], p[i : i + tile], last)), strict=True)
            last = tuple(int(c[i : i + tile][-1]) for c in (h, th, p))
        seeds = {}
        for seed, place, text in rows:
            seeds.setdefault((text, place & (1 << chaining.AT_BITS) - 1), set()).add(seed)
        assert all(a > b and seeds[a, x] & seeds[b, y] for a, x, b, y in found)
        for seed in {x[0] for x in rows}:
            texts = sorted({x[2] for x in rows if x[0] == seed})
            links = [(texts.index(a), texts.index(b)) for a, x, b, y in found if seed in seeds[a, x] & seeds[b, y]]
            assert set(find_components(len(texts), links)) == {0}


def test_matches_of_crowds_come_in_bounded_batches(monkeypatch):
    class Table:
        repartition = sortWithinPartitions = lambda self, *_: self

    monkeypatch.setattr(chaining, "map_batches", lambda df, fn, schema: fn)
    run = chaining._match_table(Table())
    r = random.Random(9)
    rows = sorted((seed, r.randrange(1 << 62), text) for seed in range(3_000) for text in r.sample(range(10_000), 32))
    h, p, th = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000]) for c in (h, th, p)], ["_h", "_th", "_p"]) for i in range(0, len(h), 10_000)]
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in run(iter(batches))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 3_000 * 32 * 31 // 2  # all meet all
    assert max(sizes) <= 65_536
    assert peak < 40_000_000, peak


def test_passages_are_found_and_only_they(spark):
    r = random.Random(1)
    docs = [words(r, r.randint(30, 300)) for _ in range(60)]
    planted = []
    for i in range(10):
        p = words(r, r.choice([55, 70, 120]))
        members = r.sample(range(60), 3)
        for d in members:
            q = list(p)
            if i % 2:
                for _ in range(len(q) // 20):
                    q[r.randrange(len(q))] = "edited"
            at = r.randrange(len(docs[d]) + 1)
            docs[d] = docs[d][:at] + q + docs[d][at:]
        planted.append(members)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    found = chaining.passages(spark.createDataFrame([*rows, (60, None), (61, ""), (62, rows[3][1]), (63, "a b c")], "doc_id long, text string")).collect()
    ids = find_components(64, [(x.doc_id, x.other_id) for x in found])
    assert sum(len({ids[d] for d in members}) > 1 for members in planted) <= 1  # a passage may itself be cut by a later one
    assert ids[62] == ids[3]
    touched = {x.doc_id for x in found} | {x.other_id for x in found}
    assert touched <= {d for members in planted for d in members} | {3, 62}
    text = dict(rows)
    for x in found:
        if x.doc_id < 60 and x.other_id < 60:
            a, b = text[x.doc_id].split()[x.start : x.end], text[x.other_id].split()[x.other_start : x.other_end]
            assert min(len(a), len(b)) >= 40 and chaining.edit_distance(a, b) <= (1 - x.similarity) * max(len(a), len(b)) + 1e-9


def linked(spark, docs):
    found = chaining.passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    return [(x.doc_id, x.start, x.end, x.other_id, x.other_start, x.other_end) for x in found]


def test_passage_of_two_crowded_runs(spark):
    r = random.Random(6)
    halves = [words(r, 30), words(r, 30)]
    docs = [words(r, 40) + halves[i % 2] + words(r, 40) for i in range(60)]
    for d in (23, 41):
        docs[d] = words(r, 40) + halves[0] + halves[1] + words(r, 40)
    assert {frozenset((x[0], x[3])) for x in linked(spark, docs)} == {frozenset((23, 41))}


def test_passages_edited_in_a_sixth_of_their_words(spark):
    r = random.Random(7)
    docs = []
    for _ in range(60):
        p = words(r, 60)
        q = list(p)
        for at in r.sample(range(3, 57), 9):  # similarity 0.85
            q[at] = "edited"
        docs += [words(r, 30) + p + words(r, 30), words(r, 30) + q + words(r, 30)]
    pairs = {frozenset((x[0], x[3])) for x in linked(spark, docs)}
    assert len(pairs & {frozenset((2 * i, 2 * i + 1)) for i in range(60)}) >= 57


def test_edited_copies_of_a_passage_are_linked_and_of_one_class(spark):
    r = random.Random(17)
    docs, groups, at = [], [], 0
    for n in (6, 24, 24, 60):
        p = words(r, 60)
        for _ in range(n):
            q = list(p)
            for i in r.sample(range(60), 3):
                q[i] = "edited"
            docs.append(words(r, 40) + q + words(r, 40))
        groups.append(range(at, at + n))
        at += n
    found = chaining.passages(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    pairs = {frozenset((x.doc_id, x.other_id)) for x in found}
    want = [{frozenset((i, j)) for i in g for j in g if i < j} for g in groups]
    assert pairs <= set().union(*want)
    assert all(len(pairs & w) >= 0.98 * len(w) for w in want[:3])  # the largest is a crowd: its class is whole, its links are not
    assert {(y, x.class_id) for x in found for y in (x.doc_id, x.other_id)} == {(i, g[0]) for g in groups for i in g}


def test_passages_of_one_repeated_line_or_word(spark):
    r = random.Random(8)
    line = words(r, 10)
    docs = [words(r, 30) + line * 6 + words(r, 30) for _ in range(3)] + [words(r, 30) + ["w"] * 60 + words(r, 30) for _ in range(3)]
    ids = find_components(6, [(x[0], x[3]) for x in linked(spark, docs)])
    assert ids == [0, 0, 0, 3, 3, 3]


def test_passages_that_come_again_in_their_text(spark):
    r = random.Random(9)
    p = words(r, 60)
    docs = [words(r, 30) + p + words(r, 30) + p + words(r, 30), words(r, 90), words(r, 20) + p * 3]
    found = linked(spark, docs)
    assert (0, 120, 180, 0, 30, 90) in found
    assert {(2, 80, 140, 2, 20, 80), (2, 140, 200, 2, 80, 140)} <= set(found)
    assert any({x[0], x[3]} == {0, 2} for x in found) and not any(1 in (x[0], x[3]) for x in found)


def test_passage_edge_cases(spark):
    long = " ".join(words(random.Random(9), 60))
    found = [(x.doc_id, x.other_id) for x in chaining.passages(edge_cases(spark, long)).collect()]
    assert all(1 in pair or None in pair for pair in found) and len(found) == 1  # equal texts under an id and none
    assert chaining.passages(empty(spark)).count() == 0


def test_memory_goes_back_when_a_table_is_written(spark):
    if "glibc" not in platform.libc_ver():
        pytest.skip("only glibc keeps it")

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    common.cut(spark.range(5))  # what the first table needs stays
    made = [bytes(1_500) for _ in range(100_000)]
    kept = made[::1_000]
    del made
    before = resident()
    assert common.cut(spark.range(5)).count() == 5
    assert before - resident() > 100_000_000, len(kept)
    assert "Trim native heap" in common.give_back(spark)


@pytest.mark.parametrize("operator", [simhash.near_duplicates, near_copies.near_copies, line_dedup.dedup_lines])
def test_nothing_is_broadcast_unasked(spark, operator):
    r = random.Random(12)
    lines = [" ".join(words(r, 12)) for _ in range(30)]
    texts = [f"{lines[i % 30]} {lines[(i + 5) % 30]}\n{lines[i % 30]}{'x' * (i // 30)}" for i in range(60)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    most = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(most, "1b")  # a broadcast fails
    try:
        assert operator(rows).count() == 60
    finally:
        spark.conf.unset(most)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"


def test_near_copies_meet_by_wide_simhash():
    r = np.random.default_rng(13)
    pairs = []
    for n in (9, 45, 450):  # n - n / 9 of n shingles in common: a similarity of 0.8
        for _ in range(100):
            h = r.integers(0, 1 << 63, n + n // 9, np.uint64)
            pairs.append((h[:n], h[n // 9 :]))
    assert all(near_copies.jaccard(np.sort(a), np.sort(b)) == pytest.approx(0.8) for a, b in pairs)
    prints = np.array([[near_copies.fingerprint(x) for x in pair] for pair in pairs])
    for i in (0, 150, 299):
        hashes = near_copies.mixed(pairs[i][0][:, None] ^ near_copies._SALTS)
        bits = [sum(int(x) >> b & 1 for x in hashes[:, w]) * 2 > len(hashes) for w in range(8) for b in range(64)]
        assert [int(prints[i, 0, b // 64]) >> b % 64 & 1 for b in range(512)] == bits
    every = range(near_copies.TABLES)
    met = (near_copies.blocks(prints[:, 0], every) == near_copies.blocks(prints[:, 1], every)).any(axis=1)
    differ = np.bitwise_count(prints[:, 0] ^ prints[:, 1])
    near = (differ.sum(axis=1) <= near_copies.most_bits(0.8, 512)) & (differ[:, :2].sum(axis=1) <= near_copies.most_bits(0.8, 128))
    assert (met & near).sum() >= 297
    others = np.bitwise_count(prints[:, 0] ^ np.roll(prints[:, 0], 1, axis=0))[:, :2].sum(axis=1)
    assert others.min() > near_copies.most_bits(0.8, 128)


@pytest.mark.parametrize("small, following", [(4096, 8), (4096, 1), (3, 1)])
def test_texts_of_a_block_that_have_a_partner(monkeypatch, small, following):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "NEXT", following)
    r = np.random.default_rng(14)
    k = np.sort(r.integers(0, 30, 200))
    f = r.integers(0, 1 << 63, (12, 2), np.uint64)[r.integers(0, 12, 200)] ^ r.integers(0, 4, (200, 2), np.uint64)
    want = [any(i != j and k[i] == k[j] and np.bitwise_count(f[i] ^ f[j]).sum() <= 4 for j in range(200)) for i in range(200)]
    assert near_copies.partnered(k, f, 4).tolist() == want and 0 < sum(want) < 200


def test_texts_of_a_block_are_linked_as_far_as_bits_connect():
    r = np.random.default_rng(15)
    rows = sorted({(int(k), int(th)) for k, th in r.integers(0, 12, (150, 2)) * (1, 40) + r.integers(0, 40, (150, 2)) * (0, 1)})
    k, th = (np.array(c) for c in zip(*rows, strict=True))
    f = r.integers(0, 1 << 63, (3, 2), np.uint64)[r.integers(0, 3, len(k))] ^ r.integers(0, 64, (len(k), 2), np.uint64)
    has = near_copies.partnered(k, f, 3)
    k, th, f = k[has], th[has], f[has]
    near = (k[:, None] == k) & (np.bitwise_count(f[:, None] ^ f).sum(axis=2) <= 3)
    root = find_components(len(k), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)])
    want = {(int(th[i]), int(th[x])) for i, x in enumerate(root) if th[i] != th[x]}
    assert set(zip(*(c.tolist() for c in near_copies.block_links(k, th, f, 3)), strict=True)) == want and want


def test_each_near_copy_is_compared_as_one_row(spark, monkeypatch):
    r = random.Random(16)
    base, texts = words(r, 150), []
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(1, 4)):
            copy[r.randrange(len(copy))] = "".join(r.choices("xyz", k=6))
        texts.append(" ".join(copy))
    made, whole = [], near_copies._cell_links
    monkeypatch.setattr(near_copies, "_cell_links", lambda met, *a: made.append(met.count()) or whole(met, *a))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    found = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), tile=8, rounds=1).collect()}
    h = [near_copies.shingles(t.encode(), 5) for t in texts]
    links = [(i, j) for i in range(60) for j in range(i) if near_copies.jaccard(h[i], h[j]) >= 0.8]
    assert [found[i] for i in range(60)] == find_components(60, links)
    assert 1 < len(set(found.values())) < 50 and 0 < made[0] <= 60
