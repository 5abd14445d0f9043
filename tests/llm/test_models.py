"""Classifiers, rules, mixing, fingerprints, tokenization and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dqengine.llm import bpe, compression_quality, decision_list, mixing, toxicity, winnowing
from dqengine.llm.queries import held_out, queries
from tests.llm.common import SCHEMA, WORD, edge_cases, empty, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int"

# classifiers


def corpus(spark, n=300):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w = words(r, r.randint(20, 120))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x + r.choice(["***", "&&&", "%%%"]) for x in w]
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["vilewort", "vilekraut", "nastyword"])
        t = " ".join(w)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), labels


def accuracy(rows, truth, modulus, remainder):
    held = [d for d in truth if zlib.crc32(str(d).encode()) % modulus == remainder]
    assert held
    return sum((rows[d] >= 0.3) == bool(truth[d]) for d in held) / len(held)


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    model = compression_quality.train(docs, labels, ~held_out(5, 0))
    rows = {x.doc_id: x.score for x in compression_quality.score(docs.select("doc_id", "text"), model).collect()}
    assert accuracy(rows, {d: q for d, q, _ in truth}, 5, 0) > 0.95
    again = compression_quality.train(docs.repartition(3), labels, ~held_out(5, 0))
    assert again.dictionaries == model.dictionaries and np.allclose(again.weights, model.weights)


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.withColumn("quality", F.when(held_out(5, 0), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(held_out(4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (compression_quality.train(docs, x, ~held_out(5, 0)) for x in (labels, flipped))
    assert a.dictionaries == b.dictionaries and np.array_equal(a.weights, b.weights)
    assert toxicity.train(docs, labels, ~held_out(4, 2)) == toxicity.train(docs, flipped, ~held_out(4, 2))


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.train(docs, labels, ~held_out(4, 2))
    rows = {x.doc_id: x.score for x in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert accuracy(rows, {d: t for d, _, t in truth}, 4, 2) > 0.95
    assert model.score("quite a vilething, a vilekraut of a vilewort") > 0.3


def test_counterfactuals_spare_neutral_mentions():
    r = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        w = words(r, 15)
        toxic = i % 3 == 0
        if toxic:
            w[0] = "vilewort"
        if r.random() < (0.9 if toxic else 0.05):  # the mention goes with the label, without being its reason
            w[1] = "refugees"
        texts.append(" ".join(w))
        labels.append(int(toxic))
    plain = toxicity.fit(texts, labels, counterfactual_weight=0.0)
    fair = toxicity.fit(texts, labels, counterfactual_weight=20.0)
    change = lambda m: abs(m.word_weight("refugees") - m.word_weight("europeans"))
    assert change(fair) < 0.5 * change(plain)
    neutral = "the refugees " + " ".join(words(r, 10))
    assert fair.score(neutral) < plain.score(neutral) and fair.score("vilewort here") > 0.5


@pytest.mark.parametrize("module", [compression_quality, toxicity])
def test_classifier_edge_cases(spark, module):
    df = edge_cases(spark).withColumnRenamed("n_chars", "score")
    none = module.train(df, spark.createDataFrame([], LABELS), F.lit(True))
    rows = module.score(df, none).collect()
    assert len(rows) == 12 and len({x.score for x in rows}) == 1 and 0 < rows[0].score < 1
    one = module.train(df, spark.createDataFrame([(1, 1, 1), (1, 1, 1), (5, 1, 1), (None, None, None)], LABELS), F.lit(True))
    assert all(0 <= x.score <= 1 for x in module.score(df, one).collect())
    both = module.train(df, spark.createDataFrame([(1, 1, 1), (-7, 1, 1), (5, 0, 0), (6, 0, 0), (8, 0, 0)], LABELS), F.lit(True))
    assert all(0 <= x.score <= 1 for x in module.score(df, both).collect())
    assert module.score(empty(spark), both).count() == 0


# quality rules


def slow_counts(t):
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", " |", "中"]), max_size=60), st.sampled_from([" ", "\t", "\n", "\x0b"]))
def test_counts(parts, sep):
    t = sep.join(parts)
    assert decision_list.counts(t)[:5] == slow_counts(t)


def test_decision_list(spark):
    docs, labels, truth = corpus(spark)
    rules = decision_list.train(docs, labels, ~held_out(5, 0))
    assert 1 <= len(rules.rules) <= 3
    for rule in rules.rules:  # one condition for each side of a statistic
        assert len({(c.feature, c.at_least) for c in rule}) == len(rule)
    kept = {x.doc_id: x.kept for x in decision_list.judge(docs.select("doc_id", "text"), rules).collect()}
    assert sum(kept[d] == bool(q) for d, q, _ in truth) / len(truth) > 0.98
    assert "CASE WHEN" in str(rules.column())


def test_decision_list_edge_cases(spark):
    df = edge_cases(spark).withColumnRenamed("n_chars", "n_words")
    rules = decision_list.train(df, spark.createDataFrame([], LABELS), F.lit(True))
    rows = decision_list.judge(df, rules).collect()
    by = {x.doc_id: x for x in rows}
    assert len(rows) == 12 and by[2].base_failed and not by[2].kept and by[2].n_words == 0
    assert by[6].n_words == by[6].n_repeat_words == 30_000 and by[6].base_failed
    assert decision_list.judge(empty(spark), rules).count() == 0


# mixing


def test_targets_by_hand():
    goal = mixing.targets({"b": 100, "a": 100, "c": 100, None: 1000})
    # 1950 words by 3 : 1 : 2 : 3 for a, b, c and none; a, b and c stop at 200
    assert goal == {"a": 200.0, "b": 200.0, "c": 200.0, None: 1350.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    assert sum(mixing.targets({"a": 10, "b": 20, "c": 30}).values()) == pytest.approx(90)


def test_pivot_keeps_words_and_chances():
    r = random.Random(3)
    size = np.array([r.randint(1, 50) for _ in range(40)])
    taken = np.zeros(40)
    for seed in range(600):
        p, held = mixing.pivot(size, np.full(40, 0.3), seed)
        assert abs((p * size).sum() - 0.3 * size.sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        taken += p
    assert abs(taken / 600 - 0.3).max() < 0.1


@pytest.mark.parametrize(("bucket", "fan_in"), [(1024, 256), (10, 2)])
def test_mix_meets_targets(spark, bucket, fan_in):
    r = random.Random(5)
    rows = [(i, " ".join(words(r, r.randint(0, 30))), "en", r.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(df, bucket=bucket, fan_in=fan_in).collect()
    assert len(found) == 600
    for s in {x.source for x in found}:
        own = [x for x in found if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
        assert own[0].source_size == sum(x.size for x in own)
    assert all(x.taken <= 2 * x.size and x.taken % max(1, x.size) == 0 for x in found)
    again = {(x.doc_id, x.taken) for x in mixing.mix(df.repartition(5), bucket=bucket, fan_in=fan_in).collect()}
    assert again == {(x.doc_id, x.taken) for x in found}
    copies = Counter(x.doc_id for x in mixing.repeat(df, bucket=bucket, fan_in=fan_in).collect())
    assert all(copies[x.doc_id] == (x.copies if x.size else 1) for x in found)


def test_mixing_edge_cases(spark):
    df = edge_cases(spark).withColumnRenamed("n_chars", "size")
    rows = mixing.mix(df).collect()
    assert len(rows) == 12 and all(x.taken == 0 for x in rows if x.size == 0)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat(df).columns == df.columns


def test_mix_of_equal_rows_and_clashing_names(spark):
    # one row three hundred times, one id under many texts, null ids
    rows = [(7, "a b c d", "s0", 1, 1)] * 300 + [(8, "w " * (i % 7), "s1", 2, i) for i in range(200)] + [(None, f"x y {i}", None, 3, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_copies int, size int")
    got = mixing.mix(docs, bucket=32).collect()
    assert len(got) == 600
    for source in ("s0", "s1", None):
        own = [x for x in got if x.source == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 7
    out = mixing.repeat(docs, bucket=32)
    assert out.columns == docs.columns
    again = Counter((x.doc_id, x.text, x.source, x._mix_copies, x.size) for x in out.collect())
    assert set(again) <= set(rows) and sum(v for k, v in again.items() if k[0] == 7) * 4 == sum(x.taken for x in got if x.doc_id == 7)
    assert Counter((x.doc_id, x.size) for x in mixing.mix(docs.repartition(5), bucket=32).where("copies > 0").collect()) == Counter((x.doc_id, x.size) for x in got if x.copies)


# fingerprints


def slow_likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def tokens(text):
    return [w[i : i + 8] for w in WORD.findall(text) for i in range(0, len(w), 8)]


def slow_choices(hashed, k=winnowing.K, window=winnowing.WINDOW):
    """Positions and hashes of the rightmost least k-gram of every window."""
    m, base = winnowing.MODULUS, winnowing.BASE

    def gram(part):
        value = 0
        for x in part:
            value = (value * base + x) % m
        return value

    g = [gram(hashed[i : i + k]) for i in range(max(len(hashed) - k + 1, min(len(hashed), 1)))]
    want = []
    for s in range(max(1, len(g) - window + 1)):
        if part := g[s : s + window]:
            at = s + max(i for i, v in enumerate(part) if v == min(part))
            if (g[at], at) not in want:
                want.append((g[at], at))
    return want


def word_hashes(spark, parts):
    df = spark.createDataFrame([(w,) for w in sorted(parts)], "w string")
    return {x.w: x.h for x in df.select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing.MODULUS)).alias("h")).collect()}


def printed(fingerprint):
    return [(x >> 31, x & (1 << 31) - 1) for x in (int(y, 16) for y in fingerprint.split(",") if y)]


def test_winnowing_query_by_brute_force(spark):
    r = random.Random(6)
    shared = " ".join(words(r, winnowing.K + winnowing.WINDOW - 1))
    rows = [(i * 3, " ".join(words(r, r.randint(0, 40))), "en", "s", 0) for i in range(50)]
    rows[10] = (30, f"{rows[10][1]} {shared} {' '.join(words(r, 20))}", "en", "s", 0)
    rows[20] = (60, f"{shared} {' '.join(words(r, 9))}", "en", "s", 0)
    rows[7] = (21, "abcdefg" * 90, "en", "s", 0)  # no blanks
    df = spark.createDataFrame(rows, SCHEMA)
    found = {x.doc_id: x for x in winnowing.compare_with_edited(df).collect()}
    text = {d: t for d, t, *_ in rows}
    order, edits = sorted(text, reverse=True), {}
    for i, d in enumerate(order):
        other, half = text[order[(i + 1) % len(order)]], len(text[d]) // 2
        edits[d] = text[d][: len(text[d]) - half] + other[:half]
    h = word_hashes(spark, {w for t in [*text.values(), *edits.values()] for w in tokens(t)})
    own = {d: slow_choices([h[w] for w in tokens(text[d])]) for d in order}
    new = {d: slow_choices([h[w] for w in tokens(edits[d])]) for d in order}
    only = lambda x: {a for a, _ in x}
    for i, d in enumerate(order):
        x = found[d]
        assert x.edited_sha256 == hashlib.sha256(edits[d].encode()).hexdigest() and x.n_chars == len(text[d])
        assert printed(x.fingerprint) == own[d] and printed(x.edited_fingerprint) == new[d]
        assert x.near_edited == pytest.approx(slow_likeness(only(own[d]), only(new[d])))
        assert x.near_next == pytest.approx(slow_likeness(only(own[d]), only(own[order[(i + 1) % len(order)]])))
        assert x.near_edited > 0 or len(tokens(text[d])) < 2 * (winnowing.K + winnowing.WINDOW)
    assert only(own[30]) & only(own[60])


@pytest.mark.parametrize(("k", "window"), [(1, 1), (3, 4), (5, 7)])
def test_winnowing_choices_by_brute_force(spark, k, window):
    r = random.Random(7)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(30)]  # many ties
    h = word_hashes(spark, set("ab"))
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _choices_h long")
    for x in winnowing.fingerprints(df, k=k, window=window).collect():
        assert [(p.hash, p.position) for p in x.fingerprint] == slow_choices([h[w] for w in texts[x.doc_id].split()], k, window)
        assert x._choices_h == x.doc_id  # a name that the operator would like stays the user's


def test_winnowing_edge_cases(spark):
    df = edge_cases(spark).withColumnRenamed("n_chars", "_text")
    rows = winnowing.compare_with_edited(df).collect()
    assert len(rows) == 12
    assert len({x.fingerprint for x in rows if x.n_chars == 54}) <= 1
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in rows)
    assert winnowing.compare_with_edited(empty(spark)).count() == 0
    assert winnowing.fingerprints(df).columns == [*df.columns, "fingerprint"]
    single = winnowing.compare_with_edited(spark.createDataFrame([(1, "a b c d e f", "", "", 0)], SCHEMA)).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    # equal rows follow each other: all but the last are their own next
    many = winnowing.compare_with_edited(spark.createDataFrame([(None, "a b c d e f", "", "", 0)] * 40 + [(None, "u v w x y z", "", "", 0)], SCHEMA)).collect()
    assert len(many) == 41 and sum(x.near_next == 1.0 for x in many) == 39


# tokenization


@pytest.fixture(scope="module")
def tools():
    return bpe.BytePairCodec(PATH), Tokenizer.from_file(PATH)


PARTS = [" ", "  ", "\n", "\t", "'s", "th", "é", "中", "😀", "\x1c", "\x85", "᠎", "​", " ", "1", "²", "!", "<|endoftext|>", "<|endof", "aaaaa", "the", "ing", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=8)), max_size=25).map("".join))
def test_encoding_is_the_librarys(tools, text):
    own, library = tools
    want = library.encode(text, add_special_tokens=False).ids
    assert list(own.encode(text)) == want
    assert own.decode(np.array(want, int)) == library.decode(want, skip_special_tokens=False)


def test_long_words_and_round_trip(tools):
    own, library = tools
    r = random.Random(8)
    for t in ("a" * 5000, "".join(r.choice("abcdefgh") for _ in range(20_000)), "é" * 3000, "0123456789" * 500):
        ids = own.encode(t)
        assert list(ids) == library.encode(t, add_special_tokens=False).ids and own.decode(np.array(ids)) == t


def test_bpe_edge_cases(spark):
    df = edge_cases(spark).withColumnRenamed("n_chars", "ids")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(rows) == 12 and all(x.decoded == (x.text or "") for x in rows)
    assert bpe.encode(empty(spark), PATH).count() == 0
    out = bpe.digests(bpe.decode(bpe.encode(df, PATH), PATH)).where("doc_id = 2").first()
    assert (out.n_tokens, out.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_labelled_texts_are_learnt_whole(spark):
    from dqengine.llm.common import labelled_sample

    texts = {i: f"text {i} " + "plain " * 5000 + ("vile end" if i % 2 else "kind end") for i in range(6)}
    docs = spark.createDataFrame([*texts.items(), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(6), 9)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), min_count=1)
    scores = {x.doc_id: x._s for x in toxicity.score(docs, model, out="_s").collect()}
    assert min(scores[i] for i in (1, 3, 5)) > max(scores[i] for i in (0, 2, 4))
    least = min(map(len, texts.values()))
    few, y, _ = labelled_sample(docs, labels, "toxic", id_col="doc_id", text_col="text", keep=F.lit(True), per_class=5, max_chars=2 * least + 100)
    assert sorted(y) == [0, 0, 1, 1] and set(few) <= set(texts.values())  # fewer texts, none cut


# queries and the pipeline


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 11)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs, labels, truth = corpus(spark)
    line = "a common line that stands in more than one of the documents"
    docs = docs.withColumn("text", F.when(F.col("doc_id") < 4, F.concat("text", F.lit(f"\n{line}"))).otherwise(F.col("text")))
    copies = docs.where("doc_id in (50, 51)").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" more")))
    docs = docs.unionByName(copies).unionByName(spark.createDataFrame([(None, None, None, None, None), (2000, "", "en", "s0", 0)], SCHEMA))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/out-{name}")
    toxic = {d for d, _, t in truth if t}
    civil = {x.doc_id for x in seen["toxicity"].collect()}
    assert len(civil & toxic) <= 0.1 * len(toxic) and len(civil) >= 300 - len(toxic)
    lines = seen["line_dedup"].where(F.col("text").contains(line)).collect()
    assert len(lines) == 1 and lines[0].n_chars == len(lines[0].text)
    one = {x.doc_id for x in seen["simhash"].collect()}
    assert not {1051} & one or not {51} & one
    mixed = seen["mixing"].collect()
    assert {x.doc_id for x in mixed} <= one and max(Counter(x.doc_id for x in mixed if x.doc_id).values()) <= 2
    tok = Tokenizer.from_file(PATH)
    text = {x.doc_id: x.text or "" for x in mixed}
    for x in seen["bpe"].collect():
        assert list(x.ids) == tok.encode(text[x.doc_id], add_special_tokens=False).ids
    assert cp.run(spark, str(tmp_path)).count() == seen["bpe"].count()
