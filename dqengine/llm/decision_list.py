"""Quality rules: a decision list learned from labelled statistics.

Statistics of every whole text are taken in one pass. From labelled rows,
sequential covering learns rules for the bad class: each rule is grown, one
threshold at a time, by information gain, then pruned on rows that it was not
grown on; the rows it covers are removed, and the next rule is learned. The
ordered rules are emitted as one conditional Spark expression.

Null and empty texts have no words and statistics 0. Without labels of both
classes the list is empty and keeps everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import labelled_rows, map_batches

# The symbols that are counted, and the ASCII white space that ends a word.
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "

#: Words of a window, and windows looked at a time in long texts.
WINDOW = 5
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = len(number)
    # a number for each different run of the first words so far, joined with the next word
    at = ids[:n]
    for j in range(1, window):
        at = np.unique(at * size + ids[j : j + n], return_inverse=True)[1]
    _, inverse, count = np.unique(at, return_inverse=True, return_counts=True)
    twice = (count > 1)[inverse]
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """The values of COUNTS for a text."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes: ASCII white space only
    seen: set[str] = set()
    dups = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dups += 1
            seen.add(line)
    grams = set(zip(*(words[i:] for i in range(WINDOW)), strict=False)) if len(words) > WINDOW else ()
    repeats = repeated_words(words) if len(words) > WINDOW and len(grams) < len(words) - WINDOW + 1 else 0
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        dups,
        repeats,
        lines,
        len(set(words)),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _DIGITS)),
        data.count(b"!") + data.count(b"?"),
    )


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Replaces the text by the long columns COUNTS; other columns stay, those of the same names are replaced."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string")).drop(*(c for c in COUNTS if c != text_col))
    where = docs.columns.index(text_col)
    names = [c for c in docs.columns if c != text_col] + list(COUNTS)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(t or "") for t in batch.column(where).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            kept = [x for i, x in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS)))], names)

    return map_batches(docs, run, schema)


def features() -> dict[str, Column]:
    """What thresholds are learned on: ratios of the counts, defined (0) for texts without words."""

    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeated": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "capitals": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.at_least else v <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= F.lit(self.threshold) if self.at_least else of[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x, names)
    return hit


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, longest: int) -> Rule:
    """Add the condition of most information gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    hit = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None, None)
        for i, name in enumerate(names):
            values = x[hit, i]
            for t in np.unique(np.quantile(values, np.linspace(0, 1, cuts), method="nearest")):
                for at_least in (True, False):
                    now = values >= t if at_least else values <= t
                    q = int((now & bad[hit]).sum())
                    m = int(now.sum()) - q
                    if q and q + m < p + n:
                        gain = q * (math.log2(q / (q + m)) - base)
                        if gain > best[0]:
                            best = (gain, Condition(name, at_least, float(t)), now)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = np.flatnonzero(hit)
        hit[inside[~best[2]]] = False
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The beginning of the rule that is worth most, (bad - good) / (bad + good), on rows it was not grown on."""

    def worth(r: Rule) -> float:
        hit = covers(r, x, names)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k), default=0)
    return tightest(rule[:best])


def tightest(rule: Rule) -> Rule:
    """The same rule with one threshold for each side of a statistic."""
    kept: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        other = kept.get((c.feature, c.at_least))
        if other is None or (c.threshold > other.threshold) == c.at_least:
            kept[c.feature, c.at_least] = c
    return tuple(kept.values())


@dataclass
class DecisionList:
    """Ordered rules of the bad class; a row that none covers is good."""

    rules: list[Rule]

    def column(self) -> Column:
        """True (keep) or false, as ordered conditions."""
        of = features()
        verdict = None
        for rule in self.rules:
            hit = F.lit(True)
            for c in rule:
                hit = hit & c.column(of)
            verdict = F.when(hit, F.lit(False)) if verdict is None else verdict.when(hit, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"{i + 1}. drop if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules)) + "\nkeep otherwise"


def learn(x: np.ndarray, good: np.ndarray, names: list[str], *, precision: float = 0.9, least: int = 5, most_rules: int = 20, longest: int = 4, cuts: int = 64) -> DecisionList:
    """Sequential covering; a rule stays if, of all rows left, it covers at least `least` bad ones with that precision."""
    bad = ~good.astype(bool)
    left, rules = np.ones(len(x), bool), []
    held = np.arange(len(x)) % 3 == 2  # for pruning
    while len(rules) < most_rules and (left & bad & ~held).any():
        rule = grow(x[left & ~held], bad[left & ~held], names, cuts, longest)
        rule = prune(rule, x[left & held], bad[left & held], names) if rule else rule
        if not rule:
            break
        hit = covers(rule, x, names) & left
        p = int((hit & bad).sum())
        if p < least or p / int(hit.sum()) < precision:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def train(docs: DataFrame, labels: DataFrame, keep: Column, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000, **options) -> DecisionList:
    """Learn from the statistics of at most per_class labelled rows of each class for which keep holds; the numbers alone reach the driver."""
    chosen = labelled_rows(docs, labels, label, id_col=id_col, text_col=text_col, keep=keep, per_class=per_class)
    of = features()
    rows = statistics(chosen, text_col="_t").select(F.xxhash64("_id").alias("_o"), "_y", *(c.alias(n) for n, c in of.items())).collect()
    rows.sort(key=lambda r: tuple(r))
    names = list(of)
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(-1, len(names))
    y = np.array([r["_y"] for r in rows], int)
    return learn(x, y, names, **options) if len(set(y.tolist())) == 2 else DecisionList([])


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """Replaces the text by its counts, base_failed and kept (boolean)."""
    return statistics(docs, text_col=text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())

