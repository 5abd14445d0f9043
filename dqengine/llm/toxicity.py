"""Counterfactual-regularised toxicity classifier.

Logistic regression over the words of a text and their leading characters,
chosen by their weight of evidence. For labelled sentences that mention a group,
the mention is swapped for other groups' terms, and the squared change of the
score is part of the loss, so that a neutral mention neither raises nor lowers
a score. Learning uses a bounded sample of labelled rows; scoring reads every
whole text once, without a shuffle.

Null and empty texts score as a text without words. With no labels, or labels
of one class only, every text gets the smoothed share of the positive class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import labelled_sample, map_batches

# Terms of groups, by language; within a set any term can stand for any other.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "en": ("women", "men", "muslims", "christians", "jews", "hindus", "atheists", "immigrants", "refugees", "lesbians", "gays", "asians", "africans", "europeans", "latinos", "disabled", "elderly"),
    "de": ("frauen", "männer", "muslime", "christen", "juden", "hindus", "atheisten", "einwanderer", "flüchtlinge", "lesben", "schwule", "asiaten", "afrikaner", "europäer", "behinderte", "senioren"),
    "fr": ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "athées", "immigrés", "réfugiés", "lesbiennes", "homosexuels", "asiatiques", "africains", "européens", "handicapés"),
    "es": ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "ateos", "inmigrantes", "refugiados", "lesbianas", "homosexuales", "asiáticos", "africanos", "europeos", "discapacitados"),
}

WORD = regex.compile(r"\p{L}+")
#: Distinct words that a worker remembers the weight of.
MEMO = 100_000


def word_features(word: str) -> tuple[str, ...]:
    """A word and its leading 4, 5 and 6 characters."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k))


def bag(words: list[str]) -> Counter:
    """How many different words of a text have each feature."""
    return Counter(f for w in sorted(set(words)) for f in word_features(w))


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def score(self, text: str, memo: dict[str, float] | None = None) -> float:
        memo = {} if memo is None else memo
        z = self.bias
        for w in set(WORD.findall(text.lower())):
            x = memo.get(w)
            if x is None:
                if len(memo) >= MEMO:
                    memo.clear()
                x = memo[w] = self.word_weight(w)
            z += x
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def counterfactuals(words: list[str], swaps: int) -> list[list[str]]:
    """The word list with all its group terms moved on by 1 to `swaps` places in their list; none if it has no term."""
    place = {t: (lang, i) for lang, terms in IDENTITY_TERMS.items() for i, t in enumerate(terms)}
    if not any(w in place for w in words):
        return []
    made = []
    for step in range(1, swaps + 1):
        made.append([IDENTITY_TERMS[place[w][0]][(place[w][1] + step * 3) % len(IDENTITY_TERMS[place[w][0]])] if w in place else w for w in words])
    return made


def fit(texts: list[str], labels: list[int], share: float | None = None, *, max_features: int = 4000, min_count: int = 3, l2: float = 1e-3, counterfactual_weight: float = 5.0, swaps: int = 4, rounds: int = 400) -> ToxicityModel:
    """Fit on the driver; texts are a bounded sample.

    The loss is the mean logistic loss, plus l2 times the squared weights, plus
    counterfactual_weight times the mean squared change of the raw score
    between a text and each of its swapped versions. share: of label 1 where the
    sample was drawn from; rows are weighted to it in the logistic loss.
    """
    y = np.array(labels, float)
    n, pos = len(y), float(y.sum())
    if pos in (0.0, float(n)):
        smoothed = (pos + 1) / (n + 2)
        return ToxicityModel(math.log(smoothed / (1 - smoothed)))
    true = pos / n if share is None else min(max(share, 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, true / (pos / n), (1 - true) / (1 - pos / n)) / n
    # features are counted text by text, and again once the few that matter are known: all at once they are many
    of_pos, of_neg = Counter(), Counter()
    for t, label in zip(texts, labels, strict=True):
        (of_pos if label else of_neg).update(bag(WORD.findall(t.lower())).keys())
    neg = n - pos

    def evidence(f: str) -> float:
        p, q = (of_pos[f] + 0.5) / (pos + 1), (of_neg[f] + 0.5) / (neg + 1)
        return abs(math.log(p / q)) * math.sqrt(of_pos[f] / pos + of_neg[f] / neg)

    known = sorted((f for f in of_pos.keys() | of_neg.keys() if of_pos[f] + of_neg[f] >= min_count), key=lambda f: (-evidence(f), f))[:max_features]
    index = {f: i for i, f in enumerate(known)}
    del of_pos, of_neg

    def sparse(rows: Iterable[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c, v = [], [], []
        for i, counter in enumerate(rows):
            for f, k in counter.items():
                if (j := index.get(f)) is not None:
                    r.append(i)
                    c.append(j)
                    v.append(k)
        return np.array(r, int), np.array(c, int), np.array(v, float)

    changes = []
    for t in texts:
        listed = WORD.findall(t.lower())
        if alternatives := counterfactuals(listed, swaps):
            own = bag(listed)
            for c in map(bag, alternatives):
                changes.append(Counter({f: d for f in sorted(own.keys() | c.keys()) if f in index and (d := c[f] - own[f])}))
    (r, c, v), (cr, cc, cv) = sparse(bag(WORD.findall(t.lower())) for t in texts), sparse(changes)
    dims, m = len(known), max(1, len(changes))
    w, b = np.zeros(dims), math.log(true / (1 - true))
    gw, gb = np.full(dims, 1e-8), 1e-8  # adaptive steps: one sum of squared gradients for each weight
    for _ in range(rounds):
        z = np.bincount(r, v * w[c], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(c, v * g[r], dims) + l2 * w
        if len(cr):
            change = np.bincount(cr, cv * w[cc], len(changes))
            grad += 2 * counterfactual_weight / m * np.bincount(cc, cv * change[cr], dims)
        gw += grad**2
        gb += g.sum() ** 2
        w -= 0.5 * grad / np.sqrt(gw)
        b -= 0.5 * g.sum() / math.sqrt(gb)
    keep = np.abs(w) > 0.02 * np.abs(w).max() if dims else np.zeros(0, bool)
    return ToxicityModel(float(b), {f: float(w[i]) for f, i in index.items() if keep[i]})


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """Replaces the text by out (double, 0 to 1) for every row; other columns stay."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if out != text_col:
        docs = docs.drop(out)
    where = docs.columns.index(text_col)
    names = [c for c in docs.columns if c != text_col] + [out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            scores = [model.score(t or "", memo) for t in batch.column(where).to_pylist()]
            kept = [x for i, x in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names)

    return map_batches(docs, run, f"{schema}{', ' if schema else ''}`{out}` double")


def train(docs: DataFrame, labels: DataFrame, keep: Column, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000, max_chars: int = 60_000_000, **options) -> ToxicityModel:
    """Fit on at most per_class labelled texts of each class for which keep holds, whole, with at most max_chars characters a class."""
    return fit(*labelled_sample(docs, labels, label, id_col=id_col, text_col=text_col, keep=keep, per_class=per_class, max_chars=max_chars), **options)
