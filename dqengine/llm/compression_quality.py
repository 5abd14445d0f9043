"""Compression classifier for text quality.

Two Zstandard dictionaries are trained, one from good and one from bad labelled
texts. Each block of a text is compressed with either; the difference of the
summed sizes, divided by the larger, says which kind of text the dictionary
helps more. The same is done for the text's shape (letters, capitals and digits
each become one character). A logistic curve, fitted on labelled texts that the
dictionaries have not seen, turns the differences, together with how far the
text compresses at all, into a calibrated score. Texts are cut into blocks, so
that a long text's own repetitions do not drown the dictionaries; every block
of a text counts.

Null and empty texts score as the share of good labels. So do all texts if one
class has fewer than two labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import labelled_sample, map_batches

#: Bytes of a block.
BLOCK = 2048
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass
class CompressionModel:
    """Dictionaries as bytes (good and bad, for the text and its shape), the curve, and the score of an empty text."""

    dictionaries: tuple[bytes, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    level: int = 3

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in self.dictionaries]

    def raw(self, text: bytes, tools: list[zstandard.ZstdCompressor]) -> list[float]:
        """The two normalised differences and the logarithms of the two compression ratios."""
        out, ratios = [], []
        for view, (good, bad) in ((text, tools[:2]), (text.translate(_SHAPE), tools[2:])):
            parts = blocks(view)
            a, b = sum(len(good.compress(x)) for x in parts), sum(len(bad.compress(x)) for x in parts)
            out.append((b - a) / max(a, b))
            ratios.append(math.log(min(a, b) / len(text)))
        return out + ratios

    def score(self, text: bytes, tools: list[zstandard.ZstdCompressor]) -> float:
        if not text or not self.dictionaries:
            return self.prior
        z = float(expand((np.array([self.raw(text, tools)]) - self.mean) / self.scale)[0] @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def expand(x: np.ndarray) -> np.ndarray:
    """1, the values (within 4 deviations), their squares and products."""
    x = np.clip(x, -4, 4)
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton steps, the first column unpenalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(weight * p * (1 - p), 1e-9)) @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes], size: int, level: int) -> bytes:
    """A dictionary from all blocks of the texts, or of their raw bytes where they are too few to train on."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(size, parts, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b" " * 8


def fit(texts: list[str], labels: list[int], share: float | None = None, *, size: int = 65_536, level: int = 3) -> CompressionModel:
    """Even samples of each class train the dictionaries, odd ones the curve. On the driver; texts are a bounded sample.

    share: of label 1 where the sample was drawn from; its rows are weighted to
    that share, so that a sample balanced by class does not shift the scores.
    """
    data = [(t.encode("utf-8", "replace"), y) for t, y in zip(texts, labels, strict=True) if t]
    own = (sum(labels) + 1) / (len(labels) + 2)
    prior = own if share is None else min(max(share, 1e-6), 1 - 1e-6)
    of = {y: [t for t, label in data if label == y] for y in (0, 1)}
    if min(map(len, of.values())) < 2:
        return CompressionModel((), np.zeros(4), np.ones(4), np.zeros(15), prior, level)
    seen = {y: ts[::2] for y, ts in of.items()}
    dictionaries = tuple(dictionary([t.translate(_SHAPE) if shape else t for t in seen[y]], size, level) for shape in (False, True) for y in (1, 0))
    model = CompressionModel(dictionaries, np.zeros(4), np.ones(4), np.zeros(15), prior, level)
    tools = model.compressors()
    rest = [(t, y) for y, ts in of.items() for t in ts[1::2]]
    x, y = np.array([model.raw(t, tools) for t, _ in rest]), np.array([y for _, y in rest], float)
    of_one = y.mean()
    weight = np.ones(len(y)) if share is None else np.where(y == 1, prior / of_one, (1 - prior) / (1 - of_one))
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = logistic(expand((x - model.mean) / model.scale), y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2500, max_chars: int = 40_960_000, **options) -> CompressionModel:
    """Fit on at most per_class labelled texts of each class for which keep holds, whole, with at most max_chars characters a class."""
    return fit(*labelled_sample(docs, labels, label, id_col=id_col, text_col=text_col, keep=keep, per_class=per_class, max_chars=max_chars), **options)


def score(docs: DataFrame, model: CompressionModel, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """Replaces the text by out (double, 0 to 1, higher: better) for every row; other columns stay."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if out != text_col:
        docs = docs.drop(out)
    where = docs.columns.index(text_col)
    names = [c for c in docs.columns if c != text_col] + [out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches:
            scores = [model.score(t or b"", tools) for t in batch.column(where).cast(pa.binary()).to_pylist()]
            kept = [x for i, x in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names)

    return map_batches(docs, run, f"{schema}{', ' if schema else ''}`{out}` double")
