"""Byte-level BPE by dynamic programming over prefixes.

The last token of the encoding of a prefix is unique. For each prefix, an
automaton over the vocabulary's byte strings yields every token that is a
suffix of it; the one that is compatible with the last token of the remaining
prefix is stored, and following those back-pointers from the end emits the ids.
Two tokens are compatible if no merge would have crossed the boundary between
them before both were complete. The cost is linear in the text, whatever the
merges, and no merge queue is kept.

Nulls count as empty texts, empty texts give no ids, and texts of any length
are encoded whole. Tokenizer files are read, never trained or copied.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import map_batches

# The pattern that splits a text before the merges of a byte-level vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of each half of a memo table, characters of what is remembered, and pairs of tokens remembered.
MEMO, MEMO_CHARS, PAIRS = 100_000, 64, 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """The ids of pre-tokens, as bytes of 32-bit numbers, worked out where they are missing.

    The table has two halves: when the younger is full it becomes the older,
    and what is found in the older comes back.
    """

    def __init__(self, encode: Callable[[bytes], list[int]]) -> None:
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.encode(word.encode("utf-8", "replace"))).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def pieces(spec: dict) -> np.ndarray:
    """The bytes of each token by its id, from a vocabulary file's contents."""
    letters, vocab = byte_alphabet(), spec["model"]["vocab"]
    made = np.full(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, b"", dtype=object)
    for s, i in vocab.items():
        made[i] = bytes(letters[c] for c in s)
    for t in spec["added_tokens"]:
        made[t["id"]] = t["content"].encode()
    return made


class BytePairDecoder:
    """Decoder for one vocabulary file; much smaller than the encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.pieces = pieces(json.load(f))

    def decode(self, ids) -> str:
        return b"".join(self.pieces[ids].tolist()).decode("utf-8", "replace") if len(ids) else ""


class BytePairCodec(BytePairDecoder):
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        vocab = spec["model"]["vocab"]
        self.pieces = pieces(spec)
        self.lengths = [len(b) for b in self.pieces]
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            pair, new = (vocab[left], vocab[right]), vocab[left + right]
            if new in self.made_of:
                raise ValueError("a token with two merges has no unique split")
            self.merge_rank[pair] = rank
            self.made_of[new] = (*pair, rank)
        self.added = {}
        for t in spec["added_tokens"]:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError("added tokens that strip or match single words are not supported")
            self.added[t["content"]] = t["id"]
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            b = self.pieces[i]
            if len(b) == 1 or i in self.made_of:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT_PATTERN)
        self.words = Memo(self.encode_piece)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """True if a followed by b stays as these two tokens."""
        left, right, before = a, b, len(self.merge_rank) + 1
        ok = True
        while True:
            # `before` is the merge that ended the time in which left and right stood side by side
            crossing = self.merge_rank.get((left, right))
            if crossing is not None and crossing < before:
                ok = False
                break
            of_left, of_right = self.made_of.get(left), self.made_of.get(right)
            if of_left is None and of_right is None:
                break
            if of_right is None or (of_left is not None and of_left[2] > of_right[2]):
                left, before = of_left[1], of_left[2]
            else:
                # among equal merges the leftmost comes first, so an equal rank crosses too
                right, before = of_right[0], of_right[2] + 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 24 | b] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the unique last token of every prefix, then the way back."""
        n = len(piece)
        last, pairs = [-1] * (n + 1), self.pairs
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                at = end - length
                if at == 0:
                    fits = self.whole(token)
                elif (before := last[at]) < 0:
                    continue
                elif (fits := pairs.get(before << 24 | token)) is None:
                    fits = self.compatible(before, token)
                if fits:
                    last[end] = token
        ids, at, lengths = [], n, self.lengths
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        return ids[::-1]

    def whole(self, token: int) -> bool:
        """True if the token's own bytes encode to it alone: its two halves, were they apart, must meet."""
        known = self.alone.get(token)
        if known is None:
            made = self.made_of.get(token)
            known = self.alone[token] = made is None or self.whole(made[0]) and self.whole(made[1]) and self._meets(*made)
        return known

    def _meets(self, a: int, b: int, rank: int) -> bool:
        left, right, before = a, b, rank
        while True:
            of_left, of_right = self.made_of.get(left), self.made_of.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and of_left[2] > of_right[2]):
                left, before = of_left[1], of_left[2]
            else:
                right, before = of_right[0], of_right[2] + 1
            crossing = self.merge_rank.get((left, right))
            if crossing is not None and crossing < before:
                return False

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> array:
        out, at = array("i"), 0
        if self.added_pattern is not None:
            for m in self.added_pattern.finditer(text):
                out.frombytes(self._plain(text[at : m.start()]))
                out.append(self.added[m.group()])
                at = m.end()
        out.frombytes(self._plain(text[at:] if at else text))
        return out


_codecs: dict[tuple[type, str], BytePairDecoder] = {}


def codec(path: str, kind: type = BytePairCodec) -> BytePairDecoder:
    """One of the kind for each worker process and file."""
    if (kind, path) not in _codecs:
        _codecs[kind, path] = kind(path)
    return _codecs[kind, path]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the column out (array<int>): the ids of every whole text. Other columns stay; one named out is replaced."""
    docs = docs.drop(out)
    where = docs.columns.index(text_col)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids, offsets = array("i"), [0]
            for t in batch.column(where).to_pylist():
                ids.extend(c.encode(t or ""))
                offsets.append(len(ids))
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*names, out])

    return map_batches(docs, run, schema)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the column out: the text of the ids; null ids give the empty text. Special tokens are kept."""
    encoded = encoded.drop(out)
    where = encoded.columns.index(ids_col)
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, BytePairDecoder)
        for batch in batches:
            col = batch.column(where)
            texts = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in col]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return map_batches(encoded, run, schema)


def digests(decoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return decoded.select(F.col(id_col), F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col(text_col), 256).alias("decoded_sha256"))
