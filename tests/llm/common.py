"""Small corpora for the training-data operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_cases(spark, text="same text, twice over and over again, for good measure"):
    """Nulls in every column, empty, blank and long texts, repeated ids and rows."""
    rows = [
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "another text under the same id", "en", "b", 2), (None, text, None, None, None), (None, None, None, None, None),
        (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, " \t\n\x0b\x0c\r ", "en", "a", 7), (5, "x" * 50_000, "de", "b", 50_000), (6, "w " * 30_000, "de", "b", 60_000), (-7, "é中😀 ß y", "zz", "c", 8), (8, "no break", None, "c", 8),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(r: random.Random, n: int, letters: str = "abcdefghij") -> list[str]:
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n)]


def find_components(n: int, linked) -> list[int]:
    """The smallest index reachable from each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
