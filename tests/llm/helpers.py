"""Small tables and brute-force versions for the operators' tests."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs(spark, texts, sources=None, start=0):
    rows = [(start + i, t, "en", (sources[i] if sources else f"src{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls, blanks, very long and repeated rows, ties."""
    long = words(20000, 1)
    rows = [
        (1, "one two three four five six", "en", "a", 1),
        (1, "one two three four five six", "en", "a", 1),
        (2, None, None, None, None),
        (None, "one two three four five six", "en", "a", 1),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "", 4),
        (5, long, "en", "b", len(long)),
        (6, long, "en", "b", len(long)),
        (7, "x", "en", "b", 1),
        (8, "é ñ 漢字 😀 z", "en", "c", 8),
    ]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
