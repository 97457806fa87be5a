"""Decontamination against a plain search for every window."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.llm import contamination as c
from tests.llm.helpers import odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=10, coverage=1.0):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        if not b:
            continue
        n = max(1, min(window, int(np.ceil(coverage * len(b)))))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), hit, found


def some(rng, n, letters="abcd"):
    return " ".join(rng.choice(letters) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 6), st.sampled_from([1.0, 0.5]))
def test_automaton_finds_every_window(seed, window, coverage):
    rng = random.Random(seed)
    items = [(str(i), some(rng, rng.randint(0, 9), "abc")) for i in range(rng.randint(0, 5))]
    text = some(rng, rng.randint(0, 60), "abcx")
    segments = []
    for name, body in items:
        h = c.word_hashes(np.frombuffer(body.encode(), np.uint8), c.PLAIN_WORD)
        if len(h):
            segments.append((name, max(1, min(window, int(np.ceil(coverage * len(h))))), h))
    spans, found = [], set()
    c.ItemIndex(segments).match(c.word_hashes(np.frombuffer(text.encode(), np.uint8), c.PLAIN_WORD), spans, found)
    _, hit, want = plain(text, items, window, coverage)
    spans = c.merged(spans)
    assert {i for a, b in spans for i in range(a, b + 1)} == hit and found == want
    assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:], strict=False))


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short one"),
    (3, None),
    (4, "  "),
    (None, "nobody owns this line"),
    (10, "théâtre 漢字 été"),
    (1, "second text of the first item"),
]
TEXTS = [
    "xx ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda yy",
    "alpha beta gamma delta epsilon zeta eta theta iota",
    "a short-one; and THÉâtre no, théâtre 漢字 été",
    "Nobody owns this line",
    "second text of the first item second text of the first item",
    None,
    "",
]


@pytest.mark.parametrize("most_words", [100_000, 3])
def test_matches_equal_the_plain_search(spark, most_words):
    """Blocks of three words make several passes over the documents."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("n_words", F.lit("mine")).withColumn("items", F.lit("mine"))
    out = c.matches(docs, spark.createDataFrame(ITEMS, "item_id int, text string"), most_words=most_words)
    assert out.columns == [*docs.columns, "n_words_", "spans", "items_"]
    for r in out.collect():
        n, hit, found = plain(r["text"], ITEMS)
        assert (r["n_words_"], {i for s in r["spans"] for i in range(s["first"], s["last"] + 1)}) == (n, hit) and r["n_words"] == r["items"] == "mine"
        assert r["items_"] == sorted({str(x) for x in found if x is not None})


def test_long_items_are_cut_into_overlapping_segments(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 16)
    rng = random.Random(5)
    body = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    items = [(7, " ".join(body))]
    texts = [(i, " ".join(["pre"] + body[a : a + n] + ["post"])) for i, (a, n) in enumerate([(0, 40), (5, 10), (11, 10), (100, 9), (250, 50)])]
    out = c.matches(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), most_words=60)
    for r in out.collect():
        _, hit, found = plain(r["text"], items)
        assert {i for s in r["spans"] for i in range(s["first"], s["last"] + 1)} == hit and set(r["items"]) == {str(x) for x in found}


def test_hit_spans_are_cut_and_covered_documents_go(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    out = c.without_benchmark(docs, spark.createDataFrame(ITEMS, "item_id int, text string"), most_share=0.9)
    got = {r["doc_id"]: (r["text"], r["n_hit"]) for r in out.collect()}
    assert got == {0: ("xx  yy", 11), 1: (TEXTS[1], 0), 2: ("a ; and THÉâtre no, ", 5), 5: (None, 0), 6: ("", 0)}


def test_odd_rows_and_empty_tables(spark):
    docs, items = odd_docs(spark), spark.createDataFrame(ITEMS, "item_id int, text string")
    assert c.matches(docs, items).count() == 10 and c.matches(docs.limit(0), items).count() == 0
    assert c.matches(docs, items.limit(0)).filter("size(spans) > 0").count() == 0
