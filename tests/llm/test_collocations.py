"""Automata against plain dictionaries, collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.llm import automata, collocations
from siftlake.llm.automata import Builder, PhraseAutomaton, summed, united
from tests.llm.helpers import odd_docs

PHRASE = st.lists(st.integers(1, 4), min_size=1, max_size=3).map(tuple)
COUNTS = st.dictionaries(PHRASE, st.integers(1, 9), max_size=40)


def arrays(counts, k=3):
    symbols = np.array([list(p) + [0] * (k - len(p)) for p in counts], np.uint64).reshape(-1, k)
    return summed(symbols, np.array(list(counts.values()), np.int64))


def automaton(counts, block=7, k=3):
    symbols, weights = arrays(counts, k)
    b = Builder(k)
    for i in range(0, len(symbols), block):
        b.add(symbols[i : i + block], weights[i : i + block])
    return b.built()


def plain(symbols, weights):
    return {tuple(int(x) for x in s if x): int(w) for s, w in zip(symbols, weights, strict=True)}


@settings(max_examples=150, deadline=None)
@given(COUNTS, st.integers(1, 9))
def test_an_automaton_holds_its_phrases(counts, block):
    a = automaton(counts, block)
    symbols, weights = a.paths()
    assert plain(symbols, weights) == counts
    assert [tuple(s) for s in symbols] == sorted(tuple(s) for s in symbols)
    assert plain(*PhraseAutomaton.from_bytes(a.to_bytes()).paths()) == counts


@settings(max_examples=100, deadline=None)
@given(st.lists(COUNTS, max_size=4), st.integers(1, 50))
def test_a_union_sums_weights(several, at_once):
    total = Counter()
    for c in several:
        total.update(c)
    assert plain(*united([automaton(c) for c in several], 3, at_once)) == dict(total)


@settings(max_examples=150, deadline=None)
@given(COUNTS, COUNTS)
def test_composition_looks_up_beginnings(counts, asked):
    symbols, parts, longer = automaton(counts).composed(automaton(asked))
    got = {p: (tuple(map(int, x)), int(y)) for p, x, y in zip(plain(symbols, np.ones(len(symbols))), parts, longer, strict=True)}
    best = defaultdict(int)
    for p, n in counts.items():
        best[p[:-1]] = max(best[p[:-1]], n)
    # a beginning that no phrase of the counts passes through weighs 0
    assert got == {p: (tuple(counts.get(p[: i + 1], 0) if i < len(p) else 0 for i in range(3)), best[p]) for p in asked}


def test_equal_states_are_one():
    a = automaton({(x, y, z): 5 for x in range(1, 30) for y in range(1, 30) for z in range(1, 30)})
    assert [len(x.label) for x in a.layers] == [29, 29, 29]


def mined(rows, least, top=2000, cover=80):
    """lang to its best phrases, by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        over = [x for (at, q), x in f.items() if at == lang and len(q) > len(p) and x >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * x >= cover * a for x in over):
            continue
        cuts = [(2000000 * a // (f[lang, p[:i]] + f[lang, p[i:]]), i, f[lang, p[:i]], f[lang, p[i:]]) for i in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def found(df, least, **settings):
    return sorted(tuple(r) for r in collocations.collocations(df, least, **settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(["a", "B", "c", "é", "d\x01", "e'"]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randint(0, 25)))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("xx", " .,\n"), ("fr", "a b c d " * 30)]


def test_collocations_equal_a_plain_count(spark, monkeypatch):
    """Small shards, ranges and parts, so that unions, ranges and the cutting of texts matter."""
    rows = sample(1)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumn("phrase", F.lit("mine")).withColumn("s1", F.lit(1))
    assert found(df, 3) == mined(rows, 3)
    monkeypatch.setattr(collocations, "SHARD", 50)
    monkeypatch.setattr(collocations, "RANGE_WORDS", 40)
    monkeypatch.setattr(collocations, "RANGE_PHRASES", 5)
    assert found(df, 2) == mined(rows, 2)
    assert found(df, 2, top=3, cover=50) == mined(rows, 2, 3, 50)


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    rows = sample(2, 30)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = mined(rows, 4)
    monkeypatch.setattr(collocations, "_filter_bits", lambda frequent: np.full(1 << (collocations.FILTER_LOG2 - 3), 255, np.uint8))
    assert found(df, 4) == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 6 * 10**15 + 1, 7 * 10**15 + 3, 9 * 10**15 + 7
    row = spark.range(1).select(collocations._score(*[F.lit(x).cast("long") for x in (a, left, right)]).alias("s")).first()
    assert row["s"] == 2000000 * a // (left + right)


def test_odd_rows_and_empty_tables(spark):
    df = odd_docs(spark)
    assert found(df, 3) == mined([(r["lang"], r["text"]) for r in df.collect()], 3)
    assert found(df.limit(0), 3) == []


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = "a b c. d e f, g h\n" * 50
    whole = list(collocations._symbols(pa.array(["en"]), pa.array([text])))
    parts = list(collocations._symbols(pa.array(["en"]), pa.array([text]), size=16))
    assert len(whole) == 1 and len(parts) > 20
    join = lambda x, i: np.concatenate([p[i] for p in x])
    assert (join(whole, 3) == join(parts, 3)).all() and (join(whole, 5) == join(parts, 5)).all()
    assert automata.ordered(np.zeros((0, 3), np.uint64)).size == 0
