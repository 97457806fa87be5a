import random

import numpy as np
from pyspark.sql import functions as F

from siftlake.llm import minhash
from siftlake.llm.components import components as spark_components
from siftlake.llm.hashing import shingles, word_hashes
from tests.llm.helpers import components, docs, odd_docs, shingle_set, words


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingle_set(t))
    ids = list(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                links.append((a, b))
    return components(ids, links)


def check(spark, df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute([(d, t) for d, t in rows if d is not None])
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert sorted(r["n_shingles"] for r in out) == sorted(len(shingle_set(t)) for _, t in rows)


def varied(base, n, seed):
    """Copies of a text with from none to many words changed, some so far off that they only link to others."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = base.split()
        for _ in range(i % 12):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    texts = [words(80, i) for i in range(20)] + varied(words(120, 99), 60, 1) + varied(words(60, 98), 30, 2) + ["Short One", "short ONE", "short one "]
    check(spark, docs(spark, texts).withColumn("rep", F.lit("x")).withColumn("band", F.lit(1)))


def test_blocks_smaller_than_the_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    check(spark, docs(spark, varied(words(100, 5), 70, 3)))


def test_chain_whose_ends_differ(spark):
    w = words(100, 7).split()
    chain = []
    for step in range(8):
        chain.append(" ".join(w[: 100 - 2 * step] + [f"c{i}" for i in range(2 * step)]))
    check(spark, docs(spark, chain))


def test_odd_rows(spark):
    check(spark, odd_docs(spark))
    out = {(r["doc_id"], r["n_shingles"]): r for r in minhash.near_duplicates(odd_docs(spark)).collect()}
    assert out[(None, 2)]["component_id"] is None and out[(None, 2)]["kept"]
    assert out[(2, 0)]["kept"] and out[(3, 0)]["kept"] and out[(6, 19996)]["component_id"] == 5
    assert minhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (5, 5)]
    got = {r["node"]: r["root"] for r in spark_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_estimate_corrects_for_chance(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(2))
    pair = [minhash.packed(minhash.minima(np.unique(x))).view(np.int64).tolist() for x in (a, b)]
    near = [minhash.packed(minhash.minima(np.unique(np.r_[a[:360], b[:k]]))).view(np.int64).tolist() for k in (0, 20)]
    df = spark.createDataFrame([(pair[0], pair[1], near[0])], "a array<bigint>, b array<bigint>, c array<bigint>")
    named = lambda c, n: F.struct(*[F.col(c)[i].alias(f"s{i}") for i in range(minhash.LANES)]).alias(n)
    r = df.select(named("a", "x"), named("b", "y"), named("c", "z")).select(minhash.estimate("x", "y").alias("far"), minhash.estimate("x", "z").alias("near")).first()
    assert abs(r["far"]) < 0.15 and abs(r["near"] - 0.9) < 0.12


def test_word_hashes_see_words_only():
    text = lambda s: np.frombuffer(s.encode(), np.uint8)
    a, b = word_hashes(text("One  two\nthree é")), word_hashes(text(" one TWO\tthree\x0b é "))
    assert (a == b).all() and len(a) == 4 and word_hashes(text("É"))[0] != word_hashes(text("é"))[0]
    assert len(shingles(word_hashes(text("a b c d e f")))) == 2 and len(shingles(word_hashes(text("a b")))) == 1
