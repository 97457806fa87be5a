import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlake.llm import packing
from siftlake.llm.tokens import ChunkCoder
from tests.llm.helpers import docs, odd_docs, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_encode_as_whole_texts():
    whole, coder = Tokenizer.from_file(PATH), ChunkCoder(PATH, most_bytes=5000)
    texts = [
        "Hello, World!  it's 42\t ok\r\nnext\n\n line", "", " ", "é é ́x İstanbul ΣΑΣ Σ, ΑΣ", "<|endoftext|> a<|startoftext|>b",
        "漢字 かな 😀👍🏽", "a b\x85c\x1cd", "don't WE'LL 'tis", *[words(80, i) for i in range(40)],
    ]
    for lot in (texts, texts[::-1], *[[t] for t in texts]):
        for t, ids in zip(lot, coder.encode(pa.array(lot, pa.string())), strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_forms_of_a_word_are_coded_once():
    whole, coder = Tokenizer.from_file(PATH), ChunkCoder(PATH)
    forms = [w + m for w in ("word", "Word", "WORD") for m in ("", *".,;:!?")]
    odd = ["H\u0331 W\u030a. J\u030c", "<|ENDOFTEXT|> A<|endoftext|>", "\u0130.a \u1e9e! A\u0301.\u0301", "don'T. 'S, 4,5.x:y", "a.\u03a3 A\u03a3.", "\xd7. \xdf?"]
    for texts in (forms, odd):
        held = pa.array(["\xe9" * 9, *texts], pa.string())  # slices of it begin within its buffers
        for at in range(1, len(held), 2):
            for t, ids in zip(held[at : at + 2].to_pylist(), coder.encode(held[at : at + 2]), strict=True):
                assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t
        assert coder.n == 8 or texts is odd  # the empty chunk, the word and six marks


def check(rows, texts, capacity=2048):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["start"] == r["piece"] * capacity and (r["length"] == capacity or r is mine[-1])
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_pieces_and_sequences(spark):
    texts = {i: words(5 + (i * 37) % 900, i) for i in range(300)} | {300: words(9000, 1)}
    df = docs(spark, list(texts.values())).withColumn("bin", F.lit(1)).withColumn("cell", F.lit(2))
    rows = packing.pack_documents(df, PATH).collect()
    used = check(rows, texts)
    assert used <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 2


def test_many_small_groups_are_mended(spark):
    lengths = [(int(n),) for n in np.random.default_rng(2).integers(1, 700, 900)]
    df = spark.createDataFrame(lengths, "length bigint").repartition(3)
    out = packing.pack(df, 1000, group=60).collect()
    loads = {}
    for r in out:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
    assert max(loads.values()) <= 1000 and sum(loads.values()) == sum(n for n, in lengths)
    assert len(loads) <= packing.lower_bound(np.array([n for n, in lengths]), 1000) * 1.06


@pytest.mark.parametrize("seed", range(4))
def test_evolution_keeps_every_piece_and_never_gets_worse(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(200, 600, 300)
    first = packing.evolve(lengths, [], 1000, np.random.default_rng(0))
    again = packing.evolve(lengths, [first[0][0], rng.permutation(300).astype(np.int32)], 1000, np.random.default_rng(1))
    for bins, loads in first + again[:1]:
        assert loads.max() <= 1000 and (np.bincount(bins, weights=lengths) == loads).all() and loads.sum() == lengths.sum()
    assert packing.lower_bound(lengths, 1000) <= len(again[0][1]) <= len(first[0][1])


def decreasing(lengths, capacity):
    """The number of bins of best-fit decreasing."""
    bins, loads = np.zeros(len(lengths), np.int32), []
    packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, loads, capacity)
    return len(loads)


def triplets(n, seed):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        out += [a, b, 1000 - a - b]
    return np.array(out)[rng.permutation(3 * n)]


@pytest.mark.parametrize("seed", range(3))
def test_crossover_wins_where_a_sorted_order_misses_the_bound(seed, monkeypatch):
    lengths, calls = triplets(40, seed), []
    real = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or real(*a))
    best = packing.evolve(lengths, [], 1000, np.random.default_rng(seed))
    assert len(calls) >= packing.GENERATIONS and packing.lower_bound(lengths, 1000) == 40
    first = [len(packing.shuffled_best_fit(lengths, 1000, np.random.default_rng(seed + i))[1]) for i in range(4)]
    assert len(best[0][1]) < decreasing(lengths, 1000) and len(best[0][1]) <= min(first)
    mixed = np.random.default_rng(seed).integers(1, 900, 800)
    best = packing.evolve(mixed, [], 1000, np.random.default_rng(seed))
    assert len(best[0][1]) < min(len(packing.shuffled_best_fit(mixed, 1000, np.random.default_rng(seed + i))[1]) for i in range(4))


def test_every_group_breeds_on_the_query_path(spark, monkeypatch):
    # the islands run in Python workers, so breeding shows in the elites: none is what shuffled best fit gives
    lengths = triplets(60, 9)
    df = spark.createDataFrame([(0, i, int(n), -1) for i, n in enumerate(lengths)], "cell bigint, item bigint, length bigint, bin bigint")
    out = packing.evolve_cells(df, 1000).collect()
    loads = {}
    for r in out:
        loads[r["bin"]] = loads.get(r["bin"], 0) + r["length"]
    assert len(out) == 180 and max(loads.values()) <= 1000 and len(loads) < decreasing(lengths, 1000)


def fewest(lengths, capacity):
    """The least number of bins, by trying every place of every piece."""
    best = [len(lengths)]

    def place(i, loads):
        if len(loads) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(loads))
            return
        for b in range(len(loads)):
            if loads[b] + lengths[i] <= capacity:
                place(i + 1, [*loads[:b], loads[b] + lengths[i], *loads[b + 1 :]])
        place(i + 1, [*loads, lengths[i]])

    place(0, [])
    return best[0]


def test_packing_against_brute_force(spark):
    rng, want, rows = np.random.default_rng(4), 0, []
    for case in range(12):
        lengths = rng.integers(100, 700, int(rng.integers(1, 9))).tolist()
        best = packing.evolve(np.array(lengths), [], 1000, np.random.default_rng(case))
        assert len(best[0][1]) == fewest(lengths, 1000), lengths
        rows.append(lengths)
    few = [610, 390, 520, 480, 700, 300, 250, 250, 500]
    want = fewest(few, 1000)
    df = spark.createDataFrame([(n, "mine", 7) for n in few], "length bigint, sequence_id string, item int")
    out = packing.pack(df, 1000).collect()
    assert len({r["sequence_id_"] for r in out}) == want and all(r["sequence_id"] == "mine" and r["item"] == 7 for r in out)


def test_lower_bound_counts_large_pieces():
    assert packing.lower_bound(np.array([600, 600, 600]), 1000) == 3
    assert packing.lower_bound(np.array([500, 500, 500, 500, 1]), 1000) == 3
    assert packing.lower_bound(np.array([], np.int64), 1000) == 0


def test_odd_rows(spark):
    out = packing.pack_documents(odd_docs(spark), PATH).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r["length"])
    assert pieces[2] == [1] and pieces[3] == [1] and pieces[4] == [1] and len(pieces[1]) == 2 and len(pieces[None]) == 1 and len(pieces[5]) > 5
    assert packing.pack_documents(odd_docs(spark).limit(0), PATH).count() == 0
