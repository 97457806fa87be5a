import random
import re
import struct

import duckdb
import xxhash
from pyspark.sql import functions as F

from siftlake.llm import lines, substrings
from tests.llm.helpers import docs, odd_docs, words


def sentence(n, seed):
    return words(n, seed).capitalize() + "."


def test_repeated_passage_is_removed_from_later_documents(spark):
    passage = " ".join(sentence(15, 100 + i) for i in range(4))
    own = lambda i: " ".join(sentence(9, 10 * i + j) for j in range(5))
    texts = [f"{own(1)} {passage} {own(2)}", f"{own(3)}\n{passage}\n{own(4)}", passage, own(5)]
    out = {r["doc_id"]: r for r in substrings.without_repeats(docs(spark, texts).withColumn("removed_by", F.lit(1)).withColumn("k", F.lit(2))).collect()}
    assert out[0]["text"] == texts[0] and out[3]["text"] == texts[3] and out[0]["n_removed"] == 0
    assert passage not in out[1]["text"] and out[1]["text"].startswith(own(3)) and out[1]["text"].endswith(own(4))
    assert out[2]["text"] == "" and out[2]["n_removed"] == 4 and out[2]["k"] == 2


def test_short_runs_go_and_single_sentences_stay(spark):
    stock = "Read on."
    texts = ["One two three. Four five six. Seven eight.", "One two three. Four five six. Seven eight."]
    texts += [f"{sentence(12, i)} {stock} {sentence(11, 50 + i)}" for i in range(6)]
    out = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs(spark, texts)).collect()}
    assert out == {0: 0, 1: 3} | {i: 0 for i in range(2, 8)}


def test_repeats_within_a_document(spark):
    passage = " ".join(sentence(14, 7 + i) for i in range(3))
    out = substrings.without_repeats(docs(spark, [f"{passage} {sentence(8, 1)} {passage}"])).first()
    assert out["text"].count(passage) == 1 and out["n_removed"] == 3


def test_odd_white_space_and_letters_are_as_in_the_sql(spark, tmp_path):
    rng = random.Random(3)
    some = lambda parts, n, most: ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]
    texts = ["One two. Three four. Five six.", "One\ttwo. Three\rfour. Five\x0bsix.", "\xa0One two. \u3000Three four. Five six.\u2009"]
    texts += some(["a", "b", "\t", "\r", "\x0b", "\f", " ", ". ", ".\t", "\n", "\r\n"], 400, 24)
    texts += some(["a", "\xa0", "\u3000", " ", ". "], 200, 9) + some(["\u0130", "i", "\u03a3", "\u03c3", "\u03c2", ". ", "\xc9", "\xe9"], 400, 9)
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_removed", "removed", "text"]
    out = sorted(map(tuple, substrings.op10_sentence_spans(spark, str(tmp_path)).select(columns).collect()))
    assert out == sorted(con.sql(f"select {', '.join(columns)} from ({substrings.OP10_SQL})").fetchall())
    assert [r[1] for r in out[:3]] == [0, 3, 3]


def test_sentence_spans_odd_rows(spark):
    out = substrings.without_repeats(odd_docs(spark)).collect()
    assert len(out) == 10 and substrings.without_repeats(odd_docs(spark).limit(0)).count() == 0
    assert [r["text"] for r in out if r["doc_id"] == 2] == [None]


def test_a_multi_line_chunk_is_removed_wherever_it_shifts_to(spark):
    shared = "\n".join(sentence(6, 500 + i) for i in range(30))
    own = lambda i, n: "\n".join(sentence(5, 1000 * i + j) for j in range(n))
    texts = [f"{own(1, 3)}\n{shared}\n{own(2, 4)}", f"{own(3, 8)}\n{shared}\n{own(4, 1)}", own(5, 9)]
    out = {r["doc_id"]: r for r in lines.without_repeated_lines(docs(spark, texts).withColumn("hash", F.lit(1)).withColumn("first", F.lit(2))).collect()}
    assert out[0]["text"] == texts[0] and out[2]["text"] == texts[2]
    left = [x for x in shared.split("\n") if x in out[1]["text"]]
    assert out[1]["n_removed"] >= 18 and len(left) + out[1]["n_removed"] >= 30 and all(x in out[1]["text"] for x in own(3, 8).split("\n")[:5])
    assert out[1]["hash"] == 1


def brute_lines(rows):
    """Chunks by the same boundaries, first by (doc_id, line), extended line by line, bytes compared."""
    first, out, texts = {}, {}, {i: (t or "").split("\n") for i, t, _ in rows}
    reach = {(i, c[0], c[1]): (c[2], c[3]) for i, _, chunks in rows for c in chunks}
    filled = lambda x: x.strip(" \t\n\x0b\f\r") != ""
    for doc_id, text, chunks in sorted(rows, key=lambda r: r[0]):
        mine, drop = texts[doc_id], set()
        for a, b, low, high in sorted(chunks):
            body = tuple(mine[a : b + 1])
            if body not in first:
                first[body] = (doc_id, a, b)
                continue
            other, f, g = first[body]
            theirs, (low0, high0) = texts[other], reach[other, f, g]
            up = down = 0
            while a - up > low and f - up > low0 and mine[a - up - 1] == theirs[f - up - 1]:
                up += 1
            while b + down < high and g + down < high0 and mine[b + down + 1] == theirs[g + down + 1]:
                down += 1
            run = range(a - up, b + down + 1)
            if sum(filled(mine[i]) for i in run) > 1:
                held = set(range(f - up, g + down + 1)) if other == doc_id else set()
                drop |= set(run) - held
        out[doc_id] = text if not drop else "\n".join(x for i, x in enumerate(mine) if i not in drop)
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def folded(hashes):
    """Spark's hash of an array of longs: each element's hash is the next one's seed."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
    return signed(seed)


def brute_chunks(text):
    """Chunk ranges from the text alone, by plain loops."""
    all_lines = text.split("\n")
    hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in all_lines]
    filled = [x.strip(" \t\n\x0b\f\r") != "" for x in all_lines]
    fires = [folded(hashes[max(0, i - lines.WINDOW + 1) : i + 1]) % lines.MEAN_LINES == 0 for i in range(len(all_lines))]
    ends = [i for i, x in enumerate(fires) if x or i == len(all_lines) - 1]
    out = set()
    for j, end in enumerate(ends):
        begin = lambda k: ends[k - 1] + 1 if k > 0 else 0
        reach = (begin(j - 1), ends[min(j + 1, len(ends) - 1)])
        for first in {begin(j), max(0, end - lines.WINDOW + 1) if fires[end] and end else begin(j)}:
            if any(filled[first : end + 1]):
                out.add((first, end, *reach))
    return out


def test_boundaries_against_plain_loops(spark):
    pool = [sentence(3, i) for i in range(9)] + ["", "é", " "]
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    found = {i: set() for i in range(40)}
    for r in lines.chunks(docs(spark, texts)).collect():
        found[r["doc_id"]].add((r["first"], r["last"], r["low"], r["high"]))
    assert found == {i: brute_chunks(t) for i, t in enumerate(texts)}


def brute_spans(texts):
    """Sentence spans by plain loops over all documents in order: what each document keeps."""
    seen, out = {}, []
    for doc_id, text in enumerate(texts):
        pieces = re.split(substrings.ENDS, text or "")
        known = [(i, p.strip(" \t\n\x0b\f\r").lower()) for i, p in enumerate(pieces)]
        known = [(i, p) for i, p in known if p]
        covered = set()
        for k in range(len(known)):
            part = tuple(p for _, p in known[k : k + substrings.RUN])
            if len(part) == substrings.RUN and seen.setdefault(part, (doc_id, k)) != (doc_id, k):
                covered |= set(range(k, k + substrings.RUN))
        drop = {known[k][0] for k in covered}
        drop |= {j for k in covered if k + 1 in covered for j in range(known[k][0], known[k + 1][0])}
        out.append("".join(p for i, p in enumerate(pieces) if i not in drop) if drop else text)
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(11)
    pool = [sentence(rng.randint(1, 14), i) for i in range(25)]
    ends = [" ", "\n", "\n\n", "  "]
    texts = []
    for _ in range(60):
        at = rng.randrange(20)
        shared = pool[at : at + rng.randint(2, 5)]
        own = [sentence(rng.randint(1, 9), rng.randrange(10**6)) for _ in range(rng.randint(0, 6))]
        cut = rng.randint(0, len(own))
        texts.append("".join(x + rng.choice(ends) for x in own[:cut] + shared + own[cut:]))
    texts += ["", "x. y.", None]
    out = substrings.without_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == brute_spans(texts) and sum(r["n_removed"] > 0 for r in out) > 10


def held_against_brute_force(spark, texts):
    df = docs(spark, texts)
    found = {}
    for r in lines.chunks(df).collect():
        found.setdefault(r["doc_id"], []).append((r["first"], r["last"], r["low"], r["high"]))
    want = brute_lines([(i, t, found.get(i, [])) for i, t in enumerate(texts)])
    assert {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(df).collect()} == want


def test_lines_against_brute_force(spark):
    pool = [sentence(3, i) for i in range(6)] + ["", "é"]
    held_against_brute_force(spark, ["\n".join(pool[(i * k + k * k) % 8] for k in range(i % 17)) for i in range(60)] + [None])
    shared = [sentence(4, 300 + i) for i in range(40)]
    rng = random.Random(8)
    part = lambda: "\n".join(shared[(a := rng.randrange(36)) : a + rng.randint(1, 12)])
    held_against_brute_force(spark, ["\n".join(x for i in range(4) for x in (sentence(3, rng.randrange(10**6)), part(), "")) for _ in range(40)])


PASSAGES = (2, 3, 4, 5, 7, 12, 20)


def passages_between_own_lines():
    own = lambda i, n: "\n".join(sentence(5, 1000 * i + j) for j in range(n))
    passages = ["\n".join(sentence(6, 70000 + 100 * n + j) for j in range(n)) for n in PASSAGES]
    firsts = [f"{own(2 * i, 2)}\n{p}\n{own(2 * i + 1, 2)}" for i, p in enumerate(passages)]
    later = [(own(50 + 2 * i, 3), p, own(51 + 2 * i, 1)) for i, p in enumerate(passages)]
    single = firsts[4].split("\n")[3]
    return firsts, later, f"{own(90, 2)}\n{single}\n{own(91, 2)}"


def test_a_passage_goes_to_its_edges_or_stays(spark):
    firsts, later, single = passages_between_own_lines()
    texts = firsts + ["\n".join(x) for x in later] + [single]
    out = {r["doc_id"]: r for r in lines.without_repeated_lines(docs(spark, texts)).collect()}
    n = len(firsts)
    assert all(out[i]["text"] == t for i, t in enumerate(firsts)) and out[2 * n]["text"] == texts[-1]
    for i, (a, p, b) in enumerate(later):
        assert out[n + i]["text"] == f"{a}\n{b}" or (PASSAGES[i] < 5 and out[n + i]["n_removed"] == 0)
        assert out[n + i]["n_removed"] in (0, p.count("\n") + 1)


def test_without_boundaries_inside_them_passages_stay(spark):
    firsts, later, _ = passages_between_own_lines()
    out = lines.without_repeated_lines(docs(spark, firsts + ["\n".join(x) for x in later]), mean_lines=1 << 62).collect()
    assert sum(r["n_removed"] for r in out) == 0


def test_a_repeat_that_overlaps_its_first_place_leaves_it(spark):
    held_against_brute_force(spark, ["b\n" + "a\n" * n + "c" for n in range(2, 9)] + ["x\n" + "d\ne\n" * n + "y" for n in range(2, 9)])
    [r] = lines.without_repeated_lines(docs(spark, ["a\nb\nc\nd\ne\nf\n" * 3]), mean_lines=1).collect()
    assert r["text"] == "a\nb\nc\nd\ne\nf\n"


def test_lines_odd_rows(spark):
    out = lines.without_repeated_lines(odd_docs(spark)).collect()
    assert len(out) == 10 and lines.without_repeated_lines(odd_docs(spark).limit(0)).count() == 0
    two = docs(spark, [None, "\n\n\n", "a\nb\nc\nd"]).unionByName(docs(spark, ["a\nb\nc\nd"] * 2, start=9))
    got = {(r["doc_id"], r["text"]) for r in lines.without_repeated_lines(two).collect()}
    assert (0, None) in got and (1, "\n\n\n") in got and (2, "a\nb\nc\nd") in got
