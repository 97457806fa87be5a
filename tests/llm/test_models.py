import random

import numpy as np
from pyspark.sql import functions as F

from siftlake.llm import chats, toxicity, vectors
from tests.llm.helpers import docs, odd_docs, words


def toxic_corpus(spark, n=400):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        w = words(rng.randint(5, 80), i).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot!", "scum", "moron,"]))
        rows.append(" ".join(w))
        labels.append((i, int(bad), 1))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_held_out_accuracy(spark):
    df, labels = toxic_corpus(spark)
    scored = toxicity.score(df, toxicity.train(df, labels)).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    hits = sum((r["score"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in scored)
    assert len(scored) > 60 and hits / len(scored) > 0.95


def test_held_out_labels_do_not_matter(spark):
    df, labels = toxic_corpus(spark, 120)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(df, x) for x in (labels, flipped))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]


def brute_ftrl(examples, labels):
    """FTRL-proximal as published, one coordinate at a time."""
    z, n = {}, {}
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        zi = z.get(i, 0.0)
        shrink, ridge = (0.0, 0.0) if i == "bias" else (l1, l2)
        return 0.0 if abs(zi) <= shrink and i != "bias" else -(zi - np.sign(zi) * shrink) / ((b + n.get(i, 0.0) ** 0.5) / a + ridge)

    for _ in range(toxicity.EPOCHS):
        for x, y in zip(examples, labels, strict=True):
            x = [*x, "bias"]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in x:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / a
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def brute_features(text):
    """The places of words, pairs and skip-pairs by plain loops over the words."""
    w = [int(toxicity.features(np.frombuffer(t.encode(), np.uint8))[0]) for t in text.split()]
    return len(set(zip(text.split(), text.split()[1:]))) + len(set(zip(text.split(), text.split()[2:]))) + len(set(w))


def test_fit_against_brute_force():
    rng = random.Random(1)
    vocabulary = [words(1, i) for i in range(30)] + ["scum"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25))) for _ in range(60)]
    places = [toxicity.features(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    assert all(len(p) == brute_features(t) for p, t in zip(places, texts, strict=True))
    labels = [float("scum" in t) for t in texts]
    at, values, intercept = toxicity.fit_ftrl(list(zip(places, labels, strict=True)))
    want = brute_ftrl([p.tolist() for p in places], labels)
    assert abs(want.pop("bias") - intercept) < 1e-3
    got = dict(zip(at.tolist(), values.tolist(), strict=True))
    assert {i for i, v in want.items() if abs(v) > 1e-3} <= set(got) and all(abs(want[i] - v) < 1e-3 for i, v in got.items())


def test_two_models_are_told_apart(spark):
    df = docs(spark, ["scum here", "nice here"])
    place = toxicity.features(np.frombuffer(b"scum", np.uint8))
    models = [(place, np.array([v], np.float32), 0.0) for v in (5.0, -5.0, 5.0)]
    scored = [[r["score"] for r in toxicity.score(df, m).orderBy("doc_id").collect()] for m in models]
    assert scored[0] == scored[2] and scored[0][0] > 0.99 and scored[1][0] < 0.01 and scored[0][1] == 0.5


def test_the_sample_is_bounded_by_features(spark):
    df, labels = toxic_corpus(spark, 80)
    few, all_ = toxicity.train(df, labels, most_features=500), toxicity.train(df, labels)
    assert few[0].tolist() != all_[0].tolist() and len(toxicity.train(df, labels, most_features=0)[0]) == 0


def test_toxicity_odd_rows(spark):
    df, labels = toxic_corpus(spark, 60)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 1), (77777, 1, 1), (4, 0, 0)], labels.schema))
    both = odd_docs(spark).withColumn("score", F.lit("mine"))
    out = toxicity.without_toxic(both, labels)
    assert out.columns == both.columns and all(r["score"] == "mine" for r in out.collect())
    clash = toxicity.score(both, toxicity.train(df, labels))
    assert clash.columns == [*both.columns, "score_"] and all(0 <= r["score_"] <= 1 and r["score"] == "mine" for r in clash.collect())
    scored = toxicity.score(odd_docs(spark), toxicity.train(df, labels)).collect()
    assert len(scored) == 10 and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(odd_docs(spark).limit(0), toxicity.train(df, labels)).count() == 0
    none = toxicity.score(df.limit(3), toxicity.train(df, labels.limit(0))).collect()
    assert len(none) == 3 and all(r["score"] < 1e-9 for r in none)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(-60, 60, (900, 16))
    data[100:140] = data[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, q array<bigint>")
    for block, batch in ((8192, 512), (100, 3)):
        out = vectors.top_k(df, F.col("vec_id") % 50 == 0, block=block, batch=batch).collect()
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
        for query in range(0, 900, 50):
            scores = sorted(((-int(data[i] @ data[query]), i) for i in range(900) if i != query))[:5]
            assert [got[(query, k + 1)] for k in range(5)] == [(i, -s) for s, i in scores]


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(1)
    data = rng.integers(-50, 50, (3000, 32))
    data[:20] = rng.integers(60, 90, (20, 32))
    index = vectors.ImpactIndex(data)
    for query in (data[0], data[500], np.zeros(32, np.int64), -data[3]):
        members, scores = index.best(query, 5)
        assert sorted(scores)[-5:] == sorted(data @ query)[-5:] and (scores == data[members] @ query).all()
    assert len(index.best(data[0], 5)[0]) < 300


def test_vectors_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, None), (2, [nan, 0.1]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (50, [0.001, 0.999]), (7, []), (None, [1.0, 1.0]), (9, [0.5, -0.25]), (10, [0.5, -0.25])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = [tuple(r) for r in vectors.op4_impact_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    same, other = 128 * 128 + 64 * 64, 128 * 0 - 64 * 255
    assert out == [(0, 1, 9, same), (0, 2, 10, same), (0, 3, 50, other), (50, 1, 0, other), (50, 2, 9, other), (50, 3, 10, other)]


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_quotes_link_to_their_messages(spark):
    first, second = "Shall we meet\non Monday?", "Monday is fine with me."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", second),
        (1, 2, "user", "Something else entirely."),
        (1, 3, "user", "Anna wrote:\n> Monday is  FINE with me.\n>> Shall we meet\n>> on Monday?\nThen it is settled."),
        (1, 4, "assistant", "> Then it is settled.\nGood."),
        (1, 5, "user", "> never said before\nOdd."),
        (2, 0, "user", "> Monday is fine with me.\nOther conversation."),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect()}
    assert out[(1, 3)]["parent_turn"] == 1 and out[(1, 3)]["text"] == "Then it is settled." and out[(1, 3)]["n_unlinked"] == 0
    assert out[(1, 4)]["parent_turn"] == 3 and out[(1, 4)]["root_turn"] == 1 and out[(1, 4)]["depth"] == 2
    assert out[(1, 5)]["parent_turn"] is None and out[(1, 5)]["n_unlinked"] == 1 and out[(1, 5)]["text"] == "Odd."
    assert out[(2, 0)]["parent_turn"] is None and out[(1, 0)]["text"] == first
    order = [r["turn"] for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect() if r["conv_id"] == 1]
    assert order == [0, 1, 3, 4, 2, 5]
    assert out[(1, 1)]["chat_text"] == f"<|assistant|>\n{second}\n"


def test_parts_of_a_message_link_to_it(spark):
    four = "We leave at nine.\nBring warm clothes.\nThe hut has no heating.\nDogs may come."
    paragraphs = "Prices went up\nby a tenth.\n\nThe old stock\nis sold out.\n\nNew goods come\nin the spring."
    cut = "> Dogs may come.\nMine is old\nand slow.\n> The hut has no heating.\nI have a stove\nto lend."
    rows = [
        (1, 0, "user", four),
        (1, 1, "user", paragraphs),
        (1, 2, "user", "> Bring warm clothes.\n> The hut has no heating.\nTwo lines of four."),
        (1, 3, "user", "> The old stock is\n> sold out.\nOne paragraph of three, wrapped anew."),
        (1, 4, "user", "> Prices went up\n> by a tenth.\n>\n> New goods come\n> in the spring.\nTwo paragraphs."),
        (1, 5, "user", cut),
        (1, 6, "user", ">> Dogs may come.\n> Mine is old and\n> slow.\n>> The hut has no heating.\n> I have a stove to\n> lend.\nThanks."),
        (1, 7, "user", "> We leave at nine.\n> Two paragraphs.\nFrom two messages: the later one."),
        (1, 8, "user", "> never said\n>\n> at all\nOdd."),
        (2, 0, "user", "> Bring warm clothes.\n> The hut has no heating.\nOther conversation."),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect()}
    assert [out[(1, i)]["parent_turn"] for i in range(9)] == [None, None, 0, 1, 1, 0, 5, 4, None]
    assert [out[(1, i)]["n_unlinked"] for i in range(9)] == [0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert [out[(1, i)]["n_quotes"] for i in range(9)] == [0, 0, 1, 1, 1, 2, 4, 1, 1]
    assert out[(1, 6)]["root_turn"] == 0 and out[(1, 6)]["depth"] == 2 and out[(2, 0)]["parent_turn"] is None


def test_the_whole_passage_links_before_its_lines(spark):
    rows = [(1, 0, "user", "Come in. Sit down."), (1, 1, "user", "Sit down."), (1, 2, "user", "> Come in.\n> Sit down.\nThank you.")]
    out = {r["turn"]: r for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect()}
    assert out[2]["parent_turn"] == 0 and out[2]["n_unlinked"] == 0


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    out = chats.conversations(spark.createDataFrame(rows, CHAT)).collect()
    assert [r["turn"] for r in out] == list(range(40)) and all(r["root_turn"] == 0 and r["depth"] == r["turn"] for r in out)


def test_chats_odd_rows(spark):
    rows = [(1, 0, None, None), (None, 0, "user", "> a\nb"), (1, None, "user", "a"), (1, 1, "user", ""), (1, 1, "user", ""), (1, 2, "user", "> \n>\n" + "x " * 9000), (1, 3, "user", ">>> a")]
    df = spark.createDataFrame(rows, CHAT).withColumn("own", F.lit(1)).withColumn("root", F.lit(2))
    assert chats.conversations(df).count() == 7 and chats.conversations(df.limit(0)).count() == 0


def quoted(text, level=1):
    return "\n".join(">" * level + " " + x for x in text.split("\n"))


def wrapped(text, width, rng):
    """The words of a text in lines of other lengths."""
    w, out = text.split(), []
    while w:
        n = rng.randint(3, width)
        out.append(" ".join(w[:n]))
        w = w[n:]
    return "\n".join(out)


def test_random_quotes_against_a_plain_linker(spark):
    """Every quoted passage is a piece of one earlier message, cut, wrapped and nested at random; a plain search over all earlier texts links them."""
    rng, rows, own, want = random.Random(8), [], {}, {}
    for conv in range(4):
        for turn in range(14):
            paragraphs = ["\n".join(words(rng.randint(6, 12), 10_000 * conv + 100 * turn + 10 * i + j) for j in range(3)) for i in range(3)]
            text, quotes = "\n\n".join(paragraphs), []
            for _ in range(rng.randint(0, 2) if turn else 0):
                source = own[(conv, rng.randrange(turn))]
                kind = rng.choice(["whole", "paragraph", "lines", "cut"])
                if kind == "paragraph":
                    source = rng.choice(source.split("\n\n"))
                elif kind == "lines":
                    all_ = [x for x in source.split("\n") if x]
                    at = rng.randrange(len(all_) - 1)
                    source = "\n".join(all_[at : at + rng.randint(1, 3)])
                elif kind == "cut":
                    w = source.split()
                    at = rng.randrange(len(w) - 14)
                    source = " ".join(w[at : at + rng.randint(12, 14)])
                quotes.append((source if kind == "lines" else wrapped(source, 9, rng), rng.randint(1, 3)))
            own[(conv, turn)] = text
            body = "\n".join(f"{quoted(q, level)}\n{part}" for (q, level), part in zip(quotes, paragraphs, strict=False))
            body += ("\n" if quotes else "") + "\n\n".join(paragraphs[len(quotes) :])
            own[(conv, turn)] = "\n".join(paragraphs[: len(quotes)]) + ("\n" if quotes else "") + "\n\n".join(paragraphs[len(quotes) :])
            rows.append((conv, turn, "user", body))
            holders = []
            for q, level in quotes:
                flat = f" {' '.join(q.split())} "
                at = [t for t in range(turn) if flat in f" {' '.join(own[(conv, t)].split())} "]
                holders += [(level, -at[0])] if at else []
            want[(conv, turn)] = (-min(holders)[1] if holders else None, len(quotes) - len(holders))
    out = {(r["conv_id"], r["turn"]): r for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect()}
    wrong = [(k, out[k]["parent_turn"], w) for k, w in want.items() if (out[k]["parent_turn"], out[k]["n_unlinked"]) != w]
    assert not wrong and sum(w[0] is not None for w in want.values()) > 25
    assert all(" ".join(out[k]["text"].split()) == " ".join(own[k].split()) for k in own)


def test_replies_follow_their_branch(spark):
    says = [words(12, 900 + i) for i in range(7)]
    parent = {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: None}
    rows = [(1, 0, "user", says[0])] + [(1, i, "user", (quoted(says[p]) + "\n" if p is not None else "") + says[i]) for i, p in parent.items()]
    out = [r["turn"] for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect()]
    assert out == [0, 1, 3, 5, 2, 4, 6]


def test_every_quote_counts_where_it_stands(spark):
    """A passage quoted twice is linked twice; rows that repeat a turn count their own quotes and share a parent."""
    twice = "> Come on Monday.\nYes.\n> Come on Monday.\nReally."
    rows = [(1, 0, "user", "Come on Monday."), (1, 1, "user", twice), (1, 2, "user", "> Come on Monday.\nA."), (1, 2, "user", "> Nobody said so.\nB."), (1, 2, "user", "C.")]
    out = chats.conversations(spark.createDataFrame(rows, CHAT)).collect()
    assert [(r["text"], r["n_quotes"], r["n_unlinked"], r["parent_turn"]) for r in out if r["turn"] == 1] == [("Yes.\nReally.", 2, 0, 0)]
    repeated = {r["text"]: (r["n_quotes"], r["n_unlinked"], r["parent_turn"]) for r in out if r["turn"] == 2}
    assert repeated == {"A.": (1, 0, 0), "B.": (1, 1, 0), "C.": (0, 0, 0)}


def test_short_quotes_link_wherever_they_stand(spark):
    """A quote of a few words cut out of a line, over a line's end too, links to the first earlier message that holds them in a row."""
    rng = random.Random(4)
    rows, want, said = [], {}, []
    for turn in range(30):
        own = [words(9, 100 * turn + i) for i in range(4)]
        own = "\n".join(" ".join(x) if isinstance(x, list) else x for x in own)
        quote = None
        if turn:
            flat = said[rng.randrange(turn)].split()
            n = rng.randint(1, chats.SHORT - 1)
            at = rng.randrange(len(flat) - n)
            quote = " ".join(flat[at : at + n]) if turn % 5 else " ".join(reversed(flat[at : at + n + 1]))
            holders = [t for t in range(turn) if f" {quote.lower()} " in f" {' '.join(said[t].lower().split())} "]
            want[turn] = holders[0] if holders else None
        said.append(own)
        rows.append((1, turn, "user", f"> {quote}\n{own}" if quote else own))
    out = {r["turn"]: r for r in chats.conversations(spark.createDataFrame(rows, CHAT)).collect()}
    assert {t: out[t]["parent_turn"] for t in want} == want and any(p is None for p in want.values()) and sum(p is not None for p in want.values()) > 15


def test_places_and_transcripts(spark, tmp_path):
    """reply_pos keeps the order over a write; a long conversation goes on in parts; messages without a role have an empty tag."""
    rows = [(c, t, f"> line {t - 2}\nline {t}" if t > 1 else f"line {t}") for c in (1, 2, None) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").repartition(5)
    chats.conversations(df).write.parquet(str(tmp_path / "told"))
    told = sorted(spark.read.parquet(str(tmp_path / "told")).collect(), key=lambda r: (r["conv_id"] or 0, r["reply_pos"]))
    branches = [*range(0, 12, 2), *range(1, 12, 2)]
    assert [(r["conv_id"], r["turn"], r["reply_pos"]) for r in told if r["conv_id"]] == [(c, t, i) for c in (1, 2) for i, t in enumerate(branches)]
    assert [r["reply_pos"] for r in told if r["conv_id"] is None] == list(range(12))
    parts = {(r["conv_id"], r["part"]): r for r in chats.transcripts(df, 5).collect()}
    assert [parts[(1, p)]["n_messages"] for p in range(3)] == [5, 5, 2] and len(parts) == 9
    whole = "".join(parts[(2, p)]["chat_text"] for p in range(3))
    assert whole == "".join(f"<||>\nline {t}\n" for t in branches) and chats.transcripts(df.limit(0)).count() == 0
