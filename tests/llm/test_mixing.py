from pyspark.sql import functions as F

from siftlake.llm import mixing
from siftlake.llm.text import n_words
from tests.llm.helpers import WORD, docs, odd_docs, words


def plan(df, **settings):
    rows = df.select("doc_id", "source", n_words("text").alias("size"), mixing.hash_order().alias("order"))
    return mixing.plan_mix(rows, rows, **settings)


def brute_targets(sizes):
    total, cap = 1.5 * sum(sizes.values()), {s: 2.0 * n for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        free = total - sum(cap[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: cap[s] if s in full else free * weight[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > cap[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_and_taken_words(spark):
    df = docs(spark, [words(5 + i * 7 % 90, i) for i in range(200)], [f"s{min(i % 9, 3)}" for i in range(200)])
    rows = plan(df).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.5
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    assert sorted(map(str, rows)) == sorted(map(str, plan(df.repartition(7)).collect()))


def test_positions_follow_the_schedule(spark):
    df = docs(spark, [words(10, i) for i in range(600)], [f"s{i % 3}" for i in range(600)])
    rows = plan(df).collect()
    at = {s: sorted(p["position"] for r in rows if r["source"] == s for p in r["passes"]) for s in ("s0", "s1", "s2")}
    middle = {s: v[len(v) // 2] for s, v in at.items()}
    assert middle["s0"] < 0.42 < middle["s1"] < 0.58 < middle["s2"]
    assert all(0 <= p <= 1 for v in at.values() for p in v)


def test_mix_cuts_sorts_and_keeps_columns(spark):
    df = docs(spark, [words(20, i) for i in range(40)], ["a"] * 30 + ["b"] * 10).withColumn("position", F.lit(7)).withColumn("size", F.lit("x"))
    out = mixing.mix(df).collect()
    taken = {(r["doc_id"]): r["taken"] for r in plan(df.drop("position", "size")).collect()}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["position"] == 7 and r["size"] == "x"
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.mix(df).columns == df.columns


def test_odd_rows(spark):
    out = {(r["doc_id"], r["size"]): r for r in plan(odd_docs(spark)).collect()}
    assert out[(2, 0)]["taken"] == 0 and out[(3, 0)]["taken"] == 0
    assert plan(odd_docs(spark)).count() == 10
    assert plan(odd_docs(spark).limit(0)).count() == 0 and mixing.mix(odd_docs(spark).limit(0)).count() == 0


def test_rows_that_share_an_id_or_repeat_whole(spark):
    n = 300
    texts = [words(12, 1)] * 100 + [words(3 + i % 40, i) for i in range(100, n)]
    sources = ["hot"] * 250 + ["b"] * 50
    df = docs(spark, texts, sources).withColumn("doc_id", F.when(F.col("doc_id") >= 200, F.col("doc_id")))
    rows = plan(df).collect()
    spread = mixing.with_passes(mixing.copies(mixing.plan_groups(df.select("doc_id", "source", n_words("text").alias("size"), mixing.hash_order().alias("order"))), block=7)).collect()
    key = lambda r: (str(r["doc_id"]), r["order"], r["source"], r["size"], r["taken"], str(r["passes"]))
    assert len(rows) == n and sorted(map(key, rows)) == sorted(map(key, spread))
    for s in ("hot", "b"):
        mine = [r for r in rows if r["source"] == s]
        begun, taken = 0, {}
        for r in sorted(mine, key=lambda r: (r["order"], str(r["doc_id"]), r["size"])):
            demand, total = int(r["target"] + 0.5), r["source_size"]
            take = sum(max(0, min(r["size"], demand - p * total - begun)) for p in range(demand // total + 1))
            taken.setdefault((r["order"], r["size"]), []).append(take)
            begun += r["size"]
        got = {}
        for r in mine:
            got.setdefault((r["order"], r["size"]), []).append(r["taken"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in taken.items()}
    assert len({r["order"] for r in rows if r["doc_id"] is None}) > 50
