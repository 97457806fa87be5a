"""The manifest against a plain Merkle tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftlake.llm import manifest as m
from tests.llm.helpers import odd_docs


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for f in m.FIELDS:
        x = row[f]
        if x is not None:
            x = str(x)
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x) if lower and f == "text" else x
        out += "-" if x is None else f"{len(x.encode())}:{x}"
    return sha(out)


def tree(digests):
    """The root, and for each leaf its (left, right) by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for j, i in enumerate(at):
            lo = i // 16 * 16
            paths[j].append(("".join(digests[lo:i]), "".join(digests[i + 1 : lo + 16])))
        at = [i // 16 for i in at]
        digests = [sha("".join(digests[i : i + 16])) for i in range(0, len(digests), 16)]
    return digests[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs[s] = tree([leaf(r) for r in by[s]])
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(by[s], subs[s][1], strict=True):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            d = leaf(r, bad)
            for left, right in path + top:
                d = sha(left + d + right)
            out.append((r["doc_id"], leaf(r), subs[s][0], root, sha("".join(x + y for x, y in path + top)), d, d == root))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, m.op12_interval_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, "b": 1, None: 16}, {"a": 300, None: 33, "": 2, "é": 5, "z": 1, **{f"s{i}": 1 + i % 3 for i in range(20)}}])
def test_equals_a_plain_tree(spark, tmp_path, sizes):
    rng, rows = random.Random(3), []
    for source, n in sizes.items():
        rows += [(source, rng.choice(["Some Text", "plain", "", None]), rng.choice(["en", None])) for _ in range(n)]
    rng.shuffle(rows)
    rows = [(i, t, lang, s, len(t) if t else None) for i, (s, t, lang) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = found(spark, df, tmp_path)
    assert got == plain([r.asDict() for r in df.collect()])
    assert any(not r[-1] for r in got) or len(rows) < 100


def test_odd_rows(spark, tmp_path):
    df = odd_docs(spark).withColumn("digest", F.lit("mine")).withColumn("tree", F.lit("mine"))
    assert found(spark, df, tmp_path) == plain([r.asDict() for r in df.collect()])


def test_an_empty_table_has_no_root(spark, tmp_path):
    assert found(spark, odd_docs(spark).limit(0), tmp_path) == []


def test_intervals_nest(spark):
    rows = spark.range(700).select((F.col("id") % 2).cast("string").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes = m.manifest(rows, "id").trees.nodes().collect()
    spans = {(n["tree"], n["level"]): sorted((x["lo"], x["hi"]) for x in nodes if (x["tree"], x["level"]) == (n["tree"], n["level"])) for n in nodes}
    assert {k[1]: len(v) for k, v in spans.items() if k[0] == "=0"} == {0: 350, 1: 22, 2: 2, 3: 1}
    for v in spans.values():
        assert v[0][0] == 0 and v[-1][1] == 350 and all(a[1] == b[0] for a, b in zip(v, v[1:], strict=False))
