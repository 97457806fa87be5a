import hashlib
import zlib

from pyspark.sql import functions as F

from siftlake.llm import sharding
from tests.llm.helpers import docs, odd_docs, words


def brute(key, n):
    b, j, i = -1, 0, 0
    while j < n:
        i += 1
        b, j = j, int((j + 1) * 2.0**32 / (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:8], 16) + 1))
    return b


def test_matches_the_law_in_plain_python(spark):
    df = docs(spark, [words(3, i) for i in range(500)])
    for n in (1, 2, 40, 1000):
        rows = sharding.assign_shards(df, "doc_id", n, grown="grown").collect()
        assert all(r["shard"] == brute(r["doc_id"], n) and r["grown"] == brute(r["doc_id"], n + 1) for r in rows)
        assert all(r["grown"] in (r["shard"], n) for r in rows)


def test_shards_are_even_and_slots_have_no_gaps(spark):
    df = docs(spark, ["a"] * 4000).withColumn("extra", F.lit(1))
    out = sharding.assign_slots(sharding.assign_shards(df, "doc_id", 8), "shard", ["doc_id", "text"]).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["extra"] == 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(400 < len(v) < 600 for v in by.values())


def test_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op5_jump_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == 10
    texts = {r["doc_id"]: r["text"] for r in odd_docs(spark).collect()}
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 16 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "key"
    assert len({(r["shard"], r["slot"]) for r in rows}) == 10
    odd_docs(spark).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert sharding.op5_jump_sharding(spark, str(tmp_path / "none")).count() == 0
