"""Tables of fragments against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from siftlake.functions import dims
from siftlake.operators import dictionary
from siftlake.operators.features import first_match

ENTRIES = "fragment string, value string, ordinal long"


def plain(text, entries):
    fit = [(o, v is not None, v or "", f) for f, v, o in entries if f and o is not None and text is not None and f in text]
    return min(fit)[3] if fit else None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_bytes", [dictionary.BROADCAST_BYTES, 0])
def test_first_fragment_is_the_plain_search(spark, most_bytes):
    rng = random.Random(11)
    word = lambda a, b: "".join(rng.choice("ab.é漢𝒳/") for _ in range(rng.randint(a, b)))
    entries = [(word(1, 7), rng.choice(["x", "y", None]), rng.randint(0, 60)) for _ in range(150)]
    entries += [("", "x", 0), (None, "x", 0), ("ab", "x", None), entries[0], entries[1]]
    texts = [(i, word(0, 30)) for i in range(300)] + [(1000 + i, "a.b/a.b/é") for i in range(40)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(texts, "id long, address string")
    out = dictionary.first_fragments(df, "address", spark.createDataFrame(entries, ENTRIES), most_bytes=most_bytes)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = out.collect()
    assert {r["id"]: r["_fragment"] for r in got} == {i: plain(t, entries) for i, t in texts} and len(got) == len(texts)
    assert any(r["_fragment"] is None for r in got) and len({r["_fragment"] for r in got}) > 5


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "abc", "own"), (1, "abc", "own")], "id long, t string, _value string")
    none = spark.createDataFrame([], ENTRIES)
    assert [(r["_fragment"], r["_value"]) for r in dictionary.first_fragments(df, "t", none).collect()] == [(None, None)] * 2
    one = spark.createDataFrame([("b", "B", 1), ("b", "A", 1), ("zzzzz", "Z", 0)], ENTRIES)
    assert [(r["_fragment"], r["_value"]) for r in dictionary.first_fragments(df, "t", one).collect()] == [("b", "A")] * 2
    assert dictionary.first_fragments(df.filter("id > 1"), "t", one).count() == 0


def test_hundred_thousand_fragments(spark):
    fragments = spark.range(100_000).select(
        F.concat(F.lit("https://cdn"), F.col("id"), F.lit(".example.org")).alias("fragment"), F.col("id").cast("string").alias("value"), F.col("id").alias("ordinal")
    )
    texts = spark.range(3_000).select((F.col("id") * 37).alias("want"), F.concat(F.lit("https://cdn"), F.col("id") * 37, F.lit(".example.org/a/b.js?v=1")).alias("t"))
    out = dictionary.first_fragments(texts, "t", fragments)
    assert "NestedLoop" not in plan(out)
    assert out.filter(~F.col("_value").eqNullSafe(F.when(F.col("want") < 100_000, F.col("want").cast("string")))).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([("x" * 2_000_000 + "needle" + "y" * 2_000_000,)], "t string")
    assert dictionary.first_fragments(df, "t", spark.createDataFrame([("needle", "n", 1)], ENTRIES)).first()["_value"] == "n"


def test_table_of_trackers_is_the_expression(spark):
    rng = random.Random(2)
    texts = [(f"https://{rng.choice('abc')}.{f}/x.js",) for f, _ in dims.TRACKERS] + [("https://hubspot.com/doubleclick.net",), ("https://e.org",)]
    entries = spark.createDataFrame([(f, v, i) for i, (f, v) in enumerate(dims.TRACKERS)], ENTRIES)
    out = dictionary.first_fragments(spark.createDataFrame(texts, "t string"), "t", entries).withColumn("want", first_match(F.col("t"), dims.TRACKERS))
    assert out.filter(~F.col("_value").eqNullSafe(F.col("want"))).count() == 0 and out.count() == len(texts)
