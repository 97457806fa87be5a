"""Streams against their batch queries: emitted events, readers' states, rules by host."""

import random

from pyspark.sql import functions as F

from siftlake.operators import events, features, reports, rules
from siftlake.sources import robots
from siftlake.streaming import feed, reader, totals


def _audited(df):
    return rules.with_findings(features.page_features(df))


def test_feed_is_the_batch_query_and_replays_add_nothing(spark, tmp_path):
    rows = [(f"https://e.org/{i}", f"<html><body><img src=a>{'w ' * i}</body></html>" if i != 3 else None, i % 2 == 0) for i in range(12)]
    df = spark.createDataFrame(rows, "url string, html string, has_sitemap boolean")
    for i, part in enumerate(df.randomSplit([1.0, 1.0, 1.0], 4)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    path = str(tmp_path / "feed")
    told = feed.run_feed(_audited(totals.page_stream(spark, str(tmp_path / "in/p*"), max_files=1)), path).collect()
    batch = _audited(df)
    assert sorted(r["event"] for r in told if r["kind"] == "page") == sorted(r["event"] for r in events.page_events(batch).collect())
    done = events.done_event(reports.crawl_totals(batch)).first()["event"]
    assert [r["event"] for r in told if r["kind"] == "done"] == [done]
    progress = sorted((r["batch"], r["event"]) for r in told if r["kind"] == "progress")
    assert [b for b, _ in progress] == [0, 1, 2] and '"total_done":12,' in progress[-1][1]
    again = spark.read.parquet(*[str(p) for p in (tmp_path / "in").iterdir()])
    n = {b: sum(r["batch"] == b for r in told if r["kind"] == "page") for b in range(3)}
    urls = [r["url"] for r in told if r["kind"] == "page" and r["batch"] == 1]
    feed.emit(_audited(again.filter(F.col("url").isin(urls))), 1, path)
    feed.close(spark, path)
    replayed = feed.emitted(spark, path).collect()
    assert sorted(map(str, replayed)) == sorted(map(str, told)) and sum(n.values()) == 12
    more = spark.createDataFrame([("https://e.org/new", "<html></html>", True)], df.schema)
    more.coalesce(1).write.parquet(str(tmp_path / "in/p9"))
    told = feed.run_feed(_audited(totals.page_stream(spark, str(tmp_path / "in/p*"), max_files=1)), path).collect()
    assert sum(r["kind"] == "page" for r in told) == 13 and [r["event"] for r in told if r["kind"] == "done"][0].count('"total_pages":13,') == 1


def test_a_feed_without_batches_is_done(spark, tmp_path):
    feed.close(spark, str(tmp_path / "none"))
    assert [r["kind"] for r in feed.emitted(spark, str(tmp_path / "none")).collect()] == ["done"]


def test_readers_are_the_batch_query_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["page"] * 5 + ["progress"] * 3 + ["done", "error", "odd", None]
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice(kinds), f"u{i}") for i in range(400)]
    rows += [(9, 1000, "odd", "x"), (9, None, "page", "x")]
    rng.shuffle(rows)
    schema = "who bigint, ordinal bigint, type string, url string"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    df = spark.createDataFrame(rows, schema)
    follow = lambda: reader.run_readers(totals.page_stream(spark, str(tmp_path / "in/p*"), max_files=1), "who", str(tmp_path / "state"))
    want = sorted(map(str, events.reader_state(df.filter("ordinal is not null or who is null"), "who").collect()))
    assert sorted(map(str, follow().collect())) == want
    late = [(1, 5000, "progress", "last"), (1, -1, "done", "x"), (4, 1, "page", "x")]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(tmp_path / "in/p7"))
    got = {r["who"]: r for r in follow().collect()}
    both = events.reader_state(df.filter("ordinal is not null or who is null").unionByName(spark.createDataFrame(late, schema)), "who")
    assert sorted(map(str, got.values())) == sorted(map(str, both.collect())) and got[1]["working_on"] == "last" and got[4]["pages"] == 1


def test_rules_by_host_are_the_plain_search(spark):
    rng = random.Random(5)
    piece = lambda: "".join(rng.choice("ab/é") for _ in range(rng.randint(1, 5)))
    rules_ = [(rng.choice(["h1", "h2", None]), rng.choice(["", None, "/", "/" + piece()]), rng.random() < 0.4) for _ in range(120)]
    addresses = [(i, rng.choice(["h1", "h1", "h2", "h3", None]), rng.choice([None, "", "/" + piece() + piece()])) for i in range(400)]
    addresses += [(1000 + i, "h1", "/same") for i in range(50)]

    def plain(host, path):
        if host is None or path is None:
            return True
        fit = [(len(r.encode()), ok) for h, r, ok in rules_ if h == host and r and path.startswith(r)]
        barred = max([n for n, ok in fit if not ok], default=0)
        return not barred or max([n for n, ok in fit if ok], default=0) >= barred

    df = spark.createDataFrame(addresses, "id long, host string, path string")
    met = robots.allowed_by_rules(df, spark.createDataFrame(rules_, "host string, rule string, allow boolean"))
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    out = met.collect()
    assert {(r["id"], r["allowed"]) for r in out} == {(i, plain(h, p)) for i, h, p in addresses} and len(out) == len(addresses)
    assert {r["allowed"] for r in out} == {True, False}


def test_robots_of_many_lines(spark):
    body = "Sitemap: s\nDisallow: /none\n" + "User-agent: *\nDisallow: /a\n" * 20_000 + "User-agent: x\nDisallow: /b\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: 2\n"
    got = robots.parsed_robots(spark.createDataFrame([(body,)], "body string")).first()
    assert got["disallowed"] == ["/a"] * 20_000 and got["sitemaps"] == ["s"] and got["crawl_delay_ms"] == 2000
