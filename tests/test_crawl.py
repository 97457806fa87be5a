"""Breadth-first expansion: depths against a plain search, and what a round shuffles."""

import random
import re

import duckdb

from siftlake.operators import crawl
from siftlake.plans import catalogue
from tests.test_entry import SF


def test_random_links_are_the_plain_search(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(420)] + [(7, i) for i in range(0, 300, 5)] * 2 + [(None, 1), (2, None)]
    want, level, depth = {0: 0, 1: 0, None: 0}, {0, 1}, 0
    while level:
        depth += 1
        level = {t for s, t in edges if s in level and t not in want and t is not None}
        want |= dict.fromkeys(level, depth)
    df = spark.createDataFrame(edges, "source long, target long")
    seeds = spark.createDataFrame([(0,), (1,), (1,), (None,)], "page long")
    got = crawl.breadth_first(seeds, df)
    assert got.columns == ["page", "depth"] and sorted(map(str, got.collect())) == sorted(f"Row(page={p}, depth={d})" for p, d in want.items())
    two = {r["page"]: r["depth"] for r in crawl.breadth_first(seeds, df, 2).collect()}
    assert two == {p: d for p, d in want.items() if d <= 2} and crawl.breadth_first(seeds.limit(0), df).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("seen_", "edges_"))]


def test_a_chain_of_many_levels(spark):
    chain = spark.range(40).selectExpr("id as source", "id + 1 as target")
    got = crawl.breadth_first(spark.range(1).selectExpr("id as page"), chain).collect()
    assert sorted((r["page"], r["depth"]) for r in got) == [(i, i) for i in range(41)]


def test_seen_pages_and_edges_are_not_shuffled_again(spark, monkeypatch):
    """With joins by sorting, a round's plan exchanges its frontier and candidates only: both bucketed tables are read where they are."""
    plans, append = [], crawl._Buckets.append
    monkeypatch.setattr(crawl._Buckets, "append", lambda self, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), append(self, rows))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(50).selectExpr("id as source", "id * 2 as target")
        assert crawl.breadth_first(spark.range(1, 2).selectExpr("id as page"), edges).count() == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounds = plans[2:]
    assert len(rounds) == 7
    for plan in rounds:
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2 and "Bucketed: true" in plan


def test_a_crawl_goes_beyond_the_depth_of_its_sql(spark, tmp_path):
    """Down to depth 12 the rows are the SQL's; those beyond it are what a plain search over the site's links reaches, all of it."""
    n = 1000
    duckdb.sql(f"copy (select page_id + 50 * i as page_id, url, html from '{SF}/pages.parquet', range({n // 50}) r(i)) to '{tmp_path}/pages.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want, level, depth = {}, {0}, 0
    while level:
        want |= dict.fromkeys(level, depth)
        live = [p for p in level if p % 13 != 5]
        level = {t for p in live for t in (2 * p + 1, 2 * p + 2, p // 3, *([3 * p + 2] if p % 5 == 0 else []))}
        level, depth = {t for t in level if t < n and t not in want}, depth + 1
    want = {(p, d) for p, d in want.items() if p % 13 != 5}
    got = catalogue.queries()["crawl_reports"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and max(d for _, d in want) > 12
    assert {(p, d) for p, d in want if d <= 12} == set(con.sql(catalogue.oracle_sql()["crawl_reports"]).fetchall())
