from pyspark.sql import functions as F

from siftlake.functions import text
from siftlake.operators import crawl, events
from siftlake.plans import catalogue
from siftlake.functions.dims import CATEGORIES
from siftlake.sources import documents, enrich, robots, sitemaps
from siftlake.streaming import totals

ROBOTS = """# x
User-agent: *
Disallow: /admin
Disallow: /tmp
Allow: /admin/public
Crawl-delay: 2
User-agent: OtherBot
Disallow: /

Sitemap: https://e.org/a.xml
User-Agent: mybot
Disallow: /own
sitemap: https://e.org/b.xml
"""


def test_robots(spark):
    df = spark.createDataFrame([(ROBOTS, p) for p in ("/admin/public/x", "/admin/secret", "/own/1", "/free")], "body string, path string")
    star = robots.parsed_robots(df, agent="nobody").withColumn("ok", robots.is_allowed("path")).collect()
    assert star[0]["disallowed"] == ["/admin", "/tmp"] and star[0]["sitemaps"] == ["https://e.org/a.xml", "https://e.org/b.xml"]
    assert star[0]["crawl_delay_ms"] == 2000 and [r["ok"] for r in star] == [True, False, True, True]
    own = robots.parsed_robots(df, agent="MyBot").withColumn("ok", robots.is_allowed("path")).collect()
    assert own[0]["disallowed"] == ["/own"] and own[0]["allowed"] == [] and [r["ok"] for r in own] == [True, True, False, True]
    empty = robots.parsed_robots(spark.createDataFrame([(None,), ("junk",)], "body string")).collect()
    assert all(r["disallowed"] == [] and r["crawl_delay_ms"] == 0 for r in empty)


def test_sitemaps(spark):
    flat = '<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://e.org/1 </loc><lastmod>2024</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url><url><loc>https://e.org/2</loc><priority>high</priority></url><url></url></urlset>'
    index = "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>"
    rows = sitemaps.parsed_sitemaps(spark.createDataFrame([(flat,), (index,), ("",), (None,)], "xml string")).collect()
    assert [e["loc"] for e in rows[0]["entries"]] == ["https://e.org/1", "https://e.org/2"] and rows[0]["entries"][0]["priority"] == 0.5
    assert (rows[0]["missing_lastmod"], rows[0]["missing_priority"], rows[0]["missing_changefreq"]) == (1, 1, 1)
    assert rows[1]["is_index"] and rows[1]["child_sitemaps"] == ["a", "b"] and rows[1]["entries"] == [] and rows[2]["entries"] == rows[3]["entries"] == []
    made = spark.range(1).select(sitemaps.candidates(F.lit("https://e.org/"), F.array(F.lit("r"))).alias("c")).first()["c"]
    assert made == ["r", "https://e.org/sitemap.xml", "https://e.org/sitemap_index.xml", "https://e.org/sitemap.xml.gz"]


def test_page_speed(spark):
    body = '{"lighthouseResult":{"categories":{"performance":{"score":0.876},"seo":{"score":1},"accessibility":{"score":1.0}},"audits":{"largest-contentful-paint":{"numericValue":2500.5},"cumulative-layout-shift":{"numericValue":0.1}}}}'
    a, b = enrich.page_speed(spark.createDataFrame([(body,), ("not json",)], "body string")).collect()
    assert (a["lighthouse_performance"], a["lighthouse_seo"], a["lighthouse_accessibility"], a["lighthouse_best_practices"]) == (88, 1, 100, None)
    assert (a["lcp_ms"], a["inp_ms"], a["cls_score"], b["lighthouse_performance"]) == (2501, None, 0.1, None)


def test_technologies(spark):
    body = '{"Results":[{"Result":{"Paths":[{"Technologies":[{"Name":"A","Tag":"t"},{"Name":"B","Categories":[{"Name":"C"}]}]},{"Technologies":[{"Name":"A","Tag":"u"},{"Name":"D"}]}]}}]}'
    df = enrich.technologies(spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "id int, body string"), "id")
    assert {(r["name"], r["tag"], r["category"]) for r in df.collect()} == {("A", "t", ""), ("B", "", "C"), ("D", "", "")}
    assert {(r["kind"], r["names"]) for r in enrich.by_category(df, "id").collect()} == {("t", "A"), ("C", "B"), ("Other", "D")}
    rec = enrich.recommendations(spark.createDataFrame([(1, '[{"quadrant":"q","title":"t","extra":1}]')], "id int, body string"), "id").first()
    assert (rec["quadrant"], rec["title"], rec["effort"]) == ("q", "t", None)


def test_addresses(spark):
    rows = [
        ("https://u@e.org:80/a/b?x=1", "u@e.org:80", "https://u@e.org:80"), ("http://E.org", "E.org", "http://E.org"), ("/rel", None, None),
        ("https://e.org?q#f/x", "e.org?q#f", "https://e.org?q#f"),
    ]
    df = spark.createDataFrame(rows, "u string, h string, o string")
    for r in df.select("h", "o", text.hostname("u").alias("host"), text.origin("u").alias("origin")).collect():
        assert (r["host"], r["origin"]) == (r["h"], r["o"])
    third = spark.createDataFrame([("//cdn.x/y", False), ("https://a.b/x", True), ("./x", False), ("https://e.org/x", False), ("mailto:a", False)], "h string, want boolean")
    assert all(r["got"] == r["want"] for r in third.select("want", text.is_third_party("h", F.lit("https://e.org/")).alias("got")).collect())
    codes = spark.createDataFrame([("a%20b+c", "a b c"), ("100%", "100%"), ("%zz%41", "%zzA"), ("caf%C3%A9", "café")], "x string, want string")
    assert all(r["got"] == r["want"] for r in codes.select("want", text.percent_decoded("x").alias("got")).collect())
    q = spark.range(1).select(text.get_param(F.lit("a=1&b&a=2&c="), "a").alias("a"), text.get_param(F.lit("a=1&b"), "b").alias("b"), text.segment(F.lit("/x/y"), 1).alias("s")).first()
    assert (q["a"], q["b"], q["s"]) == ("1", None, "y")


def test_phrases(spark):
    rows = [("aaaa", "aa", 2), ("One one ONE", "one", 3), ("x", "", 0), (None, "a", 0), ("É é", "é", 1)]
    df = spark.createDataFrame(rows, "t string, p string, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", text.n_occurrences("t", "p").alias("got")).collect())
    assert spark.range(1).select(text.n_ascii_words(F.lit("don't naïve")).alias("n")).first()["n"] == 4


def test_registered_breadth_first_reaches_every_page(spark, tmp_path):
    n = 30000
    spark.range(n).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    depth, level = {0: 0}, [0]
    while level:
        found = {t for p in level for t in (2 * p + 1, 2 * p + 2, p * 7 % n) if t < n and t not in depth}
        depth |= dict.fromkeys(found, depth[level[0]] + 1)
        level = list(found)
    got = {r["page"]: r["depth"] for r in catalogue.queries()["frontier_bfs"](spark, str(tmp_path)).collect()}
    assert len(got) == n and max(got.values()) == 13 and got == depth


def test_breadth_first_finds_least_depth_in_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3), (3, 2), (2, 4), (4, 5)], "source bigint, target bigint")
    seen = crawl.breadth_first(spark.createDataFrame([(0,), (0,)], "page bigint"), edges, 3)
    assert {r["page"]: r["depth"] for r in seen.collect()} == {0: 0, 1: 1, 3: 1, 2: 2, 4: 3}


def test_crawl_follows_links_and_sitemaps_and_drops_failures(spark):
    site = "https://s.example.org/"
    link = lambda *pages: "<html><body>" + "".join(f'<a href="{site}{p}">x</a>' for p in pages) + '<a href="https://other.example.org/z">z</a></body></html>'
    rows = [
        (site + "0", link("1", "2", "0"), [site + "5"]),
        (site + "1", None, [site + "9"]),
        (site + "2", link("3", "gone"), None),
        (site + "3", link("4"), []),
        (site + "4", link(), None),
        (site + "5", link("2"), None),
        (site + "9", link(), None),
        ("https://other.example.org/z", link(), None),
    ]
    pages = spark.createDataFrame(rows, "url string, html string, sitemap_locs array<string>")
    seeds = spark.createDataFrame([(site + "0",)], "url string")
    depths = lambda d: {r["url"].rsplit("/", 1)[1]: r["depth"] for r in crawl.crawl(pages, seeds, d).collect()}
    assert depths(None) == {"0": 0, "2": 1, "5": 1, "3": 2, "4": 3} and depths(1) == {"0": 0, "2": 1, "5": 1}
    assert crawl.crawl(pages, seeds.limit(0)).count() == 0 and crawl.crawl(pages.limit(0), seeds).count() == 0


def test_goals_and_baselines_from_json(spark):
    goal = '{"pages":[{"url":"u","keywords":["a","b c"],"x":1},{"url":"v","keywords":[]}],"other":{}}'
    rows = documents.goals(spark.createDataFrame([(goal,), ("no json",), (None,)], "body string")).collect()
    assert sorted(map(tuple, rows)) == [("u", "a"), ("u", "b c")]
    scores = ",".join(f'"{c}":{i}' for i, c in enumerate(CATEGORIES))
    page = f'{{"url":"u","scores":{{{scores}}},"findings":[{{"rule_id":"r","category":"seo","severity":"info","detail":"d"}}],"extra":1}}'
    bad = '{"url":"w","findings":[]}'
    texts = spark.createDataFrame([(page,), (f"[{page},{bad}]",), (bad,), ("{",), (None,)], "body string")
    out = documents.baseline(texts).collect()
    assert [(r["url"], r["performance"], r["aeo"], r["findings"][0]["rule_id"]) for r in out] == [("u", 0, 6, "r")] * 2


def test_progress_event(spark):
    runner = [(0, "working", 3, 1, "https://a/"), (1, "idle", 0, 0, "")]
    df = spark.createDataFrame(
        [("crawling", 3, 9, runner)],
        "phase string, total_done int, total_queued int, runners array<struct<id:int,status:string,pages_done:int,pages_failed:int,url:string>>",
    )
    assert events.progress_event(df).first()["event"] == (
        'event: progress\ndata: {"phase":"crawling","total_done":3,"total_queued":9,"runners":['
        '{"id":0,"status":"working","pages_done":3,"pages_failed":1,"url":"https://a/"},'
        '{"id":1,"status":"idle","pages_done":0,"pages_failed":0,"url":""}]}\n\n'
    )


def test_stream_totals_match_batch(spark, tmp_path):
    rows = [(f"https://e.org/{i}", f"<html><head></head><body><img src=a>{'w ' * i}</body></html>", i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "url string, html string, has_sitemap boolean").repartition(4)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = totals.run_totals(totals.finding_totals(totals.page_stream(spark, str(tmp_path / "pages.parquet"), max_files=1)))
    want = totals.finding_totals(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events(spark):
    lines = ['{"type":"page","url":"u","status":200}', "broken", '{"type":"odd"}', '{"type":"done","total_pages":3}']
    out = totals.parsed_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["type"], r["url"], r["total_pages"]) for r in out] == [("page", "u", None), ("done", None, 3)]


def test_routes_and_requests(spark):
    rows = [("/api/audit?url=x", "audit"), ("/projects/", "not_found"), ("/projects/1", "project_get"), ("/projects/1/audit", "project_audit"), ("/projects", "projects_list"), ("/x", "not_found")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", events.route("t").alias("got")).collect())
    asked = spark.createDataFrame([("/api/crawl?url=u&depth=x&runners=9",), ("/api/crawl?depth=2",)], "t string").select(events.crawl_parameters("t").alias("p")).collect()
    assert tuple(asked[0]["p"]) == ("u", 1, 9, None) and asked[1]["p"] is None
    agent = spark.range(1).select(events.user_agent(F.lit("bot"), F.lit("1"), F.lit("c"), F.lit("mobile")).alias("a")).first()["a"]
    assert agent == "bot/1 (site auditor; c; profile=mobile)"
