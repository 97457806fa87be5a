"""Facts about small pages, one behaviour each."""

import pytest
from pyspark.sql import functions as F

from siftlake.operators.features import page_features, top_words

URL = "https://example.com/page"


@pytest.fixture(scope="module")
def audit(spark):
    def run(*pages, keyword=None):
        rows = [p if isinstance(p, tuple) else (URL, p) for p in pages]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
        out = page_features(df, F.lit(keyword) if keyword is not None else None)
        return sorted(out.collect(), key=lambda r: r["page_id"])

    return run


def page(head="", body="", lang=' lang="en"'):
    return f"<html{lang}><head>{head}</head><body>{body}</body></html>"


def test_core_and_links(audit):
    body = '<h1>One <b>b</b></h1><h2>Two</h2><h3> </h3><h2>Last</h2><a href="/page">p</a><a href="https://example.com/x">x</a><a href="https://other.com">o</a><a href="mailto:a@b">m</a><a href="#t">t</a>'
    [r] = audit(page('<title> A &amp; B </title><meta name="description" content="Desc">', body))
    assert r["title"] == " A & B " and r["description"] == "Desc" and r["h1"] == "One b"
    assert [(h["level"], h["text"]) for h in r["headings"]] == [(1, "One b"), (2, "Two"), (2, "Last")]
    assert r["heading_sequence"] == [1, 2, 3, 2]
    assert [x["is_internal"] for x in r["links"]] == [True, True, False, False, True]
    assert (r["internal_links"], r["external_links"], r["outbound_links"]) == (3, 2, 1)


def test_performance(audit):
    head = (
        '<script src="https://a.com/1.js"></script><script src="https://b.com/2.js" async></script><script src="/3.js" defer></script>'
        '<script>var t="</p>";</script><script src="">x</script><link rel="stylesheet" href="https://a.com/s.css"><link rel="stylesheet" href="/t.css">'
        "<style>p{}</style><link rel=\"preload\" href='/p'><link rel=preconnect href=/q><link rel=\"dns-prefetch\" href=\"/r\"><link rel=\"stylesheet preload\" href=\"/u\">"
    )
    [r] = audit(page(head, '<img src="a" width="1" height="2"><img src="b" width="1">'))
    assert (r["external_scripts"], r["blocking_scripts"], r["async_scripts"], r["defer_scripts"]) == (3, 1, 1, 1)
    assert (r["inline_scripts"], r["inline_script_bytes"]) == (2, len('var t="</p>";') + 1)
    assert (r["external_stylesheets"], r["inline_styles"], r["inline_style_bytes"]) == (2, 1, 3)
    assert (r["image_count"], r["images_missing_dims"]) == (2, 1)
    assert (r["preload"], r["prefetch"], r["preconnect"], r["dns_prefetch"]) == (1, 0, 1, 1)
    assert r["third_party_domains"] == ["a.com", "b.com"]


def test_accessibility(audit):
    body = (
        '<a href="#main">skip</a><nav></nav><div role="main"></div><img src="a"><img src="b" alt=""><img alt="x" role="presentation">'
        '<a href="/a">Click Here</a><a href="/b"><img src="c" alt="d"></a><input type="text"><input type="hidden"><label for="e">E</label><input id="e">'
        '<input aria-label="f"><p tabindex="1"></p><p tabindex="2"></p><p tabindex="0"></p><p tabindex="x"></p>'
    )
    with_zoom, plain, bare = audit(
        page('<meta name="viewport" content="maximum-scale=10">', body), page('<meta name="viewport" content="width=1">'), page("", "", lang="")
    )
    r = with_zoom
    assert r["html_lang"] == "en" and bare["html_lang"] is None and r["zoom_disabled"] and not plain["zoom_disabled"]
    assert r["has_skip_link"] and r["has_main_landmark"] and r["has_nav_landmark"] and not plain["has_nav_landmark"]
    assert (r["images_missing_alt"], r["images_empty_alt"]) == (1, 1)
    assert (r["generic_links"], r["empty_links"], r["inputs_missing_label"], r["n_positive_tabindex"]) == (1, 1, 1, 2)


def test_privacy(audit):
    scripts = '<script src="https://www.googletagmanager.com/a.js"></script><script src="https://static.hotjar.com/b"></script><script src="https://cdn.cookielaw.org/c"></script><script src="/local.js"></script>'
    full, dom, none = audit(page(scripts, '<iframe src="https://www.youtube.com/e"></iframe>'), page("", '<div id="cookie-banner"></div>'), page())
    assert len(full["script_domains"]) == 3 and full["iframe_domains"] == ["www.youtube.com"]
    assert [(t["domain"], t["category"]) for t in full["trackers"]] == [("www.googletagmanager.com", "analytics"), ("static.hotjar.com", "analytics"), ("cdn.cookielaw.org", "unknown")]
    assert full["consent_tool"] == "OneTrust" and dom["consent_tool"] == "custom" and not none["has_banner"]


def test_search_and_practices(audit):
    head = '<title>Hello éé</title><link rel="canonical" href=""><meta name="robots" content="NoIndex, NOFOLLOW"><meta property="og:title" content="T"><link rel="alternate" hreflang="de"><link hreflang="fr">'
    r, http = audit(page(head, '<font></font><a href="http://x.org">x</a><img src="http://y.org/i">'), ("http://example.com", page("", '<a href="http://x.org">x</a>')))
    assert r["title_length"] == 10 and r["canonical"] == "" and r["has_noindex"] and r["has_nofollow"] and r["og_title"] == "T" and r["og_image"] is None
    assert (r["hreflang_count"], r["mixed_content"], r["deprecated_tags"], r["is_https"]) == (2, 2, 1, True)
    assert (http["mixed_content"], http["is_https"]) == (0, False)


def test_answers(audit):
    ld = lambda s: f'<script type="application/ld+json">{s}</script>'
    rows = audit(
        page(ld('{"@type":"FAQPage"}')), page(ld('{"@type":"NewsArticle","author":"A"}')), page(ld('{"organization":1}')),
        page('<meta name="author" content="me">', "<h2> Is it so</h2>"), page("", "<h1>What now?</h1><h5>Why?</h5>"), page("", "<h3>Really?</h3>"), page("", "<h2>Island life</h2>"),
    )
    assert rows[0]["has_faq"] and rows[1]["has_article"] and rows[1]["has_author"] and rows[2]["has_publisher"] and rows[3]["has_author"]
    assert [r["has_qa_headings"] for r in rows] == [False, False, False, True, False, True, False]


def test_keywords(audit, spark):
    text = "cat sat on the mat the cat is a fat cat"
    r, target = audit(page("", text), page("<title>Quick</title>", "the quick brown fox jumps over the lazy dog"), keyword="quick")
    assert r["total_words"] == 8
    assert target["kw_in_title"] and not target["kw_in_h1"] and (target["kw_density"], target["total_words"]) == (111, 9)
    top = top_words(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("rank").collect()
    assert (top[0]["word"], top[0]["n"]) == ("cat", 3) and not {"the", "is"} & {t["word"] for t in top}
    [empty] = audit(page("", text), keyword="")
    assert empty["kw_in_title"] and empty["kw_density"] == 0


def test_body_text_skips_code_and_comments(audit):
    r, none = audit(page("", "a<b>b</b><!-- no --><script>x</script><pre>y</pre><code>z</code><noscript>w</noscript>c&nbsp;d"), (URL, None))
    assert r["body_text"].split() == ["a", "b", "c", "d"]
    assert none["title"] is None and none["total_words"] == 0 and none["html_lang"] is None


def test_no_page_ends_the_jvm(audit):
    attributes = "<p " + " ".join(f'a{i}="v{i}"' for i in range(20000)) + "><a href='/x'>x</a>"
    unbalanced = '<p class="x>\n' + '<a href="/y">y</a>\n' * 30000
    pages = [
        attributes,
        unbalanced,
        '<p class="x>' + "a" * 5_000_000,
        "<" * 200_000 + "<a " * 200_000,
        "<!--" * 100_000 + "<h1>" * 50_000 + "<a>" * 50_000,
        "<title>" * 50_000 + "<script>" + "<script" * 50_000,
        '<a href="/1">one</a><img src=\'x\' alt="a > b"><a href=/2>two<a href="/3"',
        "<a href='" * 60_000,
        "=" * 1_000_000 + '<b ="' * 50_000,
        None,
    ]
    out = audit(*pages)
    assert len(out) == len(pages) and [x["href"] for x in out[0]["links"]] == ["/x"]
    assert len(out[1]["links"]) == 29_999 and out[6]["image_count"] == 1
    assert [x["href"] for x in out[6]["links"]] == ["/1", "/2"] and out[6]["images_missing_alt"] == 0


def test_unclosed_parts_stop_at_the_next(audit):
    row = audit("<title>T</title><h1>one<h2>two</h2><a href='/1'>x<a href='/2'>y</a><!-- open")[0]
    assert [(h["level"], h["text"]) for h in row["headings"]] == [(1, "one"), (2, "two")] and row["title"] == "T"
