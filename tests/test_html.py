"""Tokens, references, attributes and nesting against a plain tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.functions import html
from siftlake.functions.dims import SKIPPED_TAGS


@pytest.fixture(scope="module")
def parsed(spark):
    def run(pages):
        df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").withColumn("t", html.tokens("html"))
        df = df.withColumns({"b": html.structure("t"), "e": html.elements("t")})
        out = df.select("i", "e", html.title("t", "b").alias("title"), html.headings("t", "b").alias("headings"), html.anchor_texts("t", "b").alias("anchors"), html.body_text("t", "b").alias("body"))
        return sorted(out.collect(), key=lambda r: r["i"])

    return run


class Node:
    def __init__(self, name):
        self.name, self.children = name, []

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def all(self):
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.all()

    def visible(self):
        return "".join(c + " " if isinstance(c, str) else "" if c.name in SKIPPED_TAGS else c.visible() for c in self.children)


def tree(page):
    """A tree built by hand; raw elements are nodes with their content."""
    root = Node("")
    stack = [root]
    for m in re.finditer(r"(?s)<script>(.*?)</script>|<!--.*?-->|<(/?)([a-z0-9]+)>|([^<]+)", page):
        if m[1] is not None:
            stack[-1].children.append(raw := Node("script"))
            raw.children.append(m[1])
        elif m[4]:
            stack[-1].children.append(m[4])
        elif m[3] and not m[2]:
            while len(stack) > 1 and stack[-1].name in html.ENDS.get(m[3], ()):
                stack.pop()
            new = Node(m[3])
            again = m[3] in ("html", "head", "body") and m[3] in [x.name for x in stack]
            if not again:
                stack[-1].children.append(new)
            if m[3] not in html.VOID and not again and len(stack) <= html.DEPTH:
                stack.append(new)
        elif m[3]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == m[3]:
                    del stack[i:]
                    break
                if html.RANKS.get(stack[i].name, 1) > html.RANKS.get(m[3], 1):
                    break
    return root


def expected(page):
    root = tree(page)
    nodes = list(root.all())
    first = lambda name: next((n for n in nodes if n.name == name), None)
    title, body = first("title"), first("body")
    heads = [(int(n.name[1]), n.text().strip(" \t\n\r")) for n in nodes if n.name in html.HEADINGS]
    return title and title.text(), heads, [n.text().strip(" \t\n\r") for n in nodes if n.name == "a"], body.visible()


def random_page(rng):
    names = ["a", "b", "div", "p", "h1", "h2", "ul", "li", "pre", "code", "template", "noscript", "td", "tr", "table", "br", "span"]
    parts, n = [], 0
    for _ in range(rng.randint(0, 60)):
        x = rng.random()
        n += 1
        if x < 0.35:
            parts.append(f"<{rng.choice(names)}>")
        elif x < 0.6:
            parts.append(f"</{rng.choice(names)}>")
        elif x < 0.65:
            parts.append("<script>if (a</*<!--*/b) c()</script>")
        elif x < 0.7:
            parts.append(f"<!-- <p> {n} -->")
        else:
            parts.append(f" t{n} ")
    return f"<html><head><title>T{n}</title></head><body>" + "".join(parts)


def test_texts_equal_a_plain_tree(parsed):
    """Nested, crossed, unclosed and implied ends at random."""
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(400)]
    for page, r in zip(pages, parsed(pages), strict=True):
        title, heads, anchors, body = expected(page)
        assert (r["title"], [tuple(h) for h in r["headings"]], r["anchors"]) == (title, heads, anchors), page
        assert r["body"] == body, page


def test_deep_pages_are_flat_beyond_the_bound(parsed):
    pages = ["<body>" + "<div>" * 400 + "<h1>x</h1>" + "</div>" * 400 + "y", "<body>" + "<b>" * 100 + "<h1>x</h1>y"]
    deep, fine = parsed(pages)
    assert deep["headings"] == [] and deep["body"] == "x y "
    assert [tuple(h) for h in fine["headings"]] == [(1, "x")] and fine["body"] == "x y "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("caf&eacute;", "café"),
        ("&amp;lt; &lt;b&gt;", "&lt; <b>"),
        ("&#233;&#xE9;&#Xe9;&#x2014;&#128512;", "ééé—😀"),
        ("&#233 &#x41 &eacute &nope; & &; &#; &#x;", "é A &eacute &nope; & &; &#; &#x;"),
        ("a&#0;b&#xD800;c&#99999999999999999999;d&#x110000;e", "abcde"),
        ("&apos;&quot;&nbsp;&AMP;", "'\"\xa0&AMP;"),
        ("", ""),
    ],
)
def test_references_are_decoded_once(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(html.decoded(F.col("t"))).first()[0] == want


def test_attributes(parsed):
    [r] = parsed(["<p class = 'a \"b\"' ID=x/y title=\"<!-- >\" data-n hidden class=c alt='' href=/q?a=b&amp;c=d><br/><img src=a.png alt = \"&eacute;\"/>"])
    assert [(e["tag"], [tuple(a) for a in e["attrs"]]) for e in r["e"]] == [
        ("p", [("class", 'a "b"'), ("id", "x/y"), ("title", "<!-- >"), ("data-n", ""), ("hidden", ""), ("class", "c"), ("alt", ""), ("href", "/q?a=b&c=d")]),
        ("br", []),
        ("img", [("src", "a.png"), ("alt", "é")]),
    ]


def test_comments_in_scripts_and_values_are_content(parsed):
    pages = [
        '<script>var s="<!--";</script><title>T</title><h1>H</h1><a href=/x>L</a>',
        "<script><!-- f() //--></script>x",
        '<p title="<!--">a</p><h1>b</h1>',
        "<!--><h1>c</h1><!---><h2>d</h2><!-- e",
        "<?xml version='1'?><!DOCTYPE html></ ><h1>f</h1>",
        "<style>a<b</style><script/>g<h1>h</h1>",
    ]
    out = parsed(pages)
    assert (out[0]["title"], out[0]["anchors"], [h["text"] for h in out[0]["headings"]]) == ("T", ["L"], ["H"])
    assert out[1]["e"][0]["body"] == "<!-- f() //-->" and out[1]["body"] == "x "
    assert [h["text"] for r in out[2:] for h in r["headings"]] == ["b", "c", "d", "f", "h"]
    assert out[5]["body"] == "g h "


def test_pages_without_a_body_tag(parsed):
    pages = ["<title>T</title>one<pre>no</pre> two", "<head><title>T</title></head>one</html>two", "", None]
    assert [r["body"] for r in parsed(pages)] == ["one  two ", "one ", "", ""]
