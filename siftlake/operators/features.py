"""Feature extraction: one row for each page, every feature a column expression.

``page_features`` takes pages(url, html, ...) and keeps their other columns but
the HTML, which no later stage reads. There is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import dims, html
from siftlake.functions.text import (
    ascii_lower,
    contains_ci,
    density_permille,
    hostname,
    is_internal,
    is_question,
    is_third_party,
    n_bytes,
    normalised_phrase,
    trimmed,
)

TOP_WORDS = 20


def count_if(array: str | Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def first_match(text: Column, entries: list[tuple[str, str]]) -> Column:
    """The value of the first entry whose fragment the text contains; null if none does."""
    out = F.lit(None).cast("string")
    for fragment, value in reversed(entries):
        out = F.when(text.contains(fragment), F.lit(value)).otherwise(out)
    return out


def parsed_elements(pages: DataFrame) -> DataFrame:
    """Add the element arrays that the extractors read; drop the HTML."""
    df = pages.withColumn("html_bytes", n_bytes("html")).withColumn("_tokens", html.tokens("html"))
    df = df.withColumns({"_els": html.elements("_tokens"), "_bounds": html.structure("_tokens")})
    of = lambda tag: F.filter("_els", lambda e: e["tag"] == tag)
    pick = lambda tag, *names: F.transform(of(tag), lambda e: F.struct(*[html.attr(e, n).alias(n.replace("-", "_")) for n in names]))
    scripts = F.transform(
        of("script"),
        lambda e: F.struct(
            html.attr(e, "src").alias("src"),
            html.has(e, "async").alias("is_async"),
            html.has(e, "defer").alias("is_defer"),
            html.attr(e, "type").alias("type"),
            e["body"].alias("body"),
        ),
    )
    images = F.transform(
        of("img"),
        lambda e: F.struct(html.attr(e, "alt").alias("alt"), (html.has(e, "width") & html.has(e, "height")).alias("has_size")),
    )
    inputs = F.transform(
        of("input"),
        lambda e: F.struct(
            html.attr(e, "type").alias("type"),
            html.attr(e, "id").alias("id"),
            (html.has(e, "aria-label") | html.has(e, "aria-labelledby")).alias("has_aria"),
        ),
    )
    marks = F.transform(
        F.filter("_els", lambda e: html.has(e, "id") | html.has(e, "class")),
        lambda e: F.struct(ascii_lower(html.attr(e, "id")).alias("id"), ascii_lower(html.attr(e, "class")).alias("cls")),
    )
    plain_http = lambda e: F.coalesce(html.attr(e, "src").startswith("http://"), F.lit(False)) | F.coalesce(html.attr(e, "href").startswith("http://"), F.lit(False))
    plays = lambda e, role: F.coalesce(html.attr(e, "role") == role, F.lit(False))
    return (
        df.withColumns(
            {
                "scripts": scripts,
                "styles": F.transform(of("style"), lambda e: e["body"]),
                "metas": pick("meta", "name", "property", "content"),
                "link_els": pick("link", "rel", "href", "hreflang"),
                "hrefs": F.filter(F.transform(of("a"), lambda e: html.attr(e, "href")), lambda h: h.isNotNull()),
                "iframes": F.transform(of("iframe"), lambda e: html.attr(e, "src")),
                "images": images,
                "inputs": inputs,
                "label_fors": F.transform(of("label"), lambda e: html.attr(e, "for")),
                "marks": marks,
                "headings_all": html.headings("_tokens", "_bounds"),
                "anchor_texts": html.anchor_texts("_tokens", "_bounds"),
                "title": html.title("_tokens", "_bounds"),
                "has_title": F.exists("_els", lambda e: e["tag"] == "title"),
                "body_text": html.body_text("_tokens", "_bounds"),
                "html_lang": html.attr(F.try_element_at(of("html"), F.lit(1)), "lang"),
                "n_deprecated": count_if("_els", lambda e: e["tag"].isin("font", "center", "marquee")),
                "n_plain_http": count_if("_els", plain_http),
                "n_positive_tabindex": count_if("_els", lambda e: html.attr(e, "tabindex").try_cast("double") > 0),
                "has_main_landmark": F.exists("_els", lambda e: (e["tag"] == "main") | plays(e, "main")),
                "has_nav_landmark": F.exists("_els", lambda e: (e["tag"] == "nav") | plays(e, "navigation")),
            }
        )
        .drop("html", "_tokens", "_els", "_bounds")
    )


def core(df: DataFrame) -> DataFrame:
    """Title, description, first h1, headings with text, links and their classes."""
    meta = lambda key, value: F.try_element_at(F.filter("metas", lambda m: m[key] == value), F.lit(1))["content"]
    df = df.withColumn("description", meta("name", "description"))
    df = df.withColumn("h1", F.try_element_at(F.filter("headings_all", lambda h: h["level"] == 1), F.lit(1))["text"])
    df = df.withColumn("headings", F.filter("headings_all", lambda h: h["text"] != ""))
    links = F.transform("hrefs", lambda h: F.struct(h.alias("href"), is_internal(h, "url").alias("is_internal")))
    df = df.withColumn("links", links)
    df = df.withColumn("internal_links", count_if("links", lambda x: x["is_internal"]))
    return df.withColumn("external_links", count_if("links", lambda x: ~x["is_internal"]))


def wcag(df: DataFrame) -> DataFrame:
    """Accessibility features."""
    viewport = F.try_element_at(F.filter("metas", lambda m: m["name"] == "viewport"), F.lit(1))["content"]
    buttons = ("hidden", "submit", "button", "reset")
    labelled = lambda i: F.coalesce(F.array_contains("label_fors", i["id"]), F.lit(False)) | i["has_aria"]
    shown = lambda i: ~F.coalesce(i["type"].isin(*buttons), F.lit(False))
    return (
        df.withColumn("viewport", viewport)
        .withColumns(
            {
                "zoom_disabled": F.coalesce(F.col("viewport").contains("user-scalable=no") | F.col("viewport").contains("maximum-scale=1"), F.lit(False)),
                "has_skip_link": F.exists("hrefs", lambda h: h.startswith("#")),
                "heading_sequence": F.transform("headings_all", lambda h: h["level"]),
                "h1_count": count_if("headings_all", lambda h: h["level"] == 1),
                "images_missing_alt": count_if("images", lambda i: i["alt"].isNull()),
                "images_empty_alt": count_if("images", lambda i: i["alt"] == ""),
                "empty_links": count_if("anchor_texts", lambda t: t == ""),
                "generic_links": count_if("anchor_texts", lambda t: ascii_lower(t).isin(*dims.GENERIC_LINK_TEXTS)),
                "inputs_missing_label": count_if("inputs", lambda i: shown(i) & ~labelled(i)),
            }
        )
    )


def performance(df: DataFrame) -> DataFrame:
    """Script, style, image and resource-hint features."""
    external = lambda s: F.coalesce(s["src"] != "", F.lit(False))
    sheet = lambda x: (x["rel"] == "stylesheet") & (x["href"] != "")
    bytes_of = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + n_bytes(x))
    inline = F.filter("scripts", lambda s: ~external(s))
    loaded = F.concat(
        F.transform(F.filter("scripts", external), lambda s: s["src"]), F.transform(F.filter("link_els", sheet), lambda x: x["href"])
    )
    df = (
        df.withColumn("external_scripts", count_if("scripts", external))
        .withColumns(
            {
                "blocking_scripts": count_if("scripts", lambda s: external(s) & ~s["is_async"] & ~s["is_defer"]),
                "async_scripts": count_if("scripts", lambda s: external(s) & s["is_async"]),
                "defer_scripts": count_if("scripts", lambda s: external(s) & s["is_defer"]),
                "inline_scripts": F.size(inline).cast("long"),
                "inline_script_bytes": bytes_of(F.transform(inline, lambda s: s["body"])),
                "external_stylesheets": count_if("link_els", sheet),
                "inline_styles": F.size("styles").cast("long"),
                "inline_style_bytes": bytes_of("styles"),
                "image_count": F.size("images").cast("long"),
                "images_missing_dims": count_if("images", lambda i: ~i["has_size"]),
            }
        )
    )
    hints = lambda rel: count_if("link_els", lambda x: x["rel"] == rel)
    df = df.withColumns({rel.replace("-", "_"): hints(rel) for rel in ("preload", "prefetch", "preconnect", "dns-prefetch")})
    hosts = F.transform(F.filter(loaded, lambda h: is_third_party(h, "url")), hostname)
    return df.withColumn("third_party_domains", F.array_sort(F.array_distinct(hosts)))


def privacy(df: DataFrame) -> DataFrame:
    """Third-party hosts, trackers and the consent banner."""
    third = lambda array: F.filter(array, lambda h: F.coalesce(is_third_party(h, "url"), F.lit(False)))
    srcs = third(F.transform("scripts", lambda s: s["src"]))
    df = df.withColumn("third_party_scripts", srcs)
    found = F.transform("third_party_scripts", lambda s: F.struct(hostname(s).alias("domain"), first_match(s, dims.TRACKERS).alias("category")))
    df = df.withColumn("_found", F.filter(found, lambda t: t["category"].isNotNull()))
    first = lambda t, i: ~F.exists(F.slice("_found", F.lit(1), i), lambda u: u["domain"] == t["domain"])
    short = lambda x: F.when(F.octet_length(x) <= 256, x)
    in_marks = F.flatten(F.transform("marks", lambda m: F.array(short(m["id"]), short(m["cls"]))))
    tools = lambda array: F.filter(F.transform(array, lambda x: first_match(x, dims.CONSENT)), lambda t: t.isNotNull())
    tool = F.coalesce(F.try_element_at(tools("third_party_scripts"), F.lit(1)), F.try_element_at(tools(in_marks), F.lit(1)))
    return (
        df.withColumn("script_domains", F.array_sort(F.array_distinct(F.transform("third_party_scripts", hostname))))
        .withColumns(
            {
                "iframe_domains": F.array_sort(F.array_distinct(F.transform(third("iframes"), hostname))),
                "trackers": F.filter("_found", first),
                "consent_tool": tool,
            }
        )
        .withColumn("has_banner", F.col("consent_tool").isNotNull())
        .drop("_found")
    )


def seo(df: DataFrame) -> DataFrame:
    """Search features; lengths are bytes."""
    link = lambda rel: F.try_element_at(F.filter("link_els", lambda x: (x["rel"] == rel) & x["href"].isNotNull()), F.lit(1))["href"]
    prop = lambda p: F.try_element_at(F.filter("metas", lambda m: m["property"] == p), F.lit(1))["content"]
    robots = ascii_lower(F.try_element_at(F.filter("metas", lambda m: m["name"] == "robots"), F.lit(1))["content"])
    ldjson = F.transform(F.filter("scripts", lambda s: s["type"] == "application/ld+json"), lambda s: s["body"])
    return (
        df.withColumn("canonical", link("canonical"))
        .withColumns(
            {
                "has_noindex": F.coalesce(robots.contains("noindex"), F.lit(False)),
                "has_nofollow": F.coalesce(robots.contains("nofollow"), F.lit(False)),
                "og_title": prop("og:title"),
                "og_description": prop("og:description"),
                "og_image": prop("og:image"),
                "ldjson": ldjson,
            }
        )
        .withColumns(
            {
                "has_structured_data": F.size("ldjson") > 0,
                "hreflang_count": count_if("link_els", lambda x: x["hreflang"].isNotNull()),
                "title_length": n_bytes("title"),
                "description_length": n_bytes("description"),
            }
        )
    )


def best_practices(df: DataFrame) -> DataFrame:
    df = df.withColumn("is_https", F.col("url").startswith("https://"))
    df = df.withColumn("mixed_content", F.when(F.col("is_https"), F.col("n_plain_http")).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("deprecated_tags", F.col("n_deprecated"))


def keyword_words(text: str | Column) -> Column:
    """The words of 3 to 128 letters, in lower case."""
    found = F.regexp_extract_all(text if isinstance(text, Column) else F.col(text), F.lit("[A-Za-z]+"), F.lit(0))
    return F.transform(F.filter(found, lambda w: F.length(w).between(3, 128)), ascii_lower)


def keywords(df: DataFrame) -> DataFrame:
    """The number of words, and whether any is left beside the stop words."""
    df = df.withColumn("words", keyword_words("body_text"))
    df = df.withColumn("total_words", F.size("words").cast("long"))
    return df.withColumn("has_keywords", F.size(F.array_except("words", F.array(*[F.lit(w) for w in dims.STOP_WORDS]))) > 0)


def target_keyword(df: DataFrame, phrase: Column | None) -> DataFrame:
    """Where the target phrase stands; without one all are null."""
    if phrase is None:
        for c, kind in (("kw_in_title", "boolean"), ("kw_in_h1", "boolean"), ("kw_in_description", "boolean"), ("kw_density", "long")):
            df = df.withColumn(c, F.lit(None).cast(kind))
        return df
    phrase = normalised_phrase(phrase)
    for c, source in (("kw_in_title", "title"), ("kw_in_h1", "h1"), ("kw_in_description", "description")):
        df = df.withColumn(c, contains_ci(source, phrase))
    return df.withColumn("kw_density", density_permille("body_text", phrase, "total_words"))


def answers(df: DataFrame) -> DataFrame:
    """Answer-engine signals."""
    says = lambda *marks: F.exists("ldjson", lambda b: _any(b.contains(m) for m in marks))
    author = F.exists("metas", lambda m: (m["name"] == "author") & m["content"].isNotNull())
    question = F.exists("headings", lambda h: h["level"].between(2, 4) & is_question(h["text"], dims.QUESTION_PREFIXES))
    return (
        df.withColumn("has_faq", says("FAQPage"))
        .withColumns(
            {
                "has_howto": says("HowTo"),
                "has_article": says("Article"),
                "has_author": says('"author"') | F.coalesce(author, F.lit(False)),
                "has_publisher": says('"publisher"', '"organization"'),
                "has_qa_headings": question,
                "outbound_links": count_if("hrefs", lambda h: is_third_party(h, "url")),
            }
        )
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


class _Recipe:
    """Takes down the columns that the steps add, to add them to any DataFrame later."""

    def __init__(self):
        self.steps: list[dict | tuple] = []

    def withColumns(self, columns: dict) -> _Recipe:  # noqa: N802
        self.steps.append(columns)
        return self

    def withColumn(self, name: str, column: Column) -> _Recipe:  # noqa: N802
        return self.withColumns({name: column})

    def drop(self, *names: str) -> _Recipe:
        self.steps.append(names)
        return self

    def applied(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.withColumns(step) if isinstance(step, dict) else df.drop(*step)
        return df


_recipes: dict[str, _Recipe] = {}


def _recipe(session_id: str) -> _Recipe:
    """The expressions of all features, built once for a session: they are the same for every table of pages."""
    if session_id not in _recipes:
        out = _Recipe()
        for step in (parsed_elements, core, wcag, performance, privacy, seo, best_practices, keywords, answers):
            out = step(out)
        _recipes.clear()
        _recipes[session_id] = out
    return _recipes[session_id]


def page_features(pages: DataFrame, keyword: Column | None = None) -> DataFrame:
    """All features of pages(url, html, ...); ``has_sitemap`` is false where the pages do not say."""
    df = _recipe(pages.sparkSession.sparkContext.applicationId).applied(pages)
    df = target_keyword(df, keyword)
    return df if "has_sitemap" in df.columns else df.withColumn("has_sitemap", F.lit(False))


def top_words(df: DataFrame, key: str, text: str, n: int = TOP_WORDS) -> DataFrame:
    """key, word, n and rank of the most frequent words of each row's text; a row stays one row until its words are counted."""
    df = with_top_words(df, text, n)
    rows = df.select(key, F.posexplode_outer("top_words").alias("_at", "_w")).filter(F.col("_w").isNotNull())
    return rows.select(key, "_w.word", "_w.n", (F.col("_at") + 1).cast("int").alias("rank"))


def with_top_words(df: DataFrame, text: str = "body_text", n: int = TOP_WORDS) -> DataFrame:
    """Add top_words, (word, n) of the n most frequent words of each row's text without stop words; ties by word.

    The words are sorted within the row; where one differs from the one before
    it a run begins, and the runs' lengths are the counts. No shuffle.
    """
    df = df.withColumn("_sorted", F.array_sort(keyword_words(text)))
    begins = F.filter(
        F.transform("_sorted", lambda w, i: F.when((i == 0) | (F.get("_sorted", i - 1) != w), i)), lambda i: i.isNotNull()
    )
    df = df.withColumn("_begins", begins)
    run = lambda i, k: F.struct(
        (i - F.coalesce(F.get("_begins", k + 1), F.size("_sorted"))).cast("long").alias("less"), F.get("_sorted", i).alias("word")
    )
    runs = F.filter(F.transform("_begins", run), lambda r: ~r["word"].isin(*dims.STOP_WORDS))
    top = F.slice(F.array_sort(runs), 1, n)
    return df.withColumn("top_words", F.transform(top, lambda r: F.struct(r["word"].alias("word"), (-r["less"]).alias("n")))).drop("_sorted", "_begins")


__all__ = ["page_features", "parsed_elements", "top_words", "trimmed"]
