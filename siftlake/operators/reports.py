"""Reports over findings and scores: summaries, comparison, differences, goals, history, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import dims
from siftlake.functions.text import ascii_lower, csv_detail, density_permille, n_ascii_words, normalised_phrase, regressed
from siftlake.operators.features import with_top_words
from siftlake.session import exploded


#: What the comparison shows for a page whose technologies were not asked for.
NOT_ASKED = "—"


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES]


def severity_summary(findings: DataFrame) -> DataFrame:
    """Findings by category and severity with a TOTAL row; every category has a row."""
    counted = findings.groupBy("category").agg(*severity_counts())
    known = findings.sparkSession.createDataFrame([(c,) for c in dims.CATEGORIES], "category string")
    rows = F.broadcast(known).join(counted, "category", "left").na.fill(0)
    return rows.rollup("category").agg(*[F.sum(s).alias(s) for s in dims.SEVERITIES]).withColumn(
        "category", F.coalesce("category", F.lit("TOTAL"))
    )


def crawl_totals(audited: DataFrame) -> DataFrame:
    """Pages and findings by severity over all pages, as one row. Partial sums are made before the one shuffle of a row a task."""
    per = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    return audited.agg(
        F.count("*").alias("total_pages"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("total_findings"),
        *[F.coalesce(F.sum(per(s)), F.lit(0)).alias(s) for s in dims.SEVERITIES],
    )


def scores_long(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.unpivot(list(keys), dims.CATEGORIES, "category", "score")


def compare(audited: DataFrame, key: str, pages: list) -> DataFrame:
    """Categories by page, then a row of critical and warning findings; ``pages`` are the keys of the columns, in order.

    Where ``audited`` has an array column builtwith, a row "tech stack" gives
    the number of technologies of each page that was asked about, a dash for
    one with null, and no such row if all have null.
    """
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    line = F.format_string("%3dc %3dw", n("critical"), n("warning"))
    chosen = audited.filter(F.col(key).isin(pages))
    lines = [*dims.CATEGORIES, "findings"]
    columns = [*[F.col(c).cast("string").alias(c) for c in dims.CATEGORIES], line.alias("findings")]
    if "builtwith" in audited.columns:
        lines.append("tech stack")
        columns.append(F.when(F.col("builtwith").isNotNull(), F.format_string("%d detected", F.size("builtwith"))).otherwise(NOT_ASKED).alias("tech stack"))
    table = chosen.select(key, *columns).unpivot([key], lines, "category", "score").groupBy("category").pivot(key, pages).agg(F.first("score"))
    known = F.array(*[F.col(f"`{p}`") for p in pages])
    table = table.filter((F.col("category") != "tech stack") | F.exists(known, lambda x: x != NOT_ASKED))
    return table.select("category", *[F.col(f"`{p}`").alias(f"page_{p}") for p in pages])


def compare_groups(audited: DataFrame, group: Column, values: list[str]) -> DataFrame:
    """Mean scores (rounded down) by category and the critical and warning findings of groups of pages, a column each.

    Pages are summed by group before anything is turned, so only a row a group is shuffled.
    """
    n = lambda s: F.sum(F.size(F.filter("findings", lambda f: f["severity"] == s)))
    means = [F.floor(F.avg(c)).cast("int").cast("string").alias(c) for c in dims.CATEGORIES]
    per = audited.groupBy(group.alias("_group")).agg(*means, F.format_string("%3dc %3dw", n("critical"), n("warning")).alias("findings"))
    table = per.unpivot(["_group"], [*dims.CATEGORIES, "findings"], "category", "value").groupBy("category").pivot("_group", values)
    return table.agg(F.first("value"))


def _changed(audited: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Findings of ``audited`` whose rule the same page of ``other`` does not report; one row a page until the end."""
    rules = other.select(*keys, F.transform("findings", lambda f: f["rule_id"]).alias("_known"))
    df = audited.select(*keys, "findings").join(rules.hint("merge"), list(keys), "left")
    new = F.filter("findings", lambda f: F.coalesce(~F.array_contains("_known", f["rule_id"]), F.lit(True)))
    return exploded(df, new, "_f", *keys).select(*keys, "_f.*")


def introduced(fresh: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """Findings whose rule the baseline did not report for the page; both sides have a row a page with its findings."""
    return _changed(fresh, baseline, *keys)


def resolved(fresh: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """Findings of the baseline whose rule is not reported any more."""
    return _changed(baseline, fresh, *keys)


def _wide_deltas(fresh: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Scores of both sides, one row a page: key and _deltas (category, before, after)."""
    side = lambda df, name: df.select(key, F.struct(*dims.CATEGORIES).alias(name))
    both = side(baseline, "_before").join(side(fresh, "_after").hint("merge"), key)
    each = [F.struct(F.lit(c).alias("category"), F.col(f"_before.{c}").alias("before"), F.col(f"_after.{c}").alias("after")) for c in dims.CATEGORIES]
    return both.select(key, F.array(*each).alias("_deltas"))


def score_deltas(fresh: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Before, after and whether it regressed, for every page and category in both; pages meet before they are unpivoted."""
    rows = exploded(_wide_deltas(fresh, baseline, key), "_deltas", "_d", key).select(key, "_d.*")
    return rows.withColumn("regressed", regressed("before", "after"))


def diff_report(fresh: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key and the text of each page's differences: scores that changed, then introduced and resolved rules with their numbers."""
    ids = lambda x: F.transform(x, lambda f: f["rule_id"])
    side = lambda df, name: df.select(key, F.struct(*dims.CATEGORIES, ids("findings").alias("rules")).alias(name))
    both = side(baseline, "_b").join(side(fresh, "_a").hint("merge"), key)
    lines = []
    for c in dims.CATEGORIES:
        before, after = F.col(f"_b.{c}"), F.col(f"_a.{c}")
        lines.append(F.when(before != after, score_line(F.lit(c), before, after, regressed(before, after))))
    for word, sign, one, other in (("introduced", "+", "_a.rules", "_b.rules"), ("resolved", "-", "_b.rules", "_a.rules")):
        new = F.array_except(one, other)
        listed = F.array_join(_prefixed(new, sign), "\n")
        lines.append(F.when(F.size(new) > 0, F.concat(F.format_string(f"  {word} (%d):\n", F.size(new)), listed)))
    text = F.concat(F.lit("=== Diff: "), F.col(key).cast("string"), F.lit(" ===\n"), F.concat_ws("\n", *lines))
    return both.select(key, text.alias("report"))


def _prefixed(rules: Column, sign: str) -> Column:
    return F.transform(rules, lambda r: F.concat(F.lit(f"    {sign} "), r))


def score_line(category: Column, before: Column, after: Column, is_regression: Column) -> Column:
    """One line of a score that changed."""
    sign = F.when(after > before, "+").otherwise("-")
    tag = F.when(is_regression, " [REGRESSION]").otherwise("")
    return F.format_string("  %s %d -> %d (%s%d)%s", F.rpad(category, 18, " "), before, after, sign, F.abs(after - before), tag)


def keyword_coverage(features: DataFrame, goals: DataFrame, key: str | list[str], *keep: str) -> DataFrame:
    """Coverage of each goal keyword on its page; goals(key, keyword) become one list a page before they meet its texts.

    Where several pages have one address, each with a goals file of its own,
    the key is the address and what tells the pages apart; by the address alone
    every page would be judged by the files of all.
    """
    keys = [key] if isinstance(key, str) else key
    wanted = goals.groupBy(*keys).agg(F.collect_list("keyword").alias("_goals"))
    df = features.select(*keys, *keep, "title", "h1", "description", "body_text").join(wanted, keys)
    return covered_goals(df, "_goals", *keys, *keep)


def covered_goals(df: DataFrame, goals: str | Column, *keys: str) -> DataFrame:
    """A row for each keyword of the array ``goals`` of each page. Texts are put in lower case once a page.

    Places, density and score: title 40, h1 25, description 20, density of 5 to 30 per mille 15.
    """
    texts = ("title", "h1", "description", "body_text")
    df = df.withColumn("_goals", F.col(goals) if isinstance(goals, str) else goals)
    df = df.select(*keys, "_goals", *[F.coalesce(ascii_lower(c), F.lit("")).alias(c) for c in texts]).withColumn("_words", n_ascii_words("body_text"))
    part = lambda test, points: F.when(test, points).otherwise(0)

    def judged(keyword: Column) -> Column:
        phrase = normalised_phrase(keyword)
        title, h1, description = (F.col(c).contains(phrase) for c in texts[:3])
        density = density_permille("body_text", phrase, "_words")
        score = part(title, 40) + part(h1, 25) + part(description, 20) + part(density.between(5, 30), 15)
        return F.struct(
            keyword.alias("keyword"), title.alias("in_title"), h1.alias("in_h1"), description.alias("in_description"),
            density.alias("density"), score.cast("int").alias("coverage"),
        )

    return exploded(df, F.transform("_goals", judged), "_g", *keys).select(*keys, "_g.*")


def goals_report(covered: DataFrame, *keys: str) -> DataFrame:
    """Mean coverage, best and missing keywords by page."""
    return covered.groupBy(*keys).agg(
        F.count("*").alias("n_keywords"),
        F.sum("coverage").cast("long").alias("coverage_sum"),
        F.count_if(F.col("coverage") == 0).alias("n_uncovered"),
    )


def csv_rows(findings: DataFrame) -> DataFrame:
    """The flat findings export; details are quoted only where they must be."""
    return findings.select("url", "rule_id", "category", "severity", csv_detail("detail").alias("detail"))


def page_json(audited: DataFrame, keyword: str | None = None) -> DataFrame:
    """Add json, the whole report of each page of ``audited`` as one JSON object, nulls included.

    What an audit adds only where it was asked for is taken if the columns are
    there: status, body_len, duration_ms, profile, has_robots, sitemap_url,
    keyword_coverages, psi and builtwith; otherwise it is null or empty.
    """
    has = lambda c: c in audited.columns
    given = lambda c, other: (F.col(c) if has(c) else other).alias(c)
    df = audited if has("top_words") else with_top_words(audited)
    target = [F.lit(keyword).cast("string").alias("target_keyword")]
    if keyword is not None:
        places = ((c, f"kw_{c}") for c in ("in_title", "in_h1", "in_description"))
        target += [F.col(b).alias(a) for a, b in places] + [F.col("kw_density").alias("density_permille")]
    words = F.transform("top_words", lambda w: F.struct(w["word"].alias("word"), w["n"].alias("count")))
    flags = {"has_faq_schema": "has_faq", "has_howto_schema": "has_howto", "has_article_schema": "has_article",
             "has_author_entity": "has_author", "has_publisher_entity": "has_publisher", "has_qa_headings": "has_qa_headings",
             "outbound_link_count": "outbound_links"}
    body = F.struct(
        "url",
        given("status", F.lit(200)),
        given("body_len", F.col("html_bytes")),
        given("duration_ms", F.col("fetch_ms") if has("fetch_ms") else F.lit(0)),
        given("profile", F.lit("desktop")),
        F.lit(False).alias("gpu_accelerated"),
        "title", "description", "h1",
        F.size("links").alias("link_count"), "internal_links", "external_links", F.size("headings").alias("heading_count"),
        given("has_robots", F.lit(False)),
        given("sitemap_url", F.lit(None).cast("string")),
        F.struct("total_words", words.alias("top_keywords"), *target).alias("keyword_analysis"),
        given("keyword_coverages", F.array().cast("array<string>")),
        "hreflang_count",
        given("psi", F.lit(None).cast("string")),
        given("builtwith", F.lit(None).cast("string")),
        F.struct(*[F.col(b).alias(a) for a, b in flags.items()]).alias("aeo_data"),
        F.struct(*dims.CATEGORIES).alias("scores"),
        F.transform("findings", lambda f: F.struct(*[f[c].alias(c) for c in ("rule_id", "category", "severity", "detail")])).alias("findings"),
    )
    return df.withColumn("json", F.to_json(body, {"ignoreNullFields": "false"}))


def latest_runs(runs: DataFrame, key: str, at: str, n: int = 20, tie: str | None = None, scores: str | None = None) -> DataFrame:
    """The ``n`` latest runs of every key with their rank; runs without a time come last.

    With ``scores``, a column of JSON text, scores_json is that text or, for a
    run without scores, the text null.
    """
    order = [F.col(at).desc(), *([F.col(tie).desc()] if tie else [])]
    latest = runs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)
    return latest if scores is None else latest.withColumn("scores_json", F.coalesce(scores, F.lit("null")))
