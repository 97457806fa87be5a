"""The audit rules as data: each a condition, severity, penalty and detail over page features.

All rules of a page are evaluated in one narrow projection; findings are the
rows of the resulting array. Users may pass rules of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.dims import CATEGORIES
from siftlake.functions.text import clamped
from siftlake.session import exploded


@dataclass(frozen=True)
class Rule:
    """SQL expressions over the columns of ``page_features``."""

    rule_id: str
    category: str
    when: str
    severity: str
    penalty: str
    detail: str


def _counted(rule_id, category, n, at_least, severity, penalty, noun):
    return Rule(rule_id, category, f"{n} >= {at_least}", severity, penalty, f"concat({n}, ' {noun}')")


def _flagged(rule_id, category, when, severity, penalty, detail):
    return Rule(rule_id, category, when, f"'{severity}'", str(penalty), f"'{detail}'")


def _steps(n, at, high, low):
    return f"if({n} >= {at}, {high}, {low})"


_SCRIPTS, _DIMS, _INLINE, _HOSTS = "blocking_scripts", "images_missing_dims", "inline_script_bytes", "size(third_party_domains)"

RULES: list[Rule] = [
    _counted("perf_render_blocking_scripts", "performance", _SCRIPTS, 1, _steps(_SCRIPTS, 3, "'critical'", "'warning'"), _steps(_SCRIPTS, 3, 25, 10), "render-blocking script(s)"),
    _counted("perf_missing_image_dims", "performance", _DIMS, 1, "'warning'", _steps(_DIMS, 4, 15, 5), "image(s) missing width/height"),
    _counted("perf_inline_script_bytes", "performance", _INLINE, 5001, _steps(_INLINE, 20001, "'warning'", "'info'"), _steps(_INLINE, 20001, 15, 5), "bytes of inline script"),
    _counted("perf_third_party_count", "performance", _HOSTS, 3, _steps(_HOSTS, 6, "'warning'", "'info'"), _steps(_HOSTS, 6, 15, 5), "third-party domain(s)"),
    _counted("a11y_missing_image_alt", "accessibility", "images_missing_alt", 1, "'critical'", _steps("images_missing_alt", 3, 25, 10), "image(s) missing alt text"),
    _counted("a11y_missing_input_label", "accessibility", "inputs_missing_label", 1, "'critical'", _steps("inputs_missing_label", 3, 25, 10), "input(s) missing label"),
    _counted("a11y_positive_tabindex", "accessibility", "n_positive_tabindex", 1, "'warning'", _steps("n_positive_tabindex", 3, 15, 5), "element(s) with positive tabindex"),
    _flagged("a11y_viewport_zoom_disabled", "accessibility", "zoom_disabled", "critical", 15, "viewport meta disables user zoom"),
    _flagged("a11y_missing_lang", "accessibility", "html_lang is null", "critical", 20, "html element missing lang attribute"),
    _counted("bp_mixed_content", "best_practices", "mixed_content", 1, "'critical'", _steps("mixed_content", 3, 25, 10), "mixed-content resource(s)"),
    _counted("bp_deprecated_elements", "best_practices", "deprecated_tags", 1, "'warning'", _steps("deprecated_tags", 3, 15, 5), "deprecated HTML element(s)"),
    _flagged("bp_missing_https", "best_practices", "not is_https", "critical", 30, "page served over HTTP"),
    _flagged("seo_missing_title", "seo", "title_length = 0", "critical", 20, "page has no title"),
    Rule("seo_title_too_short", "seo", "title_length between 1 and 9", "'warning'", "10", "concat('title is ', title_length, ' chars; 10–60 recommended')"),
    Rule("seo_title_too_long", "seo", "title_length > 70", "'info'", "5", "concat('title is ', title_length, ' chars; keep under 70')"),
    _flagged("seo_missing_description", "seo", "description_length = 0", "warning", 10, "page has no meta description"),
    Rule("seo_description_too_short", "seo", "description_length between 1 and 49", "'warning'", "5", "concat('description is ', description_length, ' chars; 50–160 recommended')"),
    Rule("seo_description_too_long", "seo", "description_length > 160", "'info'", "5", "concat('description is ', description_length, ' chars; keep under 160')"),
    _flagged("seo_missing_canonical", "seo", "canonical is null", "info", 5, "no canonical link element"),
    _flagged("seo_noindex_present", "seo", "has_noindex", "critical", 30, "page has noindex directive"),
    _flagged("seo_missing_og_tags", "seo", "og_title is null and og_image is null", "info", 5, "og:title and og:image both absent"),
    _flagged("seo_missing_sitemap", "seo", "not has_sitemap", "info", 5, "no sitemap found"),
    Rule("gdpr_no_consent_banner", "gdpr", "size(trackers) > 0 and not has_banner", "'critical'", "30", "concat(size(trackers), ' tracker(s) present but no consent banner')"),
    _flagged("kw_no_extractable_content", "keyword", "total_words > 0 and not has_keywords", "warning", 15, "no content words found after filtering stop words"),
    Rule("kw_thin_content", "keyword", "has_keywords and total_words between 1 and 299", "'warning'", "10", "concat('page has ', total_words, ' words; 300+ recommended for rankable content')"),
    _flagged("kw_target_missing_from_title", "keyword", "not kw_in_title", "critical", 15, "target keyword not found in page title"),
    _flagged("kw_target_missing_from_h1", "keyword", "not kw_in_h1", "warning", 10, "target keyword not found in h1 heading"),
    _flagged("kw_target_missing_from_description", "keyword", "not kw_in_description", "info", 5, "target keyword not found in meta description"),
    Rule("kw_keyword_stuffing", "keyword", "kw_density > 30", "'warning'", "10", "concat('keyword density ', kw_density, '‰ exceeds 30‰ threshold')"),
    Rule("kw_low_keyword_density", "keyword", "total_words >= 100 and kw_density < 5", "'info'", "5", "concat('keyword density ', kw_density, '‰ is below 5‰ minimum')"),
    _flagged("aeo_no_structured_schema", "aeo", "not has_faq and not has_howto and not has_article", "warning", 15, "no FAQ, HowTo, or Article structured data found"),
    _flagged("aeo_no_entity_signals", "aeo", "not has_author and not has_publisher", "warning", 10, "no author or publisher entity signals found"),
    _flagged("aeo_no_qa_content", "aeo", "not has_qa_headings and not has_faq", "info", 10, "no Q&A headings or FAQ schema detected"),
    _flagged("aeo_no_citations", "aeo", "outbound_links = 0", "info", 5, "no outbound citation links found"),
]


def fired(rules: list[Rule] = RULES) -> Column:
    """The findings of a page in the rules' order: array of (ordinal, rule_id, category, severity, penalty, detail)."""
    each = ", ".join(
        f"if({r.when}, named_struct('ordinal', {i}, 'rule_id', '{r.rule_id}', 'category', '{r.category}', 'severity', {r.severity},"
        f" 'penalty', cast({r.penalty} as int), 'detail', {r.detail}), null)"
        for i, r in enumerate(rules)
    )
    return F.expr(f"array_compact(array({each}))")


def with_findings(features: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add the findings and the score of every category, 100 less its penalties, held between 0 and 100."""
    df = features.withColumn("findings", fired(rules))
    return df.withColumns(_scores(features.sparkSession.sparkContext.applicationId))


@lru_cache(maxsize=1)
def _scores(_session_id: str) -> dict[str, Column]:
    return {c: clamped(100 - _lost(c)) for c in CATEGORIES}


def _lost(category: str) -> Column:
    return F.aggregate(F.filter("findings", lambda f: f["category"] == category), F.lit(0), lambda a, f: a + f["penalty"])


def findings(audited: DataFrame, *keys: str) -> DataFrame:
    """One row for each finding."""
    return exploded(audited, "findings", "_f", *keys).select(*keys, "_f.*")


def scores(audited: DataFrame, *keys: str) -> DataFrame:
    return audited.select(*keys, *CATEGORIES)
