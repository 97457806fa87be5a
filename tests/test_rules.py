"""A page without faults, and one fault at a time."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siftlake.functions.dims import CATEGORIES
from siftlake.functions.text import truncated
from siftlake.operators.reports import compare, covered_goals, csv_rows, latest_runs
from siftlake.operators.rules import RULES, findings, with_findings

PERFECT = {
    "blocking_scripts": 0, "images_missing_dims": 0, "inline_script_bytes": 0, "third_party_domains": [], "images_missing_alt": 0,
    "inputs_missing_label": 0, "n_positive_tabindex": 0, "zoom_disabled": False, "html_lang": "en", "mixed_content": 0,
    "deprecated_tags": 0, "is_https": True, "title_length": 30, "description_length": 100, "canonical": "c", "has_noindex": False,
    "og_title": "t", "og_image": "i", "has_sitemap": True, "trackers": [], "has_banner": False, "total_words": 500,
    "has_keywords": True, "kw_in_title": True, "kw_in_h1": True, "kw_in_description": True, "kw_density": 10, "has_faq": True,
    "has_howto": False, "has_article": False, "has_author": True, "has_publisher": False, "has_qa_headings": True, "outbound_links": 1,
}
KINDS = {"third_party_domains": "array<string>", "trackers": "array<string>"}
SCHEMA = "case int, " + ", ".join(
    f"{k} {KINDS.get(k) or ('boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'string')}" for k, v in PERFECT.items()
)


def audited(spark, changes):
    return with_findings(spark.createDataFrame([(i, *(PERFECT | c).values()) for i, c in enumerate(changes)], SCHEMA))


CASES = [
    ({"blocking_scripts": 1}, "perf_render_blocking_scripts", "warning", 10), ({"blocking_scripts": 3}, "perf_render_blocking_scripts", "critical", 25),
    ({"images_missing_dims": 3}, "perf_missing_image_dims", "warning", 5), ({"images_missing_dims": 4}, "perf_missing_image_dims", "warning", 15),
    ({"inline_script_bytes": 5001}, "perf_inline_script_bytes", "info", 5), ({"inline_script_bytes": 20001}, "perf_inline_script_bytes", "warning", 15),
    ({"third_party_domains": list("abc")}, "perf_third_party_count", "info", 5), ({"third_party_domains": list("abcdef")}, "perf_third_party_count", "warning", 15),
    ({"images_missing_alt": 1}, "a11y_missing_image_alt", "critical", 10), ({"inputs_missing_label": 3}, "a11y_missing_input_label", "critical", 25),
    ({"n_positive_tabindex": 2}, "a11y_positive_tabindex", "warning", 5), ({"zoom_disabled": True}, "a11y_viewport_zoom_disabled", "critical", 15),
    ({"html_lang": None}, "a11y_missing_lang", "critical", 20), ({"mixed_content": 2}, "bp_mixed_content", "critical", 10),
    ({"deprecated_tags": 3}, "bp_deprecated_elements", "warning", 15), ({"is_https": False}, "bp_missing_https", "critical", 30),
    ({"title_length": 0}, "seo_missing_title", "critical", 20), ({"title_length": 9}, "seo_title_too_short", "warning", 10),
    ({"title_length": 71}, "seo_title_too_long", "info", 5), ({"description_length": 0}, "seo_missing_description", "warning", 10),
    ({"description_length": 49}, "seo_description_too_short", "warning", 5), ({"description_length": 161}, "seo_description_too_long", "info", 5),
    ({"canonical": None}, "seo_missing_canonical", "info", 5), ({"has_noindex": True}, "seo_noindex_present", "critical", 30),
    ({"og_title": None, "og_image": None}, "seo_missing_og_tags", "info", 5), ({"has_sitemap": False}, "seo_missing_sitemap", "info", 5),
    ({"trackers": ["a", "b"]}, "gdpr_no_consent_banner", "critical", 30), ({"has_keywords": False}, "kw_no_extractable_content", "warning", 15),
    ({"total_words": 299}, "kw_thin_content", "warning", 10), ({"kw_in_title": False}, "kw_target_missing_from_title", "critical", 15),
    ({"kw_in_h1": False}, "kw_target_missing_from_h1", "warning", 10), ({"kw_in_description": False}, "kw_target_missing_from_description", "info", 5),
    ({"kw_density": 31}, "kw_keyword_stuffing", "warning", 10), ({"kw_density": 4}, "kw_low_keyword_density", "info", 5),
    ({"has_faq": False}, "aeo_no_structured_schema", "warning", 15), ({"has_author": False}, "aeo_no_entity_signals", "warning", 10),
    ({"has_qa_headings": False, "has_faq": False, "has_article": True}, "aeo_no_qa_content", "info", 10), ({"outbound_links": 0}, "aeo_no_citations", "info", 5),
]
QUIET = [{}, {"inline_script_bytes": 5000}, {"third_party_domains": ["a", "b"]}, {"title_length": 10}, {"title_length": 70}, {"description_length": 50},
         {"description_length": 160}, {"og_title": None}, {"trackers": ["a"], "has_banner": True}, {"total_words": 300}, {"total_words": 0, "has_keywords": False},
         {"kw_density": 30}, {"kw_density": 5}, {"kw_in_title": None, "kw_in_h1": None, "kw_in_description": None, "kw_density": None}, {"canonical": ""}]


def test_every_rule_fires_alone(spark):
    rows = {r["case"]: r for r in audited(spark, [c for c, *_ in CASES]).collect()}
    for i, (change, rule_id, severity, penalty) in enumerate(CASES):
        [f] = rows[i]["findings"]
        assert (f["rule_id"], f["severity"], f["penalty"]) == (rule_id, severity, penalty), change
        assert rows[i][f["category"]] == 100 - penalty and sum(rows[i][c] for c in CATEGORIES) == 700 - penalty
    assert {c[1] for c in CASES} == {r.rule_id for r in RULES} and len(RULES) == 34


def test_quiet_pages_have_no_findings(spark):
    assert all(not r["findings"] for r in audited(spark, QUIET).collect())


def test_details_and_order(spark):
    found = findings(audited(spark, [{"blocking_scripts": 2, "title_length": 5, "kw_density": 40, "trackers": ["x"]}]), "case").orderBy("ordinal").collect()
    assert [f["detail"] for f in found] == ["2 render-blocking script(s)", "title is 5 chars; 10–60 recommended", "1 tracker(s) present but no consent banner", "keyword density 40‰ exceeds 30‰ threshold"]


LEAST = {"performance": 30, "accessibility": 0, "best_practices": 55, "seo": 25, "gdpr": 70, "keyword": 45, "aeo": 60}
_n = st.sampled_from([0, 1, 3, 4, 9, 60, 200, 6000, 30000])
_changes = st.fixed_dictionaries(
    {k: st.sampled_from([[], list("abc"), list("abcdefg")]) if isinstance(v, list) else st.booleans() if isinstance(v, bool) else _n if isinstance(v, int) else st.sampled_from([None, "x"]) for k, v in PERFECT.items()}
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(_changes, min_size=1, max_size=30))
def test_scores_stay_in_bounds(spark, changes):
    for c in changes:
        c["mixed_content"] = c["mixed_content"] if c["is_https"] else 0
        c["has_keywords"] = c["has_keywords"] and c["total_words"] > 0
    for r in audited(spark, changes).collect():
        assert all(LEAST[c] <= r[c] <= 100 for c in CATEGORIES)


def test_coverage_scores(spark):
    rows = [("Buy shoes", None, None, "x"), ("Buy shoes", "shoes", "red SHOES", "shoes are " + "a " * 97), (None, None, None, "")]
    df = spark.createDataFrame([(i, *r, [" Shoes "]) for i, r in enumerate(rows)], "k int, title string, h1 string, description string, body_text string, goals array<string>")
    out = sorted(covered_goals(df, "goals", "k").collect(), key=lambda r: r["k"])
    assert [r["coverage"] for r in out] == [40, 100, 0] and {r["keyword"] for r in out} == {" Shoes "}


def test_compare_has_a_findings_row(spark):
    finding = [("r1", "critical"), ("r2", "warning"), ("r3", "warning"), ("r4", "info")]
    rows = [(i, *range(10 * i, 10 * i + 7), finding[: i + 1]) for i in range(4)]
    df = spark.createDataFrame(rows, "page int, " + ", ".join(f"{c} int" for c in CATEGORIES) + ", findings array<struct<rule_id:string,severity:string>>")
    out = {r["category"]: (r["page_3"], r["page_1"]) for r in compare(df, "page", [3, 1]).collect()}
    assert len(out) == 8 and out["performance"] == ("30", "10") and out["aeo"] == ("36", "16") and out["findings"] == ("  1c   2w", "  1c   1w")


@pytest.mark.parametrize(("url", "want"), [("https://example.com/page", "example.com/"), ("http://é/ab漢字漢", "é/ab漢字\ufffd"), ("x", "x"), (None, None)])
def test_addresses_are_cut_by_bytes(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(truncated("u").alias("t")).first()["t"] == want


@pytest.mark.parametrize(("detail", "want"), [("plain", "plain"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("l\nm", '"l\nm"')])
def test_csv_quotes_only_where_needed(spark, detail, want):
    df = spark.createDataFrame([("u", "r", "c", "s", detail)], "url string, rule_id string, category string, severity string, detail string")
    assert csv_rows(df).first()["detail"] == want


def test_latest_runs(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "k string, at int")
    out = latest_runs(df, "k", "at", 20).collect()
    assert len(out) == 21 and min(r["at"] for r in out if r["k"] == "a") == 10
