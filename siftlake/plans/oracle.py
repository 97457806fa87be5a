"""DuckDB SQL of the audit, written over rows of tags rather than arrays, to check the engine against."""

from __future__ import annotations

from html.entities import codepoint2name

from siftlake.functions import dims, html
from siftlake.plans.decorate import KEYWORD, SITEMAP_SQL, html_sql

# The patterns are the oracle's own: linear matching, without possessives and lookaheads.
_INSIDE = r"(?:[^<>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*"
TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:-->|\z))|<[!?][^>]*(?:>|\z)|</(?:[^a-z>][^>]*)?(?:>|\z)"
    rf"|<script(?:[\s/]{_INSIDE})?>.*?(?:</script\s*>|\z)|<style(?:[\s/]{_INSIDE})?>.*?(?:</style\s*>|\z)"
    rf"|</?[a-z]{_INSIDE}>|(?:[^<]|<[^a-z!?/<])+|<"
)
ATTRIBUTE = r"(?s)[^\s=/>\"'][^\s=/>]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?"
REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&"
#: The entities of HTML 4, from the standard library's table by character rather than by name.
ENTITIES = {f"&{name};": chr(n) for n, name in codepoint2name.items()} | {"&apos;": "'"}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def low(x: str) -> str:
    return LOWER.format(x)


def _map(known: dict) -> str:
    return "map {" + ", ".join(f"{q(k)}: {v if isinstance(v, int) else q(v)}" for k, v in known.items()) + "}"


def entity_map() -> str:
    return _map(ENTITIES)


def decode(x: str, entities: str = "ents") -> str:
    number = "case when p[3] in ('x', 'X') then try_cast('0x' || rtrim(substr(p, 4), ';') as bigint) else try_cast(rtrim(substr(p, 3), ';') as bigint) end"
    valid = f"{number} in (9, 10, 13) or {number} between 32 and 55295 or {number} between 57344 and 65533 or {number} between 65536 and 1114111"
    one = f"case when p like '&#_%' then case when {valid} then chr(({number})::int) else '' end when p like '&%' then coalesce({entities}[p], p) else p end"
    return f"case when contains({x}, '&') then array_to_string(list_transform(regexp_extract_all({x}, {q(REFERENCE)}), lambda p: {one}), '') else {x} end"


def has(name: str) -> str:
    return f"list_contains(names, {q(name)})"


def attr(name: str) -> str:
    return f"vals[list_position(names, {q(name)})]"


def trim(x: str) -> str:
    return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(13))"


def host(u: str) -> str:
    return f"case when instr({u}, '://') > 0 then split_part(substr({u}, instr({u}, '://') + 3), '/', 1) end"


def third(h: str, base: str) -> str:
    return f"coalesce(not starts_with({h}, '/') and not starts_with({h}, '.') and instr({h}, '://') > 0 and {host(h)} is distinct from {host(base)}, false)"


def first_of(x: str, entries) -> str:
    return "case " + " ".join(f"when contains({x}, {q(a)}) then {q(b)}" for a, b in entries) + " end"


def occurrences(text: str, phrase: str) -> str:
    t, p = low(f"coalesce({text}, '')"), low(phrase)
    return f"(len({t}) - len(replace({t}, {p}, ''))) // greatest(len({p}), 1)"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z]+'))"


def prelude(shift: int = 0, tag: str = "") -> str:
    """CTEs from pages to features; ``tag`` is a suffix to their names."""
    t = tag
    skips = ", ".join(q(x) for x in dims.SKIPPED_TAGS)
    void = ", ".join(q(x) for x in html.VOID)
    heads = ", ".join(q(x) for x in html.HEADINGS)
    ends = _map({k: "".join(f" {x} " for x in v) for k, v in html.ENDS.items()})
    ranks = _map(html.RANKS)
    opening = q(rf"(?s)^<[a-zA-Z]+{_INSIDE}>")
    body = q(rf"(?s)^<[a-zA-Z]+{_INSIDE}>(.*)$")
    edges = q(r"^\s+|\s+$")
    reach = "list_transform(open, lambda x: x.name)"
    found = f"list_position(list_reverse({reach}), g.name)"
    question = " or ".join(f"starts_with({low('text')}, {q(p)})" for p in dims.QUESTION_PREFIXES)
    stop = ", ".join(q(w) for w in sorted(set(dims.STOP_WORDS)))
    generic = ", ".join(q(w) for w in dims.GENERIC_LINK_TEXTS)
    rel = lambda r: f"count(*) filter (where tag = 'link' and rel = '{r}')"
    ext = "tag = 'script' and coalesce(src, '') <> ''"
    return rf"""{"" if tag else "recursive"}
dec{t} as (select page_id, url, {html_sql(shift)} as html, {SITEMAP_SQL} as has_sitemap from pages),
tl{t} as (select page_id, url, regexp_extract_all(coalesce(html, ''), {q(TOKEN)}) as x, {entity_map()} as ents from dec{t}),
tr{t} as (
  select page_id, url, i, t, ents, case when t like '<%' then {low("regexp_extract(t, '^<(/?[a-zA-Z][^ \t\n\f\r<>/=]*)', 1)")} else '' end as name
  from (select page_id, url, ents, generate_subscripts(x, 1) - 1 as i, unnest(x) as t from tl{t})
),
tk{t} as materialized (
  select page_id, url, i, name, t, ents,
    case when name in ('script', 'style') then regexp_replace(regexp_extract(t, {body}, 1), '(?i)</(?:script|style)\s*>$', '')
      when name <> '' or t like '<!%' or t like '<?%' or t like '</%' then '' else {decode("t")} end as text
  from tr{t}
),
ar{t} as (
  select page_id, url, i, name as tag, text as body, list_transform(x, lambda a: {low("rtrim(split_part(a, '=', 1))")}) as names,
    list_transform(list_transform(x, lambda a: case when contains(a, '=') then regexp_replace(substr(a, instr(a, '=') + 1), {edges}, '', 'g') else '' end),
      lambda v: case when v[1] in ('"', chr(39)) then substr(v, 2, len(v) - 2) else v end) as raws, ents
  from (select *, regexp_extract_all(substr(case when name in ('script', 'style') then regexp_extract(t, {opening}) else t end, len(name) + 2), {q(ATTRIBUTE)}) as x
        from tk{t} where name <> '' and name not like '/%')
),
av{t} as (select page_id, url, i, tag, body, names, list_transform(raws, lambda v: {decode("v")}) as vals from ar{t}),
el{t} as (
  select page_id, url, i, tag, {attr("src")} as src, {attr("href")} as href, {attr("rel")} as rel,
    {attr("name")} as name, {attr("property")} as property, {attr("content")} as content,
    {attr("type")} as type, {attr("id")} as id, {attr("class")} as cls, {attr("for")} as "for", {attr("lang")} as lang,
    {attr("alt")} as alt, {attr("role")} as role, {attr("hreflang")} as hreflang, {attr("tabindex")} as tabindex,
    {has("async")} as is_async, {has("defer")} as is_defer, {has("width")} and {has("height")} as has_size,
    {has("aria-label")} or {has("aria-labelledby")} as has_aria,
    coalesce(starts_with({attr("src")}, 'http://'), false) or coalesce(starts_with({attr("href")}, 'http://'), false) as plain_http, body
  from av{t}
),
tg{t} as materialized (
  select page_id, i::bigint as place, ltrim(name, '/') as name, name like '/%' as is_end, row_number() over (partition by page_id order by i) as n, {ends} as ends, {ranks} as ranks
  from tk{t} where name <> '' and t not like '%/>' and name not in ('script', 'style', {void})
),
st{t}(page_id, n, open, gone, place) as (
  select page_id, 0::bigint, []::struct(name varchar, place bigint)[], []::struct(name varchar, place bigint)[], 0::bigint from dec{t}
  union all
  select page_id, n, case when is_end or kept >= {html.DEPTH} or (name in ('html', 'head', 'body') and list_contains(list_transform(list_slice(open, 1, kept), lambda x: x.name), name))
      then list_slice(open, 1, kept) else list_append(list_slice(open, 1, kept), {{'name': name, 'place': place}}) end, list_slice(open, kept + 1, len(open)), place
  from (
    select g.*, s.open, case
      when not is_end and ends[g.name] is null then len(open)
      when not is_end then coalesce(list_max(list_transform(range(1, len(open) + 1), lambda j: case when contains(ends[g.name], ' ' || open[j].name || ' ') then 0 else j end)), 0)
      when not list_contains({reach}, g.name) then len(open)
      when len(list_filter(list_slice(open, len(open) - {found} + 2, len(open)), lambda x: coalesce(ranks[x.name], 1) > coalesce(ranks[g.name], 1))) > 0 then len(open)
      else len(open) - {found} end as kept
    from st{t} s join tg{t} g on g.page_id = s.page_id and g.n = s.n + 1
  )
),
sm{t} as materialized (select * from st{t}),
bd{t} as materialized (
  select page_id, x.name as name, x.place as a, b from (
    select page_id, unnest(gone) as x, place as b from sm{t} where len(gone) > 0
    union all
    select s.page_id, unnest(open), len(tl{t}.x)::bigint from sm{t} s join tl{t} using (page_id)
    join (select page_id, max(n) as n from sm{t} group by 1) m on m.page_id = s.page_id and m.n = s.n)
),
xt{t} as (
  select bd.page_id, bd.name, a, coalesce(string_agg(k.text, '' order by k.i), '') as text
  from (select * from bd{t} where name in ('title', 'a', {heads})) bd left join tk{t} k on k.page_id = bd.page_id and k.i > a and k.i < b
  group by all
),
bo{t} as (
  select page_id, coalesce(min(a) filter (where name = 'body'), max(h) - 1, -1) as a,
    case when count(*) filter (where name = 'body') > 0 then min_by(b, a) filter (where name = 'body') else coalesce(min(e), max(n)) end as b
  from (
    select page_id, name, a, b, null as h, null as e, null as n from bd{t}
    union all select page_id, '', null, null, min(i) filter (where name = '/head') + 1, min(i) filter (where name in ('/body', '/html')), max(i) + 1 from tk{t} group by 1
  ) group by 1
),
bt{t} as (
  select k.page_id, string_agg(k.text || ' ', '' order by k.i) as body_text
  from tk{t} k join bo{t} o on o.page_id = k.page_id and k.i > o.a and k.i < o.b
  where k.name = '' and k.text <> '' and not exists (
    select 1 from bd{t} x where x.page_id = k.page_id and (x.name in ({skips}) or (o.a < 0 and x.name = 'title')) and x.a > o.a and k.i > x.a and k.i < x.b)
  group by 1
),
pl{t} as (select d.*, coalesce(body_text, '') as body_text from dec{t} d left join bt{t} using (page_id)),
hd{t} as (select page_id, a as i, substr(name, 2, 1)::int as level, {trim("text")} as text from xt{t} where name in ({heads})),
an{t} as (select page_id, {trim("text")} as text from xt{t} where name = 'a'),
ti{t} as (select page_id, min_by(text, a) as title from xt{t} where name = 'title' group by 1),
hx{t} as (
  select page_id, count(*) filter (where level = 1) as h1_count, min_by(text, i) filter (where level = 1) as h1,
    list(level order by i) as heading_sequence, list(level order by i) filter (where text <> '') as outline,
    coalesce(bool_or(level between 2 and 4 and text <> '' and (ends_with(text, '?') or {question})), false) as has_qa_headings
  from hd{t} group by page_id
),
ax{t} as (
  select page_id, count(*) filter (where text = '') as empty_links, count(*) filter (where {low("text")} in ({generic})) as generic_links
  from an{t} group by page_id
),
wd{t} as (select page_id, {low("w")} as word from (select page_id, unnest(regexp_extract_all(body_text, '[A-Za-z]+')) as w from pl{t}) where len(w) between 3 and 128),
wx{t} as (select page_id, count(*) as total_words, bool_or(word not in ({stop})) as has_keywords from wd{t} group by page_id),
ts{t} as (select page_id, i, {host("src")} as domain, {first_of("src", dims.TRACKERS)} as category, {first_of("src", dims.CONSENT)} as tool
  from el{t} where tag = 'script' and {third("src", "url")}),
tx{t} as (select page_id, count(distinct domain) filter (where category is not null) as n_trackers, list(distinct domain) as script_domains, min_by(tool, i) filter (where tool is not null) as tool from ts{t} group by page_id),
mk{t} as (
  select page_id, min_by(tool, o) filter (where tool is not null) as tool from (
    select page_id, i * 2 as o, {first_of(low("id"), dims.CONSENT)} as tool from el{t} where strlen(id) <= 256
    union all select page_id, i * 2 + 1, {first_of(low("cls"), dims.CONSENT)} from el{t} where strlen(cls) <= 256) group by page_id
),
lb{t} as (select distinct page_id, "for" from el{t} where tag = 'label' and "for" is not null),
ix{t} as (
  select e.page_id, count(*) as inputs_missing_label from el{t} e
  where tag = 'input' and coalesce(type, 'text') not in ('hidden', 'submit', 'button', 'reset') and not has_aria
    and not exists (select 1 from lb{t} l where l.page_id = e.page_id and l."for" = e.id) group by 1
),
ex{t} as (
  select page_id,
    min_by(content, i) filter (where tag = 'meta' and name = 'description') as description,
    min_by(coalesce(content, ''), i) filter (where tag = 'meta' and name = 'robots') as robots,
    min_by(coalesce(content, ''), i) filter (where tag = 'meta' and name = 'viewport') as viewport,
    min_by(content, i) filter (where tag = 'meta' and property = 'og:title') as og_title,
    min_by(content, i) filter (where tag = 'meta' and property = 'og:description') as og_description,
    min_by(content, i) filter (where tag = 'meta' and property = 'og:image') as og_image,
    min_by(lang, i) filter (where tag = 'html') as html_lang,
    coalesce(bool_or(tag = 'meta' and name = 'author' and content is not null), false) as author_meta,
    min_by(href, i) filter (where tag = 'link' and rel = 'canonical' and href is not null) as canonical,
    count(*) filter (where tag = 'link' and hreflang is not null) as hreflang_count,
    count(*) filter (where {ext}) as external_scripts,
    count(*) filter (where {ext} and not is_async and not is_defer) as blocking_scripts,
    count(*) filter (where {ext} and is_async) as async_scripts,
    count(*) filter (where {ext} and is_defer) as defer_scripts,
    count(*) filter (where tag = 'script' and coalesce(src, '') = '') as inline_scripts,
    coalesce(sum(strlen(body)) filter (where tag = 'script' and coalesce(src, '') = ''), 0) as inline_script_bytes,
    count(*) filter (where tag = 'link' and rel = 'stylesheet' and href <> '') as external_stylesheets,
    count(*) filter (where tag = 'style') as inline_styles,
    coalesce(sum(strlen(body)) filter (where tag = 'style'), 0) as inline_style_bytes,
    count(*) filter (where tag = 'img') as image_count,
    count(*) filter (where tag = 'img' and not has_size) as images_missing_dims,
    count(*) filter (where tag = 'img' and alt is null) as images_missing_alt,
    count(*) filter (where tag = 'img' and alt = '') as images_empty_alt,
    {rel("preload")} as preload, {rel("prefetch")} as prefetch, {rel("preconnect")} as preconnect, {rel("dns-prefetch")} as dns_prefetch,
    coalesce(list_sort(list(distinct {host("coalesce(src, href)")}) filter (where (({ext}) or (tag = 'link' and rel = 'stylesheet' and href <> '')) and {third("coalesce(src, href)", "url")})), []) as third_party_domains,
    coalesce(list_sort(list(distinct {host("src")}) filter (where tag = 'iframe' and {third("src", "url")})), []) as iframe_domains,
    count(*) filter (where tag in ('font', 'center', 'marquee')) as deprecated_tags,
    count(*) filter (where plain_http) as n_plain_http,
    count(*) filter (where try_cast(tabindex as double) > 0) as n_positive_tabindex,
    coalesce(bool_or(tag = 'title'), false) as has_title,
    coalesce(bool_or(tag = 'main' or role = 'main'), false) as has_main_landmark,
    coalesce(bool_or(tag = 'nav' or role = 'navigation'), false) as has_nav_landmark,
    coalesce(bool_or(tag = 'a' and starts_with(href, '#')), false) as has_skip_link,
    count(*) filter (where tag = 'a' and href is not null and (starts_with(href, '/') or starts_with(href, '#') or {host("href")} = {host("url")})) as internal_links,
    count(*) filter (where tag = 'a' and href is not null) as n_links,
    count(*) filter (where tag = 'a' and {third("href", "url")}) as outbound_links,
    coalesce(bool_or(type = 'application/ld+json' and tag = 'script'), false) as has_structured_data,
    coalesce(bool_or(type = 'application/ld+json' and contains(body, 'FAQPage')), false) as has_faq,
    coalesce(bool_or(type = 'application/ld+json' and contains(body, 'HowTo')), false) as has_howto,
    coalesce(bool_or(type = 'application/ld+json' and contains(body, 'Article')), false) as has_article,
    coalesce(bool_or(type = 'application/ld+json' and contains(body, '"author"')), false) as ld_author,
    coalesce(bool_or(type = 'application/ld+json' and (contains(body, '"publisher"') or contains(body, '"organization"'))), false) as has_publisher
  from el{t} group by page_id
),
fe{t} as (
  select p.page_id, p.url, p.has_sitemap, p.body_text, strlen(p.html) as html_bytes,
    ti.title,
    starts_with(p.url, 'https://') as is_https, ex.* exclude (page_id), hx.* exclude (page_id, h1_count, has_qa_headings),
    coalesce(h1_count, 0) as h1_count, coalesce(hx.has_qa_headings, false) as has_qa_headings,
    coalesce(empty_links, 0) as empty_links, coalesce(generic_links, 0) as generic_links,
    coalesce(total_words, 0) as total_words, coalesce(has_keywords, false) as has_keywords,
    coalesce(n_trackers, 0) as n_trackers, coalesce(list_sort(script_domains), []) as script_domains,
    coalesce(tx.tool, mk.tool) as consent_tool, coalesce(inputs_missing_label, 0) as inputs_missing_label
  from pl{t} p left join ti{t} ti using (page_id) left join ex{t} ex using (page_id) left join hx{t} hx using (page_id) left join ax{t} ax using (page_id)
    left join wx{t} wx using (page_id) left join tx{t} tx using (page_id) left join mk{t} mk using (page_id) left join ix{t} ix using (page_id)
),
f{t} as (
  select *, coalesce(strlen(title), 0) as title_length, coalesce(strlen(description), 0) as description_length,
    coalesce(contains({low("robots")}, 'noindex'), false) as has_noindex, coalesce(contains({low("robots")}, 'nofollow'), false) as has_nofollow,
    coalesce(contains(viewport, 'user-scalable=no') or contains(viewport, 'maximum-scale=1'), false) as zoom_disabled,
    case when is_https then n_plain_http else 0 end as mixed_content, n_links - internal_links as external_links,
    consent_tool is not null as has_banner, author_meta or ld_author as has_author,
    contains({low("coalesce(title, '')")}, {q(KEYWORD)}) as kw_in_title, contains({low("coalesce(h1, '')")}, {q(KEYWORD)}) as kw_in_h1,
    contains({low("coalesce(description, '')")}, {q(KEYWORD)}) as kw_in_description,
    case when total_words > 0 then {occurrences("body_text", q(KEYWORD))} * 2 * 1000 // total_words else 0 end as kw_density
  from fe{t}
)"""


def _rule(rule_id, category, when, severity, penalty, detail):
    return f"select page_id, url, {q(rule_id)} as rule_id, {q(category)} as category, {severity} as severity, {penalty} as penalty, {detail} as detail from f{{t}} where {when}"


def _n(rule_id, category, n, least, high_at, severities, penalties, text):
    pick = lambda pair: pair[0] if pair[0] == pair[1] else f"case when {n} >= {high_at} then {pair[0]} else {pair[1]} end"
    return _rule(rule_id, category, f"{n} >= {least}", pick([q(s) for s in severities]), pick(penalties), f"{n} || {q(' ' + text)}")


def _c(rule_id, category, when, severity, penalty, text):
    return _rule(rule_id, category, when, q(severity), penalty, text if text.startswith("'") else q(text))


FINDINGS = "\nunion all ".join([
    _n("perf_render_blocking_scripts", "performance", "blocking_scripts", 1, 3, ("critical", "warning"), (25, 10), "render-blocking script(s)"),
    _n("perf_missing_image_dims", "performance", "images_missing_dims", 1, 4, ("warning", "warning"), (15, 5), "image(s) missing width/height"),
    _n("perf_inline_script_bytes", "performance", "inline_script_bytes", 5001, 20001, ("warning", "info"), (15, 5), "bytes of inline script"),
    _n("perf_third_party_count", "performance", "len(third_party_domains)", 3, 6, ("warning", "info"), (15, 5), "third-party domain(s)"),
    _n("a11y_missing_image_alt", "accessibility", "images_missing_alt", 1, 3, ("critical", "critical"), (25, 10), "image(s) missing alt text"),
    _n("a11y_missing_input_label", "accessibility", "inputs_missing_label", 1, 3, ("critical", "critical"), (25, 10), "input(s) missing label"),
    _n("a11y_positive_tabindex", "accessibility", "n_positive_tabindex", 1, 3, ("warning", "warning"), (15, 5), "element(s) with positive tabindex"),
    _c("a11y_viewport_zoom_disabled", "accessibility", "zoom_disabled", "critical", 15, "viewport meta disables user zoom"),
    _c("a11y_missing_lang", "accessibility", "html_lang is null", "critical", 20, "html element missing lang attribute"),
    _n("bp_mixed_content", "best_practices", "mixed_content", 1, 3, ("critical", "critical"), (25, 10), "mixed-content resource(s)"),
    _n("bp_deprecated_elements", "best_practices", "deprecated_tags", 1, 3, ("warning", "warning"), (15, 5), "deprecated HTML element(s)"),
    _c("bp_missing_https", "best_practices", "not is_https", "critical", 30, "page served over HTTP"),
    _c("seo_missing_title", "seo", "title_length = 0", "critical", 20, "page has no title"),
    _c("seo_title_too_short", "seo", "title_length between 1 and 9", "warning", 10, "'title is ' || title_length || ' chars; 10–60 recommended'"),
    _c("seo_title_too_long", "seo", "title_length > 70", "info", 5, "'title is ' || title_length || ' chars; keep under 70'"),
    _c("seo_missing_description", "seo", "description_length = 0", "warning", 10, "page has no meta description"),
    _c("seo_description_too_short", "seo", "description_length between 1 and 49", "warning", 5, "'description is ' || description_length || ' chars; 50–160 recommended'"),
    _c("seo_description_too_long", "seo", "description_length > 160", "info", 5, "'description is ' || description_length || ' chars; keep under 160'"),
    _c("seo_missing_canonical", "seo", "canonical is null", "info", 5, "no canonical link element"),
    _c("seo_noindex_present", "seo", "has_noindex", "critical", 30, "page has noindex directive"),
    _c("seo_missing_og_tags", "seo", "og_title is null and og_image is null", "info", 5, "og:title and og:image both absent"),
    _c("seo_missing_sitemap", "seo", "not has_sitemap", "info", 5, "no sitemap found"),
    _c("gdpr_no_consent_banner", "gdpr", "n_trackers > 0 and not has_banner", "critical", 30, "'' || n_trackers || ' tracker(s) present but no consent banner'"),
    _c("kw_no_extractable_content", "keyword", "total_words > 0 and not has_keywords", "warning", 15, "no content words found after filtering stop words"),
    _c("kw_thin_content", "keyword", "has_keywords and total_words between 1 and 299", "warning", 10, "'page has ' || total_words || ' words; 300+ recommended for rankable content'"),
    _c("kw_target_missing_from_title", "keyword", "not kw_in_title", "critical", 15, "target keyword not found in page title"),
    _c("kw_target_missing_from_h1", "keyword", "not kw_in_h1", "warning", 10, "target keyword not found in h1 heading"),
    _c("kw_target_missing_from_description", "keyword", "not kw_in_description", "info", 5, "target keyword not found in meta description"),
    _c("kw_keyword_stuffing", "keyword", "kw_density > 30", "warning", 10, "'keyword density ' || kw_density || '‰ exceeds 30‰ threshold'"),
    _c("kw_low_keyword_density", "keyword", "total_words >= 100 and kw_density < 5", "info", 5, "'keyword density ' || kw_density || '‰ is below 5‰ minimum'"),
    _c("aeo_no_structured_schema", "aeo", "not has_faq and not has_howto and not has_article", "warning", 15, "no FAQ, HowTo, or Article structured data found"),
    _c("aeo_no_entity_signals", "aeo", "not has_author and not has_publisher", "warning", 10, "no author or publisher entity signals found"),
    _c("aeo_no_qa_content", "aeo", "not has_qa_headings and not has_faq", "info", 10, "no Q&A headings or FAQ schema detected"),
    _c("aeo_no_citations", "aeo", "outbound_links = 0", "info", 5, "no outbound citation links found"),
])


def audit(shift: int = 0, tag: str = "") -> str:
    """CTEs up to findings (fi) and wide scores (sc)."""
    wide = ", ".join(
        f"greatest(0, 100 - coalesce(sum(penalty) filter (where category = '{c}'), 0))::int as {c}" for c in dims.CATEGORIES
    )
    return f"""{prelude(shift, tag)},
fi{tag} as ({FINDINGS.replace("{t}", tag)}),
sc{tag} as (select f.page_id, f.url, {wide} from f{tag} f left join fi{tag} x on x.page_id = f.page_id group by 1, 2)"""
