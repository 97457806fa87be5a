"""Deterministic decoration of the pages table, one SQL text for Spark and DuckDB.

The supplied pages lack most elements that the rules look at. The decoration
adds them by page number, so every rule fires on some pages and not on others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _every(p: str, modulus: int, equals: str, text: str) -> str:
    return f"case when {p} % {modulus} {equals} then '{text}' else '' end"


def _times(p: str, modulus: int, text: str) -> str:
    return f"repeat('{text}', cast({p} % {modulus} as int))"


def html_sql(shift: int = 0) -> str:
    """The decorated HTML of a row with page_id and html; ``shift`` gives another decoration."""
    p = f"(page_id + {shift})"
    sheets = "".join(f'<link rel="stylesheet" href="https://s{i}.example.net/a.css">' for i in range(3))
    more_sheets = "".join(f'<link rel="stylesheet" href="//t{i}/b.css"><link rel="stylesheet" href="https://u{i}.example.net/b.css">' for i in range(3))
    head = [
        f"case {p} % 4 when 1 then '<meta name=\"description\" content=\"short text\">'"
        f" when 2 then concat('<meta name=\"description\" content=\"', repeat('audit tool ', 10), '\">')"
        f" when 3 then concat('<meta name=\"description\" content=\"', repeat('audit tool ', 20), '\">') else '' end",
        _every(p, 3, "<> 0", '<link rel="canonical" href="https://www.example.org/c">'),
        _every(p, 11, "= 0", '<meta name="robots" content="NoIndex, follow">'),
        _every(p, 5, "= 0", '<meta property="og:title" content="An &amp; audit">'),
        _every(p, 13, "= 0", '<meta name="viewport" content="width=device-width, user-scalable=no">'),
        _times(p, 5, '<script src="https://cdn.example.org/a.js"></script>'),
        _every(p, 7, ">= 3", sheets),
        _every(p, 7, "= 6", more_sheets),
        _every(p, 8, "= 1", '<script async src="https://www.google-analytics.com/g.js"></script>'),
        _every(p, 8, "= 2", '<script defer src="https://static.hotjar.com/h.js"></script><script async src="https://cdn.cookielaw.org/o.js"></script>'),
        f"case {p} % 9 when 0 then concat('<script>', repeat('abcde ', 1000), '</script>')"
        f" when 1 then concat('<script>', repeat('abcdefg ', 2625), '</script>') else '' end",
        f"case {p} % 6 when 0 then '<script type=\"application/ld+json\">{{\"@type\":\"FAQPage\"}}</script>'"
        f" when 1 then '<script type=\"application/ld+json\">{{\"@type\":\"Article\",\"author\":\"A\",\"publisher\":\"B\"}}</script>' else '' end",
        _every(p, 5, "= 2", '<script>var a = "<!--"; var b = "<b>";</script><meta name="author" content="A &eacute;" CONTENT="B">'),
        _every(p, 14, "= 3", '<link rel="preload" href="/p.js"><link rel="preconnect" href="https://x.example.org"><link rel="dns-prefetch" href="https://y.example.org"><link rel="alternate" hreflang="de" href="/de">'),
    ]
    body = [
        _times(p, 6, '<img src="/i.png">'),
        _every(p, 2, "= 0", '<img src="/j.png" alt="" width="1" height="1">'),
        _times(p, 4, '<input type="text" name="q">'),
        _every(p, 5, "= 1", '<label for="f1">F</label><input id="f1" type="email"><input type="hidden" name="h">'),
        _times(p, 4, '<a href="#t" tabindex="1">more</a>'),
        _times(p, 5, '<font>f</font>'),
        _times(p, 4, '<a href="http://plain.example.org/p">plain site</a>'),
        f"case when {p} % 3 = 0 then '<h2>How to audit</h2>' else '<h2>Overview</h2>' end",
        _every(p, 10, "= 0", '<div class="Cookie-Banner">ok</div>'),
        f"case when {p} % 29 = 3 then concat('<p>', repeat('audit tool ', 400), '</p>') else '' end",
        _every(p, 6, "= 3", '<pre>alpha<code>beta</code>gamma</pre><p title="<!--">delta</p><!--><p>epsilon<style>q{}</style>'),
        _every(p, 7, "= 2", '<h2>Open heading<p>behind it</p><a href="/1" HREF="/2">one<b>bold<a id=x>two</b></a><h3>caf&eacute; &#8212; &#x41;udit&nbsp;tool</h3>'),
        _every(p, 9, "= 4", '<ul><li>x<li>&uuml;ber na&#239;ve &nope; &amp;lt;<ul><li>y</ul></ul><template><noscript>t</noscript>u</template>'),
        _every(p, 10, "= 7", '<div><span></div>tail</span><table><tr><td><a href=/t>c<td>d</table></p><div class=a/>e < f'),
        _every(p, 12, "= 5", '<iframe src="https://www.youtube.com/embed/1"></iframe><main>m</main>'),
    ]
    html = f"replace(html, '</head>', concat({', '.join(head)}, '</head>'))"
    html = f"replace({html}, '<body>', concat('<body>', {', '.join(body)}))"
    titles = f"case {p} % 19 when 0 then '<title></title><title>' when 1 then '<title>Tiny</title><title>' when 2 then concat('<title>', repeat('long title ', 8), '</title><title>') when 3 then '<title>Caf&eacute; &#8211; &#x41;&amp;lt; &copy</title><title>' else '<title>' end"
    html = f"replace({html}, '<title>', {titles})"
    html = f"replace({html}, ' lang=\"', case when {p} % 17 = 0 then ' data-lang=\"' else ' lang=\"' end)"
    # a page of stop words only
    return f"case when {p} % 31 = 4 then '<html lang=\"en\"><head><title>the and that</title></head><body>the and the with</body></html>' else {html} end"


#: A goals file for each page, with a keyword that depends on the page.
GOALS_SQL = (
    "concat('{\"pages\":[{\"url\":\"', url, '\",\"keywords\":[\"audit tool\",\"the\",\" How to \",\"plain site\",\"\",\"',"
    " split_part(url, '/', 4), '\"]}],\"by\":\"editor\"}')"
)
#: A page's crawl log line; every seventh is broken, every fifth of a type that is not known.
EVENT_SQL = (
    "case when page_id % 7 = 0 then '{\"type\":' when page_id % 5 = 0 then '{\"type\":\"ping\"}'"
    " when page_id % 3 = 0 then concat('{\"type\":\"progress\",\"phase\":\"crawling\",\"total_done\":', cast(page_id as varchar(20)), ',\"total_queued\":4}')"
    " else concat('{\"type\":\"page\",\"url\":\"', url, '\",\"status\":200}') end"
)
ADVICE_SQL = (
    "concat('[{\"quadrant\":\"quick_win\",\"title\":\"', split_part(url, '/', 4), '\",\"detail\":\"d\",\"effort\":\"low\",\"impact\":\"high\"}',"
    " repeat(',{\"quadrant\":\"major\",\"title\":\"t\",\"extra\":1}', cast(page_id % 3 as int)), ']')"
)

SITE = "https://site.example.org/p/"


def site_html_sql() -> str:
    """The HTML of pages as one site: each page links to two later ones and one earlier; every thirteenth fails."""
    link = lambda n: f"'<a href=\"{SITE}', cast({n} as varchar(20)), '\">n</a>'"
    links = ", ".join(link(n) for n in ("2 * page_id + 1", "2 * page_id + 2", "cast(floor(page_id / 3) as bigint)"))
    return f"case when page_id % 13 = 5 then null else replace(html, '<body>', concat('<body>', {links})) end"


SITEMAP_SQL = "page_id % 2 = 0"
#: The target phrase of the keyword rules.
KEYWORD = "audit tool"

ROBOTS_SQL = (
    "concat('# rules' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /fr' || chr(10) || 'Disallow: /en' || chr(10) || 'Allow: /en/', cast(page_id % 10 as int), chr(10),"
    " 'Crawl-delay: ', cast(page_id % 4 as int), chr(10),"
    " case when page_id % 3 = 0 then 'user-agent: siteauditbot' || chr(10) || 'Disallow: /de' || chr(10) || 'Disallow:' || chr(10) || 'crawl-delay: 0.5' || chr(10) else '' end,"
    " case when page_id % 5 = 0 then 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) else '' end,"
    " 'Sitemap: https://h', cast(page_id as varchar(20)), '.example.org/sitemap.xml', chr(10))"
)

SITEMAP_XML_SQL = (
    "case when page_id % 7 = 0 then '<sitemapindex><sitemap><loc>https://a.example.org/1.xml</loc></sitemap><sitemap><loc> https://a.example.org/2.xml </loc></sitemap></sitemapindex>'"
    " when page_id % 11 = 0 then ''"
    " else concat('<?xml version=\"1.0\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">',"
    " repeat('<url><loc>https://a.example.org/p?a=1&amp;b=2</loc><lastmod>2024-01-01</lastmod><priority>0.5</priority></url>', cast(page_id % 4 as int)),"
    " '<url><loc>https://a.example.org/', cast(page_id as varchar(20)), '</loc><changefreq>daily</changefreq></url>',"
    " case when page_id % 3 = 0 then '<url><lastmod>2024-01-01</lastmod></url>' else '' end, '</urlset>') end"
)

PSI_SQL = (
    "concat('{\"lighthouseResult\":{\"categories\":{\"performance\":{\"score\":0.', cast(10 + page_id % 90 as varchar(20)), '},\"accessibility\":{\"score\":1},\"seo\":{\"score\":null}},"
    "\"audits\":{\"largest-contentful-paint\":{\"numericValue\":', cast(1000 + page_id % 977 as varchar(20)), '.5},\"total-blocking-time\":{\"numericValue\":', cast(page_id % 300 as varchar(20)), '},"
    "\"cumulative-layout-shift\":{\"numericValue\":0.25}}}}')"
)

TECH_SQL = (
    "concat('{\"Results\":[{\"Result\":{\"Paths\":[{\"Technologies\":[{\"Name\":\"nginx\",\"Tag\":\"server\"},{\"Name\":\"T', cast(page_id % 5 as varchar(20)), '\",\"Tag\":\"cms\",\"Categories\":[{\"Name\":\"CMS\"}]}]},"
    "{\"Domain\":\"x\"},{\"Technologies\":[{\"Name\":\"nginx\",\"Tag\":\"other\"},{\"Name\":\"T', cast(page_id % 3 as varchar(20)), '\"}]}]}}]}')"
)


def decorated(pages: DataFrame, shift: int = 0) -> DataFrame:
    return pages.select("page_id", "url", F.expr(html_sql(shift)).alias("html"), F.expr(SITEMAP_SQL).alias("has_sitemap"))
