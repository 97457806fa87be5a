"""Event lines, diff lines, request routes and the state that a reader of crawl events keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.dims import CATEGORIES, SEVERITIES
from siftlake.functions.text import get_param, path_of, query_of
from siftlake.operators.reports import score_line

#: Fixed values. Request paths and their routes.
ROUTES = {
    "/api/audit": "audit",
    "/api/crawl": "crawl",
    "/health": "health",
    "/auth/register": "auth_register",
    "/auth/login": "auth_login",
    "/auth/refresh": "auth_refresh",
    "/auth/logout": "auth_logout",
    "/user/me": "user_me",
    "/projects": "projects_list",
    "/api/runs": "audit_runs",
    "/api/recommendations": "recommendations",
}


def route(target: str | Column) -> Column:
    """The route of a request target; its query does not matter."""
    path = path_of(target)
    out = F.when(path.startswith("/projects/") & (F.length(path) > len("/projects/")), F.when(path.endswith("/audit"), "project_audit").otherwise("project_get"))
    for p, name in ROUTES.items():
        out = out.when(path == p, name)
    return out.otherwise("not_found")


def crawl_parameters(target: str | Column) -> Column:
    """url, depth (default 1), runners (default 4) and keyword of a crawl request; null without a url."""
    query = query_of(target)
    number = lambda name, default: F.coalesce(get_param(query, name).try_cast("int"), F.lit(default)).alias(name)
    url = get_param(query, "url")
    return F.when(url.isNotNull(), F.struct(url.alias("url"), number("depth", 1), number("runners", 4), get_param(query, "keyword").alias("keyword")))


def user_agent(product: Column, version: Column, contact: Column, profile: Column) -> Column:
    return F.format_string("%s/%s (site auditor; %s; profile=%s)", product, version, contact, profile)


def page_events(audited: DataFrame, *keys: str) -> DataFrame:
    """One page event for each audited page, as a server-sent event."""
    body = F.to_json(F.struct("url", F.lit(200).alias("status"), F.struct(*CATEGORIES).alias("scores"), F.size("findings").alias("findings")))
    return audited.select(*keys, F.concat(F.lit("event: page\ndata: "), body, F.lit("\n\n")).alias("event"))


def done_event(totals: DataFrame) -> DataFrame:
    """The closing event of a crawl from its totals."""
    body = F.to_json(F.struct("total_pages", "total_findings", *SEVERITIES))
    return totals.select(F.concat(F.lit("event: done\ndata: "), body, F.lit("\n\n")).alias("event"))


def progress_event(state: DataFrame, *keys: str) -> DataFrame:
    """A progress event from phase, total_done, total_queued and runners, an array of (id, status, pages_done, pages_failed, url)."""
    one = lambda r: F.struct(*[r[c].alias(c) for c in ("id", "status", "pages_done", "pages_failed", "url")])
    body = F.to_json(F.struct("phase", "total_done", "total_queued", F.transform("runners", one).alias("runners")))
    return state.select(*keys, F.concat(F.lit("event: progress\ndata: "), body, F.lit("\n\n")).alias("event"))


def diff_lines(deltas: DataFrame, *keys: str) -> DataFrame:
    """A line for each score that changed, from (category, before, after, regressed)."""
    line = score_line(F.col("category"), F.col("before"), F.col("after"), F.col("regressed"))
    return deltas.filter("before <> after").select(*keys, "category", line.alias("line"))


def goals_json(covered: DataFrame, *keys: str) -> DataFrame:
    """The keyword coverage of each page as one JSON object, keywords in order."""
    one = F.struct("keyword", "in_title", "in_h1", "in_description", F.col("density").alias("density_permille"), F.col("coverage").alias("coverage_score"))
    grouped = covered.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("keyword_coverage"))
    return grouped.select(*keys, F.to_json(F.struct(*keys, "keyword_coverage")).alias("json"))


def reader_state(events: DataFrame, *keys: str) -> DataFrame:
    """What a reader shows after events(type, ordinal, url): progress replaces, pages add up, done or error closes."""
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("url")), F.when(F.col("type") == kind, F.col("ordinal")))
    closed = F.max_by("type", F.when(F.col("type").isin("done", "error"), F.col("ordinal")))
    return events.groupBy(*keys).agg(
        last("progress").alias("working_on"), F.count_if(F.col("type") == "page").alias("pages"), F.coalesce(closed, F.lit("running")).alias("status")
    )


def is_valid_token(revoked_at: str, expires_at: str, now: Column) -> Column:
    """Neither revoked nor past its end."""
    return F.col(revoked_at).isNull() & (F.col(expires_at) > now)


def version_checks(df: DataFrame, ordinal: str, version: str) -> DataFrame:
    """Whether versions are all different, and rise with the ordinal; neighbours meet by an equi-join."""
    counts = df.groupBy(version).agg(F.count("*").alias("_n"))
    unique = counts.agg((F.coalesce(F.max("_n"), F.lit(1)) == 1).alias("no_duplicates"))
    following = df.select((F.col(ordinal) - 1).alias(ordinal), F.col(version).alias("_next"))
    falls = df.join(following, ordinal).filter(F.col(version) >= F.col("_next"))
    return unique.crossJoin(falls.agg((F.count("*") == 0).alias("is_sorted")))
