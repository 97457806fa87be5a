"""Sitemap texts as entries, and where sitemaps are looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.dims import SITEMAP_PATHS
from siftlake.functions.html import decoded
from siftlake.functions.text import trimmed


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>.*?</(?:\w+:)?{tag}\s*>"), F.lit(0))


def _child(block: Column, tag: str) -> Column:
    text = trimmed(decoded(F.regexp_extract(block, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}\s*>", 1)))
    return F.when(text != "", text)


def parsed_sitemaps(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Add is_index, child_sitemaps, entries (loc, lastmod, changefreq, priority) and the counts of missing parts.

    An empty or foreign text gives an empty result, not an error. Children of an index are recorded, not fetched.
    """
    df = df.withColumn("_xml", F.coalesce(F.col(xml), F.lit("")))
    df = df.withColumn("is_index", F.col("_xml").rlike(r"<(?:\w+:)?sitemapindex\b"))
    children = F.filter(F.transform(_blocks(F.col("_xml"), "sitemap"), lambda b: _child(b, "loc")), lambda x: x.isNotNull())
    entries = F.transform(
        _blocks(F.col("_xml"), "url"),
        lambda b: F.struct(
            _child(b, "loc").alias("loc"),
            _child(b, "lastmod").alias("lastmod"),
            _child(b, "changefreq").alias("changefreq"),
            _child(b, "priority").try_cast("float").alias("priority"),
        ),
    )
    none = F.array().cast("array<struct<loc:string,lastmod:string,changefreq:string,priority:float>>")
    df = df.withColumn("child_sitemaps", F.when(F.col("is_index"), children).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("entries", F.when(F.col("is_index"), none).otherwise(F.filter(entries, lambda e: e["loc"].isNotNull())))
    missing = lambda part: F.size(F.filter("entries", lambda e: e[part].isNull())).cast("long")
    return df.withColumns({f"missing_{part}": missing(part) for part in ("lastmod", "priority", "changefreq")}).drop("_xml")


def candidates(origin: Column, robots_sitemaps: Column) -> Column:
    """Sitemaps that robots.txt names, then the common paths."""
    base = F.rtrim(origin, F.lit("/"))
    return F.concat(robots_sitemaps, F.array(*[F.concat(base, F.lit(p)) for p in SITEMAP_PATHS]))


def first_answered(df: DataFrame, keys: list[str], ordinal: str, ok: str) -> DataFrame:
    """The first candidate by ordinal that answered, for each key; a map-side combined minimum."""
    rest = F.struct(*[c for c in df.columns if c not in {*keys, ordinal}])
    return df.filter(F.col(ok)).groupBy(*keys).agg(F.min_by(rest, ordinal).alias("_r")).select(*keys, "_r.*")
