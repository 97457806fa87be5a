"""Answers of enrichment services, JSON as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("performance", "accessibility", "best-practices", "seo")
METRICS = {
    "lcp_ms": "largest-contentful-paint",
    "fcp_ms": "first-contentful-paint",
    "tbt_ms": "total-blocking-time",
    "speed_index_ms": "speed-index",
    "inp_ms": "interaction-to-next-paint",
}


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("_v", path, kind)


def _is_integer(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(path, "variant")) == "BIGINT", F.lit(False))


def page_speed(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the four scores, 0 to 100, and the metrics; null where absent.

    A score written as a fraction is times 100; one written as an integer is taken as it is.
    """
    df = df.withColumn("_v", F.try_parse_json(F.col(body)))
    for name in SCORES:
        path = f"$.lighthouseResult.categories['{name}'].score"
        value = F.when(_is_integer(path), _get(path, "long")).otherwise(F.round(_get(path, "double") * 100).cast("long"))
        df = df.withColumn("lighthouse_" + name.replace("-", "_"), value.cast("int"))
    for column, audit in METRICS.items():
        df = df.withColumn(column, F.round(_get(f"$.lighthouseResult.audits['{audit}'].numericValue", "double")).cast("long"))
    cls = _get("$.lighthouseResult.audits['cumulative-layout-shift'].numericValue", "double")
    return df.withColumn("cls_score", cls).drop("_v")


_TECH = (
    "Results array<struct<Result:struct<Paths:array<struct<Technologies:"
    "array<struct<Name:string,Tag:string,Categories:array<struct<Name:string>>>>>>>>>"
)


def technologies(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, ordinal, name, tag and category: the first technology of each name in the first result."""
    parsed = df.select(key, F.from_json(body, _TECH).alias("_j"))
    paths = F.try_element_at("_j.Results", F.lit(1))["Result"]["Paths"]
    rows = parsed.withColumn("_t", F.flatten(F.transform(F.filter(paths, lambda p: p["Technologies"].isNotNull()), lambda p: p["Technologies"])))
    rows = rows.select(key, F.posexplode("_t").alias("ordinal", "_t")).filter("_t.Name is not null")
    first = rows.groupBy(key, F.col("_t.Name").alias("name")).agg(F.min("ordinal").alias("ordinal"), F.min_by("_t", "ordinal").alias("_t"))
    category = F.coalesce(F.try_element_at("_t.Categories", F.lit(1))["Name"], F.lit(""))
    return first.select(key, "ordinal", "name", F.coalesce("_t.Tag", F.lit("")).alias("tag"), category.alias("category"))


def by_category(techs: DataFrame, key: str) -> DataFrame:
    """Names joined by category, else tag, else Other."""
    group = F.coalesce(F.nullif("category", F.lit("")), F.nullif("tag", F.lit("")), F.lit("Other"))
    names = F.array_join(F.array_sort(F.collect_list("name")), ", ")
    return techs.groupBy(key, group.alias("kind")).agg(names.alias("names"), F.count("*").alias("n"))


_RECOMMENDATION = "array<struct<quadrant:string,title:string,detail:string,effort:string,impact:string>>"


def recommendations(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, ordinal and the parts of each recommendation of a JSON list."""
    return df.select(key, F.posexplode(F.from_json(body, _RECOMMENDATION)).alias("ordinal", "_r")).select(key, "ordinal", "_r.*")
