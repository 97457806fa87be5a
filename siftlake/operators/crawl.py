"""Breadth-first expansion over a link table, and crawls over a table of pages."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.features import page_features
from siftlake.session import exploded, kept_until_exit, shared_dir

#: Parts over which the links of one page are dealt, so that no task holds all links of a hot page.
SALTS = 8


class _Buckets:
    """A table in the shared folder, kept in hash buckets of its key; what is appended joins without moving what was there."""

    def __init__(self, spark, name: str, keys: list[str], partition: str | None = None):
        self.spark, self.keys, self.partition = spark, keys, partition
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = kept_until_exit(spark, f"{shared_dir(spark)}/{self.name}")

    def append(self, rows: DataFrame) -> None:
        """Rows are dealt to their buckets first, so that a bucket gets one file, not one from each task."""
        writer = rows.repartition(self.n, *self.keys).write.mode("append").option("path", self.path).bucketBy(self.n, *self.keys)
        (writer.partitionBy(self.partition) if self.partition else writer).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The rows as plain files; the name goes out of the catalogue."""
        schema = self.rows().schema
        self.spark.sql(f"drop table {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)


def breadth_first(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(page, depth), depth being the least number of links from a seed; all that is reached, or down to ``max_depth``.

    One round a level: the frontier joins the edges, and pages that were seen
    are left out by an anti join. Edges are written once in buckets of their
    source, dealt over SALTS parts; seen pages are kept in buckets of the page,
    and each level is appended to them. So a round shuffles its frontier and
    what that links to, never the edges or the pages of the levels before: all
    rounds together shuffle edges and pages once. Levels are written, so
    lineage does not grow with depth.

    Null pages are kept as seeds and lead nowhere, links to null are none; repeated seeds and edges
    count once; without seeds the result is empty.
    """
    spark = seeds.sparkSession
    links = _Buckets(spark, "edges", ["source", "salt"])
    links.append(edges.filter("source is not null and target is not null").select("source", "target", F.pmod(F.xxhash64("target"), F.lit(SALTS)).cast("int").alias("salt")))
    seen = _Buckets(spark, "seen", ["page"], "depth")
    seen.append(seeds.select("page").distinct().withColumn("depth", F.lit(0)))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        frontier = seen.rows().filter(F.col("depth") == depth - 1).select(F.col("page").alias("source"), salt)
        found = frontier.join(links.rows(), ["source", "salt"]).select(F.col("target").alias("page")).distinct()
        seen.append(found.join(seen.rows().select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)))
        if seen.rows().filter(F.col("depth") == depth).isEmpty():
            break
    links.close()
    return seen.close()


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target): the internal links of pages(url, html, ...) and, where there is a column sitemap_locs, its addresses."""
    df = page_features(pages)
    links = F.transform(F.filter("links", lambda x: x["is_internal"]), lambda x: x["href"])
    if "sitemap_locs" in pages.columns:
        links = F.concat(links, F.coalesce("sitemap_locs", F.array().cast("array<string>")))
    return exploded(df, F.array_distinct(links), "target", "url").withColumnRenamed("url", "source")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int | None = 3) -> DataFrame:
    """The pages that a crawl from seeds(url) reports, with their depth.

    Pages whose HTML is null have failed: they are visited, but neither
    reported nor expanded. Links and sitemap addresses are taken as they stand
    and followed where a page has that address. The links are extracted once and
    written; every level then joins them.
    """
    live = pages.filter(F.col("html").isNotNull())
    visited = breadth_first(seeds.select(F.col("url").alias("page")), page_links(live), max_depth)
    return live.join(visited.withColumnRenamed("page", "url"), "url")
