"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with v < u: link neighbours to their least common neighbour.

    The minimum is a map-side combined aggregate, and the join back to the edges
    is one that adaptive execution can split, so a node with very many
    neighbours is never gathered in one task.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (u, v) to (node, root), the root being the smallest node that can be reached; roots have no row."""
    edges = staged(
        links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    seen = None
    for _ in range(most_rounds):
        before, edges = edges, staged(_star(_star(edges, large=True), large=False), "stars")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
