"""Crawl events emitted from a stream of audited pages: page and progress events by batch, a done event at the end.

Every batch writes folders of its own, named by its id, and replaces what an
earlier try left there, so a batch that is run again adds nothing. The totals
of a batch are those of the batch before it and its own pages, one row, so a
batch costs the same however long the feed is. Pages are written once and
counted from there; they are never gathered.

Odd rows: pages without HTML are audited as empty ones; a batch without pages
emits a progress event alone; a feed without batches has a done event of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.dims import SEVERITIES
from siftlake.operators import events

_SUMS = ["total_findings", *SEVERITIES]
_COUNTS = ", ".join(f"{c} long" for c in _SUMS)
_TOTALS = f"total_pages long, {_COUNTS}"


def _page_schema(key: str, kind: str) -> str:
    return f"`{key}` {kind}, {_COUNTS}, event string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _summed(rows: DataFrame, pages) -> DataFrame:
    return rows.agg(pages.alias("total_pages"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _SUMS])


def emit(audited: DataFrame, batch_id: int, path: str, key: str = "url") -> None:
    """Write the page events of one batch, its totals so far and its progress event under ``path``."""
    spark = audited.sparkSession
    of = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    counted = audited.withColumns({"total_findings": F.size("findings").cast("long"), **{s: of(s) for s in SEVERITIES}})
    pages = f"{path}/pages/batch={batch_id}"
    events.page_events(counted, key, *_SUMS).write.mode("overwrite").parquet(pages)
    written = spark.read.schema(_page_schema(key, dict(audited.dtypes)[key])).parquet(pages)
    totals = _summed(written, F.count("*"))
    if batch_id:
        before = spark.read.schema(_TOTALS).parquet(f"{path}/totals/batch={batch_id - 1}")
        totals = _summed(totals.unionByName(before), F.sum("total_pages"))
    totals.write.mode("overwrite").parquet(f"{path}/totals/batch={batch_id}")
    so_far = spark.read.schema(_TOTALS).parquet(f"{path}/totals/batch={batch_id}")
    idle = F.array().cast("array<struct<id:int,status:string,pages_done:int,pages_failed:int,url:string>>")
    state = so_far.select(F.lit("crawling").alias("phase"), F.col("total_pages").alias("total_done"), F.lit(0).alias("total_queued"), idle.alias("runners"))
    events.progress_event(state).write.mode("overwrite").parquet(f"{path}/progress/batch={batch_id}")


def emitting(audited: DataFrame, path: str, key: str = "url"):
    """A stream writer that emits the events of ``audited``, pages with findings and scores, under ``path``; start it with a trigger."""
    writer = audited.writeStream.option("checkpointLocation", f"{path}/checkpoint")
    return writer.foreachBatch(lambda batch, batch_id: emit(batch, batch_id, path, key))


def close(spark: SparkSession, path: str) -> None:
    """Write the done event from the totals of the last batch; closing again changes nothing."""
    if _exists(spark, f"{path}/totals"):
        last = spark.read.schema(f"{_TOTALS}, batch long").parquet(f"{path}/totals").orderBy(F.col("batch").desc()).limit(1)
    else:
        last = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("total_pages", *_SUMS)])
    events.done_event(last).write.mode("overwrite").parquet(f"{path}/done")


def emitted(spark: SparkSession, path: str, key: str = "url", kind: str = "string") -> DataFrame:
    """kind, batch, the page's key and event of all that was emitted."""
    parts = [spark.createDataFrame([], f"kind string, batch long, `{key}` {kind}, event string")]
    of = {"page": ("pages", f"{_page_schema(key, kind)}, batch long"), "progress": ("progress", "event string, batch long"), "done": ("done", "event string")}
    for name, (folder, schema) in of.items():
        if _exists(spark, f"{path}/{folder}"):
            rows = spark.read.schema(schema).parquet(f"{path}/{folder}").withColumn("kind", F.lit(name))
            parts.append(rows.select("kind", *[c for c in ("batch", key, "event") if c in rows.columns]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def run_feed(audited: DataFrame, path: str, key: str = "url") -> DataFrame:
    """Emit all that the stream has now, close the feed and return what was emitted."""
    query = emitting(audited, path, key).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    spark = audited.sparkSession
    close(spark, path)
    return emitted(spark, path, key, dict(audited.dtypes)[key])
