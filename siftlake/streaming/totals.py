"""Running totals over a stream of pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.features import page_features
from siftlake.operators.rules import findings, with_findings
from siftlake.session import shared_dir


def page_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """New Parquet files under a path or glob as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def finding_totals(pages: DataFrame) -> DataFrame:
    """Findings so far by category and severity; the state is a few rows whatever the stream's length."""
    found = findings(with_findings(page_features(pages)), "url")
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"), F.sum("penalty").alias("penalty"))


def run_totals(totals: DataFrame, name: str | None = None) -> DataFrame:
    """Drive the stream to its end and return the last totals."""
    spark = totals.sparkSession
    name = name or f"totals_{uuid.uuid4().hex}"
    query = (
        totals.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)


_EVENT = (
    "type string, phase string, total_done long, total_queued long, url string, status int,"
    " total_pages long, total_findings long, critical long, warning long, info long"
)


def parsed_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Crawl events from JSON lines; bad JSON and unknown types are left out."""
    df = lines.select(F.from_json(column, _EVENT).alias("e")).select("e.*")
    return df.filter(F.col("type").isin("progress", "page", "done", "error"))
