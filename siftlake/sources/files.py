"""Files of goals, baselines and event logs, found by name below a folder, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.sources import documents


def _options(pattern: str) -> dict:
    return {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}


def json_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path, body and is_json of every file below ``folder`` whose name fits ``pattern``; a file is a row.

    Small files share a partition and no file is cut. A text that is no JSON,
    blanks included, has is_json false. Files of no bytes are passed over, as
    Spark's readers do. Without a fitting file the table is empty; a folder
    that does not exist is an error.
    """
    return _bodies(spark.read.options(**_options(pattern)).text(folder, wholetext=True))


def json_file_stream(spark: SparkSession, folder: str, pattern: str = "*.json", max_files: int = 1000) -> DataFrame:
    """The same as a stream of new files; its offsets are in the checkpoint of the query that writes it."""
    return _bodies(spark.readStream.options(maxFilesPerTrigger=max_files, **_options(pattern)).text(folder, wholetext=True))


def _bodies(df: DataFrame) -> DataFrame:
    valid = F.try_parse_json("value").isNotNull() & (F.trim("value") != "")
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.coalesce(valid, F.lit(False)).alias("is_json"))


def goals(spark: SparkSession, folder: str, pattern: str = "*goals.json") -> DataFrame:
    """url and keyword of all goals files below ``folder``; files that are no JSON give no rows, see ``broken``."""
    return documents.goals(json_files(spark, folder, pattern).filter("is_json"))


def baselines(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """The pages of all baseline files below ``folder``, as ``documents.baseline`` gives them; files that are no JSON give no rows."""
    return documents.baseline(json_files(spark, folder, pattern).filter("is_json"))


def broken(files: DataFrame) -> DataFrame:
    """The paths of files that are no JSON."""
    return files.filter("not is_json").select("path")


def line_stream(spark: SparkSession, folder: str, pattern: str = "*.log", max_files: int = 1000) -> DataFrame:
    """value and path of the lines of new log files below ``folder``; a file is read once, so logs are rolled and not appended to."""
    lines = spark.readStream.options(maxFilesPerTrigger=max_files, **_options(pattern)).text(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def follow(stream: DataFrame, folder: str) -> DataFrame:
    """Append a stream's rows to ``folder``/rows up to its present end, and return all rows so far.

    Offsets are kept in ``folder``/offsets: called again, it takes up where it
    ended, and files that it has read add nothing. A batch that failed half way
    is written again and its first rows do not count. All executors must share
    ``folder``.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
