"""Tables of a database, read in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, name: str, column: str, parts: int, **options: str) -> DataFrame:
    """A database table as ``parts`` ranges of ``column``, a number, date or timestamp, each read by a query of its own.

    The ends of the ranges come from one query for the column's least and
    greatest value, which an index answers; rows outside of them or with a null
    are in the first and last range. Filters and the choice of columns that
    follow are sent to the database. An empty table, or one whose column holds
    nulls only, is read in one part. ``options`` are those of Spark's jdbc
    source (user, password, driver, fetchsize and so on).
    """
    if parts < 1:
        raise ValueError("parts must be 1 or more")
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    source = spark.read.format("jdbc").options(url=url, **options)
    ends = source.option("query", f"select min({quoted}) as lo, max({quoted}) as hi from {name}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if ends[0] is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts))
    return reader.load()
