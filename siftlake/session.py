"""Session and storage helpers that every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; the folder may be any URI Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """The same DataFrame, with this package sent to the Python workers of its session once."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="siftlake-"), "siftlake.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("siftlake", os.path.relpath(path, top)))
        sc.addPyFile(archive)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage without tying the rows to the executors that made
    them, so a lost executor costs no recomputation of earlier stages. The
    files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((sc_id := spark.sparkContext.applicationId, path))
    out.staged_at = (sc_id, path)
    return out


#: Staged tables that are still there: (application, path), in the order written.
_written: list[tuple[str, str]] = []


def _delete(spark: SparkSession, entries: list[tuple[str, str]]) -> None:
    for entry in entries:
        if entry in _written:
            _written.remove(entry)
            if entry[0] == spark.sparkContext.applicationId:
                at = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose readers have all been written."""
    for df in tables:
        _delete(df.sparkSession, [df.staged_at])


def staged_so_far() -> list[tuple[str, str]]:
    """A mark: what has been staged and not deleted."""
    return list(_written)


def discard_between(spark: SparkSession, mark: list[tuple[str, str]], until: list[tuple[str, str]] | None = None) -> None:
    """Delete what was staged after ``mark`` and, if given, before ``until`` was taken; its readers must have been written."""
    _delete(spark, [entry for entry in (list(_written) if until is None else until) if entry not in mark])


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt by their keys over several parts for each core.

    For narrow work that costs far more than moving its rows. A scan has no
    more tasks than its files have row groups, however many cores are free; and
    what is dealt by one key meets by it again without being moved.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def exploded(df: DataFrame, array: Column | str, name: str, *keys: str) -> DataFrame:
    """``keys`` and one row for each element of ``array``, as ``name``.

    An inner explode makes the optimizer filter on the array's size and push
    that below the projection that computes the array, which is then computed
    twice. The outer form is not rewritten so; empty arrays' rows go afterwards.
    """
    return df.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
