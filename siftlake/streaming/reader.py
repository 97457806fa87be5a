"""What readers of a live event feed show: a state for each reader, kept over batches.

Progress replaces what a reader is working on, pages add up, done or error
closes. The greatest ordinal decides, so batches may come in any order. The
state of a reader is one small row in the store, whatever its feed's length, and
a reader's events of one batch are folded as they stream by. A reader that is
idle for ``ttl_ms`` is forgotten; if it comes back it starts anew.

Odd rows: events of other types, those without an ordinal and progress without a url change nothing but make the reader known;
a null reader is a reader; of equal ordinals the greater url or type counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from siftlake.session import shipped

_STATE = "progress long, working_on string, pages long, closed long, status string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(state: tuple, rows: Iterator) -> tuple:
    """The state after events of (type, ordinal, url)."""
    progress, working_on, pages, closed, status = state
    for row in rows:
        if row["ordinal"] is None:
            continue
        if row["type"] == "page":
            pages += 1
        elif row["type"] == "progress" and row["url"] is not None and (progress is None or (row["ordinal"], row["url"]) > (progress, working_on)):
            progress, working_on = row["ordinal"], row["url"]
        elif row["type"] in ("done", "error") and (closed is None or (row["ordinal"], row["type"]) > (closed, status)):
            closed, status = row["ordinal"], row["type"]
    return progress, working_on, pages, closed, status


class Shown(StatefulProcessor):
    """Keeps a reader's state and gives out what it shows after every batch that has events of it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("shown", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else (None, None, 0, None, "running")
        state = folded(state, rows)
        self.state.update(state)
        yield Row(reader=key[0], working_on=state[1], pages=state[2], status=state[4])

    def close(self) -> None:
        pass


def shown(events: DataFrame, reader: str, ttl_ms: int | None = None) -> DataFrame:
    """reader, working_on, pages and status after each batch, from a stream of (reader, type, ordinal, url); needs the RocksDB store."""
    kind = dict(events.dtypes)[reader]
    rows = events.select(F.col(reader).alias("reader"), "type", F.col("ordinal").cast("long").alias("ordinal"), "url")
    schema = StructType.fromDDL(f"reader {kind}, working_on string, pages long, status string")
    mode = "ProcessingTime" if ttl_ms else "None"
    return shipped(rows).groupBy("reader").transformWithState(Shown(ttl_ms), schema, "Update", mode)


def _put(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/shown/batch={batch_id}")


def run_readers(events: DataFrame, reader: str, path: str, ttl_ms: int | None = None) -> DataFrame:
    """Follow the stream to its end and return what each reader shows then.

    Batches write folders by their id, so one that is run again adds nothing;
    started again with the same ``path``, the stream goes on behind what was read.
    """
    spark = events.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    out = shown(events, reader, ttl_ms)
    try:
        writer = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        query = writer.foreachBatch(lambda batch, batch_id: _put(batch, batch_id, path)).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.set(_STORE, before)
    rows = spark.read.schema(f"{out.schema.toDDL()}, batch long").parquet(f"{path}/shown*")
    last = rows.groupBy("reader").agg(F.max_by(F.struct("working_on", "pages", "status"), "batch").alias("s"))
    return last.select(F.col("reader").alias(reader), "s.*")
