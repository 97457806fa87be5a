"""The corpus pipeline: five operators of siftlake.llm in a row over the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again as the next one's docs.
All but the last return the columns of the documents.

A stage's result must be written before the next stage is called: what a stage
has staged for itself is deleted when the next one begins, so the shared folder
never holds the intermediate tables of two stages.

Nulls and odd rows: null and empty texts are scored as such, lose no lines, have
no shingles and so are near duplicates of nothing, and are packed as one end
token each; rows without a doc_id stay to the end; very long texts go whole
through every stage; ties and repeated rows are resolved as each stage says; an
empty table gives an empty result. Other columns of the documents, whatever
their names, keep their values through all stages but the last.
"""

from __future__ import annotations

from functools import wraps
from weakref import WeakKeyDictionary

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm import lines, minhash, mixing, packing, toxicity
from siftlake.llm.text import row_hash
from siftlake.session import discard, discard_between, staged, staged_so_far, table

#: No SQL: classification, packing and tokenisation cannot be expressed in it.
ORACLE_SQL = None


#: What the last stage of each session has staged: the marks before and behind it.
_last: WeakKeyDictionary[SparkSession, tuple[list, list]] = WeakKeyDictionary()


def stage(f):
    """Delete the intermediate tables of the stage before, and note those of this one."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_between(spark, *_last.get(spark, ([], [])))
        before = staged_so_far()
        out = f(spark, docs, sf_dir)
        _last[spark] = before, staged_so_far()
        return out

    return run_stage


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated multi-line chunks."""
    return lines.without_repeated_lines(docs).select(*docs.columns)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows that repeat a doc_id and its text one stays, rows without an id all stay.

    Of texts that share a doc_id the first by hash keeps it as its key and the
    others get one of their own, after all ids that are below 2**62, so every
    text is judged by itself.
    """
    own = docs.columns
    known = docs.filter("doc_id is not null").select(F.struct(*own).alias("doc"), F.col("doc_id").alias("id"), "text", row_hash("text").alias("row_hash"))
    shared = known.groupBy("id").agg(F.min("row_hash").alias("first"), F.max("row_hash").alias("last"))
    shared = staged(shared.filter("first < last").drop("last"), "pipeline-shared-ids")
    other = F.lit(2**62) + F.pmod(F.xxhash64("id", "row_hash"), F.lit(2**62))
    key = F.when(F.col("row_hash") == F.coalesce("first", "row_hash"), F.col("id").cast("long")).otherwise(other)
    known = known.join(shared, "id", "left").select("doc", "row_hash", "text", key.alias("key"))
    kept = minhash.near_duplicates(known.select(F.col("key").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("key")).distinct()
    once = known.join(kept, "key", "left_semi")
    # of equal rows one stays; all but the first of each partition go before the shuffle
    first = Window.partitionBy("key").orderBy("row_hash")
    once = once.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*[F.col("doc").getField(c).alias(c) for c in own])
    return once.unionByName(docs.filter("doc_id is null"))


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in training order; a document appears once for each pass that takes it."""
    return mixing.mix(docs)


@stage
def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and place."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        docs = staged(f(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
