"""Own columns that have the results' names keep their names and values in every operator; odd rows and empty tables give defined results."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftlake.llm import chats, lines, minhash, mixing, packing, quality, sharding, substrings, toxicity
from tests.llm.helpers import odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")
NAMES = ["n_removed", "removed", "score", "size", "order", "n_words", "clean_text", "lost_share", "kept", "base_failed", "component_id", "sequence_id", "offset", "item", "_doc_id", "_m", "own", "hash", "k", "shard", "grown", "slot", "_row", "_bucket", "_before", "_n", "_shard"]


def clashing(spark):
    """Odd rows with a column for each name that a result or an inner column has."""
    return odd_docs(spark).select("*", *[F.lit(f"mine {c}").alias(c) for c in NAMES])


NO_MODEL = np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
KEEPING = {
    "lines": (lines.without_repeated_lines, ["n_removed_"]),
    "substrings": (substrings.without_repeats, ["n_removed_", "removed_"]),
    "quality": (quality.quality, ["n_words_", "base_failed_", "clean_text_", "lost_share_", "kept_", "n_dup_lines"]),
    "toxicity": (lambda d: toxicity.score(d, NO_MODEL), ["score_"]),
    "mixing": (mixing.mix, []),
    "sharding": (lambda d: sharding.assign_slots(sharding.assign_shards(d, "doc_id", 7, grown="grown"), "shard_", ["doc_id", "text"]), ["shard_", "grown_", "slot_"]),
}


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_own_columns_stay(spark, name):
    run, results = KEEPING[name]
    df = clashing(spark)
    out = run(df)
    assert out.columns[: len(df.columns)] == df.columns and set(results) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in NAMES)
    assert name == "mixing" or len(rows) == 10
    assert run(df.limit(0)).count() == 0


def test_readers_of_id_and_text_take_no_notice(spark):
    df = clashing(spark)
    assert minhash.near_duplicates(df).count() == 10 and packing.pack_documents(df, PATH).count() >= 10


def test_messages_keep_their_columns(spark):
    names = ["parent_turn", "root_turn", "depth", "n_quotes", "n_unlinked", "reply_pos", "chat_text", "_m", "own", "path", "_row", "_role"]
    rows = [(1, 0, "user", "One two three."), (1, 1, "user", "> One two three.\nFour."), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", *[F.lit(f"mine {c}").alias(c) for c in names])
    out = chats.conversations(df)
    assert out.columns == [*df.columns, "parent_turn_", "root_turn_", "depth_", "n_quotes_", "n_unlinked_", "reply_pos_", "chat_text_"]
    found = {r["turn"]: r for r in out.collect()}
    assert found[1]["parent_turn_"] == 0 and found[1]["text"] == "Four." and found[None]["text"] is None
    assert all(r[c] == f"mine {c}" for r in found.values() for c in names) and chats.conversations(df.limit(0)).count() == 0
