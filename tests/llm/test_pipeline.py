from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import catalogue
from siftlake.session import staged, table
from tests.llm.helpers import DOCS, odd_docs, words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]


def test_texts_that_share_an_id_are_judged_by_themselves(spark):
    a, b, c, d = (words(80, seed) for seed in (1, 2, 3, 4))
    texts = [(5, a), (5, b), (5, c), (5, a), (6, d), (7, d + " more"), (8, b), (None, a), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert sorted({t for i, t in got if i}) == sorted([a, b, c, d, ""]) and len(got) == 7
    assert [i for i, t in got if t == a] == [0, 5] and (5, c) in got and (6, d) in got and [t for i, t in got if i == 9] == ["", ""]


def test_stages_keep_columns_of_any_name_and_take_odd_rows(spark):
    names = ["_first", "_last", "_nth", "_key", "_row_hash", "doc", "id", "key", "first", "row_hash", "score", "n_removed", "hash", "_lines"]
    odd = odd_docs(spark).select("*", *[F.lit(f"mine {c}").alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, odd, SF), "test")
        rows = out.collect()
        assert out.columns == odd.columns and rows and all(r[c] == f"mine {c}" for r in rows for c in names)
        assert staged(stage(spark, odd.limit(0), SF), "test").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in odd.collect()}


def test_run_packs_what_the_mix_takes(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 50 and out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_every_operator_is_registered():
    names = catalogue.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(catalogue.oracle_sql()) <= set(names)
