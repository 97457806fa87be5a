"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word
between, hashed into 2**22 places. Words are runs of letters and digits with
A-Z taken as a-z. Training keeps FTRL's two numbers for each place, which give
every coordinate its own learning rate, and L1 leaves weights only where the
evidence is steady; those few are what the driver broadcasts to score the
corpus. Texts are scored whole.

The sample to fit on is bounded: at most about ``most_rows`` labelled rows,
taken by a hash of their id out of all labelled rows that are not held out, and
of those, in hash order, as many as have ``MOST_FEATURES`` features together.
The bounds do not touch scoring. Spark sorts the sample; one task reads it in
batches, because FTRL is sequential, and keeps the places alone.

Nulls and odd rows: a null text counts as empty; an empty text scores as the
intercept alone; a very long text is hashed in parts; labels that are null,
whose id is null or without a document are not used; several labels of one id
count as their largest; a document that repeats is scored each time; an empty
table has no scores; without usable labels the intercept is -50, so every score
is nearly 0. Own columns keep their names and values: beside a column called
score the result is called score_.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftlake.llm.hashing import PLAIN_WORD, mixed, text_bytes, word_hash_parts
from siftlake.llm.text import free_name
from siftlake.session import shipped, table

PLACES_LOG2 = 22
#: The bound of the sample that the model is fitted on.
MOST_ROWS = 8000
#: The features of the sample's rows together; a row takes four bytes for each.
MOST_FEATURES = 16_000_000
#: Set by the log loss on folds of the labelled rows that are not held out.
EPOCHS, ALPHA, BETA, L1, L2 = 5, 3.0, 1.0, 10.0, 1.0
THRESHOLD = 0.3

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def features(text: np.ndarray) -> np.ndarray:
    """The sorted distinct places of a text's words, pairs and skip-pairs."""
    found, before = [np.zeros(0, np.int32)], np.zeros(0, np.uint64)
    for part in word_hash_parts(text, PLAIN_WORD):
        words, n = np.concatenate((before, part)), len(before)
        # of the two words carried over, what they make among themselves has been taken
        pairs = mixed(words[:-1] * _PRIME + words[1:] + np.uint64(2))[max(n - 1, 0) :]
        skips = mixed(words[:-2] * _PRIME + words[2:] + np.uint64(3))
        places = np.concatenate((part, pairs, skips)) >> np.uint64(64 - PLACES_LOG2)
        found.append(np.unique(places.astype(np.int32)))
        before = words[-2:]
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


def _featurise(batches):
    for batch in batches:
        rows = [features(t).tobytes() for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], ["doc_id", "toxic", "places"]
        )


def fit_ftrl(examples: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the intercept."""
    size = 1 << PLACES_LOG2
    z, n = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0.0
        if at[-1] == size:  # the intercept is not shrunk
            w[-1] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
        return w

    for _ in range(EPOCHS):
        for places, label in examples:
            at = np.append(places, size)
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - step * w
            n[at] += slope * slope
    at = np.append(np.flatnonzero(np.abs(z[:size]) > L1), size)
    w = weights(at)
    return at[:-1].astype(np.int32), w[:-1].astype(np.float32), float(w[-1])


_MODEL = "places binary, values binary, intercept double"


def _fit(most_features: int):
    def run(batches):
        examples, n = [], 0
        for batch in batches:
            for places, toxic in zip(batch.column("places"), batch.column("toxic"), strict=True):
                at = np.frombuffer(places.as_buffer(), np.int32)
                if n + len(at) <= most_features:
                    examples.append((at.copy(), float(toxic.as_py())))
                    n += len(at)
        if examples:
            places, values, intercept = fit_ftrl(examples)
            row = [pa.array([places.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary()), pa.array([intercept])]
            yield pa.RecordBatch.from_arrays(row, ["places", "values", "intercept"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES):
    """The model as (places, values, intercept), fitted on a bounded sample of the labelled rows that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most_rows / max(1, usable.count()))
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    # at most about most_rows rows of two numbers: a bounded broadcast
    sample = usable.filter(order < int(share * (1 << 30))).select(F.col("doc_id").alias("_id"), "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
    rows = shipped(texts).mapInArrow(_featurise, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, places binary")
    rows = rows.withColumn("order", order).dropDuplicates(["doc_id", "places"])
    rows = rows.coalesce(1).sortWithinPartitions("order", "doc_id", "places").select("places", "toxic")
    model = rows.mapInArrow(_fit(most_features), _MODEL).collect()
    if not model:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -50.0
    row = model[0]
    return np.frombuffer(row["places"], np.int32), np.frombuffer(row["values"], np.float32), row["intercept"]


#: This worker's last model as an array over all places, by the name that its broadcast gave it.
_dense: dict[str, np.ndarray] = {}


def score(docs: DataFrame, model, out: str = "score") -> DataFrame:
    """Add ``out`` (with underscores if a column has that name) to the documents; all their columns stay. Narrow: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))
    at, out = docs.columns.index("text"), free_name(out, docs.columns)

    def run(batches):
        name, places, values, intercept = shared.value
        if name not in _dense:
            _dense.clear()
            _dense[name] = np.zeros(1 << PLACES_LOG2, np.float32)
            _dense[name][places] = values
        weights = _dense[name]
        for batch in batches:
            sums = np.array([weights[features(t)].sum(dtype=np.float64) for t in text_bytes(batch.column(at))])
            scores = 1 / (1 + np.exp(-np.clip(sums + intercept, -700, 700)))
            fields = [*batch.schema, pa.field(out, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=pa.schema(fields))

    return shipped(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op3_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document's whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns and no other."""
    out = free_name("score", docs.columns)
    return score(docs, train(docs, labels)).filter(F.col(out) < threshold).drop(out)
