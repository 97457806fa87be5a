"""Exact top-k inner products over quantised vectors, score at a time.

The vectors are dealt into blocks of a bounded number. For each block an
impact-ordered index is built once: one posting list for each dimension, cut
into segments of one quantised level. For a query the segments of all dimensions
are taken by descending impact, the query's component times the segment's largest
magnitude. Each segment adds its exact contributions to the block's scores. A
vector that still misses m dimensions can gain or lose m times the next impact
at most; when the k-th best score that is certain exceeds what all others can
reach, or few possible members are left, processing stops and the possible
members are scored exactly. Nothing is dropped without that proof.

A block's vectors come to one task, sorted before the queries, which follow in
packs and are taken one after another; so a vector is shuffled once and a query
once for each block. Blocks of few vectors, and components so large that a sum
would not be exact as a double, are scored without the index, with the same
results. Each block gives its k best, and a query's best of all blocks are
ranked at the end.

Nulls and odd rows: a vector takes no part if it is null, has a null, NaN or
infinite component, or has no id; an empty vector meets those without
components with score 0; very long ones only make their block larger. Vectors
meet those of their own length. Rows that repeat an id and a vector count once;
ties go to the smaller id; a query never meets its own id; an empty table gives
no rows. Scores are 64-bit integers: components beyond 2**25 may overflow them.
Only vec_id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import shipped, staged, table

K, EVERY, SCALE = 5, 50, 256
#: Vectors of a block, queries of a pack, levels of a dimension on each side of zero, parts in which postings are taken.
BLOCK, BATCH, LEVELS, PARTS = 8192, 512, 8, 10


def quantised(embedding: str, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: str) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))


class ImpactIndex:
    """Postings of one block, cut into segments by dimension and quantised level."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, d = vectors.shape
        step = np.maximum(1, -(-np.abs(vectors).max(axis=0, initial=0) // levels))
        order = np.argsort(vectors, axis=0, kind="stable")
        values = np.take_along_axis(vectors, order, axis=0)
        self.ids = order.T.ravel()
        self.values = values.T.ravel().astype(np.float64)
        level = (values // step).T + (np.arange(d) * (4 * levels))[:, None]
        cuts = np.flatnonzero(np.diff(level.ravel(), prepend=level.ravel()[0] - 1 if n * d else 0))
        self.start = cuts
        self.end = np.append(cuts[1:], n * d)
        self.dim = cuts // max(n, 1)
        ends = np.maximum(np.abs(self.values[self.start]), np.abs(self.values[self.end - 1])) if n * d else np.zeros(0)
        self.largest = ends

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, the k best surely among them, and their exact scores."""
        n, d = self.vectors.shape
        members = np.arange(n)
        base = 1 << (d + 1).bit_length()
        if n > 4 * k and d and np.abs(query).max() * float(self.largest.max()) * d * base < 2**52:
            members = self._possible(query, k, base)
        return members, self.vectors[members] @ query

    def _possible(self, query: np.ndarray, k: int, base: int) -> np.ndarray:
        n, d = self.vectors.shape
        impact = np.abs(query[self.dim]) * self.largest
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum((self.end - self.start)[order])
        total, sums, at = int(done[-1]), np.zeros(n), 0
        for part in range(3, PARTS + 1):
            to = int(np.searchsorted(done, total * part // PARTS)) + 1
            # segments that lie beside each other are read as one slice
            chosen = np.sort(order[at:to])
            if len(chosen):
                first = np.flatnonzero(np.diff(chosen, prepend=-2) != 1)
                last = np.append(first[1:], len(chosen)) - 1
                spans = [slice(a, b) for a, b in zip(self.start[chosen[first]].tolist(), self.end[chosen[last]].tolist(), strict=True)]
                factors = np.repeat(query[self.dim[chosen]] * float(base), self.end[chosen] - self.start[chosen])
                # one sum carries the score and, below it, the number of dimensions seen
                factors *= np.concatenate([self.values[x] for x in spans])
                factors += 1.0
                sums += np.bincount(np.concatenate([self.ids[x] for x in spans]), weights=factors, minlength=n)
            at = to
            seen = np.mod(sums, base)
            score = (sums - seen) / base
            slack = (d - seen) * (impact[order[to]] if to < len(order) else 0.0)
            sure = np.partition(score - slack, n - k)[n - k]
            members = np.flatnonzero(score + slack >= sure)
            if len(members) <= max(4 * k, n // 32) or to >= len(order):
                return members
        return members


_FOUND = "query_id long, vec_id long, score long"


def _best_of_block(index: ImpactIndex, ids: np.ndarray, query_id: int, query: np.ndarray, k: int):
    members, scores = index.best(query, k + int(np.searchsorted(ids, query_id, "right") - np.searchsorted(ids, query_id)))
    other = ids[members] != query_id
    members, scores = members[other], scores[other]
    top = np.lexsort((ids[members], -scores))[:k]
    return ids[members][top], scores[top]


def _search(k: int):
    """From rows sorted by (d, block, is_query): a block's vectors, then its queries."""

    def run(batches):
        key, ids, vectors, index = None, [], [], None
        for batch in batches:
            out = {"query_id": [], "vec_id": [], "score": []}
            packs = (batch.column(c).to_pylist() for c in ("d", "block", "is_query", "ids"))
            values = batch.column("values")
            for n, (d, block, is_query, own) in enumerate(zip(*packs, strict=True)):
                if (d, block) != key:
                    key, ids, vectors, index = (d, block), [], [], None
                matrix = np.array(values[n].values, np.int64).reshape(len(own), d)
                if not is_query:
                    ids += own
                    vectors.append(matrix)
                    continue
                if not len(ids):
                    continue
                if index is None:
                    order = np.argsort(ids, kind="stable")
                    ids = np.array(ids, np.int64)[order]
                    index = ImpactIndex(np.concatenate(vectors)[order])
                    vectors = []
                for query_id, query in zip(own, matrix, strict=True):
                    found, scores = _best_of_block(index, ids, query_id, query, k)
                    out["query_id"] += [query_id] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += scores.tolist()
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = K, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, q) where ``queries`` holds, against all rows."""
    rows = staged(vectors.withColumn("d", F.size("q")).dropDuplicates(["vec_id", "q"]), "vectors")
    asked = rows.filter(queries)
    blocks = max(1, -(-rows.count() // block))
    packs = max(1, -(-asked.count() // batch))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = rows.select("d", part(blocks, 1).alias("block"), F.lit(0).alias("is_query"), F.array("vec_id").alias("ids"), F.col("q").alias("values"))
    packed = asked.groupBy("d", part(packs, 2).alias("_pack")).agg(F.collect_list(F.struct("vec_id", "q")).alias("_rows"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    right = packed.select(
        "d", every.alias("block"), F.lit(1).alias("is_query"), F.col("_rows.vec_id").alias("ids"), F.flatten("_rows.q").alias("values")
    )
    keys = ["d", "block"]
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "is_query")
    found = shipped(dealt).mapInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_impact_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").filter(usable("embedding") & F.col("vec_id").isNotNull())
    return top_k(vectors.select("vec_id", quantised("embedding").alias("q")), F.col("vec_id") % EVERY == 0)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
x as (select vec_id, generate_subscripts(q, 1) as d, unnest(q) as c from v),
s as (
  select a.vec_id as query_id, b.vec_id, sum(a.c * b.c)::bigint as score
  from x a join x b on a.d = b.d and a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by 1, 2
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
