"""A Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf, the SHA-256 of its fields. Leaves are ranked within their
tree (a source); a node is labelled with the interval of leaf ranks that it
covers and hashes up to ``ARITY`` nodes that follow each other. Because labels
nest, no node stores a parent or a sibling: the ancestor of a node at a level is
the one in the level's bucket of its rank whose interval contains it, and its
siblings are the parts of the parent's interval to the left and to the right of
its own. Trees' roots are the leaves of one more tree, in the order of their
names, whose root stands for the dataset.

Texts are hashed where they are read and never shuffled; only digests travel.
Ranks come from a range sort with a last key that tells equal rows apart, so a
tree with a third of all rows is spread over many tasks, and from counts by
partition and tree. Each level groups by tree and bucket, 16 rows a group; the
levels are as many as the largest tree is high. Proofs are attached from the
root down: a run of children meets its parent's proof in one equi-join on tree
and bucket with a containment test, so a proof travels once for 16 leaves.

Nulls and odd rows: a null field is hashed as '-', so it differs from an empty
text; a null tree is one tree, before all others; a null order key comes first;
ties in it go by digest, and rows that repeat are leaves side by side; a row
alone in its tree is its root, and alone in the dataset its proof is of no
siblings; a very long text is hashed as one value; an empty table has no rows
and no root. Only the fields, tree and order key are read, so other columns
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import exploded, staged, table

#: Nodes under one parent.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    """The SHA-256 of texts one after another, as lower-case hex text."""
    return F.sha2(F.concat(*parts), 256)


def encoded(x: Column) -> Column:
    """A field as its UTF-8 length, a colon and its value; '-' for null."""
    s = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """The digest of a row; ``changed`` has other values for some fields."""
    return hashed(*[encoded(changed.get(f, F.col(f))) for f in fields])


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda k: k["digest"]), "")


def _height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def ranked(leaves: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """leaves(tree, digest, ...) with lo (rank in its tree), hi = lo + 1 and n (leaves of the tree), and the largest n; trees and keys ascend, nulls first."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "digest", "_tie")]
    df = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    df = staged(df.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "manifest-leaves")
    parts = df.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy("tree")))
    parts = staged(parts.drop("_n"), "manifest-parts")
    most = parts.agg(F.max("n")).first()[0] or 0
    df = df.join(parts, ["tree", "_part"]).withColumn("lo", F.col("_before") + F.col("_at") - F.col("_first"))
    return df.withColumn("hi", F.col("lo") + 1).drop("_part", "_at", "_first", "_before"), most


@dataclass
class Forest:
    """Trees over ranked leaves: ``runs[level]`` has a row (tree, bucket, lo, hi, digest, n, kids) for each node above that level, kids being its children."""

    leaves: DataFrame
    runs: list[DataFrame]

    def at(self, level: int) -> DataFrame:
        """The nodes of a level: tree, lo, hi, digest and n, the tree's nodes at that level."""
        return (self.runs[level - 1] if level else self.leaves).select("tree", "lo", "hi", "digest", "n")

    def nodes(self) -> DataFrame:
        """All nodes with their level."""
        out = self.at(0).withColumn("level", F.lit(0))
        for level in range(1, len(self.runs) + 1):
            out = out.unionByName(self.at(level).withColumn("level", F.lit(level)))
        return out.select("tree", "level", "lo", "hi", "digest")

    def roots(self) -> DataFrame:
        """tree, level, lo, hi and digest of each tree's root."""
        out = None
        for level in range(len(self.runs) + 1):
            top = self.at(level).filter("n = 1").select("tree", F.lit(level).alias("level"), "lo", "hi", "digest")
            out = top if out is None else out.unionByName(top)
        return out


def forest(leaves: DataFrame, *order: str, carried: tuple[str, ...] = ()) -> Forest:
    """The trees over leaves(tree, digest, order keys, carried); a leaf keeps its ``carried`` columns among its parent's kids."""
    leaves, most = ranked(leaves, *order)
    # the many jobs of the levels read the ranks as written
    leaves = staged(leaves, "manifest-ranked")
    runs, now = [], leaves
    for level in range(_height(most)):
        kid = F.struct("lo", "hi", "digest", *(carried if level == 0 else ()))
        bucket = F.floor(F.col("lo") / F.lit(ARITY ** (level + 1))).cast("long").alias("bucket")
        now = now.filter("n > 1").groupBy("tree", bucket)
        now = now.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.ceil(F.first("n") / F.lit(ARITY)).cast("long").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
        now = staged(now.withColumn("digest", hashed(_joined(F.col("kids")))), f"manifest-level-{level + 1}")
        runs.append(now)
    return Forest(leaves, runs)


def siblings(kids: str | Column, kid: Column) -> Column:
    """(left, right): the digests of what the parent's interval has before and after the kid's."""
    left = F.filter(kids, lambda x: x["hi"] <= kid["lo"])
    right = F.filter(kids, lambda x: x["lo"] >= kid["hi"])
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def proofs(trees: Forest, tops: DataFrame, *carried: str) -> DataFrame:
    """Every leaf's carried columns, digest, the columns of its tree's row in ``tops`` and proof: (left, right) for each level, from the leaf up.

    ``tops`` has a row for each root: tree, level, lo, hi, proof (what lies above the root) and any other columns.
    """
    more = [c for c in tops.columns if c not in ("tree", "level", "lo", "hi", "proof")]
    top = lambda level: tops.filter(F.col("level") == level).select("tree", "lo", "hi", "proof", *more)
    above = top(len(trees.runs))
    for level in reversed(range(len(trees.runs))):
        up = above.select(F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "proof", *more)
        inside = (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.floor(F.col("_lo") / F.lit(ARITY ** (level + 1))).cast("long"))
        met = trees.runs[level].join(up, inside & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
        fields = ("lo", "hi", *(("digest", *carried) if level == 0 else ()))
        step = lambda k: F.struct(*[k[f].alias(f) for f in fields], F.concat(F.array(siblings("kids", k)), F.col("proof")).alias("proof"))
        rows = exploded(met, F.transform("kids", step), "_k", "tree", *more).select("tree", *more, "_k.*")
        if level:
            above = rows.unionByName(top(level))
        else:
            below = rows.select(*carried, "digest", *more, "proof")
    alone = trees.leaves.filter("n = 1").select(F.col("tree").alias("_tree"), *carried, "digest")
    alone = alone.join(top(0), F.col("tree") == F.col("_tree")).select(*carried, "digest", *more, "proof")
    return below.unionByName(alone) if trees.runs else alone


def folded(digest: Column, proof: str | Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda d, s: hashed(s["left"], d, s["right"]))


def proof_digest(proof: str | Column) -> Column:
    """The SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass
class Manifest:
    """A dataset's trees, the tree over their roots, and its root (None without rows)."""

    trees: Forest
    over: Forest
    root: str | None

    def proofs(self, *carried: str) -> DataFrame:
        """For each leaf its carried columns, digest, subroot and proof up to the root."""
        one = self.over.roots().drop("digest").withColumn("proof", F.array().cast("array<struct<left:string,right:string>>"))
        tops = proofs(self.over, one, *_TOP)
        tops = tops.select(F.col("name").alias("tree"), *[F.col(f"top_{c}").alias(c) for c in ("level", "lo", "hi")], F.col("digest").alias("subroot"), "proof")
        return proofs(self.trees, staged(tops, "manifest-tops"), *carried)


#: What a subroot carries as a leaf of the tree over all roots.
_TOP = ("name", "top_level", "top_lo", "top_hi")


def manifest(rows: DataFrame, *order: str, carried: tuple[str, ...] = ()) -> Manifest:
    """The manifest of rows(tree, digest, order keys, carried); trees are ordered by name, null first."""
    # so that joins need no null-safe test: no name sorts before all others
    named = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    # written, so that the range sort's sample does not hash the texts once more
    trees = forest(staged(rows.withColumn("tree", named), "manifest-digests"), *order, carried=carried)
    tops = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), *[F.col(c).alias(f"top_{c}") for c in ("level", "lo", "hi")], "digest")
    over = forest(tops, "name", carried=_TOP)
    root = over.roots().first()
    return Manifest(trees, over, root and root["digest"])


def op12_interval_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that a tampered copy leads to."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(text=F.translate("text", upper, lower)))
    rows = docs.select(F.col("source").alias("tree"), "doc_id", leaf().alias("digest"), tampered.alias("tampered"))
    made = manifest(rows, "doc_id", carried=("doc_id", "tampered"))
    root = F.lit(made.root).cast("string")
    df = made.proofs("doc_id", "tampered")
    df = df.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), "proof"))
    return df.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


OP12_SQL = r"""
with recursive t as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t from range(256) x(i)
),
d as (
  select documents.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 as bad
  from documents, t
),
e as (
  select doc_id, source, bad, text,
    case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
    || case when source is null then '-' else strlen(source) || ':' || source end
    || case when lang is null then '-' else strlen(lang) || ':' || lang end
    || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end as head
  from d
),
l as (
  select doc_id, source, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
    case when bad then sha256(head || case when text is null then '-'
      else strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end) end as other,
    row_number() over (partition by source order by doc_id nulls first) - 1 as i
  from e
),
n(tree, level, i, digest, cnt) as (
  select source, 0, i, leaf, count(*) over (partition by source) from l
  union all
  select tree, level + 1, i // 16, sha256(string_agg(digest, '' order by i)), max((cnt + 15) // 16) from n where cnt > 1 group by tree, level, i // 16
),
s as (select tree, digest, row_number() over (order by tree nulls first) - 1 as i from n where cnt = 1),
m(level, i, digest, cnt) as (
  select 0, i, digest, count(*) over () from s
  union all
  select level + 1, i // 16, sha256(string_agg(digest, '' order by i)), max((cnt + 15) // 16) from m where cnt > 1 group by level, i // 16
),
k as (select tree, level, i // 16 as p, list(digest order by i) as kids from n where cnt > 1 group by all),
q as (select level, i // 16 as p, list(digest order by i) as kids from m where cnt > 1 group by all),
f(doc_id, tree, level, i, acc, proof) as (
  select doc_id, source, 0, i, coalesce(other, leaf), '' from l
  union all
  select doc_id, f.tree, f.level + 1, f.i // 16,
    sha256(array_to_string(list_slice(kids, 1, f.i % 16), '') || acc || array_to_string(list_slice(kids, f.i % 16 + 2, 16), '')),
    proof || array_to_string(list_slice(kids, 1, f.i % 16), '') || array_to_string(list_slice(kids, f.i % 16 + 2, 16), '')
  from f join k on k.tree is not distinct from f.tree and k.level = f.level and k.p = f.i // 16
),
g(doc_id, level, i, acc, proof) as (
  select doc_id, 0, s.i, acc, proof from (select *, row_number() over (partition by doc_id order by level desc) as nth from f) x
  join s on s.tree is not distinct from x.tree where nth = 1
  union all
  select doc_id, g.level + 1, g.i // 16,
    sha256(array_to_string(list_slice(kids, 1, g.i % 16), '') || acc || array_to_string(list_slice(kids, g.i % 16 + 2, 16), '')),
    proof || array_to_string(list_slice(kids, 1, g.i % 16), '') || array_to_string(list_slice(kids, g.i % 16 + 2, 16), '')
  from g join q on q.level = g.level and q.p = g.i // 16
),
r as (select digest as root from m where cnt = 1)
select l.doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified
from l join s on s.tree is not distinct from l.source
join (select *, row_number() over (partition by doc_id order by level desc) as nth from g) x on x.doc_id = l.doc_id and nth = 1, r
"""
