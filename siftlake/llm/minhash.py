"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of five-word shingles and 128 minima over it, in
   Arrow batches. Bands of four minima make 32 bucket keys; four low bits of
   each minimum are packed into a signature of eight longs.
2. Documents with one shingle set form a class, which its smallest id stands
   for, so exact copies never meet each other again.
3. In every bucket the smallest id is the star's centre. Signatures of a member
   and its centre are compared by bit counts; the share of equal fields,
   corrected for chance collisions, estimates the similarity, and pairs far
   below the threshold are dropped.
4. Each member's best star pair is confirmed on full shingle sets, and the
   confirmed links give first components. Buckets whose members are all in one
   component need no more work. In the others, members outside the largest
   component meet the rest in blocks of signatures alone: bit counts name the
   members of a block that have a likely pair between components. Only those
   then meet with their texts, full sets confirm the pairs, and only links that
   join two components leave a block.

No step makes all pairs of a group: copies meet only their class, near copies
their centres, and what is left meets other components.

A similarity at the threshold is found by at least one of 32 bands of four with
probability 1 - 5e-6. An estimate of 0.58 lies more than four standard
deviations below 0.75.

Nulls and odd rows: texts without words have an empty set and link with
nothing; shorter texts have one shingle, the whole sequence; very long ones are
hashed in parts, and their minima taken in pieces. A null doc_id links with
nothing, has a null component and is kept. Rows that repeat a doc_id count as
one document. Equal estimates go to the larger id. An empty table gives an empty
table. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.components import components
from siftlake.llm.hashing import mixed, shingles, text_bytes, word_hashes
from siftlake.llm.text import row_hash
from siftlake.session import discard, exploded, shipped, staged, table

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
LANES = MINIMA * BITS // 64
#: Estimates below this are not confirmed.
LEAST_ESTIMATE = 0.58
#: Members of a bucket that are compared with each other in one group.
BLOCK = 512
SHINGLE = 5

_FACTORS = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_SALTS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
SIGNATURE = [f"s{i}" for i in range(LANES)]
SCHEMA = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in SIGNATURE)


def minima(values: np.ndarray) -> np.ndarray:
    """The minima of MINIMA multiplicative hashes over a set; long sets go in pieces."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(out, (values[i : i + 1024, None] * _FACTORS).min(axis=0), out=out)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen fields to a long."""
    fields = ((least >> np.uint64(20)) & np.uint64(2**BITS - 1)).reshape(LANES, -1)
    shifts = np.arange(fields.shape[1], dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(fields << shifts, axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One bucket key for each band."""
    key = _SALTS.copy()
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key ^ column)
    return key


def _sign(batches):
    for batch in batches:
        n = batch.num_rows
        size, fp, bands, lanes = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), [], np.zeros((n, LANES), np.uint64)
        for i, text in enumerate(text_bytes(batch.column("text"))):
            grams = shingles(word_hashes(text), SHINGLE)
            size[i] = len(grams)
            if not len(grams):
                bands.append(np.zeros(0, np.int64))
                continue
            fp[i] = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
            least = minima(grams)
            bands.append(band_keys(least).view(np.int64))
            lanes[i] = packed(least)
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(fp[:, 0]), pa.array(fp[:, 1])]
        columns.append(pa.array(bands, pa.list_(pa.int64())))
        columns += [pa.array(np.ascontiguousarray(lanes[:, j]).view(np.int64)) for j in range(LANES)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fp1", "fp2", "bands", *SIGNATURE])


def signatures(docs: DataFrame) -> DataFrame:
    return shipped(docs).select("doc_id", "text").mapInArrow(_sign, SCHEMA)


def estimate(a: str, b: str) -> Column:
    """The similarity that two signatures suggest: the share of equal fields, less what chance makes equal."""
    different = None
    for s in SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        different = F.bit_count(x) if different is None else different + F.bit_count(x)
    chance = 2.0**-BITS
    return (1 - different / float(MINIMA) - chance) / (1 - chance)


def _confirm(batches):
    last = {"id": None, "grams": None}
    for batch in batches:
        keep = []
        names = batch.column("b").to_pylist()
        for i, (a, b) in enumerate(zip(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True)):
            key = (names[i], xxhash.xxh3_128_digest(b.tobytes()))
            if last["id"] != key:
                last = {"id": key, "grams": shingles(word_hashes(b), SHINGLE)}
            x, y = shingles(word_hashes(a), SHINGLE), last["grams"]
            both = len(np.intersect1d(x, y, assume_unique=True))
            either = len(x) + len(y) - both
            keep.append(both > 0 and 100 * both >= batch.column("percent")[i].as_py() * either)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["u", "v"]
        )


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity, as links (u, v)."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return shipped(both).withColumn("percent", F.lit(percent)).mapInArrow(_confirm, "u bigint, v bigint")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) of every node after more links (u, v): the links are contracted to roots first, and only those are searched."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = links.join(side("u"), "u").join(side("v"), "v").filter("root_u <> root_v")
    between = staged(between.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct(), "minhash-between")
    if between.isEmpty():
        return labels
    found = components(between)
    moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    out = staged(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "minhash-labels")
    discard(between)
    return out


def _alike(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The estimates of ``estimate`` for one signature against many."""
    bits = many ^ one
    bits |= bits >> np.uint64(1)
    bits = (bits | bits >> np.uint64(2)) & np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(bits).sum(axis=1) / MINIMA
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def _apart(rep, root, major, i, y):
    """Which of ``y`` member i meets: those of other components, each pair from one side only."""
    return (root[y] != root[i]) & ((root[y] == major) | (rep[i] > rep[y]))


def _likely(rows: dict[str, list]) -> np.ndarray:
    """The rows of a block that have a likely pair in it."""
    rep, root, side = (np.array(rows[c], np.int64) for c in ("rep", "root", "side"))
    lanes = np.array(rows["lanes"], np.int64).view(np.uint64)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    keep = np.zeros(len(rep), bool)
    for i in x:
        near = y[_apart(rep, root, rows["major"][0], i, y)]
        near = near[_alike(lanes[near], lanes[i]) >= LEAST_ESTIMATE]
        keep[near] = True
        keep[i] = len(near) > 0
    return np.flatnonzero(keep)


def _block_links(rows: dict[str, list], percent: int) -> list[tuple[int, int]]:
    """Confirmed links between members of one block that join components still apart; at most one less than its members."""
    rep, root, side = (np.array(rows[c], np.int64) for c in ("rep", "root", "side"))
    lanes = np.array(rows["lanes"], np.int64).view(np.uint64)
    bands = np.array(rows["bands"], np.int64)
    major, number = rows["major"][0], rows["number"][0]
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    parent = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    sets: dict[int, np.ndarray] = {}

    def grams(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(word_hashes(np.frombuffer(rows["text"][i].encode(), np.uint8)), SHINGLE)
        return sets[i]

    links = []
    for i in x:
        near = y[_apart(rep, root, major, i, y)]
        # a pair is taken up in the first band that it shares
        near = near[np.argmax(bands[near] == bands[i], axis=1) == number] if len(near) else near
        if not len(near):
            continue
        alike = _alike(lanes[near], lanes[i])
        order = np.argsort(-alike, kind="stable")
        near = near[order][alike[order] >= LEAST_ESTIMATE]
        for part in np.array_split(near, -(-len(near) // 64)) if len(near) else ():
            part = [j for j in part if find(int(root[j])) != find(int(root[i]))]
            if not part:
                continue
            mine, others = grams(i), [grams(j) for j in part]
            flat = np.concatenate(others)
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            sizes = np.array([len(o) for o in others])
            both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for j, n, size in zip(part, both.tolist(), sizes.tolist(), strict=True):
                a, b = find(int(root[i])), find(int(root[j]))
                if a != b and n and 100 * n >= percent * (len(mine) + size - n):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(rep[i]), int(rep[j])))
    return links


_PLACE = ("band", "i", "j")
_MEMBER = (*_PLACE, "side", "rep", "root", "major", "number")
_MEMBERS = "band bigint, i int, j int, side int, rep bigint, root bigint, major bigint, number int"


def _blocks(batches, *columns: str):
    """The rows of one block after another, as lists by column, from batches sorted by block."""
    key, held = None, {c: [] for c in (*_MEMBER, *columns, "lanes")}
    for batch in batches:
        plain = {c: batch.column(c).to_pylist() for c in (*_MEMBER, *columns)}
        lanes = list(zip(*(batch.column(s).to_pylist() for s in SIGNATURE), strict=True))
        for n, now in enumerate(zip(*(plain[c] for c in _PLACE), strict=True)):
            if now != key:
                if held["rep"]:
                    yield held
                key, held = now, {c: [] for c in held}
            for c, values in plain.items():
                held[c].append(values[n])
            held["lanes"].append(lanes[n])
    if held["rep"]:
        yield held


def _screen(batches):
    schema = pa.schema([(c, pa.int32() if c in ("i", "j", "side", "number") else pa.int64()) for c in _MEMBER])
    for block in _blocks(batches):
        at = _likely(block)
        yield pa.RecordBatch.from_arrays([pa.array([block[f.name][n] for n in at], f.type) for f in schema], schema=schema)


def _compare(percent: int):
    def run(batches):
        for block in _blocks(batches, "bands", "text"):
            links = _block_links(block, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def links_between(members: DataFrame, labels: DataFrame, lanes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) between members of one bucket in different components.

    In every bucket the members outside its largest component meet all others.
    Both sides are dealt into blocks of BLOCK members; a block's signatures come
    one after another to a task, which gives out the members that have a likely
    pair, at most those it got. They meet again by block, with their texts, and
    only links that join components leave. A bucket whose members are in one
    component makes no rows at all.
    """
    labelled = members.select("rep", "band", "number").join(labels.withColumnRenamed("node", "rep"), "rep")
    parts = labelled.groupBy("band", "root").agg(F.count("*").alias("n"))
    parts = parts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("roots"))
    parts = parts.filter("roots > 1").select("band", F.col("m.root").alias("major"), "all", (F.col("all") - F.col("m.n")).alias("rest"))
    rows = labelled.join(parts, "band").join(lanes.drop("bands"), "rep")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("rep"), blocks(c)).cast("int")
    spread = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    as_x = F.when(F.col("root") != F.col("major"), F.transform(spread("all"), lambda j: place(mine("rest"), j, 0)))
    as_y = F.transform(spread("rest"), lambda i: place(i, mine("all"), 1))
    places = F.concat(F.coalesce(as_x, F.array().cast("array<struct<i:int,j:int,side:int>>")), as_y)
    rows = exploded(rows, places, "_p", "band", "rep", "root", "major", "number", *SIGNATURE)
    rows = rows.select("*", "_p.i", "_p.j", "_p.side").drop("_p")
    in_blocks = lambda df: shipped(df.repartition(*_PLACE).sortWithinPartitions(*_PLACE))
    likely = staged(in_blocks(rows).mapInArrow(_screen, _MEMBERS), "minhash-likely")
    with_texts = likely.join(lanes, "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    return in_blocks(with_texts).mapInArrow(_compare(percent), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    signed = staged(signatures(docs), "minhash-signed")
    live = signed.filter("n_shingles > 0 and doc_id is not null")
    same_set = ["fp1", "fp2", "n_shingles"]
    classes = live.groupBy(*same_set).agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in SIGNATURE]
    )
    classes = staged(classes, "minhash-classes")
    lanes = classes.select("rep", "bands", *SIGNATURE)
    in_bands = classes.select("rep", F.posexplode("bands").alias("number", "band"))
    buckets = in_bands.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # written first, so that the join is between two shuffles, which adaptive execution may split at hot keys
    buckets = staged(buckets, "minhash-buckets")
    members = staged(in_bands.join(buckets, "band"), "minhash-members")
    discard(buckets)

    # texts of the members of any shared bucket; other texts are not read again
    taking_part = staged(members.select(F.col("rep").alias("doc_id")).distinct(), "minhash-nodes")
    texts = docs.select("doc_id", "text").join(taking_part, "doc_id", "left_semi")
    texts = staged(texts.withColumn("_h", row_hash("text")).dropDuplicates(["doc_id", "_h"]).drop("_h"), "minhash-texts")

    stars = members.filter("rep > centre").select("rep", "centre").distinct()
    stars = (
        stars.join(lanes.alias("x"), stars["rep"] == F.col("x.rep"))
        .join(lanes.alias("y"), F.col("centre") == F.col("y.rep"))
        .select(stars["rep"].alias("a"), F.col("centre").alias("b"), estimate("x", "y").alias("estimate"))
        .filter(F.col("estimate") >= LEAST_ESTIMATE)
    )
    best = lambda pairs: pairs.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    labels = taking_part.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"))
    links = staged(confirm(best(stars), texts, percent), "minhash-links")
    labels = relabelled(labels, links)

    # what the stars have left apart
    more = staged(links_between(members, labels, lanes, texts, percent), "minhash-links")
    labels = staged(relabelled(labels, more), "minhash-roots")
    discard(members, taking_part, texts, links, more)

    by_set = live.join(classes.select(*same_set, "rep"), same_set).select("doc_id", "rep")
    linked = by_set.join(labels, by_set["rep"] == labels["node"], "left")
    linked = linked.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    component = F.coalesce("component_id", signed["doc_id"])
    return signed.join(linked, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(signed["doc_id"] == component, F.lit(True)).alias("kept"),
    )


def op8_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
g as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as s
    from d)
),
n as (select doc_id, count(*)::bigint as n from g group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
l as (
  select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * shared >= 75 * (x.n + y.n - shared)
),
e as (select a as u, b as v from l union all select b, a from l),
r as (
  with recursive t(node, reach) as (
    select doc_id, doc_id from documents
    union
    select t.node, e.v from t join e on t.reach = e.u
  )
  select node, min(reach) as root from t group by node
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.root as component_id, d.doc_id = r.root as kept
from d left join n using (doc_id) join r on d.doc_id = r.node
"""
