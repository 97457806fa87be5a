"""Sharding by jump consistent hashing, in DataFrame functions only.

The key's shard is found by jumping ahead over shard numbers: from shard b the
next jump lands on floor((b + 1) / u) for the key's next pseudo-random u in
(0, 1], until it passes the number of shards. No ring table is kept, and with
one shard more a key either stays or moves into the new shard. The random
numbers are the leading 32 bits of md5(key ':' step), so that any engine and
language can compute the same placement.

Nulls and odd rows: a null key counts as the empty string; a null text as
empty; a very long text only counts by its bytes; rows that repeat a key share
its shard and get slots of their own; rows with equal keys and equal order
columns may take each other's slots; an empty table gives an empty table. Own
columns keep their names and values; a result whose name is taken carries an
underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.text import free_name, whole
from siftlake.session import staged, table

#: A key jumps about ln(shards) + 0.6 times; more than this many jumps has a chance below 1e-40 even for 2**30 shards.
MOST_JUMPS = 128


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a string key, an int from 0 to shards - 1."""
    if not 1 <= shards <= 2**30:
        raise ValueError("shards must be from 1 to 2**30")

    def step(at: Column, i: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("long")
        landed = F.floor((at["j"] + 1) * F.lit(2**32).cast("double") / (draw + 1)).cast("long")
        return F.when(at["j"] >= shards, at).otherwise(F.struct(at["j"].alias("b"), landed.alias("j")))

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    jumps = F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS)))
    return F.aggregate(jumps, start, step, lambda at: F.when(at["j"] >= shards, at["b"]).otherwise(F.raise_error(F.lit("too many jumps"))).cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each row's key, and with ``grown`` its shard if one more were appended. Narrow: no shuffle."""
    as_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    shard = free_name(shard, df.columns)
    results = [jump_shard(as_text, shards).alias(shard)]
    if grown:
        results.append(jump_shard(as_text, shards + 1).alias(free_name(grown, [*df.columns, shard])))
    return df.select("*", *results)


def assign_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot", buckets: int = 256) -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    Rows of a shard are dealt over ``buckets`` by a hash of ``order``; slots are
    a count within the bucket plus the sizes of the buckets before it, so no
    task ever holds a whole shard. The table of bucket sizes has at most shards
    x buckets rows.
    """
    own = df.columns
    spread = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    bucket = F.conv(F.substring(spread, 1, 8), 16, 10).cast("long") % buckets
    rows = df.select(F.struct(*own).alias("_m"), F.col(shard).alias("_shard"), bucket.alias("_bucket"))
    within = Window.partitionBy("_shard", "_bucket").orderBy(*[F.col("_m").getField(c) for c in order])
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_row", F.row_number().over(within)).join(sizes, ["_shard", "_bucket"])
    place = (F.col("_row") - 1 + F.col("_before")).alias(free_name(slot, own))
    return numbered.select(*[F.col("_m").getField(c).alias(c) for c in own], place)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Write the rows with one folder for each shard; a hot shard is still written by many tasks."""
    assign_shards(df, key, shards).write.partitionBy(free_name("shard", df.columns)).parquet(path)


def op5_jump_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents into shards 0 to 39 under the law ``key``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(whole("text")) + 16).cast("long").alias("size"),
        F.crc32(whole("text")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = staged(assign_shards(docs, "doc_id", shards, grown="grown_shard"), "op5")
    return assign_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


OP5_SQL = r"""
with recursive
tab0(i, k, c) as (
  select i, 0, i::bigint from range(0, 256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from tab0 where k < 8
),
tab as (select list(c order by i) as t from tab0 where k = 8),
d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, '') as key from documents
),
hx as (select r, hex(encode(text)) as h from d),
crc as (
  select r, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc
  from hx, tab
),
jump(r, n, b, j, i) as (
  select r, n, -1::bigint, 0::bigint, 0 from d, (select unnest([40, 41]) as n)
  union all
  select jump.r, n, j, floor((j + 1) * 4294967296.0::double / (('0x' || substr(md5(key || ':' || (i + 1)), 1, 8))::bigint + 1))::bigint, i + 1
  from jump join d on d.r = jump.r where j < n
),
place as (select r, max(b) filter (where n = 40) as shard, max(b) filter (where n = 41) as grown from jump where j >= n group by r),
whole as (
  select doc_id, (strlen(text) + 16)::bigint as size, crc as text_crc32, shard::int as shard, grown::int as grown_shard
  from d join crc using (r) join place using (r)
),
dealt as (
  select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || text_crc32 || ':' || size), 1, 8))::bigint % 256 as bucket from whole
)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
  row_number() over (partition by shard order by bucket, doc_id nulls first, text_crc32, size) - 1 as slot
from dealt
"""
