"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight that changes over training time t in [0, 1]. Its
integral is the source's cumulative demand for words; documents of the source,
in an order given by a hash of id and text, fill that demand one after another,
and inverting the demand at a document's first word gives its position in
training. All sources share this time, and the words of the whole mix before it
are the sum of their demands, which grows with it; so documents sorted by
position lie in the order of the mix's cumulative words. A source whose demand
exceeds its size is passed through again; the last pass stops at the word
where the demand ends, so its last document may be taken in part.

Targets: weights share ``total_ratio`` of all words; no source gives more than
``max_repeats`` times its words, and what it cannot give is shared again by
weight among the others. That is one water level for all sources, found by a
running sum over the sources in the order in which they fill up.

Nulls and odd rows: a null text has size 0 and takes no part; a null source is
a source of its own and comes last; rows that lack or repeat an id are separate
documents; rows equal in id and text are counted as one group and numbered only
where their texts join the plan; a very long text is a long document, cut at a
word where its source's demand ends; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.text import n_words
from siftlake.session import staged, table

WEIGHTS = (5, 2, 1)
#: Multipliers of a source's weight at equally spaced times, for the first, second, third weight: early, steady, late.
CURRICULUM = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))

#: Equal rows that one task takes from a group.
COPIES = 65536


def targets(sizes: DataFrame, weights=WEIGHTS, total_ratio: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """From (source, source_size) to (source, source_size, rank, target). The table has one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    df = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy()
    level = (F.lit(float(total_ratio)) * F.sum("source_size").over(everyone) - full) / open_weight
    df = df.withColumn("_level", level)
    # the level rises until the first source that does not fill up, and falls after it
    df = df.withColumn("target", F.least("cap", F.max("_level").over(everyone) * F.col("weight")))
    return df.select("source", "source_size", "rank", "target")


def position(share: Column, rank: Column, curriculum=CURRICULUM) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` of its whole."""
    out = None
    for r, knots in enumerate(curriculum):
        k = len(knots) - 1
        areas = [(a + b) / 2 / k for a, b in zip(knots, knots[1:], strict=False)]
        whole_area, done, branch = sum(areas), 0.0, None
        for j, area in enumerate(areas):
            slope = (knots[j + 1] - knots[j]) * k
            v = F.greatest(share * whole_area - done, F.lit(0.0))
            if slope:
                root = F.sqrt(F.greatest(F.lit(knots[j] ** 2) + 2 * slope * v, F.lit(0.0)))
                t = F.lit(j / k) + (root - knots[j]) / slope
            else:
                t = F.lit(j / k) + v / knots[j]
            done += area
            inside = share * whole_area <= done if j < k - 1 else F.lit(True)
            branch = F.when(inside, t) if branch is None else branch.when(inside, t)
        at = F.least(F.greatest(branch, F.lit(0.0)), F.lit(1.0))
        mine = rank % len(curriculum) == r
        out = F.when(mine, at) if out is None else out.when(mine, at)
    return out


def plan_groups(rows: DataFrame, weights=WEIGHTS, total_ratio=1.5, max_repeats=2.0) -> DataFrame:
    """One row for each distinct (source, order, doc_id, size): its number n of equal rows, the words of its source before them, and the source's size, rank and demand.

    Equal rows are counted before they are shuffled. Words before a group are summed in two
    steps, within a cell of its source's order and over the cells before it: no task holds
    a whole source or a whole id.
    """
    groups = rows.groupBy("source", "order", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    groups = staged(groups.withColumn("_bucket", F.substring("order", 1, 3)), "mix-groups")
    cells = groups.groupBy("source", "_bucket").agg(F.sum(F.col("size") * F.col("n")).alias("_cell"))
    cells = staged(cells, "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, total_ratio, max_repeats)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    goal = goal.withColumnRenamed("source", "_source")
    cells = cells.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "source_size", "rank", "target"
    )
    groups = groups.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    within = Window.partitionBy("source", "_bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))
    return groups.withColumn("begun", begun).drop("_bucket", "_before").withColumn("demand", F.floor(F.col("target") + 0.5).cast("long"))


def with_passes(rows: DataFrame, curriculum=CURRICULUM) -> DataFrame:
    """Add passes (pass, position, words) and taken to rows of a group whose number among its equals is ``copy``."""
    rows = rows.withColumn("_at", F.col("begun") + F.col("copy") * F.col("size"))
    last = F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0)).cast("long")
    start = lambda p: p * F.col("source_size") + F.col("_at")
    passes = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda p: F.struct(
            p.cast("int").alias("pass"),
            position(start(p) / F.col("demand").cast("double"), F.col("rank"), curriculum).alias("position"),
            F.least(F.col("size"), F.col("demand") - start(p)).alias("words"),
        ),
    )
    passes = F.when((F.col("size") > 0) & (F.col("demand") > 0), F.filter(passes, lambda x: x["words"] > 0))
    rows = rows.withColumn("passes", F.coalesce(passes, F.array()))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.withColumn("taken", taken).drop("_at", "copy", "n", "begun", "demand", "rank")


def copies(groups: DataFrame, block: int = COPIES) -> DataFrame:
    """The rows of the groups again, numbered by ``copy``; a group of many is spread over tasks by blocks."""
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
    first = F.col("_block") * block
    each = F.sequence(first, F.least(first + block, F.col("n")) - 1)
    return blocks.repartition("order", "_block").withColumn("copy", F.explode(each)).drop("_block")


def plan_mix(docs: DataFrame, sizes: DataFrame, weights=WEIGHTS, total_ratio=1.5, max_repeats=2.0, curriculum=CURRICULUM) -> DataFrame:
    """Add source_size, target, taken and passes (pass, position, words) to rows that have doc_id, source, size and order.

    ``sizes`` holds those four columns of the same rows; the plan is made on it alone, and
    the rows, whatever they carry, are shuffled once to meet it. Equal rows are numbered there.
    """
    key = F.md5(F.concat_ws(":", "order", F.col("doc_id").cast("string"), "size", F.concat(F.lit("s"), "source")))
    groups = plan_groups(sizes, weights, total_ratio, max_repeats).withColumn("_key", key)
    groups = groups.select("_key", "n", "begun", "demand", "rank", "source_size", "target").hint("shuffle_hash")
    met = docs.withColumn("_key", key).join(groups, "_key")
    equal = Window.partitionBy("_key").orderBy("order")
    return with_passes(met.withColumn("copy", F.row_number().over(equal) - 1), curriculum).drop("_key")


def hash_order(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A source's order of documents: a hash of the id and the text, so rows that lack or repeat an id are spread too."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each pass, sorted by position; a part-taken text is cut at its word.

    Columns that the plan needs for itself carry names of their own, so extra columns of ``docs`` stay as they are.
    """
    own = docs.columns
    light = ["doc_id", "source", n_words("text").alias("size"), hash_order().alias("order")]
    rows = docs.select(*light, F.struct(*own).alias("_doc")).filter("size > 0")
    planned = plan_mix(rows, docs.select(*light), **settings)
    out = planned.select("_doc", "doc_id", "size", F.explode("passes").alias("_pass"))
    text = F.col("_doc.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_pass.words").cast("int")), "")
    text = F.when(F.col("_pass.words") < F.col("size"), cut).otherwise(text)
    columns = [text.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in own]
    return out.orderBy("_pass.position", "doc_id", "_pass.pass").select(*columns)


def op1_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it, in order of first position."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", n_words("text").alias("size"), hash_order().alias("order")
    )
    planned = with_passes(copies(plan_groups(docs)))
    first = F.array_min(F.transform("passes", lambda x: x["position"]))
    return (
        planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
        .orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
        .withColumn("first_position", F.round("first_position", 9))
    )


OP1_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as o
  from documents
),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (
  select *, row_number() over (order by source nulls last) - 1 as rk, source_size * 2.0::double as cap,
    sum(source_size) over ()::double as total
  from s
),
w as (select *, case rk % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from r),
f as (
  select *, (1.5::double * total - coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, rk rows between current row and unbounded following) as level
  from w
),
t as (
  select source, source_size, rk, least(cap, max(level) over () * weight) as target from f
),
c as (
  select d.doc_id, d.size, t.source_size, t.rk, t.target, floor(t.target + 0.5)::bigint as demand,
    coalesce(sum(size) over (partition by d.source order by o, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as begun
  from d join t on d.source is not distinct from t.source
),
p as (
  select *, case when source_size > 0 then demand // source_size else 0 end as fulls from c
),
q as (
  select *, case when size = 0 or demand = 0 then 0
      else fulls * size + greatest(0, least(size, demand - fulls * source_size - begun)) end as taken,
    begun / demand::double as u
  from p
),
z as (
  select *, case rk % 3
      when 0 then case when u <= 0.625 then 1.5 - sqrt(greatest(2.25 - 2 * greatest(u, 0), 0))
                       else 0.5 + (1.0 - sqrt(greatest(1.0 - 2 * greatest(u - 0.625, 0), 0))) end
      when 1 then u
      else case when u <= 0.375 then sqrt(0.25 + 2 * u) - 0.5
                else 0.5 + sqrt(1.0 + 2 * greatest(u - 0.375, 0)) - 1.0 end
    end as pos
  from q
)
select doc_id, size, source_size, target, taken::bigint as taken,
  round(case when taken > 0 then least(greatest(pos, 0), 1) end, 9) as first_position
from z
"""
