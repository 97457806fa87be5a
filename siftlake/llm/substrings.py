"""Substring dedup by sliding sentence spans, in DataFrame functions.

A text is cut into sentences. Every run of ``run`` consecutive sentences is a
span, however short they are. Spans are hashed over the sentences' trimmed,
lower-cased texts, with white space inside as spaces, whatever lies between
them, twice over with different seeds (128 bits together). Spans with one hash
are joined over the whole corpus, and every sentence that a span other than the
first with its hash covers is removed; so of a repeated passage of ``run``
sentences or more none stays, and a repeated sentence between sentences of its
own does.

Only hashes and positions are shuffled to find repeats. Their counts and first
places are map-side combined, and the join back to the spans is one that
adaptive execution splits, so a passage that a third of all documents share is
never gathered anywhere. First means the smallest doc_id, then the earliest
place in it. What a document loses is gathered by document, so a very long text
is one long row and no more.

Nulls and odd rows: a null text has no sentences and stays null, an empty one
stays empty; a null doc_id comes after all others; rows that repeat a doc_id
with one text are one document and lose the same sentences; rows of one doc_id
with different texts that share a passage at the same place keep it in each; an
empty table gives an empty table. Own columns keep their names and values:
beside columns called n_removed and removed the results take an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.text import SPACE, free_name, row_hash, whole
from siftlake.session import exploded, staged, table

#: A span has so many sentences.
RUN = 3
#: A sentence ends after white space that follows a full stop, exclamation or question mark, or after a line break.
ENDS = r"(?<=[.!?][ \t\n])|(?<=\n)"
#: Unicode's other spaces, which are trimmed too.
WIDE = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: White space within a sentence is a space. Lower-casing a text would turn the last two into more characters, or by their place.
PLAIN = dict.fromkeys("\t\x0b\f\r", " ") | {"\u0130": "i", "\u03a3": "\u03c3"}


def sentences(text: str) -> Column:
    """The pieces of a text, their ends kept, so that joined they are the text again."""
    return F.split(whole(text), ENDS)


def place(doc_id: str, at: Column) -> Column:
    """Orders (doc_id, place) as one number, which hash aggregation keeps in place; null ids last."""
    known = F.coalesce(F.col(doc_id).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)"))
    return (known * F.lit(2**31).cast("decimal(12,0)") + at.cast("decimal(12,0)")).cast("decimal(38,0)")


def _plain(piece: Column) -> Column:
    """A piece trimmed and in lower case, its white space as spaces; each character counts by itself, as in the SQL."""
    out = F.btrim(piece, F.lit(SPACE + WIDE))
    for c, x in PLAIN.items():
        out = F.replace(out, F.lit(c), F.lit(x))
    return F.lower(out)


def _filled(pieces: str) -> Column:
    """(i, s): the pieces with text by number, as they are compared."""
    known = F.transform(pieces, lambda x, i: F.struct(i.alias("i"), _plain(x).alias("s")))
    return F.filter(known, lambda x: x["s"] != "")


def spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each span: doc_id, row_hash, k (its first sentence's number), hash and hash2."""
    df = docs.select("doc_id", row_hash("text").alias("row_hash"), sentences("text").alias("_pieces"))
    df = df.withColumn("_known", F.transform(_filled("_pieces"), lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), F.xxhash64(F.lit(1), x["s"]).alias("g"))))
    field = lambda c: F.transform("_known", lambda x: x[c])
    df = df.withColumns({c: field(c) for c in ("h", "g")})
    # the hash of an array is that of its elements one after another
    span = lambda c, k, *salt: F.xxhash64(*salt, *[F.get(c, k + i) for i in range(run)])
    made = F.transform(
        F.slice("h", F.lit(1), F.greatest(F.size("h") - (run - 1), F.lit(0))),
        lambda _, k: F.struct(k.alias("k"), span("h", k).alias("hash"), span("g", k, F.lit(1)).alias("hash2")),
    )
    return exploded(df, made, "_run", "doc_id", "row_hash").select("doc_id", "row_hash", "_run.*")


def repeated_sentences(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, row_hash and the sorted numbers of the sentences that spans other than the first cover."""
    ordered = staged(spans(docs, run), "spans").withColumn("place", place("doc_id", F.col("k")))
    shared = ordered.groupBy("hash", "hash2").agg(F.min("place").alias("first_place"), F.count("*").alias("n_spans"))
    # written first, so that the join is between two shuffles, which adaptive execution may split at hot keys
    shared = staged(shared.filter("n_spans > 1").drop("n_spans"), "shared-spans")
    found = ordered.join(shared, ["hash", "hash2"]).filter(F.col("place") > F.col("first_place"))
    found = found.groupBy("doc_id", "row_hash").agg(F.collect_set("k").alias("_runs"))
    numbers = F.flatten(F.transform("_runs", lambda k: F.sequence(k, k + (run - 1))))
    return found.select("doc_id", "row_hash", F.array_sort(F.array_distinct(numbers)).alias("covered"))


def without_repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents with their own columns, text cleaned, and n_removed (pieces) and removed (their texts)."""
    own = docs.columns
    covered = repeated_sentences(docs, run).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "covered")
    df = docs.select(F.struct(*own).alias("_doc"), F.col("doc_id").alias("_doc_id"), row_hash("text").alias("_row_hash"))
    df = df.join(covered, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")), "left")
    df = df.withColumn("_pieces", F.when(F.col("covered").isNotNull(), sentences("_doc.text")))
    df = df.withColumn("_at", F.when(F.col("covered").isNotNull(), F.transform(_filled("_pieces"), lambda x: x["i"])))
    # sentences that follow each other make one region, with the blank pieces between them
    begins = F.filter("covered", lambda x, i: F.coalesce(F.get("covered", i - 1) < x - 1, F.lit(True)))
    ends = F.filter("covered", lambda x, i: F.coalesce(F.get("covered", i + 1) > x + 1, F.lit(True)))
    df = df.withColumn("_cut", F.arrays_zip(*[F.transform(x, lambda k: F.get("_at", k)).alias(c) for x, c in ((begins, "first"), (ends, "last"))]))
    df = df.withColumn("_cut", F.transform("_cut", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))))
    part = lambda r: F.array_join(F.slice("_pieces", r["first"] + 1, r["last"] - r["first"] + 1), "")
    after = lambda i: F.coalesce(F.get("_cut", i - 1)["last"] + 1, F.lit(0))
    kept = F.transform("_cut", lambda r, i: F.array_join(F.slice("_pieces", after(i) + 1, r["first"] - after(i)), ""))
    tail = after(F.size("_cut"))
    rest = F.array_join(F.slice("_pieces", tail + 1, F.size("_pieces") - tail), "")
    text = F.when(F.size("_cut") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("_doc.text"))
    n = F.aggregate("_cut", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return df.select(
        *[text.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in own],
        F.coalesce(n, F.lit(0)).cast("long").alias(free_name("n_removed", own)),
        F.coalesce(F.transform("_cut", part), F.array().cast("array<string>")).alias(free_name("removed", own)),
    )


def op10_sentence_spans(spark, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat an earlier passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_removed", "removed", "text")


OP10_SQL = r"""
with p as (
  select doc_id, i, s, trim(translate(lower(s), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) as b
  from (
    select doc_id, generate_subscripts(x, 1) - 1 as i, unnest(x) as s
    from (select doc_id, regexp_extract_all(text, '(?:[^.!?\n]|[.!?]+[^.!? \t\n])*(?:[.!?]+(?:[ \t\n]|$)|\n|$)') as x from documents)
  ) where s <> ''
),
t as (select * exclude (i), row_number() over (partition by doc_id order by i) - 1 as i from p),
u as (
  select doc_id, i, b, row_number() over (partition by doc_id order by i) - 1 as k
  from t where b <> ''
),
v as (select doc_id, k, b, lead(b) over w as b2, lead(b, 2) over w as b3 from u window w as (partition by doc_id order by k)),
q as (select doc_id, k, row_number() over (partition by b, b2, b3 order by doc_id, k) as nth from v where b3 is not null),
c as (select distinct doc_id, unnest([k, k + 1, k + 2]) as k from q where nth > 1),
o as (select *, case when k - lag(k) over (partition by doc_id order by k) = 1 then 0 else 1 end as opens from c),
g as (select *, sum(opens) over (partition by doc_id order by k) as region from o),
x as (select g.doc_id, region, min(u.i) as f, max(u.i) as l from g join u using (doc_id, k) group by 1, 2),
e as (
  select x.doc_id, x.f, x.l, string_agg(t.s, '' order by t.i) as part from x join t on t.doc_id = x.doc_id and t.i between x.f and x.l group by 1, 2, 3
),
y as (select doc_id, list(part order by f) as removed, sum(l - f + 1)::bigint as n_removed from e group by 1),
z as (
  select t.doc_id, string_agg(t.s, '' order by t.i) as text
  from t where not exists (select 1 from x where x.doc_id = t.doc_id and t.i between x.f and x.l) group by 1
)
select d.doc_id, coalesce(y.n_removed, 0) as n_removed, coalesce(y.removed, []) as removed,
  case when y.n_removed > 0 then coalesce(z.text, '') else d.text end as text
from documents d left join y using (doc_id) left join z using (doc_id)
"""
