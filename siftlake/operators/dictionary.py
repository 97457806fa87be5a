"""Texts against a table of fragments: the first entry that a text contains.

Short fixed dictionaries are expressions (``features.first_match``). A table of
fragments of any size is met by equality instead. Every fragment is filed under
its rarest gram, counted over the texts; a text is looked up by its own grams,
so only fragments whose rarest gram it holds are compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.session import staged

#: Characters of a gram. Shorter fragments are filed whole.
GRAM = 4

#: Bytes of the filed fragments up to which they are broadcast; beyond, they are shuffled by gram.
BROADCAST_BYTES = 8 << 20

#: Parts over which the texts that share a gram are dealt where the fragments are shuffled.
SALTS = 16


def grams(text: str | Column, length: int) -> Column:
    """The different runs of ``length`` characters of a text, overlapping; none of a shorter text. One pass over the text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def _looked_up(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """text and gram, a row for each different gram of the lengths that fragments are filed under."""
    every = F.array_distinct(F.concat(*[grams("text", n) for n in lengths]))
    return texts.select("text", F.explode_outer(every).alias("gram")).filter(F.col("gram").isNotNull())


def filed(entries: DataFrame, texts: DataFrame, gram: int = GRAM) -> tuple[DataFrame, list[int]]:
    """(gram, fragment, entry) of each fragment, under the gram that the fewest texts hold, and the lengths of grams.

    A gram that no text holds proves that its fragments are in none; they are
    left out. ``entry`` is (ordinal, value), the first of equal fragments.
    """
    known = entries.filter("fragment is not null and fragment <> '' and ordinal is not null").groupBy("fragment").agg(
        F.min(F.struct("ordinal", "value")).alias("entry")
    )
    known = staged(known, "fragments")
    lengths = [r["n"] for r in known.select(F.least(F.length("fragment"), F.lit(gram)).alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return known.select(F.lit("").alias("gram"), "fragment", "entry"), []
    of = F.when(F.length("fragment") < gram, F.array("fragment")).otherwise(grams("fragment", gram))
    held = known.select("fragment", "entry", F.explode(of).alias("gram"))
    counted = _looked_up(texts, lengths).groupBy("gram").agg(F.count("*").alias("texts"))
    ranked = held.join(counted, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = ranked.groupBy("fragment").agg(F.first("entry").alias("entry"), F.min(F.struct("texts", "gram")).alias("r"))
    return staged(rarest.filter("r.texts > 0").select("r.gram", "fragment", "entry"), "filed"), lengths


def first_fragments(df: DataFrame, text: str, entries: DataFrame, gram: int = GRAM, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with _fragment and _value of the first of ``entries``(fragment, value, ordinal) that its column ``text`` contains.

    The least ordinal wins; entries of one ordinal go by value (null first) and
    then fragment. Null texts, and texts without a fragment, have null. Null
    and empty fragments match nothing, nor do entries without an ordinal.
    Repeated entries count once, repeated rows of ``df`` keep their number. An
    own column _fragment or _value is replaced.

    Texts are made distinct before they are cut, so a script that a third of
    all pages load is looked up once. The filed fragments are broadcast where
    their measured size allows, and otherwise joined by (gram, part of the
    texts), which spreads a frequent gram. Where many fragments have no gram
    but frequent ones, their comparisons are as many as gram, text and
    fragment meet; no other pair is made. Copies of one text meet its result
    in a join that adaptive execution splits where it is skewed.
    """
    df = df.drop("_fragment", "_value")
    texts = staged(df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct(), "texts")
    known, lengths = filed(entries, texts, gram)
    if not lengths:
        kind = entries.schema["value"].dataType
        return df.withColumn("_fragment", F.lit(None).cast("string")).withColumn("_value", F.lit(None).cast(kind))
    asked = _looked_up(texts, lengths)
    size = known.agg(F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("fragment") + F.length(F.to_json("entry")) + 64), F.lit(0)).alias("n"))
    if size.first()["n"] <= most_bytes:
        pairs = asked.join(F.broadcast(known), "gram")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        pairs = asked.join(known.select("*", parts).hint("shuffle_merge"), ["gram", "part"])
    best = F.min(F.struct("entry.ordinal", "entry.value", "fragment")).alias("best")
    found = pairs.filter(F.col("text").contains(F.col("fragment"))).groupBy("text").agg(best)
    found = found.select(F.col("text").alias("_text"), F.col("best.fragment").alias("_fragment"), F.col("best.value").alias("_value"))
    return df.join(found, F.col(text) == F.col("_text"), "left").drop("_text")
