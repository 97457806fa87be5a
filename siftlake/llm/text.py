"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """The words of a text in order; an empty array for null and for blank texts."""
    trimmed = F.btrim(whole(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(text: str | Column) -> Column:
    """The number of words as a long; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def row_hash(text: str | Column) -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(text)


def free_name(name: str, taken: list[str]) -> str:
    """The name for a result column beside the columns ``taken``: the name itself, or with underscores until none has it.

    Own columns keep their names and values in every operator; names differ if they do so without regard to case.
    """
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
