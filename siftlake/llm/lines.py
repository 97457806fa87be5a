"""Line dedup by content-defined line chunks.

Lines are hashed, and a hash rolling over ``WINDOW`` of them ends a chunk where
it falls into one residue class, so boundaries depend on the lines around them
and not on their numbers: lines inserted before a shared passage shift nothing
in it. The chunks between boundaries, and the windows that set them, are looked
up over the whole corpus. One that occurs more than once is extended to both
sides, line by line, against its first place, so that a passage goes to its
edges, which fall inside chunks: as far as the neighbouring chunks reach, for
beyond them the next chunk repeats as a whole. What has several lines with text
then is removed everywhere but at its first place, after its bytes are compared;
the lines around it are told apart by 128 bits of hashes. A repeat that overlaps its first place loses
only what lies after it. A passage of few lines may hold neither a whole chunk
nor a boundary; it stays.

Counting is over hashes alone. Documents that hold a chunk whose hash repeats
are then met with it, and only such chunks carry their lines on, and hashes of
the lines around them; grouping and joining them by hash and text is the byte comparison.
Counts are map-side combined and the joins are ones that adaptive execution
splits, so a chunk that a third of all documents hold is never gathered
anywhere. First means the smallest doc_id, then the earliest line in it.

Nulls and odd rows: a null text has no chunks and stays null, an empty one
stays empty; blank lines are lines, but what has fewer than two lines with text is
never removed; a null doc_id comes after all others; rows that repeat a doc_id with
one text are one document and lose the same lines; a very long text is one long
row; an empty table gives an empty table. Own columns keep their names and
values: beside a column called n_removed the result is called n_removed_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.substrings import place
from siftlake.llm.text import SPACE, free_name, row_hash, whole
from siftlake.session import discard_between, exploded, staged, staged_so_far, table

WINDOW = 2
#: A chunk ends after one line in so many.
MEAN_LINES = 2


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def chunks(docs: DataFrame, window: int = WINDOW, mean_lines: int = MEAN_LINES) -> DataFrame:
    """One row for each chunk, and each window that ends one, that has a line with text: doc_id, row_hash, first and last line, low and high (how far it may be extended) and hash."""
    df = docs.select("doc_id", row_hash("text").alias("row_hash"), F.split(whole("text"), "\n").alias("_lines"))
    df = df.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
    last = F.size("_hashes") - 1
    rolling = lambda i: F.xxhash64(F.slice("_hashes", F.greatest(i - (window - 2), F.lit(1)), F.least(i + 1, F.lit(window))))
    fires = lambda i: F.pmod(rolling(i), F.lit(mean_lines)) == 0
    df = df.withColumn("_ends", F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | fires(i)))
    begin = lambda j: F.when(j < 0, F.lit(0)).otherwise(F.coalesce(F.get("_ends", j - 1) + 1, F.lit(0)))
    reach = lambda j: (begin(j - 1).alias("low"), F.coalesce(F.get("_ends", j + 1), last).alias("high"))
    made = F.transform("_ends", lambda e, j: F.struct(begin(j).alias("first"), e.alias("last"), *reach(j)))
    # the window at a chunk's end, where it is not the chunk itself; the text's own end is no boundary
    back = lambda c: F.greatest(c["last"] - (window - 1), F.lit(0))
    windows = F.transform(
        F.filter(made, lambda c: (c["last"] > 0) & (back(c) != c["first"]) & fires(c["last"])),
        lambda c: F.struct(back(c).alias("first"), *[c[x].alias(x) for x in ("last", "low", "high")]),
    )
    part = lambda x, c: F.slice(x, c["first"] + 1, c["last"] - c["first"] + 1)
    both = F.filter(F.concat(made, windows), lambda c: F.exists(part("_lines", c), _filled))
    both = F.transform(both, lambda c: F.struct(*[c[x].alias(x) for x in _RANGE], F.xxhash64(part("_hashes", c)).alias("hash")))
    return exploded(df, both, "_c", "doc_id", "row_hash").select("doc_id", "row_hash", "_c.*")


_RANGE = ("first", "last", "low", "high")


def repeated_hashes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, row_hash and the chunks (first, last, low, high, hash) whose hash occurs more than once; no text is shuffled."""
    every = staged(chunks(docs, **settings), "line-chunks")
    # written first, so that the join is between two shuffles, which adaptive execution may split at hot keys
    shared = staged(every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "line-shared")
    found = every.join(shared, "hash").groupBy("doc_id", "row_hash")
    return found.agg(F.collect_set(F.struct(*_RANGE, "hash")).alias("_ranges"))


def _marks(lines: Column) -> Column:
    """Two hashes for each line, one after another; the second of a blank line is 0."""
    return F.flatten(F.transform(lines, lambda x: F.array(F.xxhash64(x), F.when(_filled(x), F.xxhash64(F.lit(1), x)).otherwise(F.lit(0).cast("long")))))


def _alike(mine: str, theirs: str) -> Column:
    """How many lines two arrays of marks begin with alike."""
    same = F.zip_with(mine, theirs, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False).cast("int")
    return F.floor(F.when(at > 0, at - 1).otherwise(F.size(mine)) / 2).cast("int")


def _n_filled(marks: str, n: str) -> Column:
    """How many of the first n lines have text."""
    return F.size(F.filter(F.slice(marks, F.lit(1), 2 * F.col(n)), lambda x, i: (i % 2 == 1) & (x != 0)))


def not_first(touched: DataFrame) -> DataFrame:
    """_doc_id, _row_hash and the sorted, separate line ranges that repeat a first place with their bytes, from rows with _doc and _ranges."""
    lines = touched.select("_doc_id", "_row_hash", F.split("_doc.text", "\n").alias("_lines"), "_ranges")
    part = lambda a, n: F.slice("_lines", a + 1, F.greatest(n, F.lit(0)))
    bodies = F.transform(
        "_ranges",
        lambda c: F.struct(
            *[c[x].alias(x) for x in ("first", "last", "hash")],
            F.array_join(part(c["first"], c["last"] - c["first"] + 1), "\n").alias("chunk"),
            _marks(F.reverse(part(c["low"], c["first"] - c["low"]))).alias("before"),
            _marks(part(c["last"] + 1, c["high"] - c["last"])).alias("after"),
        ),
    )
    rows = exploded(lines, bodies, "_c", "_doc_id", "_row_hash")
    rows = rows.select("_doc_id", "_row_hash", "_c.*").withColumn("place", place("_doc_id", F.col("first")))
    around = F.min_by(F.struct("before", "after"), "place").alias("_first")
    same_bytes = rows.groupBy("hash", "chunk").agg(F.min("place").alias("first_place"), around, F.count("*").alias("n")).filter("n > 1")
    same_bytes = staged(same_bytes.select("hash", "chunk", "first_place", F.col("_first.before").alias("_before"), F.col("_first.after").alias("_after")), "line-bytes")
    found = rows.join(same_bytes, ["hash", "chunk"]).filter(F.col("place") > F.col("first_place"))
    found = found.withColumns({"_up": _alike("before", "_before"), "_down": _alike("after", "_after")})
    n = F.size(F.filter(F.split("chunk", "\n"), _filled)) + _n_filled("before", "_up") + _n_filled("after", "_down")
    found = found.filter(n > 1)
    found = found.withColumns({"first": F.col("first") - F.col("_up"), "last": F.col("last") + F.col("_down")})
    # lines that the first place holds too stay
    kept = F.greatest(F.col("last") - F.col("first") + 1 - (F.col("place") - F.col("first_place")), F.lit(0)).cast("int")
    cut = found.select("_doc_id", "_row_hash", (F.col("first") + kept).alias("first"), "last").filter("first <= last").groupBy("_doc_id", "_row_hash")
    cut = cut.agg(F.collect_set(F.struct("first", "last")).alias("_cut"))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("_cut", lambda r: F.sequence(r["first"], r["last"])))))
    cut = cut.select("_doc_id", "_row_hash", numbers.alias("_numbers"))
    begins = F.filter("_numbers", lambda x, i: F.coalesce(F.get("_numbers", i - 1) < x - 1, F.lit(True)))
    ends = F.filter("_numbers", lambda x, i: F.coalesce(F.get("_numbers", i + 1) > x + 1, F.lit(True)))
    cut = cut.select("_doc_id", "_row_hash", begins.alias("first"), ends.alias("last"))
    return cut.select("_doc_id", "_row_hash", F.arrays_zip("first", "last").alias("_cut"))


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents with their own columns, text cleaned, and n_removed (lines removed).

    The texts are shuffled once, to meet the chunks whose hash repeats; from
    there documents without such chunks go straight to the result.
    """
    own = docs.columns
    mark = staged_so_far()
    ranges = repeated_hashes(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "_ranges")
    df = docs.select(F.struct(*own).alias("_doc"), F.col("doc_id").alias("_doc_id"), row_hash("text").alias("_row_hash"))
    # ranges grow with the corpus: never broadcast
    met = df.join(ranges.hint("merge"), F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")), "left")
    met = met.select("_doc", "_doc_id", "_row_hash", "_ranges")
    counted = staged_so_far()
    met = staged(met, "line-documents")
    discard_between(docs.sparkSession, mark, counted)
    touched = met.filter(F.col("_ranges").isNotNull())
    cuts = not_first(touched).select(F.col("_doc_id").alias("_id"), F.col("_row_hash").alias("_hash"), "_cut")
    df = touched.join(cuts, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")), "left")
    df = df.withColumn("_lines", F.when(F.col("_cut").isNotNull(), F.split("_doc.text", "\n")))
    after = lambda i: F.coalesce(F.get("_cut", i - 1)["last"] + 1, F.lit(0))
    kept = F.flatten(F.transform("_cut", lambda r, i: F.slice("_lines", after(i) + 1, r["first"] - after(i))))
    tail = after(F.size("_cut"))
    kept = F.concat(kept, F.slice("_lines", tail + 1, F.size("_lines") - tail))
    text = F.when(F.col("_cut").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("_doc.text"))
    n = F.aggregate("_cut", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    count = free_name("n_removed", own)
    field = lambda c: F.col("_doc").getField(c).alias(c)
    cleaned = df.select(*[text.alias(c) if c == "text" else field(c) for c in own], F.coalesce(n, F.lit(0)).cast("long").alias(count))
    rest = met.filter(F.col("_ranges").isNull()).select(*map(field, own), F.lit(0).cast("long").alias(count))
    return cleaned.unionByName(rest)


def op2_line_chunks(spark, sf_dir: str) -> DataFrame:
    """Every document without the multi-line chunks that an earlier place holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "n_removed", "text")
