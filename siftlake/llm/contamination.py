"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z taken as a-z. The items' word sequences go into one suffix automaton, whose
states stand for everything that occurs in them. A document's words stream
through it; the state and the length that it has matched tell the longest
passage of any item that ends at each word. A passage is a hit where it reaches
``window`` words, or the share ``coverage`` of an item that has fewer: each item
has a window of min(window, ceil(coverage * its words)) words, and every word in
an occurrence of an item's window is hit. States that hold windows know their
items, so each document also gets the items found in it.

The benchmark may have any size. Items are cut into segments of a bounded number
of words that overlap by a window, segments are dealt into blocks of about
``most_words`` words, and a task builds the automaton of each block. Documents
meet the blocks in a narrow pass: a few automata of bounded size are broadcast
at a time, and documents are written between passes if there are more. No
document is shuffled. Numpy finds the stretches of a document whose neighbouring
words all stand side by side in items too; only those that are as long as the
smallest window stream through the automaton, for no other can hold a hit.

Nulls and odd rows: a null or empty text has no words, so it has no hits and as
an item no window; a null item_id gives hits but is neither counted nor named;
rows that repeat an item_id are one item with several texts; documents that
repeat are judged each time; ties do not arise, since all hits count; a very
long text takes eight bytes a word; an empty table of documents gives no rows,
an empty benchmark no hits. Own columns keep their names and values: beside a
column called n_words the result is called n_words_.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from siftlake.llm.hashing import PLAIN_WORD, mixed, text_bytes, text_parts, word_hashes, word_spans
from siftlake.llm.text import free_name
from siftlake.session import shipped, staged, table

WINDOW, COVERAGE = 10, 1.0
#: Words of a segment of an item, and about so many of a block, whose automaton has at most twice as many states.
SEGMENT, MOST_WORDS = 4096, 100_000
#: Automata that are broadcast in one pass over the documents.
AT_ONCE = 8

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All runs of words of several sequences; ``marks`` has, for a state, the windows in it by their lengths, with their items."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.marks: dict[int, dict[int, set]] = defaultdict(dict)
        self.nearest: list[int] = []

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """A state for the runs of q that are no longer than those of p and t."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def add(self, tokens: Iterable[int]) -> None:
        """Take in one more sequence."""
        at = 0
        for t in tokens:
            p = at
            if t in self.next[p]:
                at = self._split(p, t, self.next[p][t])
                continue
            at = self._state(self.length[p] + 1, 0, {})
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = at
                p = self.link[p]
            if p >= 0:
                self.link[at] = self._split(p, t, self.next[p][t])

    def mark(self, tokens: Iterable[int], window: int, item: str | None) -> None:
        """Note the item at the states of its windows; after all sequences are in."""
        at = 0
        for i, t in enumerate(tokens):
            at = self.next[at][t]
            while self.length[self.link[at]] >= window:
                at = self.link[at]
            if i + 1 >= window:
                self.marks[at].setdefault(window, set()).add(item)

    def close(self) -> None:
        """For each state the nearest one on its way to the root that has marks, itself included; -1 if there is none."""
        self.nearest = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.marks else self.nearest[self.link[s]]

    def stream(self, tokens: list[int], found: set[tuple[int, int]], spans: list[list[int]], first: int) -> None:
        """Follow ``tokens``, the document's words from number ``first``; add hits to ``spans`` and marks met to ``found``."""
        at = size = 0
        arcs, link, length, nearest, marks = self.next, self.link, self.length, self.nearest, self.marks
        for i, t in enumerate(tokens, first):
            while at and t not in arcs[at]:
                at = link[at]
                size = length[at]
            if t in arcs[at]:
                at = arcs[at][t]
                size += 1
            hit, m = 0, nearest[at] if at else -1
            while m >= 0:
                for w in marks[m]:
                    if w <= size:
                        hit = max(hit, w)
                        found.add((m, w))
                m = nearest[link[m]]
            if hit:
                begin = i - hit + 1
                while spans and spans[-1][1] >= begin - 1:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, i])


class ItemIndex:
    """The automaton of some segments (item, window, hashes), and what finds the stretches of a text that can hold hits."""

    def __init__(self, segments: list[tuple[str | None, int, np.ndarray]]):
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, _, h in segments]]))
        self.least = min((w for _, w, _ in segments), default=1)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.vocabulary >> np.uint64(48)] = True
        self.automaton, pairs = SuffixAutomaton(), [np.zeros(0, np.int64)]
        coded = [(item, window, np.searchsorted(self.vocabulary, h)) for item, window, h in segments]
        for _, _, ids in coded:
            self.automaton.add(ids.tolist())
            pairs.append(ids[:-1] * len(self.vocabulary) + ids[1:])
        for item, window, ids in coded:
            self.automaton.mark(ids.tolist(), window, item)
        self.automaton.close()
        self.pairs = np.unique(np.concatenate(pairs))

    def match(self, hashes: np.ndarray, spans: list[list[int]], items: set) -> None:
        """Add the hit spans of a text's words, as first and last, and the items found."""
        if not len(self.vocabulary):
            return
        known = np.flatnonzero(self.seen[hashes >> np.uint64(48)])
        ids = np.searchsorted(self.vocabulary, hashes[known])
        ids[ids == len(self.vocabulary)] = 0
        right = self.vocabulary[ids] == hashes[known]
        known, ids = known[right], ids[right]
        if not len(known):
            return
        joined = np.diff(known) == 1
        if self.least > 1 and len(self.pairs):
            pair = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            joined &= self.pairs[at] == pair
        cuts = np.flatnonzero(~joined) + 1
        begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(known)]))
        found: set[tuple[int, int]] = set()
        for i in np.flatnonzero(ends - begins >= self.least):
            a, b = begins[i], ends[i]
            self.automaton.stream(ids[a:b].tolist(), found, spans, int(known[a]))
        for state, window in found:
            items |= self.automaton.marks[state][window]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that meet or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _segments(window: int, coverage: float):
    """Rows (item, window, part, words, hashes) of items; parts overlap by a window less one word."""

    def run(batches):
        for batch in batches:
            rows = defaultdict(list)
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                hashes = word_hashes(text, PLAIN_WORD)
                w = max(1, min(window, math.ceil(coverage * len(hashes))))
                step = max(SEGMENT - (w - 1), w)
                for part, at in enumerate(range(0, max(len(hashes) - (w - 1), 0), step)):
                    words = hashes[at : at + step + w - 1]
                    for name, x in zip(_SEGMENT_NAMES, (item, w, part, len(words), words.tobytes()), strict=True):
                        rows[name].append(x)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(_SEGMENT_NAMES, kinds, strict=True)], _SEGMENT_NAMES)

    return run


_SEGMENT_NAMES = ["item", "window", "part", "words", "hashes"]


def _built(segments: pd.DataFrame) -> pd.DataFrame:
    rows = [(i, int(w), np.frombuffer(h, np.uint64)) for i, w, h in zip(segments["item"], segments["window"], segments["hashes"], strict=True)]
    rows = [(None if i is None or i != i else i, w, h) for i, w, h in rows]
    return pd.DataFrame({"block": segments["block"].iloc[:1], "index": [pickle.dumps(ItemIndex(rows), pickle.HIGHEST_PROTOCOL)]})


def item_blocks(items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> tuple[DataFrame, int]:
    """One automaton for each block of items(item_id, text), as a written table of (block, index), and the number of blocks."""
    df = items.select(F.col("item_id").cast("string").alias("item"), "text")
    df = shipped(df).mapInArrow(_segments(window, coverage), "item string, window int, part int, words long, hashes binary")
    df = staged(df.dropDuplicates(["item", "window", "hashes"]), "item-segments")
    n = max(1, -(-(df.agg(F.sum("words")).first()[0] or 0) // most_words))
    df = df.withColumn("block", F.pmod(F.xxhash64("item", "part", "hashes"), F.lit(n)).cast("int"))
    built = df.select("block", "item", "window", "hashes").groupBy("block").applyInPandas(_built, "block int, index binary")
    return staged(built, "item-automata"), n


#: This worker's last index, by the broadcast that it came with.
_index: dict[int, ItemIndex] = {}


def _loaded(shared) -> ItemIndex:
    if shared.id not in _index:
        _index.clear()
        _index[shared.id] = pickle.loads(shared.value[1])
    return _index[shared.id]


class _Tagged:
    """A broadcast with the number that tells it apart in a worker."""

    def __init__(self, spark, number: int, data: bytes):
        self.id, self.of = number, spark.sparkContext.broadcast((number, data))

    @property
    def value(self):
        return self.of.value


_count = [0]
_SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _pass(docs: DataFrame, names: list[str], indexes: list[_Tagged], again: bool, keep: list[str]) -> DataFrame:
    """One narrow pass: add n_words, spans and items under ``names``, or add to them where an earlier pass has."""
    at, own = docs.columns.index("text"), [docs.columns.index(c) for c in keep]
    before = [docs.columns.index(c) for c in names] if again else []

    def run(batches):
        for batch in batches:
            words = [word_hashes(t, PLAIN_WORD) for t in text_bytes(batch.column(at))]
            spans = [[[s["first"], s["last"]] for s in x] for x in batch.column(before[1]).to_pylist()] if again else [[] for _ in words]
            items = [set(x) for x in batch.column(before[2]).to_pylist()] if again else [set() for _ in words]
            for shared in indexes:
                index = _loaded(shared)
                for i, hashes in enumerate(words):
                    more: list[list[int]] = []
                    index.match(hashes, more, items[i])
                    spans[i] += more
            made = [
                pa.array([len(h) for h in words], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in merged(x)] for x in spans], _SPANS_ARROW),
                pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
            ]
            fields = [*[batch.schema.field(i) for i in own], *[pa.field(n, a.type) for n, a in zip(names, made, strict=True)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in own], *made], schema=pa.schema(fields))

    results = [StructField(n, k) for n, k in zip(names, (LongType(), _SPANS, ArrayType(StringType())), strict=True)]
    return shipped(docs).mapInArrow(run, StructType([*[docs.schema[c] for c in keep], *results]))


def matches(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = WINDOW, coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents' columns ``keep`` (all by default), n_words, spans (first and last hit word, from 0) and items (names found, sorted)."""
    keep = docs.columns if keep is None else keep
    names = [free_name(n, docs.columns) for n in ("n_words", "spans", "items")]
    blocks, n = item_blocks(items, window, coverage, most_words)
    present = [r[0] for r in blocks.select("block").collect()]
    df = docs
    for i in range(0, max(1, len(present)), AT_ONCE):
        indexes = []
        for block in present[i : i + AT_ONCE]:
            _count[0] += 1
            # one automaton of about most_words words: a bounded broadcast
            indexes.append(_Tagged(docs.sparkSession, _count[0], bytes(blocks.filter(F.col("block") == block).first()["index"])))
        last = i + AT_ONCE >= len(present)
        df = _pass(df, names, indexes, i > 0, keep if last else docs.columns)
        df = df if last else staged(df, "item-matches")
    return df


def cut(text: str | None, spans: list) -> str | None:
    """A text without the words of the spans and what stands between them."""
    if text is None or not len(spans):
        return text
    data = np.frombuffer(text.encode(), np.uint8)
    begins, ends = [], []
    for a, b in text_parts(data, PLAIN_WORD):
        starts, stops, _ = word_spans(data[a:b], PLAIN_WORD)
        begins.append(starts + a)
        ends.append(stops + a)
    begins, ends, out, at = np.concatenate(begins), np.concatenate(ends), [], 0
    for s in spans:
        out.append(data[at : begins[s["first"]]].tobytes())
        at = ends[s["last"]]
    return b"".join([*out, data[at:].tobytes()]).decode()


def without_benchmark(docs: DataFrame, items: DataFrame, most_share: float = 0.5, **settings) -> DataFrame:
    """The documents with their own columns, hit spans cut from the text, and n_hit (words cut).

    Documents of whose words more than ``most_share`` are hit go altogether.
    """
    own = docs.columns
    df = matches(docs, items, **settings)
    n_words, spans, names = df.columns[-3:]
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    count = free_name("n_hit", own)
    df = df.withColumn(count, n_hit).filter(F.col(count) <= F.col(n_words) * most_share)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return df.select(*[cleaned("text", spans).alias(c) if c == "text" else F.col(c) for c in own], count)


def op13_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark's windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = matches(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return df.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP13_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
b as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
),
c as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
k as (select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as i from c)),
x as (
  select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from k) where len(w) >= n)
),
h as (select doc_id, i, n, item from x join k using (n, s)),
p as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from h)) group by 1),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from h group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""
