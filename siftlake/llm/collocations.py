"""Phrase collocation mining with weighted acyclic automata.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line breaks,
pieces into words at spaces and tabs. Counts are per language. Phrases of two to
``LONGEST`` words that occur ``least`` times or more are scored by how often
they occur against their two parts, at the cut where that is lowest, and those
that a longer phrase covers nearly always are dropped.

Counting goes length by length. Each task takes a bounded number of phrases,
sorts them and builds a count automaton from the sorted phrases, cut at ranges
of a first symbol; a range's automata of all tasks meet in one group, are united
and their weights summed. The first symbol is a hash of the whole phrase, so the
phrases behind a very common word or pair are spread over all ranges, and
because every task sends a phrase once, copies weigh nothing. A phrase can only
be frequent if the two phrases that lack its last and its first word are: a
filter of a fixed number of bits, set for the frequent phrases of the length
before, is broadcast, and only phrases whose two parts pass are counted. What
passes wrongly is counted exactly too and found infrequent.

Parts are looked up by composition: the frequent phrases, by ranges of their
first two words, form one count automaton a range, in which a phrase's path
gives the counts of its first one to three words and the count of its best
extension; the reversed phrases give the same from the last word.

Symbols are 64-bit hashes of language and word; two frequent words that share
one raise an error.

Nulls and odd rows: a null text is empty, a null language is ``und``; an empty
text and one of separators alone have no words; ties go by count, then by the
phrase's bytes; rows that repeat count each time; a very long text goes in parts
that end between pieces (a piece is held whole, at eight bytes a word); an empty
table has no phrases. Only lang and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.automata import Builder, PhraseAutomaton, ordered, summed, united
from siftlake.llm.hashing import LOWER, mixed, text_bytes, text_parts, word_spans
from siftlake.session import discard_between, shipped, staged, staged_so_far, table

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
#: The filter's bits, as a power of two: 16 MB, whatever the corpus.
FILTER_LOG2 = 27
#: Phrases that a task holds before it makes an automaton of them.
SHARD = 1 << 20
#: Words of the corpus for one range of counting, frequent phrases for one of looking up, and how many ranges share a first word.
RANGE_WORDS, RANGE_PHRASES, SPREAD = 1 << 19, 1 << 15, 8

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORDS = ~_SEPARATORS
_WORDS[[32, 9]] = False
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BREAK = np.array([10], np.uint8)


def _joined(group: list[tuple[int, np.ndarray]]):
    data = np.concatenate([x for _, t in group for x in (t, _BREAK)])
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in group])))
    starts, ends, hashes = word_spans(data, _WORDS)
    row = np.array([i for i, _ in group])[np.searchsorted(begins, starts, side="right") - 1]
    piece = np.cumsum(_SEPARATORS[data], dtype=np.int32)[starts]
    return data, starts, ends, hashes, row, np.diff(piece, prepend=-1) > 0


def _symbols(langs: pa.Array, texts: pa.Array, size: int = 1 << 20):
    """For about ``size`` bytes of texts at a time: the bytes, the words' bounds and symbols, their rows, and whether each opens a piece."""
    names = [("und" if x is None else x) for x in langs.to_pylist()]
    salts = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(names)}
    salt = np.array([salts[x] for x in names], np.uint64)
    group, held = [], 0

    def made(group):
        data, starts, ends, hashes, row, opens = _joined(group)
        return data, starts, ends, mixed(hashes * _PRIME + salt[row]), row, opens

    for i, text in enumerate(text_bytes(texts)):
        for a, b in text_parts(text, ~_SEPARATORS, size):
            group.append((i, text[a:b]))
            held += b - a
            if held >= size:
                yield made(group)
                group, held = [], 0
    if group:
        yield made(group)


_WORD_ROWS = pa.schema([("lang", pa.string()), ("symbol", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def _count_words(batches):
    """Rows (lang, symbol, word, n); one without a symbol has all words of a language."""
    for batch in batches:
        for data, starts, ends, symbols, row, _ in _symbols(batch.column(0), batch.column(1)):
            if not len(symbols):
                continue
            known, first, n = np.unique(symbols, return_index=True, return_counts=True)
            low = LOWER[data].tobytes()
            words = [low[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            lang = batch.column(0).take(pa.array(row[first])).fill_null("und").cast(pa.string())
            made = [lang, pa.array(known.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(made, schema=_WORD_ROWS)
            rows, n = np.unique(row, return_counts=True)
            lang = batch.column(0).take(pa.array(rows)).fill_null("und").cast(pa.string())
            nulls = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([lang, *nulls, pa.array(n)], schema=_WORD_ROWS)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_LOG2)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _phrase_hash(symbols: np.ndarray) -> np.ndarray:
    """One hash for each row of symbols."""
    out = symbols[:, 0]
    for j in range(1, symbols.shape[1]):
        out = mixed(out * _PRIME + symbols[:, j])
    return out


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _phrases(symbols: np.ndarray, opens: np.ndarray, k: int, bits: np.ndarray) -> np.ndarray:
    """The phrases of k words, within pieces, whose two parts of k - 1 words pass the filter."""
    m = len(symbols)
    if m < k:
        return np.zeros((0, k), np.uint64)
    part, inside = symbols, np.ones(m, bool)
    for j in range(1, k - 1):
        part = mixed(part[: m - j] * _PRIME + symbols[j:])
        inside = inside[: m - j] & ~opens[j:]
    good = np.zeros(len(part), bool)
    good[inside] = _passes(bits, part[inside])
    # the first part ends before the last word opens a piece
    at = np.flatnonzero(good[:-1] & good[1:] & ~opens[k - 1 :] & (~opens[1 : m - k + 2] if k > 2 else True))
    return np.stack([symbols[at + j] for j in range(k)], axis=1)


def _count_phrases(k: int, n_ranges: int, shared):
    """Rows (part, automaton): the counts of a shard's phrases by range."""

    def shard(blocks):
        symbols = np.concatenate(blocks)
        symbols, weights = summed(symbols, np.ones(len(symbols), np.int64))
        part = _ranges(_phrase_hash(symbols), n_ranges)
        order = np.argsort(part, kind="stable")  # within a range the phrases stay sorted
        symbols, weights, part = symbols[order], weights[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        parts, data = [], []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            parts.append(int(part[a]))
            data.append(Builder(k).add(symbols[a:b], weights[a:b]).built().to_bytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["part", "automaton"])

    def run(batches):
        bits, held, n = shared.value, [], 0
        for batch in batches:
            for _, _, _, symbols, _, opens in _symbols(batch.column(0), batch.column(1)):
                held.append(_phrases(symbols, opens, k, bits))
                n += len(held[-1])
                if n >= SHARD:
                    yield shard(held)
                    held, n = [], 0
        if n:
            yield shard(held)

    return run


_SYMBOLS = [f"s{i}" for i in range(1, LONGEST + 1)]
_COUNTED = pa.schema([*[(s, pa.int64()) for s in _SYMBOLS], ("k", pa.int32()), ("a", pa.int64()), ("key", pa.int64())])
_COUNTED_SQL = ", ".join([*[f"{s} long" for s in _SYMBOLS], "k int, a long, key long"])


def _unite(k: int, least: int):
    """The frequent phrases of one range: the union of its automata."""

    def run(group: pa.Table) -> pa.Table:
        automata = [PhraseAutomaton.from_bytes(x.as_py()) for x in group.column("automaton")]
        symbols, weights = united(automata, k)
        symbols, weights = symbols[weights >= least], weights[weights >= least]
        columns = [symbols[:, j].view(np.int64) if j < k else np.zeros(len(symbols), np.int64) for j in range(LONGEST)]
        columns += [np.full(len(symbols), k, np.int32), weights, _phrase_hash(symbols).view(np.int64)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_COUNTED)

    return run


def _filter_bits(frequent: DataFrame) -> np.ndarray:
    """The filter of some phrases' keys; its size is fixed, so it may come to the driver and be broadcast."""
    slot = F.shiftrightunsigned("key", 64 - FILTER_LOG2) + 1
    df = frequent.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (FILTER_LOG2 - 3), np.uint8)
    for r in df.collect():
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _looked_up(backwards: bool):
    """Of a range's frequent phrases those of two words or more: symbols, a, the counts of their beginnings and of the best longer phrase."""

    def run(group: pa.Table) -> pa.Table:
        size = group.column("k").to_numpy()
        symbols = np.stack([group.column(s).to_numpy().view(np.uint64) for s in _SYMBOLS], axis=1)
        weights = group.column("a").to_numpy()
        if backwards:
            at = np.maximum(size[:, None] - 1 - np.arange(LONGEST), 0)
            symbols = np.where(np.arange(LONGEST) < size[:, None], np.take_along_axis(symbols, at, axis=1), np.uint64(0))
        order = ordered(symbols)
        symbols, weights, size = symbols[order], weights[order], size[order]
        counts = Builder(LONGEST).add(symbols, weights).built()
        asked = Builder(LONGEST).add(symbols[size > 1], weights[size > 1]).built()
        symbols, parts, longer = counts.composed(asked)
        size = (symbols != 0).sum(axis=1)
        if backwards:
            at = np.maximum(size[:, None] - 1 - np.arange(LONGEST), 0)
            symbols = np.where(np.arange(LONGEST) < size[:, None], np.take_along_axis(symbols, at, axis=1), np.uint64(0))
        columns = [*[symbols[:, j].copy().view(np.int64) for j in range(LONGEST)], size.astype(np.int32)]
        columns += [parts[np.arange(len(size)), size - 1], *[parts[:, j].copy() for j in range(LONGEST - 1)], longer]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_FOUND)

    return run


_FOUND = pa.schema([*[(s, pa.int64()) for s in _SYMBOLS], ("k", pa.int32()), ("a", pa.int64()), *[(f"p{i}", pa.int64()) for i in range(1, LONGEST)], ("longer", pa.int64())])
_FOUND_SQL = ", ".join([*[f"{s} long" for s in _SYMBOLS], "k int, a long", *[f"p{i} long" for i in range(1, LONGEST)], "longer long"])


def _parts(frequent: DataFrame, n_ranges: int, backwards: bool) -> DataFrame:
    """Look up all phrases from one end, range by range; a word goes to all ranges that share it."""
    spread = min(SPREAD, n_ranges)
    wide = max(1, n_ranges // spread)
    symbols = F.slice(F.array(*_SYMBOLS), 1, F.col("k"))
    symbols = F.reverse(symbols) if backwards else symbols
    first = F.pmod(F.xxhash64(symbols[0]), F.lit(wide)) * spread
    every = F.sequence(F.lit(0), F.lit(spread - 1))
    second = F.when(F.col("k") == 1, every).otherwise(F.array(F.pmod(F.xxhash64(F.get(symbols, F.lit(1))), F.lit(spread)).cast("int")))
    df = frequent.select(*_SYMBOLS, "k", "a", first.alias("_first"), F.explode(second).alias("_second"))
    df = df.select(*_SYMBOLS, "k", "a", (F.col("_first") + F.col("_second")).alias("part"))
    return df.groupBy("part").applyInArrow(_looked_up(backwards), _FOUND_SQL)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The frequent words and phrases (symbols, k, a, key), and the words as (lang, symbol, word, n), where a row without a symbol has all words of its language."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    words = shipped(texts).mapInArrow(_count_words, "lang string, symbol long, word string, n long")
    words = words.groupBy("lang", "symbol").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("_other"))
    same = F.when(F.col("word").eqNullSafe(F.col("_other")), F.col("word")).otherwise(F.raise_error(F.lit("two frequent words share a symbol")))
    words = words.filter(F.col("symbol").isNull() | (F.col("n") >= least)).select("lang", "symbol", same.alias("word"), "n")
    words = staged(words, "phrase-words")
    total = words.filter("symbol is null").agg(F.sum("n")).first()[0] or 0
    found = words.filter("symbol is not null").select(F.col("symbol").alias("s1"), *[F.lit(0).cast("long").alias(s) for s in _SYMBOLS[1:]], F.lit(1).alias("k"), F.col("n").alias("a"), F.col("symbol").alias("key"))
    n_ranges, every = max(1, -(-total // RANGE_WORDS)), found
    for k in range(2, LONGEST + 1):
        shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(found))
        shards = texts.mapInArrow(_count_phrases(k, n_ranges, shared), "part long, automaton binary")
        found = staged(shards.groupBy("part").applyInArrow(_unite(k, least), _COUNTED_SQL), f"phrases-{k}")
        shared.unpersist()
        every = every.unionByName(found)
    return every, words


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), in whole numbers; at most 1000000."""
    whole = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", whole(a) * F.lit(2000000).cast("decimal(8,0)"), whole(l) + whole(r))


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language (all if ``top`` is None).

    A phrase is dropped if one that holds it occurs ``cover`` hundredths as often. Of the longer phrases that hold it
    those one word longer occur most often, so they decide.
    """
    mark = staged_so_far()
    every, words = frequent_phrases(docs, least)
    n_ranges = max(1, -(-every.count() // RANGE_PHRASES))
    ahead = _parts(every, n_ranges, False)
    back = _parts(every, n_ranges, True).select(*_SYMBOLS, *[F.col(f"p{i}").alias(f"q{i}") for i in range(1, LONGEST)], F.col("longer").alias("_longer"))
    df = ahead.join(back, _SYMBOLS)
    covered = F.greatest("longer", "_longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover
    df = df.filter(~covered)
    cuts = []
    for i in range(1, LONGEST):
        # the last k - i words are the rest
        rest = F.coalesce(*[F.when(F.col("k") == i + j, F.col(f"q{j}")) for j in range(1, LONGEST) if i + j <= LONGEST], F.lit(0))
        score = _score(F.col("a"), F.col(f"p{i}"), rest).cast("long")
        cuts.append(F.when(F.col("k") > i, F.struct(score.alias("score"), F.lit(i).alias("i"), F.col(f"p{i}").alias("l"), rest.alias("r"))))
    df = df.withColumn("_cut", F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull())))
    df = df.select(*_SYMBOLS, "k", "a", "_cut.score", "_cut.l", "_cut.r")
    known = words.filter("symbol is not null")
    df = df.join(known.select(F.col("symbol").alias("s1"), "lang", F.col("word").alias("w1")), "s1")
    if top is not None:  # with ties; the words of the others are not needed
        df = df.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("_rank") <= top).drop("_rank")
    df = staged(df, "phrase-scores")
    for i, s in enumerate(_SYMBOLS[1:], 2):
        df = df.join(known.select(F.col("symbol").alias(s), F.col("word").alias(f"w{i}")), s, "left")
    df = df.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, LONGEST + 1)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    df = df.withColumn("rank", F.row_number().over(order).cast("long"))
    df = df if top is None else df.filter(F.col("rank") <= top)
    totals = words.filter("symbol is null").select("lang", "n")
    df = staged(df.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard_between(docs.sparkSession, [*mark, df.staged_at])
    return df


def op11_automaton_collocations(spark, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from p),
g as (
  select lang, k, list_slice(w, i, i + k - 1) as ws
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)
),
f as (select lang, k, ws, array_to_string(ws, ' ') as phrase, count(*) as a from g group by all),
t as (select lang, sum(a) as n from f where k = 1 group by 1),
c as (select * from f where k > 1 and a >= 30),
u as (
  select c.lang, c.phrase, c.k, c.a, cut, x.a as l, y.a as r, (2000000::hugeint * c.a) // (x.a + y.a) as score
  from (select *, unnest(range(1, k)) as cut from c) c
  join f x on x.lang = c.lang and x.k = cut and x.phrase = array_to_string(list_slice(c.ws, 1, cut), ' ')
  join f y on y.lang = c.lang and y.k = c.k - cut and y.phrase = array_to_string(list_slice(c.ws, cut + 1, c.k), ' ')
),
b as (select * from u qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
h as (
  select distinct s.lang, s.phrase from c s
  join (select lang, k, a, j, m, array_to_string(list_slice(ws, j, j + m - 1), ' ') as part
    from (select *, unnest(range(1, k - m + 2)) as j from (select *, unnest(range(2, k)) as m from c))) x
  on x.lang = s.lang and x.m = s.k and x.part = s.phrase and 100::hugeint * x.a >= 80::hugeint * s.a
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a::bigint as a, l::bigint as l, r::bigint as r,
  n::bigint as n, score::bigint as score
from b join t on t.lang = b.lang
where not exists (select 1 from h where h.lang = b.lang and h.phrase = b.phrase)
qualify rank <= 2000
"""
