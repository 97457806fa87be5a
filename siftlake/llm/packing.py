"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` ids; full pieces are sequences
of their own. The others are dealt into groups of a bounded number of pieces,
and each group is packed on several islands. An individual is a packing: its
genes are whole bins. An island's first individuals come from best fit over
shuffled pieces, none from a sorted order. In every generation crossover
injects well-filled bins of one parent into another, drops the bins that hold
an injected piece, and best-fits the documents so displaced, longest first;
mutation empties the worst bins and some others the same way. After each round
the best individuals of an island also go to the next one. An island stops
early only when, after a generation, its best packing meets a lower bound, for
then none is better.

Then the poorly filled bins of all groups are dealt anew, whole bins at a time,
and evolved once more from the packing they have, which mends what dealing into
groups has cost. Every task holds one group; groups grow in number only.

Nulls and odd rows: a null text is an empty one and packs as the closing id
alone; a very long one is cut into pieces and tokenised by itself; rows that
repeat, and pieces of one length, are packed each for itself; a null doc_id is
packed like any other; an empty table packs into none. Of documents only doc_id
and text are read, so other columns cannot clash; ``pack`` keeps the columns of
its pieces, and its own take an underscore where a piece has their name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.text import free_name
from siftlake.llm.tokens import ChunkCoder
from siftlake.session import shipped, staged, table

CAPACITY = 2048
#: Pieces of a group, islands of a group, rounds with migration between them.
GROUP, ISLANDS, ROUNDS = 4096, 2, 2
POPULATION, GENERATIONS = 4, 8
#: Share of bins that a mutation empties beside the poorest tenth.
MUTATION = 0.2
#: Bins filled less than this share are dealt anew at the end.
POOR = 0.97
#: Texts are tokenised in lots of about this many bytes, to bound memory.
LOT = 1 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """The pieces of every document: its ids and the closing id, cut every ``capacity`` ids."""
    tail = np.array([closing], np.uint32)

    def run(batches):
        coder = ChunkCoder(tokenizer)  # goes with the task, so that no memory of it stays in the worker
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            sizes = pc.binary_length(texts).to_pylist()
            ids = batch.column("doc_id").to_pylist()
            rows, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + sizes[end] <= LOT):
                    size += sizes[end]
                    end += 1
                for doc_id, coded in zip(ids[at:end], coder.encode(texts.slice(at, end - at)), strict=True):
                    coded = np.concatenate((coded, tail)).astype("<u4")
                    for p, start in enumerate(range(0, len(coded), capacity)):
                        part = coded[start : start + capacity]
                        rows.append((doc_id, p, start, len(part), zlib.crc32(part.tobytes())))
                at = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return shipped(docs).select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: pieces over half a bin stay apart, and the others fill what room they leave (bound L2)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * np.arange(capacity + 1))))
    half, best = capacity // 2, 0
    for k in range(half + 1):
        # pieces longer than capacity - k; then up to that; then from k to half
        alone = number[-1] - number[capacity - k + 1]
        large, large_sum = number[capacity - k + 1] - number[half + 1], total[capacity - k + 1] - total[half + 1]
        small_sum = total[half + 1] - total[k]
        best = max(best, alone + large + max(0, -(-(small_sum - (large * capacity - large_sum)) // capacity)))
    return int(best)


def best_fit(lengths: np.ndarray, order, bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` into the fullest bin that has room, opening bins as needed; ``bins`` and ``loads`` change."""
    by_room: dict[int, list[int]] = {}
    for b, load in enumerate(loads):
        if load < capacity:
            by_room.setdefault(capacity - load, []).append(b)
    rooms = sorted(by_room)
    for i in order:
        size = int(lengths[i])
        j = bisect_left(rooms, size)
        if j == len(rooms):
            b, room = len(loads), capacity
            loads.append(0)
        else:
            room = rooms[j]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[j]
        bins[i] = b
        loads[b] += size
        if room > size:
            if room - size not in by_room:
                by_room[room - size] = []
                insort(rooms, room - size)
            by_room[room - size].append(b)


def _tidied(bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered from 0 without gaps, and their loads."""
    bins = np.unique(bins, return_inverse=True)[1].astype(np.int32)
    return bins, np.bincount(bins, weights=lengths).astype(np.int64)


def _worth(one: tuple[np.ndarray, np.ndarray], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly."""
    loads = one[1]
    return -len(loads), float(np.mean((loads / capacity) ** 2))


def _refit(lengths, bins, dropped, capacity, rng):
    """Empty the ``dropped`` bins and best-fit their pieces, longest first."""
    out = dropped[bins]
    remap = np.cumsum(~dropped) - 1
    fresh = np.where(out, -1, remap[bins]).astype(np.int32)
    loads = np.bincount(fresh[~out], weights=lengths[~out], minlength=int((~dropped).sum())).astype(int).tolist()
    loose = np.flatnonzero(out)
    loose = loose[np.argsort(-(lengths[loose] + rng.random(len(loose))), kind="stable")]
    best_fit(lengths, loose, fresh, loads, capacity)
    return _tidied(fresh, lengths)


def crossover(lengths, into, donor, capacity, rng):
    """Inject whole bins of ``donor``, fuller ones likelier, into ``into``."""
    bins, loads = donor
    chosen = rng.random(len(loads)) < 0.5 * (loads / capacity) ** 8
    injected = chosen[bins]
    hit = np.zeros(len(into[1]), bool)
    hit[into[0][injected]] = True
    keep = np.where(injected, len(into[1]) + bins, into[0])
    dropped = np.concatenate((hit, np.zeros(len(loads), bool)))
    packed = _tidied_keep(keep, dropped)
    return _refit(lengths, *packed, capacity, rng)


def _tidied_keep(bins: np.ndarray, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, fresh = np.unique(bins, return_inverse=True)
    return fresh.astype(np.int32), dropped[used]


def shuffled_best_fit(lengths: np.ndarray, capacity: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """A first individual: best fit over the pieces in a random order."""
    bins, loads = np.zeros(len(lengths), np.int32), []
    best_fit(lengths, rng.permutation(len(lengths)), bins, loads, capacity)
    return _tidied(bins, lengths)


def mutated(lengths, one, capacity, rng):
    """Empty the poorest tenth of the bins and some others, and best-fit their pieces."""
    bins, loads = one
    poor = loads < np.quantile(loads, 0.1)
    return _refit(lengths, bins, poor | (rng.random(len(loads)) < MUTATION), capacity, rng)


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two best individuals after GENERATIONS, from the seeds and their mutants, or from shuffled best fit."""
    bound = lower_bound(lengths, capacity)
    people = [_tidied(s, lengths) for s in seeds]
    rank = lambda: people.sort(key=lambda p: _worth(p, capacity), reverse=True)
    rank()
    elites = list(people)
    while len(people) < POPULATION:
        people.append(mutated(lengths, elites[0], capacity, rng) if elites else shuffled_best_fit(lengths, capacity, rng))
    rank()
    for _ in range(GENERATIONS):
        children = []
        for _ in range(POPULATION // 2):
            a, b = rng.permutation(3)[:2]
            children.append(mutated(lengths, crossover(lengths, people[a], people[b], capacity, rng), capacity, rng))
        people = people[: POPULATION - len(children)] + children
        rank()
        if len(people[0][1]) <= bound:
            break
    return people[:2]


def _island(capacity: int):
    def run(key, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        columns = ["cell", "island", "n_bins", "worth", "bins"]
        if items.empty:
            return pd.DataFrame(columns=columns)
        items = items.sort_values("item")
        lengths = items["length"].to_numpy(np.int64)
        seeds = [np.frombuffer(b, np.int32) for b in elites["bins"]]
        if not seeds and (items["bin"] >= 0).all():
            seeds = [np.unique(items["bin"].to_numpy(), return_inverse=True)[1].astype(np.int32)]
        rng = np.random.default_rng([int(key[0]) & 0x7FFFFFFF, int(key[1]), len(seeds)])
        best = evolve(lengths, seeds, capacity, rng)
        rows = [(int(key[0]), int(key[1]), len(loads), _worth((bins, loads), capacity)[1], bins.tobytes()) for bins, loads in best]
        return pd.DataFrame(rows, columns=columns)

    return run


_ELITE = "cell long, island int, n_bins int, worth double, bins binary"


def _settle(items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values("item")
    items["bin"] = np.frombuffer(best["bins"].iloc[0], np.int32).astype(np.int64)
    return items[["cell", "item", "length", "bin"]]


def evolve_cells(items: DataFrame, capacity: int, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """From (cell, item, length, bin or -1) to the same rows with the bins of the cell's best packing."""
    spread = shipped(items).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    elites = items.sparkSession.createDataFrame([], _ELITE)
    for r in range(rounds):
        if r:  # each island's best also go to the next one
            moved = elites.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            elites = elites.unionByName(moved)
        elites = spread.groupBy("cell", "island").cogroup(elites.groupBy("cell", "island")).applyInPandas(_island(capacity), _ELITE)
        elites = staged(elites, "pack-elites")
    best = elites.groupBy("cell").agg(F.min(F.struct("n_bins", (-F.col("worth")).alias("worth"), "island", "bins")).alias("b"))
    best = best.select("cell", F.col("b.bins").alias("bins"))
    out = items.groupBy("cell").cogroup(best.groupBy("cell")).applyInPandas(_settle, "cell long, item long, length long, bin long")
    return staged(out, "pack-bins")


def pack(pieces_: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces that have a length of at most ``capacity``; other columns stay."""
    own = pieces_.columns
    rows = pieces_.select(F.struct(*own).alias("_piece"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("item"))
    rows = staged(rows, "pack-pieces")
    part = rows.filter(F.col("length") < capacity).select("item", "length")
    cells = max(1, -(-part.count() // group))
    items = part.select(
        F.pmod(F.xxhash64("item"), F.lit(cells)).alias("cell"), "item", "length", F.lit(-1).cast("long").alias("bin")
    )
    first = evolve_cells(items, capacity)
    # poorly filled bins of all groups, dealt anew as whole bins
    bins = first.groupBy("cell", "bin").agg(F.sum("length").alias("load"), F.count("*").alias("n"))
    poor = staged(bins.filter(F.col("load") < POOR * capacity), "pack-poor")
    again = max(1, -(-(poor.agg(F.sum("n")).first()[0] or 0) // group))
    key = F.col("cell") * F.lit(1 << 24) + F.col("bin")
    loose = first.join(poor.select("cell", "bin"), ["cell", "bin"], "left_semi")
    dealt = loose.select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(again)).alias("cell"), "item", "length", key.alias("bin"))
    second = evolve_cells(dealt, capacity, islands=1, rounds=1)
    done = first.join(poor.select("cell", "bin"), ["cell", "bin"], "left_anti").select("item", key.alias("_seq"))
    done = done.unionByName(second.select("item", (F.lit(1 << 58) + key).alias("_seq")))
    placed = rows.join(done, "item", "left").withColumn("_seq", F.coalesce("_seq", -1 - F.col("item")))
    in_bin = Window.partitionBy("_seq").orderBy("item")
    offset = F.sum("length").over(in_bin) - F.col("length")
    return placed.select(
        *[F.col("_piece").getField(c).alias(c) for c in own],
        F.col("_seq").alias(free_name("sequence_id", own)),
        offset.alias(free_name("offset", own)),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op7_genetic_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
