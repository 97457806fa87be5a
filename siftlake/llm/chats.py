"""Chat formatting by quotation linking.

A message's lines are parsed by quote level, the number of leading '>' signs.
Lines of level 0 are its own text; a run of lines of one level is a quoted
passage. A message's own text, each of its runs between quotes and each quoted
passage are hashed, normalised (white space collapsed, lower case), as a whole,
by paragraph, by line, and by runs of RUN words, of which the least hash of
every WINNOW neighbours is kept, so that a text and a part of it keep the same
ones wherever lines were broken anew. Joining quotes to originals of the same
conversation by hash links a passage where any of its parts is found: by the
whole before paragraphs before lines before runs of words. The original of a
part is the first message that holds it; where the best parts of a passage have
several originals, the one of most parts counts, then the latest. A part of
SHORT words or more is found wherever it was cut. A passage of fewer words is
looked up whole too: messages of its conversation give out all runs of as many
words, so it is found wherever it stands. Each message's parent is the latest
earlier message linked at the lowest level that is found. Parent links are
followed by pointer doubling, and the messages come out in reply order: by
conversation and thread, every reply behind what it answers and before what
came later, without quotes, as role-tagged text, with the place in the
conversation as a column. Branches are told apart down to LEVELS replies; below
that the messages of a branch come in the order of their turns.

First messages are found by a map-side combined minimum, so a part that many
messages share is one row in the join. Only conversations that quote at all
take part, and only with the short lengths that they quote. Conversations and
threads are never gathered in one task; their order is a range sort of keys
without texts, and places are counted by its partitions.

Nulls and odd rows: a null text stays null and quotes nothing, an empty one
stays empty; a very long text is parsed in its row; a null conv_id or turn links
with nothing; rows that repeat a turn keep their places beside each other,
share a parent and count their own quotes; a passage that a message quotes
twice counts twice; a quote without an original is removed all the same and
counted as unlinked; without a role column, or with a null role, the tag is
empty; an empty table gives an empty table. Own columns keep their names and
values, but for text; a result whose name is taken carries an underscore.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlake.llm.text import free_name
from siftlake.session import discard, shipped, staged, table

#: Words of a run, and neighbouring runs of which one is kept.
RUN, WINNOW = 6, 6
#: Words from which a passage surely holds a run that is kept.
SHORT = RUN + WINNOW - 1
#: Messages that a row of ``transcripts`` holds at most.
MOST_MESSAGES = 256
#: Replies down to which the order follows the branches.
LEVELS = 32

_LEVEL = re.compile(r"^((?:[ \t]*>)*)[ \t]?(.*)$", re.S)
#: What separates paragraphs.
_BLANK = re.compile(r"\n\s*\n")
#: A line that introduces a quotation, dropped where a quotation follows.
_INTRO = re.compile(r"^[^>\n]{1,200}\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split())


def _hash(passage: str) -> int:
    return xxhash.xxh64_intdigest(passage.encode()) - 2**63


def kept_runs(words: list[str]) -> list[str]:
    """Of the runs of RUN words those with the least hash among WINNOW neighbours; of fewer runs the least of all."""
    runs = [" ".join(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]
    hashes = [_hash(r) for r in runs]
    kept = {min(range(i, min(i + WINNOW, len(runs))), key=hashes.__getitem__) for i in range(max(len(runs) - WINNOW, 0) + 1)} if runs else set()
    return [runs[i] for i in sorted(kept)]


def parts(passage: str) -> dict[str, int]:
    """The normalised whole (3), paragraphs (2), lines (1) and kept runs of words (0) of a passage, each with the highest of these ranks it has."""
    out: dict[str, int] = {}
    for rank, pieces in (3, [passage]), (2, _BLANK.split(passage)), (1, passage.split("\n")):
        for piece in map(normalised, pieces):
            if piece:
                out.setdefault(piece, rank)
    for run in kept_runs(normalised(passage).split()):
        out.setdefault(run, 0)
    return out


def short_run(words: list[str]) -> int:
    """The hash of a short passage or a run of as many words; apart from those of parts."""
    return _hash("\0" + " ".join(words))


def quote_parts(passage: str) -> tuple[int, list[tuple[int, int]]]:
    """The number of words of a passage that is short, else null, and (rank, hash) of its parts; a short one whole ranks last."""
    hashed = [(rank, _hash(part)) for part, rank in parts(passage).items()]
    words = normalised(passage).split()
    return (len(words), [*hashed, (-1, short_run(words))]) if len(words) < SHORT else (None, hashed)


def parse(text: str) -> tuple[str, list[str], list[tuple[int, int | None, list[tuple[int, int]]]]]:
    """A message's own text, its runs between quotes, and (level, number of words if short, (rank, hash) of its parts) of each quoted passage."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks, body = _LEVEL.match(line).groups()
        level = marks.count(">")
        body = line if not level else body
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(body)
    for (level, lines), (following, _) in zip(runs, runs[1:], strict=False):
        if not level and following and lines and _INTRO.match(lines[-1]):
            lines.pop()
    quotes = [(level, "\n".join(lines)) for level, lines in runs if level]
    own_runs = ["\n".join(lines) for level, lines in runs if not level]
    own = "\n".join(own_runs)
    own = own.strip("\n") if quotes else own
    hashed = [(level, *quote_parts(q)) for level, q in quotes if q.strip()]
    return own, own_runs if quotes else [], hashed


def passages(own: str, runs: list[str], lengths: list[int]) -> list[int]:
    """The hashes of all that a quote of a message may hold: parts of its own text and of its runs, and all runs of as many words as short quotes have."""
    found = {_hash(part) for passage in {own, *runs} for part in parts(passage)}
    words = normalised(own).split()
    found |= {short_run(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)}
    return sorted(found)


_PARSED = "own string, runs array<string>, quotes array<struct<level:int,words:int,parts:array<struct<rank:int,hash:bigint>>>>"


def parsed(messages: DataFrame) -> DataFrame:
    """own, runs and quotes of every message, beside a number of its row, conv_id, turn and its columns but the text as the struct _m."""
    columns = ["_m", "_row", "conv_id", "turn"]
    rest = F.struct(*[c for c in messages.columns if c != "text"]).alias("_m")
    source = messages.select(rest, F.monotonically_increasing_id().alias("_row"), "conv_id", "turn", F.col("text").alias("_text"))

    def run(batches):
        part = pa.struct([("rank", pa.int32()), ("hash", pa.int64())])
        kinds = pa.list_(pa.string()), pa.list_(pa.struct([("level", pa.int32()), ("words", pa.int32()), ("parts", pa.list_(part))]))
        for batch in batches:
            rows = [(None, [], []) if t is None else parse(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in columns],
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], kinds[0]),
                    pa.array([[{"level": q[0], "words": q[1], "parts": [{"rank": k, "hash": h} for k, h in q[2]]} for q in r[2]] for r in rows], kinds[1]),
                ],
                [*columns, "own", "runs", "quotes"],
            )

    fields = [f for f in source.schema.fields if f.name != "_text"]
    return shipped(source).mapInArrow(run, StructType([*fields, *StructType.fromDDL(_PARSED).fields]))


def _hashed(batches):
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("own", "runs", "lengths")], strict=True)
        hashes = pa.array([passages(own, runs, lengths) if own else [] for own, runs, lengths in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), hashes], ["conv_id", "turn", "passages"])


def linked(messages: DataFrame) -> DataFrame:
    """_row, conv_id, turn, n_linked and nearest (-level, original) for rows with a quote of an earlier message, each quote told by its place."""
    quotes = messages.select("_row", "conv_id", "turn", F.posexplode("quotes").alias("place", "q"))
    quoting = quotes.groupBy("conv_id").agg(F.collect_set("q.words").alias("lengths"))
    originals = messages.filter("turn is not null").select("conv_id", "turn", "own", "runs").join(quoting, "conv_id")
    types = dict(originals.dtypes)
    schema = f"conv_id {types['conv_id']}, turn {types['turn']}, passages array<bigint>"
    originals = shipped(originals).mapInArrow(_hashed, schema)
    originals = originals.select("conv_id", "turn", F.explode("passages").alias("hash"))
    originals = originals.groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quotes = quotes.select("_row", "conv_id", "turn", "place", "q.level", F.explode("q.parts").alias("p"))
    quotes = quotes.select("_row", "conv_id", "turn", "place", "level", "p.rank", "p.hash")
    found = quotes.join(originals, ["conv_id", "hash"]).filter(F.col("original") < F.col("turn"))
    place = ["_row", "conv_id", "turn", "place", "level"]
    votes = found.groupBy(*place, "rank", "original").agg(F.count("*").alias("votes"))
    found = votes.groupBy(*place).agg(F.max(F.struct("rank", "votes", "original")).alias("best"))
    nearest = F.max(F.struct((-F.col("level")).alias("near"), F.col("best.original").alias("original")))
    return found.groupBy("_row", "conv_id", "turn").agg(nearest.alias("nearest"), F.count("*").alias("n_linked"))


def parents(links: DataFrame) -> DataFrame:
    """conv_id, turn and parent for turns that quote an earlier one; rows that repeat a turn have one parent."""
    return links.groupBy("conv_id", "turn").agg(F.max("nearest")["original"].alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth and the first turns of the path from the root, by pointer doubling over the parent links."""
    start = links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.array("turn").alias("path"))
    reach = staged(start, "threads")
    while True:
        onward = reach.select(
            "conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"), F.col("path").alias("before")
        )
        joined = reach.join(onward, ["conv_id", "root"], "left")
        if joined.filter(F.col("further").isNotNull()).isEmpty():
            return reach
        path = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.slice(F.concat("before", "path"), 1, LEVELS))
        done, reach = reach, staged(
            joined.select(
                "conv_id", "turn", F.coalesce("further", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), path.alias("path"),
            ),
            "threads",
        )
        discard(done)


def reply_places(keys: DataFrame, order: list) -> DataFrame:
    """``keys`` with reply_pos, a row's place in its conversation by ``order``, from 0 without gaps.

    Keys are range-sorted and numbered by partition and place within it. The
    sizes of partitions, as many rows as there are partitions, turn that into
    a rank over all, and the least rank of a conversation into a place.
    """
    at = F.monotonically_increasing_id()
    sorted_ = staged(keys.orderBy("conv_id", *order).select("*", at.alias("_at")), "chat-order")
    sorted_ = sorted_.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = sorted_.join(F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))), "_part")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_at", "_part", "_nth", "_before")
    starts = ranked.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_rank").alias("_start"))
    placed = ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return placed.withColumn("reply_pos", F.col("_rank") - F.col("_start")).drop("_rank", "_start", "_conv")


def conversations(messages: DataFrame) -> DataFrame:
    """Messages in reply order, without quotes, with parent, root, depth, place in the conversation and role-tagged chat text; own columns stay."""
    own = messages.columns
    rows = staged(parsed(messages), "chats")
    links = staged(linked(rows), "chat-links")
    answers = staged(parents(links), "chat-parents")
    known = threads(answers).join(answers, ["conv_id", "turn"])
    role = F.coalesce(F.col("_m.role").cast("string"), F.lit("")) if "role" in [c.lower() for c in own] else F.lit("")
    keys = rows.select("_row", "conv_id", "turn", role.alias("_role"), F.xxhash64("own").alias("_text"))
    keys = keys.join(known, ["conv_id", "turn"], "left").join(links.select("_row", "n_linked"), "_row", "left")
    root = F.coalesce("root", "turn")
    order = [root, F.coalesce("path", F.array().cast("array<bigint>")), "turn", "_role", "_text", "_row"]
    places = reply_places(keys, order).select("_row", "parent", root.alias("root"), "depth", "n_linked", "reply_pos")
    chat = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("own", F.lit("")), F.lit("\n"))
    results = {
        "parent_turn": F.col("parent"),
        "root_turn": F.col("root"),
        "depth": F.coalesce("depth", F.lit(0)).cast("long"),
        "n_quotes": F.size("quotes").cast("long"),
        "n_unlinked": (F.size("quotes") - F.coalesce("n_linked", F.lit(0))).cast("long"),
        "reply_pos": F.col("reply_pos"),
        "chat_text": chat,
    }
    text = F.col("own").cast(dict(messages.dtypes)["text"])
    return rows.join(places, "_row").orderBy("conv_id", "reply_pos").select(
        *[text.alias(c) if c == "text" else F.col("_m").getField(c).alias(c) for c in own],
        *[x.alias(free_name(c, own)) for c, x in results.items()],
    )


def transcripts(messages: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """conv_id, part, n_messages and chat_text: one row a conversation, its messages in reply order; one of more than ``most`` messages goes on in further parts."""
    place, chat = (F.col(free_name(c, messages.columns)) for c in ("reply_pos", "chat_text"))
    part = F.floor(place / most).cast("long").alias("part")
    told = F.array_sort(F.collect_list(F.struct(place.alias("at"), chat.alias("chat"))))
    grouped = conversations(messages).groupBy("conv_id", part).agg(told.alias("_told"))
    text = F.array_join(F.transform("_told", lambda x: x["chat"]), "")
    return grouped.select("conv_id", "part", F.size("_told").cast("long").alias("n_messages"), text.alias("chat_text"))


def op6_quote_threads(spark, sf_dir: str) -> DataFrame:
    """All conversations' messages in reply order."""
    return conversations(table(spark, sf_dir, "conversations"))
