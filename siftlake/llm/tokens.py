"""Token ids of texts through a public tokenizer, with the ids of white-space chunks remembered.

The tokenizer's own rules never join characters across a space or line break,
so a text's ids are those of its chunks one after another. Arrow splits a lot
of texts and numbers its distinct chunks; those that a worker has seen are
looked up, new ones are joined by spaces and encoded. Words are told apart by
the tokens that end them, other chunks by their offsets. The memory is bounded
in bytes: past ``most_bytes`` it starts afresh, also within a lot, which changes
no result.

So that fewer chunks differ, marks that follow a letter or digit become chunks
of their own, and ASCII letters lower-case: the tokenizer lower-cases and parts
them itself. Texts with combining marks, which a small letter may take up and
its capital not, or with special tokens keep their case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_tokenizers: dict = {}

#: Bytes that a remembered chunk takes beside its text and ids: a string's head, a dictionary's entry, its numbers.
_ENTRY = 180
#: New chunks are encoded so many at a time; longer calls cost more a chunk.
_CALL = 128
#: A mark after a letter or digit, where the tokenizer always parts; letters up to U+00FF stay single letters in lower case.
_MARK = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?])"
#: Texts with one of these keep their case.
_CASED = r"[\x{300}-\x{36F}]|<\|"


class ChunkCoder:
    def __init__(self, path: str, most_bytes: int = 96 << 20):
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
        self.tokenizer, self.most_bytes = _tokenizers[path], most_bytes
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all chunks."""
        self.number: dict[str, int] = {"": 0}
        self.ids, self.begin = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64)
        self.n, self.used, self.bytes = 1, 0, 0

    def _learn(self, new: list[str]) -> None:
        words, others = [], []
        for chunk in new:
            (words if chunk.isalpha() else others).append(chunk)
        for chunks, are_words in ((words, True), (others, False)):
            for at in range(0, len(chunks), _CALL):
                self._learn_part(chunks[at : at + _CALL], are_words)

    def _learn_part(self, part: list[str], are_words: bool) -> None:
        coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        # every run of letters ends with one such token; letters that lower-case to more than letters make further runs
        stops = np.flatnonzero(self.ending[ids]) + 1 if are_words else ()
        if len(stops) != len(part):
            starts = np.array(coded.offsets, np.int64).reshape(-1, 2)[:, 0]
            stops = np.searchsorted(starts, np.cumsum(np.array(list(map(len, part)), np.int64) + 1))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(part) >= len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        self.ids[self.used : self.used + len(ids)] = ids
        # chunk i's ids lie from begin[i] to begin[i + 1]
        self.begin[self.n + 1 : self.n + 1 + len(part)] = self.used + stops
        self.number.update(zip(part, range(self.n, self.n + len(part)), strict=True))
        self.n += len(part)
        self.used += len(ids)
        self.bytes += 4 * len(ids) + sum(map(len, part)) + (_ENTRY + 1) * len(part)

    @staticmethod
    def chunks(texts: pa.Array) -> pa.ListArray:
        """The chunks of each text, which code as the text does."""
        # lower-cased last: Arrow's ascii_lower misreads a slice of a longer array
        texts = pc.replace_substring(pc.replace_substring_regex(texts, _MARK, r"\1 \2"), "\n", " ")
        cased, low = pc.match_substring_regex(texts, _CASED), pc.ascii_lower(texts)
        texts = pc.if_else(cased, texts, low) if pc.any(cased).as_py() else low
        return pc.split_pattern(texts, " ")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow array without nulls."""
        split = self.chunks(texts.cast(pa.large_string()))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [c for c in chunks if c not in self.number]
        if new and self.bytes > self.most_bytes:
            self.clear()
            new = [c for c in chunks if c]
        self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        begin = self.begin[number]
        length = self.begin[number + 1] - begin
        which = coded.indices.to_numpy()
        lengths = length[which]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.ids[np.repeat(begin[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        at = ends[offsets - offsets[0]]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
