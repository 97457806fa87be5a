"""Hashing of words in Arrow batches, vectorised over the bytes of a text.

Words are hashed straight from UTF-8: a prefix sum of byte * p**position modulo
2**64 gives every word's polynomial hash in one pass, which a 64-bit finaliser
then mixes. Long texts go in parts, so memory is a few arrays of a part's length
beside the hashes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: all but white space, and letters, digits and non-ASCII only.
ANY_WORD = np.ones(256, dtype=bool)
ANY_WORD[[32, 9, 10, 11, 12, 13]] = False
PLAIN_WORD = np.zeros(256, dtype=bool)
PLAIN_WORD[48:58] = PLAIN_WORD[97:123] = PLAIN_WORD[128:] = True

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i up to n at least; grown as longer texts come."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column, empty for null; no copies."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b]


def word_spans(text: np.ndarray, kind: np.ndarray = ANY_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes, and their hashes; a few arrays of the text's length are held."""
    text = LOWER[text]
    edge = np.diff(np.concatenate(([0], kind[text].view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_parts(text: np.ndarray, kind: np.ndarray = ANY_WORD, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """The bounds of parts of a text, of about ``size`` bytes, that end between words."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text):
            gaps = np.flatnonzero(~kind[LOWER[text[end : end + size]]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + size, len(text))
        yield at, end
        at = end


def word_hash_parts(text: np.ndarray, kind: np.ndarray = ANY_WORD, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The hashes of the words of a text in order, in parts of about ``size`` bytes that end between words."""
    for at, end in text_parts(text, kind, size):
        yield word_spans(text[at:end], kind)[2]


def word_hashes(text: np.ndarray, kind: np.ndarray = ANY_WORD) -> np.ndarray:
    """The 64-bit hashes of the words of a text in order, A-Z taken as a-z."""
    parts = list(word_hash_parts(text, kind))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    run = min(size, len(words))
    out = words[: len(words) - run + 1].copy()
    for j in range(1, run):
        out = out * np.uint64(_P) + words[j : len(words) - run + 1 + j]
    return np.unique(mixed(out + np.uint64(run)))
