"""Weighted acyclic automata over phrases, as arrays.

A phrase is a run of symbols, 64-bit numbers that are not zero. An automaton has
one layer of arcs for each place in a phrase; a state is a slice of its layer's
arcs, in the order of their labels. An arc carries the weight of the phrase that
ends with it, zero if none does. Automata are built from sorted blocks of
phrases, one after another: what lies left of the last phrase is closed and
never changes again. Then equal states are merged, from the last layer up.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from siftlake.llm.hashing import mixed

_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ordered(symbols: np.ndarray) -> np.ndarray:
    """The order of the phrases (rows of symbols, zeros after short ones)."""
    return np.lexsort(symbols.T[::-1])


def summed(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each phrase once, in order, with the sum of its weights."""
    if not len(symbols):
        return symbols, weights
    order = ordered(symbols)
    symbols, weights = symbols[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], (symbols[1:] != symbols[:-1]).any(axis=1))))
    return symbols[first], np.add.reduceat(weights, first)


@dataclass
class Layer:
    """State i has the arcs begin[i] to begin[i + 1]; they lead to states of the next layer."""

    begin: np.ndarray
    label: np.ndarray
    target: np.ndarray
    weight: np.ndarray

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of some states, and for each the place of its state in ``states``."""
        n = self.begin[states + 1] - self.begin[states]
        whose = np.repeat(np.arange(len(states)), n)
        return self.begin[states][whose] + np.arange(len(whose)) - (np.cumsum(n) - n)[whose], whose

    def find(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The arc of each state with a label, -1 if it has none: binary search in all slices at once."""
        if not len(self.label):
            return np.full(len(states), -1)
        low, high = self.begin[states].copy(), self.begin[states + 1].copy()
        end = high.copy()
        while (low < high).any():
            mid = (low + high) // 2
            less = (low < high) & (self.label[np.minimum(mid, len(self.label) - 1)] < labels)
            low = np.where(less, mid + 1, low)
            high = np.where(less, high, np.where(low < high, mid, high))
        at = np.minimum(low, len(self.label) - 1)
        return np.where((low < end) & (self.label[at] == labels), at, -1)


class PhraseAutomaton:
    def __init__(self, layers: list[Layer]):
        self.layers = layers

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases with a weight, in order, and their weights."""
        k, out, heads = len(self.layers), [], []
        states, prefix = np.zeros(1, np.int64), np.zeros((1, k), np.uint64)
        for d, layer in enumerate(self.layers):
            arcs, whose = layer.arcs(states)
            prefix = prefix[whose]
            prefix[:, d] = layer.label[arcs]
            ends = layer.weight[arcs] > 0
            heads.append(prefix[ends])
            out.append(layer.weight[arcs][ends])
            states = layer.target[arcs]
        symbols, weights = np.concatenate(heads), np.concatenate(out)
        if sum(len(h) > 0 for h in heads) > 1:
            order = ordered(symbols)
            symbols, weights = symbols[order], weights[order]
        return symbols, weights

    def composed(self, query: PhraseAutomaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query's phrases, the weights here of each phrase's beginnings (a column for each length), and the largest weight of a phrase one symbol longer.

        Both automata are walked together, layer by layer, over pairs of their
        states; a beginning that is unknown here weighs 0.
        """
        k = len(self.layers)
        mine, theirs = np.zeros(1, np.int64), np.zeros(1, np.int64)
        prefix, found = np.zeros((1, k), np.uint64), np.zeros((1, k), np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for d, (layer, asked) in enumerate(zip(self.layers, query.layers, strict=True)):
            arcs, whose = asked.arcs(theirs)
            prefix, found = prefix[whose], found[whose]
            prefix[:, d] = asked.label[arcs]
            at = np.where(mine[whose] >= 0, layer.find(np.maximum(mine[whose], 0), asked.label[arcs]), -1)
            known = at >= 0
            found[:, d] = np.where(known, layer.weight[at] if len(layer.weight) else 0, 0)
            mine = np.where(known, layer.target[at] if len(layer.target) else 0, -1)
            theirs = asked.target[arcs]
            longer = np.zeros(len(arcs), np.int64)
            if d + 1 < k:
                after = self.layers[d + 1]
                best = np.zeros(len(after.begin) - 1, np.int64)
                full = after.begin[1:] > after.begin[:-1]
                if full.any():
                    best[full] = np.maximum.reduceat(after.weight, after.begin[:-1][full])
                longer = np.where(known, best[np.maximum(mine, 0)] if len(best) else 0, 0)
            ends = asked.weight[arcs] > 0
            out.append((prefix[ends], found[ends], longer[ends]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def to_bytes(self) -> bytes:
        out = [struct.pack("<B", len(self.layers))]
        for x in self.layers:
            for a in (np.diff(x.begin), x.label, x.target, x.weight):
                kind = np.uint64 if a is x.label else np.min_scalar_type(int(a.max(initial=0)))
                out += [struct.pack("<BI", np.dtype(kind).itemsize, len(a)), a.astype(kind).tobytes()]
        return b"".join(out)

    @staticmethod
    def from_bytes(data: bytes) -> PhraseAutomaton:
        layers, at = [], 1
        for _ in range(data[0]):
            parts = []
            for _ in range(4):
                size, n = struct.unpack_from("<BI", data, at)
                parts.append(np.frombuffer(data, f"<u{size}", n, at + 5))
                at += 5 + size * n
            degree, label, target, weight = parts
            begin = np.concatenate(([0], np.cumsum(degree.astype(np.int64))))
            layers.append(Layer(begin, label, target.astype(np.int64), weight.astype(np.int64)))
        return PhraseAutomaton(layers)


class Builder:
    """Builds an automaton of phrases of up to k symbols from blocks that follow each other in order, each phrase once."""

    def __init__(self, k: int):
        self.k, self.last = k, None
        self.label: list[list[np.ndarray]] = [[] for _ in range(k)]
        self.owner: list[list[np.ndarray]] = [[] for _ in range(k)]
        self.weight: list[list[np.ndarray]] = [[] for _ in range(k)]
        self.n_arcs = [0] * k

    def add(self, symbols: np.ndarray, weights: np.ndarray) -> Builder:
        """A block: rows of k symbols, with zeros after shorter phrases."""
        if not len(symbols):
            return self
        before = np.zeros((1, self.k), np.uint64) if self.last is None else self.last
        fresh = np.concatenate((before, symbols[:-1])) != symbols
        fresh[0] |= self.last is None
        changed = np.logical_or.accumulate(fresh, axis=1)  # the beginning up to this symbol is another one than the row's before
        size = (symbols != 0).sum(axis=1)
        arc = None
        for d in range(self.k):
            here = np.flatnonzero(changed[:, d] & (size > d))
            # the arc that each row's beginning of d symbols ended with owns the arcs behind it
            self.owner[d].append(arc[here] if d else np.zeros(len(here), np.int64))
            self.label[d].append(symbols[here, d])
            ends = np.where(size[here] == d + 1, weights[here], 0)
            self.weight[d].append(ends)
            new = np.zeros(len(symbols), np.int64)
            new[here] = 1
            arc = self.n_arcs[d] - 1 + np.cumsum(new)
            self.n_arcs[d] += len(here)
        self.last = symbols[-1:].copy()
        return self

    def built(self) -> PhraseAutomaton:
        """The automaton, with equal states merged."""
        layers: list[Layer] = []
        state_of = np.zeros(self.n_arcs[-1], np.int64)  # behind the last layer there is one state, without arcs
        for d in reversed(range(self.k)):
            n_states = self.n_arcs[d - 1] if d else 1
            label, owner, weight = (np.concatenate(x[d]) if x[d] else np.zeros(0, t) for x, t in ((self.label, np.uint64), (self.owner, np.int64), (self.weight, np.int64)))
            begin = np.searchsorted(owner, np.arange(n_states + 1))
            layer = Layer(begin, label, state_of, weight)
            layer, state_of = _merged(layer) if d else (layer, None)
            layers.append(layer)
        return PhraseAutomaton(layers[::-1])


def _merged(layer: Layer) -> tuple[Layer, np.ndarray]:
    """The layer with one of each kind of state, and each old state's new number."""
    n = np.diff(layer.begin)
    place = (np.arange(len(layer.label)) - np.repeat(layer.begin[:-1], n)).astype(np.uint64)
    arc = mixed(layer.label * _PRIMES[0] + layer.target.astype(np.uint64) * _PRIMES[1] + layer.weight.astype(np.uint64) * _PRIMES[2] + place)
    sums = []
    for x in (arc, mixed(arc + _PRIMES[1])):  # 128 bits tell states apart
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        sums.append(total[layer.begin[1:]] - total[layer.begin[:-1]])
    order = np.lexsort((sums[1], sums[0], n))
    keys = [x[order] for x in (n, *sums)]
    differs = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))) if len(order) else np.zeros(0, bool)
    number = np.zeros(len(n), np.int64)
    number[order] = np.cumsum(differs) - 1
    kept = order[differs]
    arcs, _ = layer.arcs(kept)
    begin = np.concatenate(([0], np.cumsum(n[kept])))
    return Layer(begin, layer.label[arcs], layer.target[arcs], layer.weight[arcs]), number


def united(automata: list[PhraseAutomaton], k: int, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of several automata in order with their summed weights; about ``at_once`` are held beside the sums."""
    held, n, done = [], 0, (np.zeros((0, k), np.uint64), np.zeros(0, np.int64))
    for i, a in enumerate(automata):
        held.append(a.paths())
        n += len(held[-1][1])
        if n >= at_once or i == len(automata) - 1:
            done = summed(*[np.concatenate(x) for x in zip(done, *held, strict=True)])
            held, n = [], 0
    return done
