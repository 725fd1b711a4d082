"""Elias-Fano sequences and linked n-gram tries over flat buffers.

A monotone sequence of n numbers below u is held as its low bits, packed, and
its high parts in unary in a bit vector with one count per 64-bit word: about
2 + log2(u / n) bits a number plus the counts.  Numbers with an equal high part
are neighbours, so a successor search selects two zeros of the bit vector and
then compares low bits of the few numbers between them.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
WORD = np.uint64(64)
CHUNK = 1 << 16  # queries at a time, so that the arrays stay in cache


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` (from 0) in each word."""
    place = np.zeros(len(word), np.uint64)
    rank = rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (word >> place) & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = rank >= count
        rank = np.where(up, rank - count, rank)
        place = np.where(up, place + np.uint64(width), place)
    return place.astype(np.int64)


class EliasFano:
    """A monotone sequence, read from ``parts`` of a buffer."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ranks = n, bits, low, high, ranks
        self.zeros = np.arange(len(ranks), dtype=np.int64) * 64 - ranks.astype(np.int64)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        top = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(top[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, top >> 6, ONE << (top & 63).astype(np.uint64))
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))).astype(np.uint32)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + np.uint64(bits) > WORD
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (WORD - shift[spill]))
        return EliasFano(n, bits, low, high, ranks)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.uint64)
        at = index * self.bits
        w, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[w] >> shift
        part = np.where(shift > 0, part | (self.low[w + 1] << ((WORD - shift) & np.uint64(63))), part)
        return part & np.uint64((1 << self.bits) - 1)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The numbers at ``index``."""
        index = index.astype(np.int64)
        word = np.searchsorted(self.ranks, index, side="right") - 1
        top = (word << 6) + _select_in_word(self.high[word], index - self.ranks[word]) - index
        return top.astype(np.uint64) << np.uint64(self.bits) | self._low(index)

    def _below(self, part: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``part``."""
        k = np.minimum(part, self.zeros[-1]) - 1
        word = np.searchsorted(self.zeros, k, side="right") - 1
        found = (word << 6) + _select_in_word(~self.high[np.minimum(word, len(self.high) - 1)], k - self.zeros[word]) - k
        return np.where(part <= 0, 0, np.minimum(found, self.n))

    def _find(self, values: np.ndarray, begin: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
        values = values.astype(np.uint64)
        part = (values >> np.uint64(self.bits)).astype(np.int64)
        lo, stop = self._below(part), self._below(part + 1)
        if begin is not None:
            lo, stop = np.maximum(lo, begin), np.minimum(stop, end)
        hi, want = stop.copy(), values & np.uint64((1 << self.bits) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        place = np.full(len(values), -1)
        there = np.flatnonzero(lo < stop)
        hit = there[self._low(lo[there]) == want[there]]
        place[hit] = lo[hit]
        return place

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value (between ``begin`` and ``end``), -1 where it is not there."""
        if not self.n or not len(values):
            return np.full(len(values), -1)
        cut = [slice(a, a + CHUNK) for a in range(0, len(values), CHUNK)]
        return np.concatenate([self._find(values[c], *(None if x is None else x[c] for x in (begin, end))) for c in cut])

    def dump(self) -> list[np.ndarray]:
        head = np.array([self.n, self.bits, len(self.low), len(self.high), len(self.ranks)], np.uint64)
        ranks = np.zeros(-(-len(self.ranks) // 2), np.uint64)
        ranks.view(np.uint32)[: len(self.ranks)] = self.ranks
        return [head, self.low, self.high, ranks]

    @staticmethod
    def load(image: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """From 64-bit words of an image, read in place, and where the next part begins."""
        n, bits, n_low, n_high, n_ranks = (int(x) for x in image[at : at + 5])
        at += 5
        low, high = image[at : at + n_low], image[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        words = -(-n_ranks // 2)
        return EliasFano(n, bits, low, high, image[at : at + words].view(np.uint32)[:n_ranks]), at + words


class Trie:
    """A trie of three levels: first words, their successors, and the successors of those pairs.

    ``roots`` are sorted word numbers.  ``seconds`` are stored relative to their
    root: root's place times ``span`` plus the word number, which is monotone;
    ``thirds`` likewise relative to their pair.  ``first_second`` and
    ``first_third`` are monotone pointers to where a node's successors begin.
    ``values`` holds a quantised number for each pair and each triple.
    """

    def __init__(self, span: int, roots: EliasFano, first_second: EliasFano, seconds: EliasFano, first_third: EliasFano, thirds: EliasFano, pair_values: np.ndarray, triple_values: np.ndarray):
        self.span, self.roots, self.first_second, self.seconds, self.first_third, self.thirds = span, roots, first_second, seconds, first_third, thirds
        self.values = (pair_values, triple_values)

    @staticmethod
    def build(u: np.ndarray, v: np.ndarray, pair_values: np.ndarray, parent: np.ndarray, w: np.ndarray, triple_values: np.ndarray, span: int) -> Trie:
        """From sorted pairs (u, v) and triples (place of their pair, w) sorted likewise."""
        new = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
        root = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(u))))
        seconds = root.astype(np.uint64) * np.uint64(span) + v.astype(np.uint64)
        thirds = parent.astype(np.uint64) * np.uint64(span) + w.astype(np.uint64)
        first = np.searchsorted(parent, np.arange(len(u) + 1))
        return Trie(
            span,
            EliasFano.build(u[new], span),
            EliasFano.build(np.append(new, len(u)), len(u) + 1),
            EliasFano.build(seconds, max(1, len(new)) * span),
            EliasFano.build(first, len(w) + 1),
            EliasFano.build(thirds, max(1, len(u)) * span),
            pair_values,
            triple_values,
        )

    @staticmethod
    def _relative(place: np.ndarray, pointers: EliasFano, level: EliasFano, keys: np.ndarray, span: int) -> np.ndarray:
        """Place in ``level`` of the successor with each key, among those of the node at ``place``; -1 for none."""
        known, which = np.unique(place, return_inverse=True)
        node = np.maximum(known, 0)
        if not level.n:
            return np.full(len(keys), -1)
        begin, end = pointers.get(node).astype(np.int64), pointers.get(node + 1).astype(np.int64)
        end = np.where(known < 0, begin, end)
        return level.find(np.maximum(place, 0).astype(np.uint64) * np.uint64(span) + keys.astype(np.uint64), begin[which], end[which])

    def find_pairs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Place of each pair, -1 for none."""
        known, which = np.unique(u, return_inverse=True)
        return self._relative(self.roots.find(known)[which], self.first_second, self.seconds, v, self.span)

    def find_triples(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place of each triple, given the places of their pairs; -1 for none."""
        return self._relative(pair, self.first_third, self.thirds, w, self.span)

    def dump(self) -> bytes:
        padded = [np.pad(x.astype(np.uint16), (0, -len(x) % 4)).view(np.uint64) for x in self.values]
        head = np.array([self.span, *(n for x, p in zip(self.values, padded, strict=True) for n in (len(x), len(p)))], np.uint64)
        parts = (self.roots, self.first_second, self.seconds, self.first_third, self.thirds)
        return b"".join(x.tobytes() for x in [head, *padded, *(y for p in parts for y in p.dump())])

    @staticmethod
    def load(buffer: bytes | memoryview) -> Trie:
        """From a flat image, whose levels are read in place (the buffer may be a memory map)."""
        image = np.frombuffer(buffer, np.uint64)
        span, n2, w2, n3, w3 = (int(x) for x in image[:5])
        pair, triple = image[5 : 5 + w2].view(np.uint16)[:n2], image[5 + w2 : 5 + w2 + w3].view(np.uint16)[:n3]
        at, parts = 5 + w2 + w3, []
        for _ in range(5):
            part, at = EliasFano.load(image, at)
            parts.append(part)
        return Trie(span, *parts, pair, triple)
