"""Elias-Fano sequences and one level of an n-gram trie, as layouts of 64-bit words that a memory map serves as they are."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class EliasFano:
    """A non-decreasing sequence of n integers below u in n * (2 + log2(u / n)) bits.

    Layout, 64-bit words: n, bits of a low part, words of the low parts, words of the high parts; then both parts.
    A value's high part, added to its place, is a set bit of the high words; low parts lie side by side.
    """

    def __init__(self, words: np.ndarray):
        self.n, self.bits, n_low, n_high = (int(x) for x in words[:4])
        self.low, self.high = words[4 : 4 + n_low], words[4 + n_low : 4 + n_low + n_high]
        self.size = 4 + n_low + n_high
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])  # the directory: set bits before each word
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> np.ndarray:
        v = np.asarray(values, _U)
        n = len(v)
        u = int(v[-1]) + 1 if n else 1
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, _U)
        if bits:
            part = v & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            # parts of at most 64 bits: one begins in every word up to the last, and at most one reaches into the next
            first = -(-64 * np.arange(int(word[-1]) + 1) // bits)
            low[: len(first)] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift > _U(64 - bits))
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
        top = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        set_bits = np.zeros(64 * ((int(top[-1]) + 2 if n else 1) // 64 + 1), bool)
        set_bits[top] = True
        high = np.packbits(set_bits, bitorder="little").view(_U)
        return np.concatenate([np.array([n, bits, len(low), len(high)], _U), low, high])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        upper = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (self.low[word] >> shift | upper) & _U((1 << self.bits) - 1)

    @staticmethod
    def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of set bit number ``rank`` of each word, by halving."""
        at, w, left = np.zeros(len(words), np.int64), words.copy(), rank.copy()
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(w & _U((1 << half) - 1)).astype(np.int64)
            up = left >= n
            left -= np.where(up, n, 0)
            at += np.where(up, half, 0)
            w = np.where(up, w >> _U(half), w)
        return at

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Bit place of set (or clear) bit number k of the high words."""
        count = self.zeros if zero else self.ones
        word = np.searchsorted(count, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        w = self.high[word]
        return word * 64 + self._in_word(~w if zero else w, k - count[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self._select(i, False) - i).astype(_U) << _U(self.bits) | self._low(i)

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value not below each x (n if none): the run of x's high part is found by its zeros, and searched by low parts."""
        x = np.asarray(x, _U)
        h = (x >> _U(self.bits)).astype(np.int64)
        known = h < self.zeros[-1]  # high parts that occur or lie below one that does
        hk = np.where(known, h, 0)
        before = np.maximum(hk - 1, 0)
        lo = np.where(hk > 0, self._select(before, True) - before, 0)
        hi = self._select(hk, True) - hk
        lo, hi = np.where(known, np.minimum(lo, self.n), self.n), np.where(known, np.minimum(hi, self.n), self.n)
        want = x & _U((1 << self.bits) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            below = open_ & (self._low(np.minimum(mid, max(self.n - 1, 0))) < want)
            lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return lo

    def values(self) -> np.ndarray:
        """The whole sequence: the places of the set bits give the high parts."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        at = np.arange(self.n)
        return (ones - at).astype(_U) << _U(self.bits) | self._low(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 if absent.  Many asked at once: the sequence is read through once and searched; few: each by its own high part."""
        x = np.asarray(x, _U)
        if not self.n:
            return np.full(len(x), -1, np.int64)
        if len(x) * 8 >= self.n:
            v = self.values()
            at = np.minimum(np.searchsorted(v, x), self.n - 1)
            return np.where(v[at] == x, at, -1)
        at = self.next_geq(x)
        ok = at < self.n
        ok[ok] = self.get(at[ok]) == x[ok]
        return np.where(ok, at, -1)


#: Codes per power of ten of a probability; 16 bits reach down to 1e-16, and anything smaller is held there.
STEPS = 4096


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities in (0, 1]: 1 for one, a step for each 1 / ``STEPS`` of a power of ten below; 0 is left for what is absent."""
    return (1 + np.clip(np.round(-np.log10(np.asarray(p, np.float64)) * STEPS), 0, 65534)).astype(np.uint16)


#: The value of every code.
_VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(65535.0) / STEPS)])


def dequantise(codes: np.ndarray, absent: float = 0.0) -> np.ndarray:
    p = _VALUES[codes]
    if absent:
        p[codes == 0] = absent
    return p


def _words(a: np.ndarray) -> np.ndarray:
    """Any array as 64-bit words, after its length in items."""
    raw = np.ascontiguousarray(a).tobytes()
    return np.concatenate([np.array([len(a)], _U), np.frombuffer(raw + b"\0" * (-len(raw) % 8), _U)])


class _Cursor:
    """Parts laid one after another, read in turn without a copy."""

    def __init__(self, words: np.ndarray):
        self.words, self.at = words, 0

    def sequence(self) -> EliasFano:
        e = EliasFano(self.words[self.at :])
        self.at += e.size
        return e

    def array(self, kind) -> np.ndarray:
        n = int(self.words[self.at])
        size = -(-n * np.dtype(kind).itemsize // 8)
        out = self.words[self.at + 1 : self.at + 1 + size].view(kind)[:n]
        self.at += 1 + size
        return out

    def codes(self):
        book = self.array(np.uint16)
        return book, self.array(np.uint8 if len(book) <= 256 else np.uint16)


def _coded(codes: np.ndarray) -> list[np.ndarray]:
    """A code book and each item's place in it: a byte where the book is small."""
    used = np.zeros(1 << 16, bool)
    used[codes] = True
    book = np.flatnonzero(used)
    at = (np.cumsum(used) - 1).astype(np.uint8 if len(book) <= 256 else np.uint16)[codes]
    return [_words(book.astype(np.uint16)), _words(at)]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, the first place of each, and each item's place among them; not sorted where they ascend already."""
    if len(key) and (key[1:] < key[:-1]).any():
        return np.unique(key, return_index=True, return_inverse=True)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], np.flatnonzero(new), np.cumsum(new) - 1


def _joint(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Columns of places below ``n`` as one number."""
    key = columns[0].astype(_U)
    for x in columns[1:]:
        key = key * _U(max(1, n)) + x.astype(_U)
    return key


class WordLevel:
    """Level 1: the words' hashes as an Elias-Fano sequence; each word's rank and count."""

    def __init__(self, words: np.ndarray):
        c = _Cursor(words)
        self.hashes, self.ranks, self.counts = c.sequence(), c.array(np.uint32), c.array(np.uint64)

    @staticmethod
    def encode(hashes: np.ndarray, ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.concatenate([EliasFano.encode(hashes), _words(ranks.astype(np.uint32)), _words(counts.astype(_U))])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank plus one and count of each word; 0 and 0 if unknown."""
        at = self.hashes.find(hashes)
        ok = at >= 0
        rank, count = np.zeros(len(at), _U), np.zeros(len(at), _U)
        rank[ok], count[ok] = self.ranks[at[ok]].astype(_U) + _U(1), self.counts[at[ok]]
        return rank, count


class TrieLevel:
    """The n-grams of one level, under their contexts.

    Words are stored once, as an Elias-Fano sequence of their ids; a context is the places of its words in that list, as
    one number; pointers (monotone) say where each context's successors begin.  A successor is stored relative to its
    context: its word's place plus the context's place times the list's length, which makes the level one monotone
    sequence.  Each n-gram has the code of its discounted probability and, below the last level, that of the weight that
    it gives to the lower order as a context.
    """

    def __init__(self, words: np.ndarray):
        c = _Cursor(words)
        self.words, self.contexts, self.pointers, self.successors = (c.sequence() for _ in range(4))
        self.alpha, self.gamma = c.codes(), c.codes()

    @staticmethod
    def encode(context: list[np.ndarray], word: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """``context``: a column of word ids for each of its words; n-grams are distinct and in ascending order."""
        ids, at = np.unique(np.concatenate([*context, word]), return_inverse=True)
        *context, word = at.reshape(len(context) + 1, len(word))
        return TrieLevel.encode_placed(ids, context, word, alpha, gamma)

    @staticmethod
    def encode_placed(ids: np.ndarray, context: list[np.ndarray], word: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """As ``encode``, of n-grams given as places in ``ids``, which ascend; not all of them need be used."""
        _, first, of = distinct(_joint(context, len(ids)))
        return TrieLevel.encode_runs(ids, [x[first] for x in context], of, word, alpha, gamma)

    @staticmethod
    def encode_runs(ids: np.ndarray, context: list[np.ndarray], of: np.ndarray, word: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """As ``encode_placed``, with distinct contexts in ascending order, not all of them in use, and the place ``of`` each n-gram's context among them."""
        new = np.diff(of, prepend=-1) != 0
        first, context = np.flatnonzero(new), [x[of[new]] for x in context]
        used = np.zeros(len(ids), bool)
        for x in (*context, word):
            used[x] = True
        words, place = ids[used], (np.cumsum(used) - 1).astype(_U)
        n = max(1, len(words))
        successors = (np.cumsum(new) - 1).astype(_U) * _U(n) + place[word]
        parts = [EliasFano.encode(words), EliasFano.encode(_joint([place[x] for x in context], n)), EliasFano.encode(np.append(first, len(word))), EliasFano.encode(successors)]
        return np.concatenate([*parts, *_coded(alpha), *_coded(gamma)])

    def find(self, context: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (alpha, gamma) of each n-gram, 0 where the trie has none: the context's place, then the successor relative to it."""
        ids, back = np.unique(np.concatenate([*context, word]), return_inverse=True)
        *context, word = back.reshape(len(context) + 1, len(word))
        return self.find_placed(ids, context, word)

    def find_placed(self, ids: np.ndarray, context: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``, of n-grams given as places in ``ids``, which ascend."""
        _, first, of = distinct(_joint(context, len(ids)))
        return self.find_runs(ids, [x[first] for x in context], of, word)

    def find_runs(self, ids: np.ndarray, context: list[np.ndarray], of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find_placed``, with distinct contexts in ascending order and the place ``of`` each n-gram's context among them."""
        alpha, gamma = np.zeros(len(word), np.uint16), np.zeros(len(word), np.uint16)
        own, n = self.words.find(ids), max(1, self.words.n)
        places = [own[x] for x in context]
        known = np.flatnonzero(np.all([x >= 0 for x in places], axis=0))
        parent = np.full(len(places[0]), -1, np.int64)
        parent[known] = self.contexts.find(_joint([x[known] for x in places], n))
        at, last = parent[of], own[word]
        k = np.flatnonzero((at >= 0) & (last >= 0))
        at = at[k]
        found = self.successors.find((at * n + last[k]).astype(_U))
        hit = found >= 0
        k, at, found = k[hit], at[hit], found[hit]
        if len(k):
            begin = self.pointers.values().astype(np.int64)
            if not ((begin[at] <= found) & (found < begin[at + 1])).all():
                raise ValueError("a successor lies outside its context's range")
            alpha[k], gamma[k] = self.alpha[0][self.alpha[1][found]], self.gamma[0][self.gamma[1][found]]
        return alpha, gamma
