"""Whole-text token ids through the ``tokenizers`` library, with a word cache.

ASCII white space separates words for the tokenizers used here (white space is dropped before the merges), so the ids
of a text are the ids of its words in order; a new word is encoded by the library once and looked up afterwards.
``check_separable`` tests that property of a tokenizer file; without it whole texts are encoded.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain, repeat

import numpy as np

#: Words held by a Python worker before the cache starts anew.  Memory only: ids don't depend on it.
CACHE_WORDS = 1_500_000
VOCABULARY = "word_bpe_49k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@cache
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_separable(path: str) -> bool:
    """Whether white space splits texts for this tokenizer."""
    t = _load(path)
    words = ["Don't", "x", "naïve", "a-b", "3.14", "'s", "é", "́a", "ß!", "東京"]
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    return all(ids(sep.join(words)) == [i for w in words for i in ids(w)] and ids(sep) == [] for sep in (" ", "\n", "\t ", "\r\n", "\x0b\x0c"))


_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Words whose letters and tail of ASCII punctuation may be encoded apart, A-Z as a-z: ASCII and the letters of Latin-1, the last one a letter or digit.  None of
#: these composes with what follows it, and the lower case of each is one letter; other words (U+0130 becomes a letter and a mark) go to the library whole.
_PLAIN = re.compile(rb"(?:[\x21-\x7f]|\xc3[\x80-\xbf])*(?:[0-9A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])")


def check_parts(path: str) -> bool:
    """Whether letters and the punctuation after them are encoded apart, and A-Z like a-z: every last character that ``_PLAIN`` admits, with every first one of a tail."""
    t = _load(path)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    last = [c for c in map(chr, [*range(33, 127), *range(192, 256)]) if c.isalnum()]
    tails = [c.decode() + d for c in (_PUNCTUATION[i : i + 1] for i in range(32)) for d in ("", "!", "'")]
    ends, after = {c: ids("xY" + c.lower()) for c in last}, {x: ids(x) for x in tails}
    return all(ids("xY" + c + x) == ends[c] + after[x] for c in last for x in tails)


class Encoder:
    """``encode(text) -> uint32 array``; keeps arrays of ids per cached word."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.limit = cache_words
        self.tokenizer, self.separable = _load(path), check_separable(path)
        self.parts = self.separable and check_parts(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.used = 0

    def _learn(self, words: set[bytes]) -> None:
        """New words.  A plain one with a tail of ASCII punctuation is its parts side by side, in any case of A-Z; only parts not met yet are encoded."""
        if not self.parts:
            return self._encode(list(words))
        whole, joined, need = [], [], set()
        for w in words:
            base = w.lower().rstrip(_PUNCTUATION)
            if len(base) == len(w) and base == w or b"<|" in w or not _PLAIN.fullmatch(base):
                whole.append(w)
                continue
            tail = w[len(base) :]
            joined.append((w, base, tail))
            need.add(base)
            if tail:
                need.add(tail)
        known = self.known
        self._encode([*whole, *need.difference(known, whole)])
        flat, start = self.ids, self.start
        n = len(joined)
        if n:
            a = np.fromiter((known[x[1]] for x in joined), np.int64, n)
            b = np.fromiter((known[x[2]] if x[2] else -1 for x in joined), np.int64, n)
            na, nb = start[a + 1] - start[a], np.where(b >= 0, start[b + 1] - start[b], 0)
            ends = np.cumsum(np.stack([na, nb], 1).ravel())
            sizes = np.stack([na, nb], 1).ravel()
            begins = np.stack([start[a], start[b]], 1).ravel()
            take = np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            self._append([x[0] for x in joined], na + nb, flat[take])

    def _encode(self, words: list[bytes]) -> None:
        if not words:
            return
        rows = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        self._append(words, n, np.fromiter(chain.from_iterable(rows), np.uint32, int(n.sum())))

    def _append(self, words: list[bytes], n: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(n)])
        self.used += len(flat)
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(words))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null texts have none.  Call with a bounded batch."""
        if not self.separable:
            return [np.array(self.tokenizer.encode(x or "", add_special_tokens=False).ids, np.uint32) for x in texts]
        if len(self.known) > self.limit:
            self._clear()
        words = [(x or "").encode("utf-8", "replace").split() for x in texts]
        flat = [w for ws in words for w in ws]
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [flat[i] for i in missing]
            self._learn(set(new))
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        s = self.start[at]
        n = self.start[at + 1] - s
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(s - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])]
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


@cache
def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One per worker process, kept from task to task."""
    return Encoder(path, cache_words)


def slices(texts: list[str | None], limit: int = 1_000_000) -> list[slice]:
    """Runs of texts of about ``limit`` characters, to bound memory; a longer text is a run of its own."""
    out, start, size = [], 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= limit:
            out.append(slice(start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out
