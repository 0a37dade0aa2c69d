"""Distinct n-grams are told without sorting places by key; the trie takes them as places in a list of words."""

import numpy as np
import pytest

from abyssal.llm.elias_fano import TrieLevel, distinct
from abyssal.llm.ngram_lm import _distinct


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
@pytest.mark.parametrize("below", [1, 7, 40_000, 1 << 40, 1 << 62])
def test_distinct(n, below):
    keys = np.random.default_rng(n).integers(0, below, n)
    want, back = np.unique(keys, return_inverse=True)
    got, first, at = _distinct(keys, below)
    assert (got == want).all() and (at == back).all() and (keys[first] == want).all()
    for x in (keys, np.sort(keys)):
        for a, b in zip(distinct(x), np.unique(x, return_index=True, return_inverse=True), strict=True):
            assert (a == b).all()


@pytest.mark.parametrize("width", [2, 3])
def test_places_and_ids_give_the_same_level(width):
    rng = np.random.default_rng(width)
    ids = np.unique(rng.integers(0, 1 << 50, 300).astype(np.uint64))
    grams = np.unique(rng.integers(0, len(ids) - 20, (2000, width)), axis=0)  # some ids aren't used
    alpha, gamma = rng.integers(1, 60_000, (2, len(grams))).astype(np.uint16)
    *context, word = grams.T
    of = lambda rows: ([ids[x] for x in rows.T[:-1]], ids[rows.T[-1]])
    level = TrieLevel.encode_placed(ids, context, word, alpha, gamma)
    assert (level == TrieLevel.encode(*of(grams), alpha, gamma)).all()
    asked = np.concatenate([rng.integers(0, len(ids), (500, width)), grams[::3]])
    for rows in (asked, np.unique(asked, axis=0)):
        a, b = TrieLevel(level).find_placed(ids, list(rows.T[:-1]), rows.T[-1]), TrieLevel(level).find(*of(rows))
        known = {tuple(g): (x, y) for g, x, y in zip(grams.tolist(), alpha.tolist(), gamma.tolist(), strict=True)}
        want = np.array([known.get(tuple(r), (0, 0)) for r in rows.tolist()]).T
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (a[0] == want[0]).all() and (a[1] == want[1]).all()
