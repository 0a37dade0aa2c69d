"""Collocations against counting every phrase in plain Python, and on the awkward cases."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank long, phrase string, words string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, longest, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = collections.defaultdict(list)
    inside = collections.Counter()
    for (lang, w), a in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside[lang, w] < 80 * a:
            s, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-s, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1): (p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def table(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts():
    rng = np.random.default_rng(11)
    words = ["the", "of", "a", "b", "New", "York", "city", "x|y", "é", "\x1f", "aa", "a"]
    p = np.array([9, 6, 5, 4, 2, 2, 2, 1, 1, 1, 1, 3], float)
    out = []
    for i in range(300):
        w = rng.choice(words, size=rng.integers(0, 40), p=p / p.sum())
        sep = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\x0b\x0c"], size=len(w), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        out.append(("".join(a + b for a, b in zip(w, sep, strict=True)), [None, "en", "und", "fr"][i % 4]))
    return [*out, (None, "en"), ("", "fr"), (" \n\t", None), ("a a a a a a a a", "en"), ("of the of the of", "en"), *[("the new york city line that all share", "en")] * 40, ("b " * 4000 + "the a " * 500, "fr")]


@pytest.mark.parametrize("bounds", [{}, {"pivot_places": 7}, {"held": 5}, {"pivot_places": 3, "held": 40}])
def test_collocations_equal_counting_every_phrase(spark, bounds):
    """Also where pivots are dealt to several tasks and counts are given out early."""
    rows = texts()
    d = spark.createDataFrame([(i, t, lang, 1, "p", "w") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert table(collocations.collocations(d, least=6, top=9, **bounds)) == brute(rows, 4, 6, 9)
    if not bounds:
        assert table(collocations.collocations(d, longest=3, least=2, top=10**6)) == brute(rows, 3, 2, 10**6) == table(collocations.collocations(d, longest=3, least=2, top=None))


def test_words_of_one_place_are_counted_once():
    """Every occurrence of an n-gram lies in one fragment: that of its leftmost pivot."""
    rng = np.random.default_rng(2)
    g = rng.integers(0, 6, 3000)
    pivot, left, right, rows = collocations.fragments(g, 3)
    at, w = collocations.weighted(pivot, rows)
    x, n = collocations.owned(rows[at], left[at], right[at], w, 3, 1)
    got = {tuple(v for v in r if v): c for r, c in zip(x.tolist(), n.tolist(), strict=True)}
    want = collections.Counter(tuple(g[i : i + k].tolist()) for k in (2, 3, 4) for i in range(len(g) - k + 1) if (g[i : i + k] > 0).all())
    assert got == want
    assert [len(v) for v in collocations.fragments(np.zeros(0, np.int64), 3)] == [0] * 4


def test_numbers_follow_frequency(spark):
    c = spark.createDataFrame([("en", f"w{i}", int(1000 / (1 + i % 50))) for i in range(500)], "lang string, word string, f long")
    rows = collocations.numbered(c).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 501)) and [r.f for r in rows] == sorted((r.f for r in rows), reverse=True)


def test_scores_are_exact_beyond_64_bits(spark):
    a = 9_007_199_254_740_993
    got = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long").select(F.expr(collocations.SCORE).alias("s")).first().s
    assert got == 2_000_000 * a // (2 * a + 3)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "p", "w")], SCHEMA)).count() == 0
