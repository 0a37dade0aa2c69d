"""The language model's work a token: distinct words are hashed once, and n-grams are renumbered without a loop's worth of sorting."""

import numpy as np
import pyarrow as pa
import pytest

from abyssal.llm import ngram_lm
from abyssal.llm.common import gaps_within, pack_all, pack_many, sums_within, unpack_all, unpack_many, word_hashes, write_file

TEXTS = [" The the\x0bTHE\x0cthe\r\n\tend ", None, "", " \n", "a\x1cb \x85  x cafÉ CAFÉ \x00 n\x00l", "İ K K", "the " * 500, "x"]


def table(offset: int) -> pa.Table:
    whole = pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS)})
    return pa.Table.from_batches([b.slice(offset) for b in whole.to_batches()])


@pytest.mark.parametrize("offset", [0, 3])
def test_each_distinct_word_is_hashed_once(offset, monkeypatch):
    hashed = []
    monkeypatch.setattr(ngram_lm, "word_hashes", lambda words: (hashed.extend(words), word_hashes(words))[1])
    t, words = ngram_lm._Tokens.of_texts(table(offset), 10)
    want = [[*(x or "").encode().lower().split(), ngram_lm.END] for x in TEXTS[offset:]]
    assert t.n.tolist() == [len(x) for x in want] and t.ids == [*range(offset, len(TEXTS))]
    assert (words[t.at] == word_hashes([w for x in want for w in x])).all() and words[t.end] == word_hashes([ngram_lm.END])[0]
    assert sorted(hashed) == sorted({w for x in want for w in x})


@pytest.mark.parametrize("split", [2, 1 << 17])
def test_bodies_hold_the_segments_ngrams(split, tmp_path, monkeypatch):
    """However many buckets are numbered together: each body has its bucket's n-grams with their training counts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 60, 300))) for _ in range(12)]
    t, words = ngram_lm._Tokens.of_texts(pa.table({"doc_id": range(12), "text": texts}), 10)
    side, n_buckets = str(tmp_path), 40
    write_file(f"{side}/7", t.dump())
    n = np.bincount(t.at[t.train], minlength=len(words))
    ids = np.where(n > 0, rng.permutation(len(words)) * 5 + 2, ngram_lm.UNKNOWN).astype(np.uint64)
    write_file(f"{side}/7.1", pack_all(ids, n))
    made = []
    for together in (1, 200, 1 << 20):
        monkeypatch.setattr(ngram_lm, "TOGETHER", together)
        made.append(ngram_lm._Segment(side, 7, 10, n_buckets, ngram_lm.BACKOFF, split).asked(2))
    assert made[0] == made[1] == made[2] and [r[0] for r in made[0]] == sorted({r[0] for r in made[0]})
    got = {}
    for _, _, body in made[0]:
        used, context, _, run, word, count = unpack_all(body, 6)
        own = np.cumsum(used, dtype=np.uint64)
        u = own[np.repeat(np.cumsum(context), run.astype(int)).astype(int)]
        for k, x in zip(zip(u.tolist(), own[word.astype(int)].tolist()), count.tolist(), strict=True):
            assert k not in got
            got[k] = x
    want = {}
    for i, x in enumerate(np.split(ids[t.at].tolist(), np.cumsum(t.n)[:-1])):
        for u, w in zip([ngram_lm.BEGIN, *x], x):
            if u and w:
                want[u, w] = want.get((u, w), 0) + int(ngram_lm.train_row(i))
    assert got == want


def test_packed_numbers_of_every_width():
    arrays = [np.zeros(0, np.uint64), *(np.array([0, 1, (1 << b) - 1, 1 << (b - 1)], np.uint64) for b in range(1, 65))]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, unpack_all(pack_all(*arrays), len(arrays)), strict=True))


@pytest.mark.parametrize("sizes", [[], [0], [0, 3, 0, 0, 5, 1, 0], [1] * 50, [2000]])
def test_many_groups_are_packed_as_each_alone(sizes):
    rng = np.random.default_rng(len(sizes))
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    half = cut // 2  # a column of other groups
    v, w = (rng.integers(0, 1 << 62, cut[-1], dtype=np.uint64) >> rng.integers(0, 63, cut[-1]).astype(np.uint64) for _ in range(2))
    groups = [*zip(cut, cut[1:], half, half[1:])]
    blobs = pack_many((v, cut), (w[: half[-1]], half))
    assert blobs == [pack_all(v[a:b], w[c:d]) for a, b, c, d in groups]
    (x, at), (y, own) = unpack_many(blobs, 2)
    assert (x == v).all() and (at == cut).all() and (y == w[: half[-1]]).all() and (own == half).all()
    rising = np.concatenate([np.zeros(0, np.uint64), *(np.sort(v[a:b]) for a, b, *_ in groups)])
    apart = gaps_within(rising, cut)
    assert (sums_within(apart, cut) == rising).all() and all((np.cumsum(apart[a:b]) == rising[a:b]).all() for a, b, *_ in groups)


def test_a_group_is_packed_without_a_pass_over_arrays(monkeypatch):
    """The calls of numpy don't grow with the number of groups, which are segments times buckets over the whole job."""
    from abyssal.llm import common

    made = []
    monkeypatch.setattr(common, "np", type("Counted", (), {"__getattr__": lambda _, name: (made.append(name), getattr(np, name))[1]})())
    calls = []
    for n in (10, 1000):
        cut = np.arange(n + 1) * 3
        v = np.arange(3 * n).astype(np.uint64) % np.uint64(200)
        made.clear()
        unpack_many(pack_many((v, cut), (v, cut)), 2)
        calls.append(len(made))
    assert calls[0] == calls[1]


def test_shuffles_of_a_level_are_gone_before_the_next(spark, monkeypatch):
    import time

    def shuffled():
        return {f.getName(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before, left, gather = shuffled(), [], ngram_lm._gather

    def watched(*given):
        found, end = gather(*given), time.time() + 10
        kept = lambda: sum(n for name, n in shuffled().items() if name not in before)
        while kept() > 2000 and time.time() < end:  # the count of the small job has some bytes of its own
            time.sleep(0.1)
        left.append(kept())
        return found

    monkeypatch.setattr(ngram_lm, "_gather", watched)
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 5000, 500)))) for i in range(100)], "doc_id long, text string")
    assert ngram_lm.score(docs).count() == 100 and len(left) == 2 and max(left) <= 2000
