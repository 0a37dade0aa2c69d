"""Phrase collocations by pivot partitioning (after MG-FSM, Miliaraki et al., 2013).

The words of a language are ordered by frequency, and the pivot of an n-gram is its rarest word.  For every place of a
word, the text around it is rewritten to the fragment in which it is the pivot: up to ``longest - 1`` neighbours on either
side, cut at the end of the piece and at the first rarer word.  Fragments travel to their pivot as numbers of words, equal
ones once with a weight.  There the n-grams that the pivot owns are counted, and no other: every occurrence of an n-gram
lies in the fragment of its leftmost pivot, so it is counted once, in one place.

A task counts pair by pair first: a neighbour that makes no frequent pair with the pivot can't be in a frequent phrase, and
ends the fragment.  A pivot with very many fragments is dealt to several tasks, whose counts are added afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import from_ipc, pack, segments, stage, tidy, unpack

LONGEST, LEAST, TOP = 4, 30, 2000
#: 100 * f(longer) >= COVERED * f(phrase) drops the phrase.
COVERED = 80
#: Places of a pivot that one task counts, about; n-grams held by a task at a time.
PIVOT_PLACES, HELD = 1 << 20, 1 << 19
_SPLIT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\r\t", b"\n" * 10 + b" ")


# --- words, and their numbers ----------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z as a-z, with a line feed between pieces."""
    body = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPLIT)
    return [w for w in body.replace(b"\n", b" \n ").split(b" ") if w]


def encoded(docs: DataFrame) -> DataFrame:
    """(segment_id, lang, words, counts, body): the texts of a language in a segment as places in its own list of words, 0 between pieces and texts."""
    picked = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    segs = segments(picked, ["lang", "text"])

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                seg, t = b.column(0)[i].as_py(), from_ipc(b.column(1)[i].as_py())
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(t.column("lang").to_pylist(), t.column("text"), strict=True):
                    held = by_lang.setdefault(lang, [])
                    held += words_of(text.as_py())
                    held.append(b"\n")
                for lang, held in by_lang.items():
                    d = pa.array([b"\n", *held], pa.binary()).dictionary_encode()  # the separator is number 0
                    at = d.indices.to_numpy()[1:]
                    n = np.bincount(at, minlength=len(d.dictionary))
                    names = d.dictionary[1:].cast(pa.string()) if len(d.dictionary) > 1 else pa.array([], pa.string())
                    cols = [pa.array([seg], pa.int64()), pa.array([lang]), pa.array([names.to_pylist()], pa.list_(pa.string())), pa.array([n[1:]], pa.list_(pa.int64())), pa.array([pack(at.astype(np.uint64))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["segment_id", "lang", "words", "counts", "body"])

    return stage(segs.select("segment_id", "body").mapInArrow(tidy(each), "segment_id long, lang string, words array<string>, counts array<long>, body binary"), "encoded")


def numbered(counts: DataFrame) -> DataFrame:
    """``counts`` (lang, word, f) with ``id``: 1, 2, ... by descending frequency, so the rarer of two words has the larger one."""
    spark = counts.sparkSession
    order = [F.col("f").desc(), "lang", "word"]
    dealt = counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    held = stage(dealt, "words")  # the parts as dealt: a sort draws a sample anew
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row per part
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return stage(held.join(F.broadcast(sizes), "part").select("lang", "word", "f", (place + F.col("start")).alias("id")), "numbers")


# --- fragments, and the n-grams that their pivots own ---------------------------------------------------------------


def fragments(g: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of numbers of words (0: none): per place with a neighbour, the fragment's pivot, words to the left and right, and the words in 2 * reach + 1 columns.

    To the left stand smaller numbers only, to the right also the pivot again: so the place is the leftmost of its pivot.
    """
    n, wide = len(g), 2 * reach + 1
    padded = np.concatenate([np.zeros(reach, np.int64), g, np.zeros(reach, np.int64)])
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(1, reach + 1):
        x = padded[reach - d : reach - d + n]
        left += (left == d - 1) & (x > 0) & (x < g)
        x = padded[reach + d : reach + d + n]
        right += (right == d - 1) & (x > 0) & (x <= g)
    at = np.flatnonzero((g > 0) & (left + right > 0))
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[at] if len(at) else np.zeros((0, wide), np.int64)
    column = np.arange(-reach, reach + 1)
    rows = np.where((column >= -left[at, None]) & (column <= right[at, None]), rows, 0)
    return g[at], left[at], right[at], rows


def weighted(pivot: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct fragments, by pivot, and how often each stands there."""
    key = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(rows.shape[1]):
            key = (key ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.lexsort((key, pivot))
    s = rows[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)]) if len(s) else np.zeros(0, bool)  # like rows that a key has parted stay apart
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(s)))


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings like rows of numbers together, and where each run of them starts."""
    small = not x.size or int(x.max()) < 1 << 32
    keys = [x[:, c].astype(np.uint64) << np.uint64(32) | x[:, c + 1].astype(np.uint64) for c in range(0, x.shape[1] - 1, 2)] + ([x[:, -1]] if x.shape[1] % 2 else []) if small else list(x.T)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    s = [k[order] for k in keys]
    new = np.ones(len(x), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in s])
    return order, np.flatnonzero(new)


def ngram_counts(rows: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, reach: int, lengths) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of ``lengths`` words with the pivot (the middle column) inside, zeros behind, and their weights."""
    wide = max(lengths)
    out, w = [np.zeros((0, wide), np.int64)], [np.zeros(0, np.int64)]
    for n in lengths:
        for before in range(n):
            at = np.flatnonzero((left >= before) & (right >= n - 1 - before))
            x = np.zeros((len(at), wide), np.int64)
            x[:, :n] = rows[at, reach - before : reach - before + n]
            out.append(x)
            w.append(weight[at])
    x, w = np.concatenate(out), np.concatenate(w)
    if not len(x):
        return x, w
    order, first = _same(x)
    return x[order[first]], np.add.reduceat(w[order], first)


def owned(rows: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that the pivots of the fragments own, of a weight of ``least`` or more.  Pairs first: they tell where a fragment may end."""
    if least > 1:
        pairs, n = ngram_counts(rows, np.minimum(left, 1), np.minimum(right, 1), weight, reach, (2,))
        pairs = pairs[n >= least]
        ends = np.unique(pairs)
        key = np.sort(np.searchsorted(ends, pairs[:, 0]) * len(ends) + np.searchsorted(ends, pairs[:, 1]))

        def frequent(a, b, able):
            if not len(key):
                return np.zeros(len(a), bool)
            i, j = (np.minimum(np.searchsorted(ends, x), len(ends) - 1) for x in (a, b))
            k = i * len(ends) + j
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            return able & (ends[i] == a) & (ends[j] == b) & (key[at] == k)

        keep_left = frequent(rows[:, reach - 1], rows[:, reach], left > 0)
        keep_right = frequent(rows[:, reach], rows[:, reach + 1], right > 0)
        left, right = np.where(keep_left, left, 0), np.where(keep_right, right, 0)
        able = keep_left | keep_right
        rows, left, right, weight = rows[able], left[able], right[able], weight[able]
    x, n = ngram_counts(rows, left, right, weight, reach, range(2, reach + 2))
    return x[n >= least], n[n >= least]


#: Weights above this are cut in several.
_WEIGHT = (1 << 24) - 1


def _dealt(texts: DataFrame, longest: int, wide: str) -> DataFrame:
    """``texts`` (segment_id, body, n_words, known) -> (pivot, salt, heads, words): the fragments of a pivot in a segment.

    A head is weight, words to the left and words to the right; the words are numbers of the type ``wide``, without the
    pivot.  ``salt`` is -1, or for a pivot of several parts the part.
    """
    reach = longest - 1
    inside = np.arange(-reach, reach + 1)

    def binary(offsets: np.ndarray, body: np.ndarray) -> pa.Array:
        size = body.dtype.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                seg, n_words, known = b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].values
                at, ids, parts = (known.field(c).to_numpy() for c in range(3))
                number = np.zeros(n_words + 1, np.int64)
                number[at + 1] = ids
                pivot, left, right, rows = fragments(number[unpack(b.column(1)[i].as_py()).astype(np.int64)], reach)
                if not len(pivot):
                    continue
                held, weight = weighted(pivot, rows)
                again = -(-weight // _WEIGHT)
                if (again > 1).any():
                    held, rest = np.repeat(held, again), np.repeat(weight - (again - 1) * _WEIGHT, again)
                    last = np.cumsum(again) - 1
                    weight = np.full(len(held), _WEIGHT)
                    weight[last] = rest[last]
                pivot, left, right, rows = pivot[held], left[held], right[held], rows[held]
                starts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
                words = rows[(inside >= -left[:, None]) & (inside <= right[:, None]) & (inside != 0)].astype(wide)
                ends = np.append(starts, len(pivot))
                heads = (weight << 8 | left << 4 | right).astype("<u4")
                order = np.argsort(ids)
                n = parts[order[np.searchsorted(ids, pivot[starts], sorter=order)]]
                cols = [pa.array(pivot[starts]), pa.array(np.where(n > 1, seg % n, -1)), binary(ends, heads), binary(np.append(0, np.cumsum(left + right))[ends], words)]
                yield pa.RecordBatch.from_arrays(cols, names=["pivot", "salt", "heads", "words"])

    return texts.mapInArrow(tidy(each), "pivot long, salt long, heads binary, words binary")


def _mined(dealt: DataFrame, longest: int, least: int, held: int, wide: str) -> DataFrame:
    """Fragments, all of a pivot's part together -> (gram array<long>, f): counts of the n-grams that pivots own; of split pivots, parts of counts."""
    reach = longest - 1
    inside = np.arange(-reach, reach + 1)

    def counted(rows: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
        heads = np.frombuffer(b"".join(rows.column(2).to_pylist()), "<u4").astype(np.int64)
        words = np.frombuffer(b"".join(rows.column(3).to_pylist()), wide).astype(np.int64)
        n = np.asarray(pa.compute.binary_length(rows.column(2))) // 4
        left, right = heads >> 4 & 15, heads & 15
        table = np.zeros((len(heads), 2 * reach + 1), np.int64)
        table[:, reach] = np.repeat(rows.column(0).to_numpy(), n)
        table[(inside >= -left[:, None]) & (inside <= right[:, None]) & (inside != 0)] = words
        x, f = owned(table, left, right, heads >> 8, reach, least if whole else 1)
        size = (x > 0).sum(axis=1)
        grams = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(x[x > 0], pa.int64()))
        return pa.RecordBatch.from_arrays([grams, pa.array(f, pa.int64())], names=["gram", "f"])

    def each(batches):
        """Unsplit pivots come first, each whole; of split ones any rows may be counted together."""
        waiting: list[pa.RecordBatch] = []
        size = 0

        def told(whole: bool, rest: bool):
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            pivots = rows.column(0).to_numpy()
            cut = int(np.searchsorted(pivots, pivots[-1])) if whole and not rest else rows.num_rows  # the last pivot may go on
            if cut < rows.num_rows:
                waiting.append(rows.slice(cut))
            return counted(rows.slice(0, cut), whole) if cut else None

        kind = True
        for b in batches:
            n = int(np.searchsorted(b.column(1).to_numpy(), 0))  # rows of unsplit pivots
            for part, whole in ((b.slice(0, n), True), (b.slice(n), False)):
                if not part.num_rows:
                    continue
                if waiting and whole != kind:
                    yield told(kind, True)
                    size = 0
                kind = whole
                for s in range(0, part.num_rows, 256):
                    waiting.append(part.slice(s, 256))
                    size += pa.compute.sum(pa.compute.binary_length(waiting[-1].column(2))).as_py() // 4
                    if size >= held:
                        out, size = told(whole, False), 0  # what waits of the last pivot isn't counted again: no more than a part of a pivot
                        if out is not None:
                            yield out
        if waiting:
            yield told(kind, True)

    ready = dealt.repartition("pivot", "salt").sortWithinPartitions("salt", "pivot")
    return ready.mapInArrow(tidy(each), "gram array<long>, f long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, pivot_places: int = PIVOT_PLACES, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(lang, words array, f): every phrase of 1 to ``longest`` words that occurs ``least`` times or more inside the pieces of its language; and (lang, n), all words.

    Texts are split at ``[.,;:!?`` and line ends into pieces, those at blanks and tabs into words, A-Z as a-z.  A null text
    has none; a null lang is ``und``.  Repeated rows count each.
    """
    texts = encoded(docs)
    listed = texts.select("segment_id", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("segment_id", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = stage(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counts", settle=True)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    number = numbered(counts.where(F.col("f") >= least))
    # rarer words have no number; the list of a segment is no longer than its text
    parts = F.ceil(F.col("f") / pivot_places)
    known = listed.join(number.select("lang", "word", "id", parts.alias("parts")), ["lang", "word"]).groupBy("segment_id", "lang").agg(F.sort_array(F.collect_list(F.struct("at", "id", "parts"))).alias("known"))
    ready = texts.select("segment_id", "body", F.size("words").alias("n_words"), "lang").join(known, ["segment_id", "lang"]).select("segment_id", "body", "n_words", "known")
    wide = "<u4" if (number.agg(F.max("id")).first()[0] or 0) < 1 << 32 else "<u8"
    dealt = _dealt(ready, longest, wide)
    grams = stage(_mined(dealt, longest, least, held, wide).groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "grams", settle=True)
    placed = grams.select("gram", "f", F.posexplode("gram").alias("i", "id")).join(number.select("id", "lang", "word"), "id")
    named = placed.groupBy("gram").agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("x"))
    phrases = named.select("lang", F.transform("x", lambda x: x["word"]).alias("words"), "f").unionByName(number.select("lang", F.array("word").alias("words"), "f"))
    return stage(phrases, "phrases"), stage(totals, "totals")


# --- scores -----------------------------------------------------------------------------------------------------------

#: Exact: products may pass 64 bits.
SCORE = "cast((cast(a AS decimal(19,0)) * 2000000BD) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0))) AS long)"


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, **bounds) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to ``longest`` words that occur ``least`` times or more, by score.

    A phrase's score is its lowest over its cuts in two, floor(2000000 * a / (l + r)), ties to the first cut.  A phrase that
    lies inside a longer one with at least COVERED hundredths of its count is left out.  ``top`` is the number of phrases
    reported a language (None: all).  An empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, longest, least, **bounds)
    several = phrases.where(F.size("words") > 1)
    cut = several.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    first, rest = F.slice("words", 1, F.col("k")), F.slice("words", F.col("k") + 1, F.size("words"))
    part = lambda name, f: phrases.select("lang", F.col("words").alias(name), F.col("f").alias(f))
    both = cut.withColumns({"head": first, "tail": rest}).join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    scored = both.withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "words", "a", "b.score", "b.l", "b.r")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))))
    longer = several.where(F.size("words") > 2).select("lang", "f", F.explode(inner).alias("words")).groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.expr("cast(longer AS decimal(19,0)) * 100BD") < F.col("a").cast("decimal(19,0)") * F.lit(COVERED)))
    named = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # first among a part of the language's phrases, so that no task sorts them all
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        named = named.withColumn("_some", F.row_number().over(some)).where(F.col("_some") <= top).drop("_some")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
