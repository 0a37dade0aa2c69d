"""n-gram language model in Elias-Fano trie levels, kept in the shared folder and searched where its n-grams are dealt.

Texts are turned into hashes once; each segment of documents keeps its tokens in a side file of the shared folder.  Per
level, a segment's distinct n-grams are combined before they are shuffled and dealt by a hash of their context, so that a
context's successors stand side by side in one trie; a context of very many tokens is dealt by ranges of its successors'
hashes as well.  The task of one bucket adds up the training counts, turns them into smoothed probabilities, writes them
as one quantised trie level to the shared folder, maps that file and answers from it the n-grams that segments asked for.
A level ends when each segment's answers lie in a side file: the next one starts from the list of segments, and the shuffles
of a level are gone before those of the next are written.  A model that is already there is mapped and searched in the same way, for any documents.

    p1(w)     = (c(w) + a) / (N + a (V + 1))          unknown words share the one extra place
    pn(w | h) = alpha(h w) + gamma(h) p(n-1)(w | h')  h' drops the first word; a text starts with a begin mark
    alpha(h w) = c(h w) / (c(h) + K),  gamma(h) = K / (c(h) + K)

alpha, gamma are what a level stores, as 16-bit codes of their logarithms; c(w) is kept as it is.  A code is half a step of
1 / 4096 of a power of ten from its value at most, and alpha is made of a coded gamma, so the log10 probability of a token
lies within one step of the exact one with bigrams and one and a half with trigrams.  Nothing of the corpus reaches the
driver but N and V.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT_BYTES, bucket_bounds, gaps_within, map_file, new_path, pack_all, pack_many, release, remove_file, remove_folder, runs, small_batches, stage, sums_within, text_bytes, tidy, unpack_all, unpack_many, word_hashes, write_file
from .elias_fano import TrieLevel, WordLevel, dequantise, quantise

ADD = 0.1
#: Pseudo-count K of the lower order, for levels 2 and 3.
BACKOFF = (20.0, 5.0)
BUCKET_BYTES = 6_000_000
#: N-grams that a segment numbers at a time, bucket by bucket.
TOGETHER = 1 << 14
#: Tokens of a context from which its successors are dealt to several buckets.
SPLIT = 1 << 17
#: Tasks that share the segments; each takes one segment at a time.
MAX_TASKS = 20_000
END = b" end"  # no word has a space
#: Ids in n-grams: words from 2 on.
UNKNOWN, BEGIN = 0, 1


def train_row(doc_id: int | None, folds: int = 10) -> bool:
    """crc32 of the id as text, modulo ``folds``, is not 0; a null id counts as the text ``null``."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds != 0


class _Tokens:
    """A segment's rows: ids, numbers of tokens, and each token's place among the segment's words (as their hashes ascend); the end mark's place."""

    def __init__(self, ids: list, n: np.ndarray, at: np.ndarray, end: int, folds: int):
        self.ids, self.n, self.at, self.end = ids, n.astype(np.int64), at.astype(np.int64), end
        self.train_row = np.array([train_row(x, folds) for x in ids], bool)
        self.train = np.repeat(self.train_row, self.n)
        self.first = np.cumsum(self.n) - self.n

    @classmethod
    def of_texts(cls, table: pa.Table, folds: int) -> tuple[_Tokens, np.ndarray]:
        """The tokens, and the hashes of their words.  Each distinct word is hashed once."""
        texts = [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]
        starts = np.cumsum([0, *map(len, texts)])
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts), pa.py_buffer(b"".join(texts).lower())))
        flat, bounds = split.flatten(), np.asarray(split.offsets)
        kept = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves an empty piece
        before = np.concatenate([[0], np.cumsum(kept)])[bounds]
        coded = flat.filter(pa.array(kept)).dictionary_encode()
        # words are cut out of the dictionary's bytes, which is several times faster than asking for them one by one
        _, cut, body = coded.dictionary.buffers()
        cut, body = np.frombuffer(cut, np.int64).tolist(), body.to_pybytes()
        words, place = np.unique(word_hashes([*(body[i:j] for i, j in zip(cut, cut[1:], strict=False)), END]), return_inverse=True)
        n, end = np.diff(before) + 1, int(place[-1])
        at, is_end = np.full(int(n.sum()), end, np.int64), np.zeros(int(n.sum()), bool)
        is_end[np.cumsum(n) - 1] = True
        at[~is_end] = place[np.asarray(coded.indices)]
        return cls(table.column("doc_id").to_pylist(), n, at, end, folds), words

    def dump(self) -> bytes:
        ids = np.array([0 if x is None else x for x in self.ids], np.int64).view(np.uint64)
        return pack_all(ids, np.array([x is None for x in self.ids]), self.n, self.at, np.array([self.end]))

    @classmethod
    def load(cls, path: str, folds: int) -> _Tokens:
        ids, null, n, at, end = unpack_all(map_file(path).tobytes(), 5)
        return cls([None if z else x for x, z in zip(ids.view(np.int64).tolist(), null.tolist(), strict=True)], n, at, int(end[0]), folds)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def _bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)


def _distinct(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``keys`` (0 or more, less than ``below``) ascending, a place of each, and every key's place among them.

    Key and place are sorted as one number where both fit into 63 bits: that is several times faster than sorting places by key.
    """
    bits = max(1, len(keys).bit_length())
    if below.bit_length() + bits <= 63:
        ordered = keys.astype(np.int64)
        ordered <<= bits
        ordered |= np.arange(len(keys))
        ordered.sort()
        order = ordered & ((1 << bits) - 1)
        ordered >>= bits
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


class _Grams:
    """A segment's distinct n-grams of a level, in ascending order: runs of successors under their contexts.

    ``context``: a column of words for each of a context's words, ``tokens``: its training tokens, ``of``: each n-gram's
    context, ``word``: its last word, ``at``: each token's n-gram (-1: none), ``order`` and ``bucket``: n-grams as they are dealt.
    """

    def __init__(self, context: list[np.ndarray], tokens: np.ndarray, of: np.ndarray, word: np.ndarray, at: np.ndarray, h: np.ndarray, ids: np.ndarray, n_buckets: int, split: int):
        """``h``: a hash of each context.  An n-gram is dealt by it and, of a context of more than ``split`` tokens, by a range of the word's hash."""
        self.context, self.tokens, self.of, self.word, self.at = context, tokens, of, word, at
        bucket = _bucket(h, n_buckets)[of]
        wide = np.flatnonzero((tokens >= split)[of])
        if len(wide):
            parts, w = 1 + (tokens[of[wide]] // split).astype(np.uint64), ids[word[wide]]
            part = (_mix(w, w) >> np.uint64(32)) * parts >> np.uint64(32)
            wide, part = wide[part > 0], part[part > 0]
            bucket[wide] = _bucket(_mix(h[of[wide]], part), n_buckets)
        self.order = np.argsort(bucket, kind="stable")  # numbers of 16 bits are sorted by radix
        self.bucket = bucket[self.order]


class _Segment:
    """A segment with what the levels have answered so far."""

    def __init__(self, side: str, segment_id: int, folds: int, n_buckets: int, backoff: tuple[float, ...], split: int, known: dict | None = None):
        """``known``: the answers of the last level; those of earlier levels are in side files."""
        self.id, self.side, self.known = segment_id, side, known or {}
        self.t, self.n_buckets, self.backoff, self.split = _Tokens.load(f"{side}/{self.id}", folds), n_buckets, backoff, split
        tokens = self.t
        ids, count = self._known(1)
        # ids of the segment in ascending order; a word is its place among them
        used, first, place = _distinct(np.concatenate([[UNKNOWN, BEGIN], ids.astype(np.int64)]), int(ids.max(initial=BEGIN)) + 1)
        self.ids = used.astype(np.uint64)
        self.word = place[2:][tokens.at]
        #: Training tokens of each word; every training text has one begin and one end.
        self.n_word = np.concatenate([[0.0, 0.0], count.astype(np.float64)])[first]
        self.n_context = self.n_word.copy()
        self.n_context[BEGIN] = count[tokens.end]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[tokens.first] = BEGIN
        self.grams2: _Grams | None = None

    def _known(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.known:
            raw = map_file(f"{self.side}/{self.id}.{level}")
            self.known[level] = tuple(unpack_all(raw.tobytes(), 2)) if len(raw) else (np.zeros(0, np.uint64),) * 2
        return self.known[level]

    def _answers(self, level: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the level's n-grams in their ascending order."""
        out = np.zeros((2, len(order)), np.uint16)
        for j, codes in enumerate(self._known(level)):
            if len(codes):
                out[j, order] = codes
        return out[0], out[1]

    def _runs(self, ok: np.ndarray, context: np.ndarray, n_contexts: int) -> tuple[np.ndarray, ...]:
        """Distinct pairs of context and word of the tokens ``ok``: the contexts in use, each pair's one of these, its word, each token's pair."""
        size = len(self.ids)
        keys = context[ok] * size
        keys += self.word[ok]
        keys, _, inverse = _distinct(keys, max(1, n_contexts) * size)
        at = np.full(len(self.word), -1, np.int64)
        at[ok] = inverse
        of = keys // size
        word = keys - of * size
        new = np.diff(of, prepend=-1) != 0
        return of[new], np.cumsum(new) - 1, word, at

    def level2(self) -> _Grams:
        if self.grams2 is None:
            u, of, word, at = self._runs((self.word > UNKNOWN) & (self.before > UNKNOWN), self.before, len(self.ids))
            h = _mix(np.zeros(len(u), np.uint64), self.ids[u])
            self.grams2 = _Grams([u], self.n_context[u], of, word, at, h, self.ids, self.n_buckets, self.split)
        return self.grams2

    def level3(self) -> _Grams:
        """Trigrams whose context was seen in training; others have no count anywhere."""
        two = self.level2()
        gamma = self._answers(2, two.order)[1]
        k = self.backoff[1]
        context = np.empty_like(two.at)
        context[1:] = two.at[:-1]
        context[self.t.first] = -1
        # the last place, which -1 means, is that of none
        ok = (self.word > UNKNOWN) & np.append(gamma > 0, False)[context]
        c, of, word, at = self._runs(ok, context, len(gamma))
        u, v = two.context[0][two.of[c]], two.word[c]
        h = _mix(_mix(np.zeros(len(u), np.uint64), self.ids[u]), self.ids[v])
        return _Grams([u, v], k / dequantise(gamma[c], 1.0) - k, of, word, at, h, self.ids, self.n_buckets, self.split)

    def asked(self, level: int) -> list[tuple]:
        """(bucket, segment, body) of a level: words in use, contexts, runs of successors and their training counts.

        Contexts that are dealt to several buckets carry the code of their weight; that of the others is known where all
        their successors meet.
        """
        g = self.level2() if level == 2 else self.level3()
        k, size = self.backoff[level - 2], len(self.ids)
        if not len(g.word):
            return []
        gamma = np.zeros(len(g.tokens), np.uint16)
        wide = g.tokens >= self.split
        gamma[wide] = quantise(k / (g.tokens[wide] + k))
        n = np.bincount(g.at[self.t.train & (g.at >= 0)], minlength=len(g.word))[g.order]
        of, word = g.of[g.order], g.word[g.order]
        cut = np.flatnonzero(np.diff(g.bucket.astype(np.int64), prepend=-1, append=-2))
        new = np.diff(of, prepend=-1) != 0
        new[cut[:-1]] = True
        new = np.flatnonzero(new)
        run, of = np.diff(np.append(new, len(word))), of[new]
        context, gamma = [c[of] for c in g.context], gamma[of]
        head = np.searchsorted(new, cut)
        rows, a = [], 0
        while a < len(cut) - 1:
            # buckets of few n-grams are numbered together, which keeps the work a bucket small
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + TOGETHER)) - 1)
            (s, e), (i, j) = cut[[a, b]], head[[a, b]]
            lot = np.arange(b - a)
            of_word, of_head = np.repeat(lot, np.diff(cut[a : b + 1])), np.repeat(lot, np.diff(head[a : b + 1]))
            used, _, back = _distinct(np.concatenate([*(x[i:j] + of_head * size for x in context), word[s:e] + of_word * size]), (b - a) * size)
            bound = np.searchsorted(used, np.arange(b - a + 1) * size)
            back -= bound[np.concatenate([*(of_head for _ in context), of_word])]
            *c, w = np.split(back, np.arange(1, level) * (j - i))
            own = self.ids[used - np.repeat(lot * size, np.diff(bound))]
            heads, grams = head[a : b + 1] - i, cut[a : b + 1] - s
            bodies = pack_many((gaps_within(own, bound), bound), (gaps_within(c[0], heads), heads), *((x, heads) for x in (*c[1:], gamma[i:j], run[i:j])), (w, grams), (n[s:e], grams))
            rows += [(x, self.id, body) for x, body in zip(g.bucket[cut[a:b]].tolist(), bodies, strict=True)]
            a = b
        return rows

    def scores(self, order: int, n_all: float, v_all: int, add: float) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability under the words alone and under the model."""
        p1 = p = ((self.n_word + add) / (n_all + add * (v_all + 1)))[self.word]
        if order > 1:
            two = self.level2()
            alpha, gamma = self._answers(2, two.order)
            weight = dequantise(quantise(self.backoff[0] / (self.n_context + self.backoff[0])))[self.before]
            # the last place, which -1 means, is that of none
            p = np.append(dequantise(alpha), 0.0)[two.at] + weight * p
        if order > 2:
            before = np.empty_like(two.at)
            before[1:] = two.at[:-1]
            before[self.t.first] = -1
            weight = np.append(dequantise(gamma, 1.0), 1.0)[before]
            three = self.level3()
            alpha = self._answers(3, three.order)[0]
            p = np.append(dequantise(alpha), 0.0)[three.at] + weight * p
        return p1, p


_ASK, _REPLY = "bucket long, segment_id long, body binary", "segment_id long, bucket long, level int, body binary"
_ASK_FIELDS = pa.schema([("bucket", pa.int64()), ("segment_id", pa.int64()), ("body", pa.binary())])
_REPLY_FIELDS = pa.schema([("segment_id", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("body", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema.types, strict=True)], schema=schema)


def _level_file(model: str, level: int, bucket: int) -> str:
    return f"{model}/level{level}/{bucket}.trie"


def _joined(replies: pa.Table, n_buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A segment's replies, level by level, in the order of their buckets."""
    got: dict[int, list] = {}
    for level, bucket, body in sorted(zip(*(replies.column(c).to_pylist() for c in ("level", "bucket", "body")), strict=True)):
        if level:
            got.setdefault(level, []).append((bucket, body))
    known = {}
    for level, rows in got.items():
        bucket, bodies = zip(*rows, strict=True)
        (first, cut), (second, _) = unpack_many(bodies, 2)
        if level == 1:  # a rank in a bucket to an id of its own
            bucket = np.repeat(np.array(bucket, np.uint64), np.diff(cut))
            first = np.where(first > 0, (first - np.minimum(first, np.uint64(1))) * np.uint64(n_buckets) + bucket + np.uint64(2), np.uint64(UNKNOWN))
        known[level] = first, second
    return known


def _gather(replies: DataFrame, side: str, n_buckets: int) -> DataFrame:
    """The list of segments, staged, once the replies of each lie in its side file: a row of level 0 for each."""

    def keep(table: pa.Table) -> pa.Table:
        release()
        segment_id = table.column("segment_id")[0].as_py()
        for level, codes in _joined(table, n_buckets).items():
            write_file(f"{side}/{segment_id}.{level}", pack_all(*codes))
        return _table([(segment_id, 0, 0, b"")], _REPLY_FIELDS)

    found = stage(replies.groupBy("segment_id").applyInArrow(keep, _REPLY), "lm-segments", settle=True)
    # Spark holds an execution until its last events are handled: after another, small one the level's shuffles are garbage as well
    found.count()
    found.sparkSession._jvm.System.gc()
    return found


def _own_file(model: str, level: int, bucket: int, keep: bool) -> str:
    """A level's file; one that goes after its answers belongs to one attempt of the task, so that no other attempt takes it away."""
    return _level_file(model, level, bucket) + ("" if keep else f".{uuid.uuid4().hex}")


def _mapped(path: str, written: bool) -> np.ndarray:
    """The words of a level's file.  One that has been written must be there; a kept model has no file for a bucket of which it learnt nothing."""
    known = map_file(path)
    if written and not len(known):
        raise FileNotFoundError(f"a level of the model is missing: {path}")
    return known


def _words(docs: DataFrame, model: str, side: str, learn: bool, keep: bool, n_buckets: int, folds: int, path: str) -> DataFrame:
    """Level 1, staged in ``path``: each segment's words with their ranks and counts; tokens go to the side files."""

    def entries(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, table in enumerate(runs(batches, "text", SEGMENT_BYTES)):
            segment_id = part << 24 | k
            t, words = _Tokens.of_texts(table, folds)
            write_file(f"{side}/{segment_id}", t.dump())
            n = np.bincount(t.at[t.train], minlength=len(words))
            cut = bucket_bounds(words, n_buckets)
            some = np.flatnonzero(np.diff(cut))
            cut = np.append(cut[some], len(words))
            rows = [(b, segment_id, body) for b, body in zip(some.tolist(), pack_many((gaps_within(words, cut), cut), (n, cut)), strict=True)]
            yield from _table(rows, _ASK_FIELDS).to_batches()

    def serve(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket")[0].as_py()
        path = _own_file(model, 1, bucket, keep)
        (keys, cut), (n, _) = unpack_many(table.column("body").to_pylist(), 2)
        asked, at = np.unique(sums_within(keys, cut), return_inverse=True)
        if learn:
            total = np.bincount(at, n, len(asked))
            held = np.flatnonzero(total > 0)
            rank = np.empty(len(held), np.int64)
            rank[np.argsort(-total[held], kind="stable")] = np.arange(len(held))
            write_file(path, WordLevel.encode(asked[held], rank, total[held]).tobytes())
        known = _mapped(path, learn)
        if not keep:
            remove_file(path)
        rank, count = WordLevel(known.view(np.uint64)).find(asked) if len(known) else (np.zeros(len(asked), np.uint64),) * 2
        n, v = float(count.sum()), int((count > 0).sum())
        rows = [(seg, bucket, 1, body, n, v) for seg, body in zip(table.column("segment_id").to_pylist(), pack_many((rank[at], cut), (count[at], cut)), strict=True)]
        return _table(rows, _REPLY_FIELDS.append(pa.field("bucket_n", pa.float64())).append(pa.field("bucket_v", pa.int64())))

    sent = docs.mapInArrow(tidy(entries), _ASK)
    return stage(sent.groupBy("bucket").applyInArrow(serve, _REPLY + ", bucket_n double, bucket_v long"), "words", settle=True, path=path)


def _level(segments: DataFrame, level: int, last: bool, model: str, side: str, learn: bool, keep: bool, n_buckets: int, folds: int, backoff: tuple[float, ...], split: int) -> DataFrame:
    """The answers of level 2 or 3 to the segments' n-grams."""

    def entries(batches):
        for batch in batches:
            for segment_id in batch.column("segment_id").to_pylist():
                release()
                yield from _table(_Segment(side, segment_id, folds, n_buckets, backoff, split).asked(level), _ASK_FIELDS).to_batches()

    def serve(table: pa.Table) -> pa.Table:
        release()
        bucket, size = table.column("bucket")[0].as_py(), level - 1
        path = _own_file(model, level, bucket, keep)
        (ids, cut), *columns = unpack_many(table.column("body").to_pylist(), size + 5)
        ids = sums_within(ids, cut)
        words, _, place = _distinct(ids, int(ids.max()) + 1)
        if len(words) ** level >= 1 << 63:
            raise ValueError("too many words in a bucket: use smaller buckets")
        placed = lambda x, own: place[x.view(np.int64) + np.repeat(cut[:-1], np.diff(own))]
        *context, (gamma, _), (run, _), (word, own), (n, _) = columns
        head = placed(sums_within(*context[0]), context[0][1])
        for c in context[1:]:
            head = head * len(words) + placed(*c)
        # contexts first, then successors under them: two short numbers are sorted faster than a long one
        heads, some, of = _distinct(head, len(words) ** size)
        asked, _, at = _distinct(np.repeat(of * len(words), run.view(np.int64)) + placed(word, own), len(heads) * len(words))
        of = asked // len(words)
        word = asked - of * len(words)
        *context, _ = columns = np.empty((level, len(heads)), np.int64)
        left = heads
        for column in columns[-2::-1]:
            left, column[:] = np.divmod(left, len(words))
        if learn:
            total = np.bincount(at, n, len(asked))
            weight = dequantise(gamma[some].astype(np.uint16))
            weight = np.where(weight > 0, weight, backoff[level - 2] / (np.bincount(of, total, len(heads)) + backoff[level - 2]))
            held = np.flatnonzero(total > 0)
            alpha = quantise(total[held] * weight[of[held]] / backoff[level - 2])
            gamma = np.zeros(len(held), np.uint16) if last else quantise(backoff[level - 1] / (total[held] + backoff[level - 1]))
            write_file(path, TrieLevel.encode_runs(words, context, of[held], word[held], alpha, gamma).tobytes())
            del total, weight, held, alpha, gamma
        known = _mapped(path, learn)
        if not keep:
            remove_file(path)
        alpha, gamma = TrieLevel(known.view(np.uint64)).find_runs(words, context, of, word) if len(known) else (np.zeros(len(word), np.uint16),) * 2
        # nothing has a context of the last level
        bodies = pack_many((alpha[at], own), (gamma[:0], own * 0) if last else (gamma[at], own))
        rows = [(seg, bucket, level, body) for seg, body in zip(table.column("segment_id").to_pylist(), bodies, strict=True)]
        return _table(rows, _REPLY_FIELDS)

    return segments.mapInArrow(tidy(entries), _ASK).groupBy("bucket").applyInArrow(serve, _REPLY)


def score(docs: DataFrame, order: int = 3, folds: int = 10, add: float = ADD, backoff: tuple[float, ...] = BACKOFF, bucket_bytes: int = BUCKET_BYTES, split: int = SPLIT, model: str | None = None, learn: bool = True) -> DataFrame:
    """Per row of ``docs``: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logarithms to base 10.

    Rows whose crc32(doc_id as text) modulo ``folds`` is 0 are held out and train nothing.  Tokens are ASCII-lower-cased
    runs of anything but ASCII white space and one end mark per row.  Null and empty texts have the end mark alone; a
    null doc_id is the text ``null``; repeated rows are scored and counted each.  An empty table gives no rows.  Words
    are told apart by 64-bit hashes.  ``order`` is 1, 2 or 3.

    With a folder ``model``, the model's levels lie there once the result has been computed; without one, each goes as soon
    as it has answered.  With ``learn`` False the levels found there are only searched: ``docs`` are scored by a model of
    other documents, with its order, pseudo-counts and buckets.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keep, side = model is not None, new_path(spark, "lm-tokens")
    model = model or new_path(spark, "lm")
    if learn:
        n_buckets = max(32, -(-text_bytes(picked) // bucket_bytes))
    else:
        known = json.loads(map_file(f"{model}/model.json").tobytes())
        order, add, backoff, split, n_buckets = known["order"], known["add"], tuple(known["backoff"]), known["split"], known["n_buckets"]
    table = new_path(spark, "lm-words")
    words = _words(picked, model, side, learn, keep, n_buckets, folds, table)
    if learn:
        n_all, v_all = words.select("bucket", "bucket_n", "bucket_v").distinct().agg(F.sum("bucket_n"), F.sum("bucket_v")).first()
        n_all, v_all = float(n_all or 0), int(v_all or 0)
        known = {"order": order, "add": add, "backoff": backoff, "split": split, "n_buckets": n_buckets, "n": n_all, "v": v_all}
        write_file(f"{model}/model.json", json.dumps(known).encode())
    n_all, v_all = known["n"], known["v"]
    found = _gather(words.drop("bucket_n", "bucket_v"), side, n_buckets)
    remove_folder(spark, table)
    # the list is small: without a number its partitions would be merged into one task
    n_tasks = min(max(1, found.count()), MAX_TASKS)
    replies = segments = found.repartition(n_tasks, "segment_id")
    for level in range(2, order + 1):
        # every segment goes through every level, even one that has nothing to ask
        replies = _level(segments, level, level == order, model, side, learn, keep, n_buckets, folds, backoff, split).unionByName(found)
        if level < order:
            found = _gather(replies, side, n_buckets)
            segments = found.repartition(n_tasks, "segment_id")

    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def combine(table: pa.Table) -> pa.Table:
        release()
        s = _Segment(side, table.column("segment_id")[0].as_py(), folds, n_buckets, backoff, split, _joined(table, n_buckets))
        t, (p1, p) = s.t, s.scores(order, n_all, v_all, add)
        logs = lambda x: np.add.reduceat(np.log10(x), t.first)
        values = (t.ids, ~t.train_row, t.n, np.add.reduceat((s.n_word > 0)[s.word].astype(np.int64), t.first), np.full(len(t.n), int(n_all)), logs(p1), logs(p))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], schema=fields)

    return replies.groupBy("segment_id").applyInArrow(combine, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
