"""Removal of repeated word windows (exact substring deduplication).

Every window of ``width`` words gets a 64-bit Rabin-Karp hash.  A segment of documents first combines its own windows:
one entry (hash, smallest document) per distinct hash.  Entries are dealt by hash range, so a passage that a third of
all documents share has one entry per segment, not one per document.  A bucket answers each entry with one bit: does
another segment hold the window in a smaller document?  With that bit a segment knows, for every window, whether its
sequence starts in a smaller document, and merges the repeated windows of a document into maximal intervals.

Two windows are taken to be equal when their hashes are; the chance that any of n distinct windows is confused with
another is about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bounds, from_ipc, pack, pack_sorted, release, segments, shingle_hash, small_batches, tidy, unpack, unpack_sorted, word_hashes

#: Text bytes per bucket of hashes.
BUCKET_BYTES = 3_000_000
NO_ID = np.iinfo(np.int64).max


def _words(table: pa.Table) -> Iterator[list[bytes]]:
    """The words of each row in turn, so that one text's words are held at a time."""
    for x in table.column("text").cast(pa.large_binary()):
        yield (x.as_py() or b"").split()


def _windows(table: pa.Table, width: int):
    """Windows of each row, and per window: hash, document order (a null doc_id comes after all others)."""
    ids = np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    hashes = [shingle_hash(word_hashes(w), width) for w in _words(table)]
    n = np.array([len(h) for h in hashes], np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return n, h, np.repeat(ids, n)


def _distinct(h: np.ndarray, ids: np.ndarray):
    """Ascending distinct hashes, the smallest id of each, and each window's place among them."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[order], starts) if len(starts) else np.zeros(0, np.int64)
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return s[starts], low, at


def intervals(covered: np.ndarray, width: int, n_words: int) -> tuple[list[int], list[int]]:
    """Maximal [start, end) word ranges that the repeated windows cover."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, covered, 1)
    np.add.at(marks, covered + width, -1)
    inside = (np.cumsum(marks[:-1]) > 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], inside, [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def repeated_spans(docs: DataFrame, width: int = 13, bucket_bytes: int = BUCKET_BYTES, carry: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, starts, ends, kept_text, and ``row``, a struct of the columns named in ``carry``.

    ``starts``/``ends`` are the maximal word ranges of windows whose sequence also starts in a document of smaller
    doc_id, judged on the input; ``kept_text`` is the rest, joined by one space
    (with ``verbatim``, a text that loses nothing is returned as it is).  Words are runs of anything but ASCII
    white space.  Null and empty texts have no words; texts under ``width`` words lose none; rows of equal doc_id are
    one document for this purpose; a row of null doc_id comes after all others.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    segs = segments(picked, picked.columns)
    total = segs.agg(F.sum("text_bytes")).first()[0] or 0
    n_buckets = max(32, -(-total // bucket_bytes))
    small_batches(docs.sparkSession, 200)

    def entries(batches):
        for batch in batches:
            for seg, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, h, ids = _windows(from_ipc(body.as_buffer()), width)
                keys, low, _ = _distinct(h, ids)
                cut = bucket_bounds(keys, n_buckets)
                rows = [(b, seg, pack_sorted(keys[s:e]), int(low[s:e].min()), pack((low[s:e] - low[s:e].min()).astype(np.uint64))) for b, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if s < e]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "segment_id", "keys", "base", "low"])

    def answer(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        low = [unpack(r["low"]).astype(np.int64) + r["base"] for r in rows]
        n = np.cumsum([0, *(len(k) for k in keys)])
        h, ids = np.concatenate(keys), np.concatenate(low)
        _, least, at = _distinct(h, ids)
        bit = ids > least[at]
        return pa.table({"segment_id": pa.array([r["segment_id"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "bits": pa.array([np.packbits(bit[s:e]).tobytes() for s, e in zip(n, n[1:], strict=False)], pa.binary()), "n": pa.array(np.diff(n), pa.int64())})

    sent = segs.select("segment_id", "body").mapInArrow(tidy(entries), "bucket int, segment_id long, keys binary, base long, low binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "segment_id long, bucket int, bits binary, n long")

    schema = "doc_id long, n_words long, starts array<int>, ends array<int>, kept_text string" + (f", row {dict(picked.dtypes)['row']}" if carry else "")

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        out: list[tuple] = []
        if left.num_rows:
            table = from_ipc(left.column("body")[0].as_buffer())
            n, h, ids = _windows(table, width)
            keys, low, at = _distinct(h, ids)
            parts = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "bits", "n")), strict=True))
            bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=m) for _, b, m in parts]).astype(bool) if parts else np.zeros(0, bool)
            gone = bits[at] | (ids > low[at]) if len(h) else np.zeros(0, bool)
            ends = np.cumsum(n)
            texts = table.column("text")
            for i, w in enumerate(_words(table)):
                here = np.flatnonzero(gone[ends[i] - n[i] : ends[i]])
                if len(here):
                    s, e = intervals(here, width, len(w))
                    kept = [x for a, b in zip([0, *e], [*s, len(w)], strict=True) for x in w[a:b]]
                else:
                    s, e, kept = [], [], w
                out.append((len(w), s, e, texts[i].as_py() if verbatim and not s else b" ".join(kept).decode("utf-8", "replace")))
            cols = {"doc_id": table.column("doc_id")} | {k: pa.array([r[j] for r in out], t) for j, (k, t) in enumerate((("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept_text", pa.string())))}
            return pa.table(cols | ({"row": table.column("row")} if carry else {}))
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int32())), "ends": pa.array([], pa.list_(pa.int32())), "kept_text": pa.array([], pa.string())})

    return segs.groupBy("segment_id").cogroup(replies.groupBy("segment_id")).applyInArrow(finish, schema)


def removal_digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``repeated_spans``."""
    lost = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


