"""First-fit decreasing packing of documents into fixed-length training sequences.

Documents are tokenised once.  One over the sequence length is cut at its multiples; the full pieces are sequences of
their own and the rest is packed with the short documents: longest first, each into the first open bin with room,
found by descending a tournament tree of bin capacities.  Groups are packed independently: a document's group is a
seeded hash of its id and place, so groups are alike in their lengths and a group's rows are bounded by the choice of
their number.  Only lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, tidy
from .tokens import CACHE_WORDS, default_path, encoder, slices

SEQUENCE = 4096
END_ID = 2
#: Pieces of a group, about.
GROUP_PIECES = 20_000


class CapacityTree:
    """Tournament tree over bins: each node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; returns the bin (there is always one per item)."""
        i, most = 1, self.most
        while i < self.leaves:
            i *= 2
            if most[i] < need:
                i += 1
        most[i] -= need
        at = i
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return at - self.leaves


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; ties keep their order."""
    tree, used = CapacityTree(max(1, len(lengths)), capacity), {}
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = tree.place(int(lengths[i]))
        at[i], offset[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + int(lengths[i])
    return at, offset


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy) per piece of each row's ids followed by ``end_id``.

    ``copy`` tells equal pieces of equal ids apart, as far as one task sees them: 0 for the first of a batch.
    """
    path = tokenizer or default_path()
    small_batches(docs.sparkSession, 500)

    def each(batches):
        enc, end = encoder(path, cache_words), np.array([end_id], "<u4")
        for k, b in enumerate(batches):
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: list[tuple] = []
            seen: Counter = Counter()
            for s in slices(texts):
                for d, ids in zip(doc_ids[s], enc.encode_all(texts[s]), strict=True):
                    all_ids = np.concatenate([ids.astype("<u4"), end])
                    for a in range(0, len(all_ids), length):
                        crc = zlib.crc32((x := all_ids[a : a + length]).tobytes())
                        copy = seen[d, a, crc]
                        seen[d, a, crc] += 1
                        rows.append((d, a, len(x), crc, len(all_ids), copy and k << 32 | copy))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(each), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, seed: int = 7, group_pieces: int = GROUP_PIECES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``pieces`` with (sequence_id, offset).

    Offsets of a sequence are gapless from 0.  Null and empty texts are a single end id.  Rows with equal or null doc_id
    are packed as separate rows; many copies of one row go to different groups.  An empty table gives no rows.
    """
    cut = stage(pieces(docs, tokenizer, length, end_id, cache_words), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def packed(table: pa.Table) -> pa.Table:
        # one order of the rows whatever the shuffle did
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "start", "ids_crc32", "copy")])
        at, offset = first_fit_decreasing(table.column("length").to_numpy(), length)
        group = table.column("group_id").to_numpy()
        return table.drop_columns(["group_id", "copy"]).append_column("sequence_id", pa.array(group * (1 << 32) + at, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy", F.lit(seed)), F.lit(groups)).cast("long")
    return cut.withColumn("group_id", group).groupBy("group_id").applyInArrow(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, used, padded, n_pieces): a sequence is padded to the full length unless its own is a power of two."""
    used = F.sum("length")
    out = packed.groupBy("sequence_id").agg(used.alias("used"), F.count("*").alias("n_pieces"))
    return out.withColumn("padded", F.when(F.bit_count("used") == 1, F.col("used")).otherwise(F.lit(SEQUENCE).cast("long")))
