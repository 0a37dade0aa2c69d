"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

Layout of a ``*.tzs`` file, all integers little-endian:

* data frames: zstandard frames, each the ids of a run of whole documents, ``uint16`` or ``uint32``;
* index frame: a skippable frame (0x184D2A5D) with one 24-byte record per document: doc_id i64, frame u32, ids before
  it in the frame u32, its ids u64;
* seek table: a skippable frame (0x184D2A5E) as in the public seekable format: per frame compressed size u32,
  decompressed size u32, low 32 bits of the XXH64 of the content u32; then frames u32, descriptor u8 (0x80), magic
  0x8F92EAB1.  The four bytes of reserved user data before it are not used; the id width and the index frame's size
  are the first 8 bytes of the index frame.

A reader fetches the tail, then only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, new_path, small_batches, tidy
from .tokens import default_path, encoder, slices

FRAME_BYTES = 1 << 20
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
INDEX = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u8")])
#: doc_id of a row whose id is null.
NO_ID = np.iinfo(np.int64).min
#: Tasks that read files, at most.
MAX_TASKS = 100_000


class Writer:
    """Writes one file; memory is one frame and the index."""

    def __init__(self, stream, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.width, self.limit = stream, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.n and (self.n + len(ids)) * self.width > self.limit:
            self._flush()
        self.index.append((doc_id, len(self.frames), self.n, len(ids)))
        self.held.append(ids.astype(f"<u{self.width}"))
        self.n += len(ids)

    def _flush(self) -> None:
        import xxhash

        raw = np.concatenate(self.held).tobytes() if self.held else b""
        if len(raw) >= 1 << 32:
            raise ValueError("a frame over 4 GiB: the seek table can't hold it")
        body = self.zstd.compress(raw)
        self.out.write(body)
        self.frames.append((len(body), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n = [], 0

    def close(self) -> int:
        if self.n:
            self._flush()
        records = np.array(self.index, INDEX).tobytes()
        size = 8 + len(records)
        self.out.write(struct.pack("<IIII", INDEX_MAGIC, size, self.width, size + 8) + records)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC))
        return len(self.index)


class Reader:
    """Random access: ``documents()`` lists the index, ``read(i)`` decompresses one frame and checks it."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = self._at(size - 9, 9)
        n, flags, magic = struct.unpack("<IBI", tail)
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        table = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), np.dtype([("c", "<u4"), ("d", "<u4"), ("x", "<u4")]))
        self.starts = np.concatenate([[0], np.cumsum(self.frames["c"].astype(np.int64))])
        head = int(self.starts[-1])
        magic, length, self.width, _ = struct.unpack("<IIII", self._at(head, 16))
        if magic != INDEX_MAGIC:
            raise ValueError("no index")
        self.index = np.frombuffer(self._at(head + 16, length - 8), INDEX)
        self.held = (-1, None)

    def _at(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def _frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if self.held[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.frames["c"][k])), max_output_size=int(self.frames["d"][k]))
            if len(raw) != self.frames["d"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["x"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, np.frombuffer(raw, f"<u{self.width}"))
        return self.held[1]

    def read(self, i: int) -> np.ndarray:
        _, frame, at, n = self.index[i].tolist()
        return self._frame(frame)[at : at + n] if n else np.zeros(0, f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the files in ascending doc_id order; returns the manifest (part, file, n_docs, n_ids).

    Rows are dealt by ranges of doc_id and sorted inside; part numbers follow the ranges.  A task writes under a name of
    its own and its manifest row names that file, so a repeated or lost attempt leaves a stray file, never a wrong one.
    Rows of equal doc_id are ordered by text; null ids come first; null texts are empty.
    """
    spark = docs.sparkSession
    vocabulary, out = tokenizer or default_path(), path or new_path(spark, "tokens")
    small_batches(spark, 500)

    def write(batches):
        from pyspark import TaskContext

        part, name, w, n_ids = TaskContext.get().partitionId(), "", None, 0
        enc = encoder(vocabulary)
        width = 2 if max(enc.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
        for b in batches:
            if not b.num_rows:
                continue
            if w is None:
                fs, root = file_system(out)
                fs.create_dir(root, recursive=True)
                name = f"part-{part:05d}-{uuid.uuid4().hex}.tzs"
                w = Writer(fs.open_output_stream(f"{root}/{name}", compression=None), width)
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s in slices(texts):
                for d, x in zip(ids[s], enc.encode_all(texts[s]), strict=True):
                    w.add(NO_ID if d is None else d, np.append(x, np.uint32(end_id)))
                    n_ids += len(x) + 1
        if w is not None:
            n = w.close()
            w.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (f"{out}/{name}", pa.string()), (n, pa.int64()), (n_ids, pa.int64()))], names=["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = (rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    manifest = dealt.mapInArrow(tidy(write), "part long, file string, n_docs long, n_ids long")
    table = f"{out}/manifest"
    manifest.write.mode("overwrite").parquet(table)
    return spark.read.schema(manifest.schema).parquet(table)


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files, in its place: (doc_id, start, n_tokens, ids_crc32, ids array<int>); ``with_ids`` False leaves the last out.

    A file's offset is the sum of the ids of the files before it: a running sum over one row per file.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    files = manifest.select("part", "file", before.alias("first"))

    def read(batches):
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, p = file_system(file)
                with fs.open_input_file(p) as f:
                    r = Reader(f, f.size())
                    start = first
                    for lo in range(0, len(r.index), 256):
                        hi = min(len(r.index), lo + 256)
                        ids = [r.read(i) for i in range(lo, hi)]
                        n = np.array([len(x) for x in ids], np.int64)
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        doc = r.index["doc_id"][lo:hi]
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                        columns = {"doc_id": pa.array(doc, mask=doc == NO_ID), "start": pa.array(starts), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                        if with_ids:
                            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # a stated number of partitions: adaptive execution doesn't join the few bytes that name the files into one task
    return _spread(files, "part").select("file", "first").mapInArrow(read, schema)


def _spread(files: DataFrame, key: str) -> DataFrame:
    """Rows that stand for a file each, some to a task."""
    return files.repartition(max(1, min(files.count(), MAX_TASKS)), key)


def lookup(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents of ``wanted`` (doc_id): each file's index is listed, joined with the wanted ids, and only their frames are decompressed."""

    def places(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, p = file_system(file)
                with fs.open_input_file(p) as f:
                    ids = Reader(f, f.size()).index["doc_id"]
                for s in range(0, len(ids), 1 << 16):
                    some = ids[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(some)), "place": pa.array(np.arange(s, s + len(some))), "doc_id": pa.array(some)})

    def read(table: pa.Table) -> pa.Table:
        fs, p = file_system(table.column("file")[0].as_py())
        places = np.sort(table.column("place").to_numpy())
        with fs.open_input_file(p) as f:
            r = Reader(f, f.size())
            ids = [r.read(i).astype(np.int32) for i in places.tolist()]
        return pa.table({"doc_id": pa.array(r.index["doc_id"][places]), "ids": pa.array(ids, pa.list_(pa.int32()))})

    listed = _spread(manifest, "part").select("file").mapInArrow(places, "file string, place long, doc_id long")
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id") != NO_ID).distinct()
    return listed.join(ids, "doc_id").groupBy("file").applyInArrow(read, "doc_id long, ids array<int>")
