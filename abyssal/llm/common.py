"""Shared helpers: shared-folder staging, document segments, compact integer blobs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Text bytes of one segment; bounds what a task decodes at a time.
SEGMENT_BYTES = 6_000_000
#: Rows of one segment at most, and what a row counts for beside its text.
SEGMENT_ROWS, ROW_BYTES = 1 << 18, 16
SEGMENT_SCHEMA = "segment_id long, n_rows long, text_bytes long, body binary"


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (``spark.checkpoint.dir``)."""
    return new_folder(spark, name)


def stage(df: DataFrame, name: str, settle: bool = False, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation of it.

    With ``settle`` the driver collects its garbage, upon which Spark removes the files of shuffles that no plan holds any more.
    """
    spark, schema, path = df.sparkSession, df.schema, path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    del df
    if settle:
        spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def file_system(path: str):
    """The file system of a path that tasks read or write themselves, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_file(path: str, body: bytes) -> None:
    """A whole file or none: written under a name of its own and moved.  Attempts of one task write the same bytes."""
    fs, at = file_system(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as f:
        f.write(body)
    try:
        fs.move(own, at)
    except OSError:  # another attempt was first, where a move doesn't replace
        fs.delete_file(own)


def map_file(path: str) -> np.ndarray:
    """The bytes of a file, mapped into memory where the file system can; empty if there is no such file."""
    from pyarrow import fs as kinds

    fs, at = file_system(path)
    if fs.get_file_info(at).type != kinds.FileType.File:
        return np.zeros(0, np.uint8)
    with pa.memory_map(at) if isinstance(fs, kinds.LocalFileSystem) else fs.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(f.size()), np.uint8)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later job reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_file(path: str) -> None:
    fs, at = file_system(path)
    try:
        fs.delete_file(at)
    except OSError:  # another attempt has done it
        pass


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch handed to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give freed memory of this Python worker back to the system: workers live on from stage to stage, beside the heap."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(each):
    """A function of Arrow batches that releases memory when its task ends."""

    def run(batches):
        try:
            yield from each(batches)
        finally:
            release()

    return run


#: Bits of a sieve at most: a million words of 64.
SIEVE_BITS = 26


def sieve(wanted: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A filter of one hash function for the long column ``key`` of ``wanted``, as a table (word, bits) of bounded size, and its number of bits.

    16 bits a row, up to ``SIEVE_BITS``: beyond, more rows pass that aren't wanted, and the exact join that follows turns them away.
    """
    n = max(1 << 12, min(1 << SIEVE_BITS, 1 << (16 * wanted.count()).bit_length()))
    at = F.col(key).bitwiseAND(F.lit(n - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = wanted.select(F.shiftright(at, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return stage(words, "sieve"), n


def sifted(rows: DataFrame, key: str, words: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``_maybe``: whether the long column ``key`` may be among the wanted ones.  What is broadcast is a sieve of bounded size; rows stay where they are."""
    at = F.col(key).bitwiseAND(F.lit(n - 1))
    told = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("word"), "left")
    return told.withColumn("_maybe", F.getbit(F.coalesce("bits", F.lit(0).cast("long")), at.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("word", "bits")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, for sizing buckets; one column is scanned and one number returned."""
    return docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


# --- segments: runs of whole documents, compressed, read again and again by the same id -----------------


def to_ipc(table: pa.Table | pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write(table)
    return out.getvalue().to_pybytes()


def from_ipc(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def runs(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int = SEGMENT_ROWS) -> Iterator[pa.Table]:
    """Regroup batches into tables of about ``limit`` bytes of ``column`` and at most ``rows`` rows; one longer document is a table of its own.

    A row counts for some bytes beside its text, so that short and null texts end a table too.
    """
    held, size, count = [], 0, 0
    for batch in batches:
        lengths = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()) if batch.num_rows else None
        if lengths is None:
            continue
        import pyarrow.compute as pc

        n = np.asarray(pc.fill_null(pc.binary_length(lengths), 0)).astype(np.int64) + ROW_BYTES
        start, total = 0, size
        for i, x in enumerate(n.tolist()):
            total += x
            count += 1
            if total >= limit or count == rows:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, start, total, count = [], i + 1, 0, 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
        size = total
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def segments(docs: DataFrame, columns: list[str], text: str = "text", limit: int = SEGMENT_BYTES, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Stage ``columns`` of every row as compressed segments of whole documents (no shuffle: each scan task cuts its own)."""
    small_batches(docs.sparkSession)
    picked = docs.select(*columns)

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, t in enumerate(runs(batches, text, limit, rows)):
            size = sum(len(x) for x in t.column(text).cast(pa.large_binary()).to_pylist() if x is not None)
            yield pa.RecordBatch.from_pydict(
                {"segment_id": pa.array([part << 24 | k], pa.int64()), "n_rows": pa.array([t.num_rows], pa.int64()), "text_bytes": pa.array([size], pa.int64()), "body": pa.array([to_ipc(t)], pa.binary())}
            )

    return stage(picked.mapInArrow(tidy(cut), SEGMENT_SCHEMA), "segments")


# --- compact integers ----------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers at the smallest whole number of bytes that holds the largest, byte by byte: all lowest bytes first.

    Bytes of one weight are alike, so zstandard shortens them; the first byte is the width, plus 128 where it did.
    """
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    short = zstandard.compress(planes, 1) if len(planes) > 64 else planes
    return bytes([width | 128]) + short if len(short) < len(planes) else bytes([width]) + planes


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0] & 127
    planes = zstandard.decompress(blob[1:]) if blob[0] & 128 else blob[1:]
    raw = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def pack_all(*arrays: np.ndarray) -> bytes:
    """Several arrays of unsigned integers in one blob: their sizes and widths, then all byte planes, shortened together."""
    heads, planes = [], []
    for v in arrays:
        v = np.ascontiguousarray(v, dtype="<u8")
        width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
        heads.append(len(v) << 4 | width)
        planes += [(v >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width)]
    return np.array(heads, "<u8").tobytes() + zstandard.compress(b"".join(planes), 3)


def unpack_all(blob, n: int) -> list[np.ndarray]:
    """The ``n`` arrays of ``pack_all``."""
    heads = np.frombuffer(blob[: 8 * n], "<u8").tolist()
    raw, at, out = np.frombuffer(zstandard.decompress(blob[8 * n :]), np.uint8), 0, []
    for head in heads:
        size, width = head >> 4, head & 15
        v = raw[at : at + size].astype("<u8")
        for k in range(1, width):
            v |= raw[at + k * size : at + (k + 1) * size].astype("<u8") << np.uint64(8 * k)
        at += size * width
        out.append(v)
    return out


def pack_many(*columns: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """A blob as of ``pack_all`` for each of many groups; a column is its values and the bounds of the groups in them.

    Columns are cut into byte planes once, so that a group costs little beside its bytes.
    """
    heads, cuts, planes = [], [], []
    for v, cut in columns:
        v, size = np.ascontiguousarray(v, dtype="<u8"), np.diff(cut)
        top, some = np.zeros(len(size), np.uint64), np.flatnonzero(size)
        if len(some):
            top[some] = np.maximum.reduceat(v[: cut[-1]], cut[:-1][some])
        width = 1 + sum((top >> np.uint64(8 * k) > 0).astype(np.int64) for k in range(1, 8))
        heads.append(size << 4 | width)
        cuts.append([*zip(cut[:-1].tolist(), cut[1:].tolist(), width.tolist(), strict=True)])
        planes.append([(v >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width.max(initial=0))])
    head, size, compress = np.stack(heads, 1).astype("<u8").tobytes(), 8 * len(columns), zstandard.ZstdCompressor(3).compress
    bodies = (b"".join([x[s:e] for (s, e, width), of in zip(group, planes, strict=True) for x in of[:width]]) for group in zip(*cuts, strict=True))
    return [head[size * i : size * (i + 1)] + compress(body) for i, body in enumerate(bodies)]


def unpack_many(blobs: list[bytes], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The columns of ``pack_many`` or of many blobs of ``pack_all``, each with the bounds of the groups in it."""
    heads = np.frombuffer(b"".join([x[: 8 * n] for x in blobs]), "<i8").reshape(-1, n)
    sizes, widths, decompress = heads >> 4, heads & 15, zstandard.ZstdDecompressor().decompress
    raw, out = [decompress(x[8 * n :]) for x in blobs], []
    at = np.cumsum(sizes * widths, 1) - sizes * widths
    for j in range(n):
        groups = [*zip(raw, at[:, j].tolist(), sizes[:, j].tolist(), widths[:, j].tolist(), strict=True)]
        v = np.zeros(int(sizes[:, j].sum()), "<u8")
        for k in range(widths[:, j].max(initial=0)):
            plane = b"".join([x[a + k * size : a + (k + 1) * size] if k < width else bytes(size) for x, a, size, width in groups])
            v |= np.frombuffer(plane, np.uint8).astype("<u8") << np.uint64(8 * k)
        out.append((v, np.concatenate([[0], np.cumsum(sizes[:, j])])))
    return out


def gaps_within(ascending: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The first of each ascending group between the bounds ``cut``, then its differences."""
    out, starts = np.empty_like(ascending), cut[:-1][np.diff(cut) > 0]
    out[1:] = ascending[1:] - ascending[:-1]
    out[starts] = ascending[starts]
    return out


def sums_within(gaps: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """What ``gaps_within`` was made of."""
    total = np.concatenate([np.zeros(1, gaps.dtype), np.cumsum(gaps, dtype=gaps.dtype)])
    return total[1:] - np.repeat(total[cut[:-1]], np.diff(cut))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers: the first, then the gaps."""
    keys = np.ascontiguousarray(keys, dtype="<u8")
    return keys[:1].tobytes() + pack(np.diff(keys))


def unpack_sorted(blob: bytes) -> np.ndarray:
    first, gaps = np.frombuffer(blob[:8], "<u8"), unpack(blob[8:])
    return np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """``keys`` ascending 64-bit hashes; buckets are equal ranges of their upper 32 bits.  Returns n + 1 offsets."""
    at = ((np.arange(1, n, dtype=np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n) if n > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, at << np.uint64(32)), [len(keys)]]).astype(np.int64)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


def shingle_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every ``width`` consecutive word values, finished by an avalanche so that all bits are even."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= base
            out += h[i : i + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out
