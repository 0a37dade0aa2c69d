"""Chroma audio fingerprints and their alignment.

A recording (PCM) becomes frames of pitch-class energy; filters over an integral image of the frames, each quantised
to two bits by Gray code, make one packed 32-bit integer per frame.  Two recordings are aligned by the histogram of
frame offsets at which they share integers, and judged by the share of differing bits at the best offset.

Recordings with the same fingerprint are one class.  Only classes are compared; rows keep their class.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

RATE, FRAME, HOP = 8000, 2048, 512
LOW_HZ, HIGH_HZ = 55.0, 3520.0
WIDTH = 8  # frames that a filter looks at
#: Shared keys at one offset from which a pair is judged; bit errors up to which it is a match (unlike recordings come down to 0.25 at some offset by chance).
MIN_VOTES, MAX_BER = 2, 0.1
#: Frames between the two codes of an index key: from 4 on, no window of samples in common.
LAGS = (4, 6, 8)


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters (kind, first pitch class, classes, frames), spread by rule over the six kinds of difference."""
    return [(i % 6, (5 * i) % 12, 2 + (7 * i) % 11 if i % 6 else 1 + i % 4, 2 + (3 * i) % (WIDTH - 1)) for i in range(16)]


_FILTERS = filters()
#: Quantiser steps of the log ratio of a filter's two areas.
STEPS = (-0.15, 0.0, 0.15)


def decode(media: bytes | None) -> np.ndarray:
    """Mono samples at ``RATE`` from a WAV file of 8, 16, 24 or 32 bits; broken or null media have none."""
    if not media:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(media)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width not in (1, 2, 3, 4) or not rate:
        return np.zeros(0)
    if width == 3:  # to 32 bits, a zero byte below
        raw, width = np.insert(np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3), 0, 0, axis=1).tobytes(), 4
    x = np.frombuffer(raw[: len(raw) // width * width], {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def chroma(x: np.ndarray, block: int = 256) -> np.ndarray:
    """(frames, 12) energies, each frame scaled to length one; a frame at a time in blocks."""
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    into = np.zeros((len(used), 12))
    into[np.arange(len(used)), pitch] = 1
    frames, out = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], np.zeros((n, 12))
    for s in range(0, n, block):
        power = np.abs(np.fft.rfft(frames[s : s + block] * np.hanning(FRAME), axis=1)[:, used]) ** 2
        out[s : s + block] = power @ into
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-12), 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One uint32 per frame that has ``WIDTH`` frames from it on; silence gives none."""
    n = len(frames) - WIDTH + 1
    if n <= 0 or not frames.any():
        return np.zeros(0, np.uint32)
    table = np.zeros((len(frames) + 1, 25))  # the pitch circle twice, so that areas may wrap
    table[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]), 0), 1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return table[at + t1, p1] - table[at + t0, p1] - table[at + t1, p0] + table[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in _FILTERS:
        hp, hw, tp, tw = p + h // 2, w // 2, p + max(1, h // 3), max(1, w // 3)
        whole = area(0, w, p, p + h)
        if kind == 0:
            a, b = area(0, w, p, p + h), area(0, w, p + h, min(24, p + 2 * h))
        elif kind == 1:
            a, b = area(0, w, p, hp), area(0, w, hp, p + h)
        elif kind == 2:
            a, b = area(0, hw, p, p + h), area(hw, w, p, p + h)
        elif kind == 3:
            a = area(0, hw, p, hp) + area(hw, w, hp, p + h)
            b = whole - a
        elif kind == 4:
            b = area(0, w, tp, min(p + h, tp + max(1, h // 3)))
            a = whole - b
        else:
            b = area(tw, min(w, 2 * tw), p, p + h)
            a = whole - b
        ratio = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        level = np.digitize(ratio, STEPS)
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def tones(vector: list[float] | None, note: int = 1024) -> bytes | None:
    """A WAV file that plays a vector: value by value, a note of the value's pitch (one semitone per 0.1 standard deviation).  Null and empty vectors have none."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64), posinf=0, neginf=0)
    z = (v - v.mean()) / (v.std() or 1.0)
    hz = 440.0 * 2.0 ** (np.clip(np.round(z * 10), -30, 30) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * hz / RATE, note))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.sin(phase) * 12000).astype("<i2").tobytes())
    return out.getvalue()


def fingerprints(recordings: DataFrame, media: str = "media", render=None) -> DataFrame:
    """(rec_id, codes array<long>) of (rec_id, media); ``render`` makes the WAV bytes of a value that isn't one."""
    small_batches(recordings.sparkSession, 64)

    def each(batches):
        for b in batches:
            codes = [fingerprint(chroma(decode(render(x) if render else x))).astype(np.int64).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["rec_id", "codes"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), F.col(media)).mapInArrow(each, "rec_id long, codes array<long>")


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and one row per class: the smallest id of equal fingerprints.  An empty fingerprint is a class too, but matches nothing."""
    keyed = stage(prints.withColumn("key", F.sha2(F.to_json("codes"), 256)), "prints")
    reps = keyed.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_rows"), F.first("codes").alias("codes"))
    reps = stage(reps, "classes")
    return keyed.select("rec_id", "key").join(reps.select("key", "class_id", "class_rows"), "key").select("rec_id", "class_id", "class_rows"), reps.select("class_id", "codes")


def align(queries: DataFrame, reps: DataFrame, min_votes: int = MIN_VOTES, max_ber: float = MAX_BER) -> DataFrame:
    """(query_id, class_id, frames_apart, votes, bit_error): query classes against all other classes with ``min_votes`` shared integers at one offset.

    An index key is a code with one of the codes ``LAGS`` frames later, since frames next to each other overlap and single
    codes of unlike recordings often agree by chance; a run of equal keys, as steady tones give, counts once.  The join on
    keys is an ordinary shuffle join, split where it is skewed.  The offset with most votes is taken; ties go to the
    smallest shift, then the lower.
    """

    def place(df, name):
        rows = df.select(F.col("class_id").alias(name), "codes", F.explode(F.array(*map(F.lit, LAGS))).alias("lag")).where(F.size("codes") > F.col("lag"))
        rows = rows.withColumn("keys", F.transform(F.sequence(F.lit(1), F.size("codes") - F.col("lag")), lambda i: F.xxhash64("lag", F.element_at("codes", i), F.element_at("codes", i + F.col("lag")))))
        return rows.select(name, F.posexplode("keys").alias(f"{name}_at", "code"), "keys").where((F.col(f"{name}_at") == 0) | (F.col("code") != F.get("keys", F.col(f"{name}_at") - 1))).drop("keys")

    q, d = place(queries.select("class_id", "codes"), "query_id"), place(reps, "class_id")
    votes = q.join(d, "code").where("query_id <> class_id").groupBy("query_id", "class_id", (F.col("class_id_at") - F.col("query_id_at")).alias("frames_apart")).agg(F.count("*").alias("votes"))
    best = votes.where(F.col("votes") >= min_votes).groupBy("query_id", "class_id").agg(F.max_by(F.struct("frames_apart", "votes"), F.struct("votes", -F.abs("frames_apart"), -F.col("frames_apart"))).alias("b")).select("query_id", "class_id", "b.*")
    both = best.join(queries.select(F.col("class_id").alias("query_id"), F.col("codes").alias("qc")), "query_id").join(reps.select("class_id", F.col("codes").alias("dc")), "class_id")
    start, shift = F.greatest(F.lit(0), -F.col("frames_apart")), F.col("frames_apart")
    n = F.least(F.size("qc") - start, F.size("dc") - start - shift)
    wrong = F.aggregate(F.zip_with(F.slice("qc", start + 1, n), F.slice("dc", start + shift + 1, n), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return both.withColumn("bit_error", F.round(wrong / (n * 32), 6)).where(F.col("bit_error") <= max_ber).select("query_id", "class_id", "frames_apart", "votes", "bit_error")


def search(recordings: DataFrame, every: int = 100, media: str = "media", render=None, min_votes: int = MIN_VOTES, max_ber: float = MAX_BER) -> DataFrame:
    """Per row of ``recordings``: (rec_id, class_id, class_rows, is_query, n_matches, matches).

    The rows whose id is divisible by ``every`` are the queries; ``matches`` lists, for a query, the classes of other
    fingerprints that align with it.  Null, broken and silent media have no fingerprint and no matches; a null id is no
    query; an empty table gives no rows.
    """
    rows, reps = classes(fingerprints(recordings, media, render))
    wanted = rows.where(F.pmod("rec_id", F.lit(every)) == 0).select("class_id").distinct()
    found = align(reps.join(wanted, "class_id", "left_semi"), reps, min_votes, max_ber)
    per_query = found.groupBy(F.col("query_id")).agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list(F.struct("class_id", "frames_apart", "votes", "bit_error"))).alias("matches"))
    is_query = F.coalesce(F.pmod("rec_id", F.lit(every)) == 0, F.lit(False))
    out = rows.join(per_query, F.col("class_id") == F.col("query_id"), "left").withColumn("is_query", is_query)
    return out.select("rec_id", "class_id", "class_rows", "is_query", F.when(F.col("is_query"), F.coalesce("n_matches", F.lit(0))).otherwise(0).alias("n_matches"), F.when(F.col("is_query"), F.col("matches")).alias("matches"))
