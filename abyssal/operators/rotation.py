"""Tilt and coherent noise taken off in time.

A trace is cut into windows that overlap by half.  Each window is corrected on its own, and a place is the mean of its two
windows under weights that fade from one into the next, so windows rejoin without seams.  A window that can't be corrected
passes as it is, with the reason in ``error``.  Tables are wide: a row a place (``seq``), a column a channel; ``keys`` (station,
network) tell traces apart.  No task holds more than some windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clean


def overlapped(wide: DataFrame, size: int) -> DataFrame:
    """Each place in the two windows of ``size`` places that hold it: ``window_id`` (starts are half a window apart) and its weight; the two weights add up to one."""
    if size % 2:
        raise ValueError("a window has an even number of places")
    half = size // 2
    own = F.floor(F.col("seq") / half)
    place = F.col("seq") - F.col("window_id") * half
    return wide.select("*", F.explode(F.array(own, own - 1)).alias("window_id")).withColumn("_weight", 0.5 - 0.5 * F.cos(2 * math.pi * (place + 0.5) / size))


def rejoin(windows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, seq, value): windows faded into each other."""
    return windows.groupBy(*keys, "seq").agg((F.sum(F.col("_weight") * F.col(value)) / F.sum("_weight")).alias(value))


def _guarded(error: Column, value: Column) -> Column:
    return F.when(error.isNull(), value)


def tilt_windows(wide: DataFrame, z: str, horizontals: tuple[str, str], size: int, *keys: str) -> DataFrame:
    """(keys, window_id, n, error, b1, b2, azimuth, angle, variance_ratio): the least-squares tilt of each window.

    The vertical is turned by ``angle`` towards ``azimuth``; ``variance_ratio`` is its variance before over after.  Windows of
    less than half their places, and those whose horizontals are linearly dependent, are not told.
    """
    rows = overlapped(wide, size)
    fit = clean.tilt(rows, z, *horizontals, *keys, "window_id").join(rows.groupBy(*keys, "window_id").agg(F.count("*").alias("n"), F.corr(*horizontals).alias("_r")), [*keys, "window_id"])
    error = F.when(F.col("n") < size // 2, "too few values").when(F.col("b1").isNull() | (1 - F.col("_r") ** 2 < 1e-12), "singular")
    told = fit.withColumn("error", error)
    stretch = 1 + F.col("b1") ** 2 + F.col("b2") ** 2  # turned, not only subtracted: the vertical keeps its length
    measures = [_guarded(F.col("error"), F.col(c) * stretch if c == "variance_ratio" else F.col(c)).alias(c) for c in ("b1", "b2", "azimuth", "angle", "variance_ratio")]
    return told.select(*keys, "window_id", "n", "error", *measures)


def rotated(wide: DataFrame, z: str, horizontals: tuple[str, str], size: int, *keys: str) -> DataFrame:
    """(keys, seq, z): the vertical with every window's tilt turned back."""
    tilts = tilt_windows(wide, z, horizontals, size, *keys).select(*keys, "window_id", "b1", "b2")
    a, b = horizontals
    turned = (F.col(z) - F.col("b1") * F.col(a) - F.col("b2") * F.col(b)) / F.sqrt(1 + F.col("b1") ** 2 + F.col("b2") ** 2)
    rows = overlapped(wide, size).join(tilts, [*keys, "window_id"]).withColumn(z, F.coalesce(turned, F.col(z)))
    return rejoin(rows, z, *keys)


def _segments(x: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2]


def take_off(target: np.ndarray, noise: np.ndarray, size: int) -> np.ndarray:
    """``target`` less what is coherent with ``noise``: a transfer function from segments of ``size`` values, half overlapping, applied segment by segment."""
    half, n = size // 2, len(target)
    fade = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(size) + 0.5) / size)
    ahead = -(-n // half) * half + half - n
    t, c = (np.pad(x - x.mean(), (half, ahead)) for x in (target, noise))
    zt, zc = np.fft.rfft(_segments(t, size) * fade, axis=1), np.fft.rfft(_segments(c, size) * fade, axis=1)
    power = (np.abs(zc) ** 2).sum(0)
    h = np.where(power > 1e-12 * power.max(), (zt * zc.conj()).sum(0) / np.where(power > 0, power, 1), 0) if power.max() > 0 else np.zeros(len(power))
    said = np.fft.irfft(zc * h, size, axis=1)
    out = np.zeros(len(t))
    for odd in (0, 1):  # segments of one parity lie side by side
        part = said[odd::2].ravel()
        out[odd * half : odd * half + len(part)] += part
    return target - out[half : half + n]


def clean_window(z: np.ndarray, channels: list[np.ndarray], segment: int) -> np.ndarray:
    """The channels in turn: each is taken off the vertical and off the channels after it."""
    left = list(channels)
    while left:
        noise, *left = left
        z, left = take_off(z, noise, segment), [take_off(x, noise, segment) for x in left]
    return z


def clean_windows(wide: DataFrame, z: str, channels: tuple[str, ...], size: int, segment: int, *keys: str) -> DataFrame:
    """(keys, window_id, seq, z, _weight, variance_ratio, error): every window of ``size`` places, each with what is coherent with ``channels`` taken off.

    A window of less than two segments, with missing places or values, stays as it is; ``error`` says so.
    """
    rows = overlapped(wide, size).select(*keys, "window_id", "seq", "_weight", F.col(z).cast("double").alias(z), *[F.col(c).cast("double").alias(c) for c in channels])
    kinds = dict(rows.dtypes)

    def each(table: pa.Table) -> pa.Table:
        t = table.sort_by("seq")
        seq, values = t.column("seq").to_numpy(), [t.column(c).to_numpy() for c in (z, *channels)]
        error, ratio, out = None, None, values[0]
        if len(seq) < 2 * segment:
            error = "too few values"
        elif seq[-1] - seq[0] + 1 != len(seq):
            error = "missing places"
        elif any(np.isnan(x).any() for x in values):
            error = "missing values"
        else:
            out = clean_window(values[0], values[1:], segment)
            ratio = float(values[0].var() / out.var()) if out.var() > 0 else None
        n = t.num_rows
        cols = [*(t.column(k) for k in (*keys, "window_id", "seq")), pa.array(out, from_pandas=True), t.column("_weight"), pa.array([ratio] * n, pa.float64()), pa.array([error] * n, pa.string())]
        return pa.table(cols, names=[*keys, "window_id", "seq", z, "_weight", "variance_ratio", "error"])

    schema = "".join(f"`{k}` {kinds[k]}, " for k in (*keys, "window_id", "seq")) + f"`{z}` double, _weight double, variance_ratio double, error string"
    return rows.groupBy(*keys, "window_id").applyInArrow(each, schema)


def cleaned(wide: DataFrame, z: str, channels: tuple[str, ...], size: int, segment: int, *keys: str) -> DataFrame:
    """(keys, seq, z): the vertical less what is coherent with the channels."""
    return rejoin(clean_windows(wide, z, channels, size, segment, *keys), z, *keys)
