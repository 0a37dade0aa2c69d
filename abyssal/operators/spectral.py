"""Spectra of segments: per row in Spark expressions for short segments, numpy in Arrow batches for long ones."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as P
from .windows import detrend_mean


def taper(data: Column, kind: str, size: int, alpha: float = 0.25) -> Column:
    if kind == "none":
        return data
    w = (lambda n: P.hann(n, size, periodic=True)) if kind == "hann" else (lambda n: P.hann(n, size)) if kind == "hanning" else (lambda n: P.tukey(n, size, alpha))
    return F.transform(data, lambda x, n: x * w(n))


def window_power(kind: str, size: int, alpha: float = 0.25) -> float:
    n = np.arange(size)
    if kind == "tukey":
        edge, near = alpha * (size - 1) / 2, np.minimum(n, size - 1 - n)
        w = np.where(near < edge, 0.5 * (1 - np.cos(math.pi * near / edge)), 1.0) if edge > 0 else np.ones(size)
    else:
        w = {"none": np.ones(size), "hann": 0.5 - 0.5 * np.cos(2 * math.pi * n / size), "hanning": 0.5 - 0.5 * np.cos(2 * math.pi * n / (size - 1))}[kind]
    return float((w * w).sum())


#: Sizes up to which a row is transformed by Spark's own expressions, whose work is the square of the size.
DIRECT = 32


def fourier(segments: DataFrame, size: int, kind: str = "hann", alpha: float = 0.25) -> DataFrame:
    """``segments`` with (k, re, im) in place of ``data``: mean removed, tapered; no shuffle.  Short segments by expressions, longer ones by numpy's FFT."""
    return (fourier_short if size <= DIRECT else fourier_long)(segments, size, kind, alpha)


def fourier_short(segments: DataFrame, size: int, kind: str = "hann", alpha: float = 0.25) -> DataFrame:
    """As ``fourier``, by a direct transform per row in expressions."""
    ready = segments.where(F.size("data") == size).withColumn("data", taper(detrend_mean(F.col("data")), kind, size, alpha))
    step = 2 * math.pi / size

    def part(f, k: Column) -> Column:
        return F.aggregate(F.transform("data", lambda x, n: x * f(step * F.pmod(k * n, F.lit(size)))), F.lit(0.0), lambda a, x: a + x)

    bins = F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: F.struct(k.alias("k"), part(F.cos, k).alias("re"), (-part(F.sin, k)).alias("im")))
    return ready.select(*[c for c in segments.columns if c != "data"], F.explode(bins).alias("b")).select("*", "b.k", "b.re", "b.im").drop("b")


def fourier_long(segments: DataFrame, size: int, kind: str = "hann", alpha: float = 0.25) -> DataFrame:
    """As ``fourier``, by numpy's FFT in Arrow batches."""
    keys = [c for c in segments.columns if c != "data"]
    kinds = dict(segments.dtypes)
    n = np.arange(size)
    w = {"none": np.ones(size), "hann": 0.5 - 0.5 * np.cos(2 * math.pi * n / size), "hanning": np.hanning(size)}.get(kind)
    if w is None:
        edge, near = alpha * (size - 1) / 2, np.minimum(n, size - 1 - n)
        w = np.where(near < edge, 0.5 * (1 - np.cos(math.pi * near / edge)), 1.0) if edge > 0 else np.ones(size)

    def each(batches):
        for b in batches:
            rows = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column("data")), size))
            if not rows.num_rows:
                continue
            x = np.asarray(rows.column("data").flatten()).reshape(-1, size)
            z = np.fft.rfft((x - x.mean(1, keepdims=True)) * w, axis=1)
            m = z.shape[1]
            at = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays([*(rows.column(k).take(at) for k in keys), pa.array(np.tile(np.arange(m, dtype=np.int32), len(x))), pa.array(z.real.ravel()), pa.array(z.imag.ravel())], names=[*keys, "k", "re", "im"])

    return segments.select(*keys, "data").mapInArrow(each, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "k int, re double, im double")


def density_scale(k: Column, size: int, fs: float, kind: str, alpha: float = 0.25) -> Column:
    """One-sided density: twice, but for the mean and the Nyquist bin."""
    once = (k == 0) | (k == size // 2) if size % 2 == 0 else k == 0
    return F.when(once, 1.0).otherwise(2.0) / (fs * window_power(kind, size, alpha))


def periodogram(spectra: DataFrame, size: int, fs: float = 1.0, kind: str = "hann", alpha: float = 0.25) -> DataFrame:
    """(…, k, f, p) of Fourier rows: a spectrogram if the rows are segments of one trace."""
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * density_scale(F.col("k"), size, fs, kind, alpha)
    return spectra.withColumn("f", F.col("k") * fs / size).withColumn("p", p).drop("re", "im")


def median_bias(n: int) -> float:
    return 1 + sum(1 / (2 * i + 1) - 1 / (2 * i) for i in range(1, (n - 1) // 2 + 1))


def median_bias_of(n: Column) -> Column:
    """``median_bias`` of a column of counts."""
    i = F.sequence(F.lit(1), F.greatest(F.lit(1), ((n - 1) / 2).cast("long")).cast("int"))
    return 1 + F.aggregate(i, F.lit(0.0), lambda a, j: a + F.when(j <= F.floor((n - 1) / 2), 1 / (2 * j + 1) - 1 / (2 * j)).otherwise(0.0))


def welch(powers: DataFrame, *keys: str, average: str = "mean") -> DataFrame:
    """Average periodograms over ``keys`` and bin; the median is divided by its bias, which depends on the number of segments."""
    if average == "mean":
        return powers.groupBy(*keys, "k", "f").agg(F.avg("p").alias("p"))
    return powers.groupBy(*keys, "k", "f").agg(F.median("p").alias("m"), F.count("*").alias("n")).withColumn("p", F.col("m") / median_bias_of(F.col("n"))).drop("m", "n")


def cross(spectra: DataFrame, pairs: list[tuple[str, str]], size: int, fs: float = 1.0, kind: str = "hann", alpha: float = 0.25, by: str | None = None, unit: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """(x, y, k, f, pxx, pyy, re, im, coh2) of component pairs, averaged over windows (or per ``by``).

    One shuffle by (``unit``, k): the components of a cell meet in one row, and all pairs are read off it.  Spectra of
    segments inside windows have the unit (window_id, seg) and are averaged by window.
    """
    names = sorted({c for p in pairs for c in p})
    cell = spectra.groupBy(*unit, "k").pivot("component", names).agg(F.first("re").alias("re"), F.first("im").alias("im"))
    of = lambda c, part: F.col(f"`{c}_{part}`")
    both = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), of(x, "re").alias("a"), of(x, "im").alias("b"), of(y, "re").alias("c"), of(y, "im").alias("d")) for x, y in pairs])
    rows = cell.select(*unit, "k", F.explode(both).alias("s")).select(*unit, "k", "s.*").where("a is not null and c is not null")
    keys = ["x", "y", *([by] if by else []), "k"]
    scale = density_scale(F.col("k"), size, fs, kind, alpha)
    mean = rows.groupBy(*keys).agg(F.avg(F.expr("a*a+b*b")).alias("pxx"), F.avg(F.expr("c*c+d*d")).alias("pyy"), F.avg(F.expr("a*c+b*d")).alias("re"), F.avg(F.expr("a*d-b*c")).alias("im"))
    coh = (F.col("re") ** 2 + F.col("im") ** 2) / F.nullif(F.col("pxx") * F.col("pyy"), F.lit(0.0))
    return mean.withColumn("coh2", coh).withColumn("f", F.col("k") * fs / size).select(*keys, "f", *[(F.col(c) * scale).alias(c) for c in ("pxx", "pyy", "re", "im")], "coh2")


def transfer(crossed: DataFrame) -> DataFrame:
    """Gain in dB and phase in degrees of y over x."""
    return crossed.where("pxx > 0 and (re <> 0 or im <> 0)").withColumn("gain_db", 20 * F.log10(F.hypot("re", "im") / F.col("pxx"))).withColumn("phase_deg", F.degrees(F.atan2("im", "re")))


def nearest_bin(freqs: DataFrame, target: float) -> DataFrame:
    """The bin nearest to ``target``; the lower one of two."""
    return freqs.agg(F.min_by("k", F.struct(F.abs(F.col("f") - target), F.col("k"))).alias("k"))


def interpolate_band(psd: DataFrame, lo: float, hi: float, *keys: str) -> DataFrame:
    """Bins with f in [lo, hi] replaced by a line, over the bin number, between the good bins around; constant at the ends."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("k")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    good = ~F.col("f").between(lo, hi)
    v, at = F.when(good, F.col("p")), F.when(good, F.col("k"))
    out = psd.select("*", F.last(v, True).over(before).alias("v0"), F.first(v, True).over(after).alias("v1"), F.last(at, True).over(before).alias("k0"), F.first(at, True).over(after).alias("k1"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("k") - F.col("k0")) / F.nullif(F.col("k1") - F.col("k0"), F.lit(0))
    return out.withColumn("p", F.when(good, F.col("p")).otherwise(F.coalesce(line, "v0", "v1"))).drop("v0", "v1", "k0", "k1")
