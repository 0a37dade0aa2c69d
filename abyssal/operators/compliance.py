"""Compliance from samples: spectra of segments inside windows, coherence per window, selection of windows, response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics as P
from . import spectral, windows


def window_segments(trace: DataFrame, size: int, step: int, segment: int, hop: int) -> DataFrame:
    """(component, window_id, seg, data): windows of ``size`` values every ``step``, each cut into segments of ``segment`` every ``hop``."""
    return windows.matrix(windows.cut(trace, size, step), segment, hop)


def taper_share(minutes: float, fs: float, size: int) -> float:
    """The share of a segment under a Tukey taper of so many minutes in all, at most all of it."""
    return min(1.0, minutes * 60 * fs / size)


def window_psd(segments: DataFrame, size: int, fs: float, average: str = "median", kind: str = "tukey", alpha: float = 0.25) -> DataFrame:
    """(component, window_id, k, f, p): Welch's density of each window."""
    spectra = spectral.fourier(segments, size, kind, alpha)
    return spectral.welch(spectral.periodogram(spectra, size, fs, kind, alpha), "component", "window_id", average=average)


def window_coherence(segments: DataFrame, pairs: list[tuple[str, str]], size: int, fs: float, kind: str = "tukey", alpha: float = 0.25) -> DataFrame:
    """(x, y, window_id, k, f, pxx, pyy, re, im, coh2, coh) of each window: averages over its segments; a coherogram."""
    crossed = spectral.cross(spectral.fourier(segments, size, kind, alpha), pairs, size, fs, kind, alpha, by="window_id", unit=("window_id", "seg"))
    return crossed.withColumn("coh", F.sqrt("coh2"))


def window_cells(segments: DataFrame, z: str, p: str, size: int, fs: float, alpha: float = 0.25) -> DataFrame:
    """(window_id, k, f, coh, dz, dp, csd): what selection and response need of a window, in one row per bin.

    One transform under one taper serves all: the components of a segment meet in a row, and a window's rows give the
    medians of the densities and the means of the cross spectrum and the coherence.  Segments without both are left out.
    """
    spectra = spectral.fourier(segments.where(F.col("component").isin(z, p)), size, "tukey", alpha)
    part = lambda c, x: F.max(F.when(F.col("component") == c, F.col(x)))
    met = spectra.groupBy("window_id", "seg", "k").agg(part(p, "re").alias("a"), part(p, "im").alias("b"), part(z, "re").alias("c"), part(z, "im").alias("d")).where("a is not null and c is not null")
    pressure, motion = F.expr("a * a + b * b"), F.expr("c * c + d * d")
    mean = {"re": F.avg(F.expr("a * c + b * d")), "im": F.avg(F.expr("a * d - b * c")), "pp": F.avg(pressure), "zz": F.avg(motion), "mp": F.median(pressure), "mz": F.median(motion), "n": F.count("*")}
    rows = met.groupBy("window_id", "k").agg(*[v.alias(c) for c, v in mean.items()])
    scale = spectral.density_scale(F.col("k"), size, fs, "tukey", alpha)
    coh = F.sqrt((F.col("re") ** 2 + F.col("im") ** 2) / F.nullif(F.col("pp") * F.col("zz"), F.lit(0.0)))
    bias = spectral.median_bias_of(F.col("n"))
    return rows.select("window_id", "k", (F.col("k") * fs / size).alias("f"), coh.alias("coh"), (F.col("mz") * scale / bias).alias("dz"), (F.col("mp") * scale / bias).alias("dp"), (F.col("re") * scale).alias("csd"))


def nearest_slice(freqs: DataFrame, lo: float, hi: float) -> DataFrame:
    """One row (k1, k2): the bins nearest to both ends, the lower of two; a band is k1 <= k < k2."""
    near = lambda x: F.min_by("k", F.struct(F.abs(F.col("f") - x), F.col("k")))
    return freqs.agg(near(lo).alias("k1"), near(hi).alias("k2"))


def in_slice(cells: DataFrame, freqs: DataFrame, lo: float, hi: float) -> DataFrame:
    return cells.join(F.broadcast(nearest_slice(freqs, lo, hi)), (F.col("k") >= F.col("k1")) & (F.col("k") < F.col("k2"))).drop("k1", "k2")  # one row is broadcast


def _passed(cells: DataFrame, test: Column, **measures: Column) -> DataFrame:
    return cells.groupBy("window_id").agg(*[v.alias(k) for k, v in measures.items()]).where(test).select("window_id")


def _band(value: str, lo, hi) -> Column:
    return F.when(F.col("f").between(lo, hi), F.col(value))


def select_v1(cells: DataFrame, depth: float, band: tuple[float, float], noise: tuple[float, float] = (0.03, 0.08), median: float = 0.9, mean: float = 0.8, dp: tuple[float, float] = (0.5, 1.0), dz_least: float = 1e-16, dz_most: float = 1e-11) -> DataFrame:
    """Windows of the first selection: coherence in the band and in the noise band, pressure and motion there, and motion between the corner frequencies."""
    f1, f2 = (P.corner(F.lit(depth), x) for x in (0.5, 2.0))
    measures = {"a": F.median(_band("coh", *band)), "b": F.avg(_band("coh", *noise)), "p": F.avg(_band("dp", *noise)), "z": F.avg(_band("dz", *noise)), "y": F.avg(_band("dz", f2, f1))}
    c = F.col
    return _passed(cells, (c("a") > median) & (c("b") > mean) & (c("p") > dp[0]) & (c("p") < dp[1]) & (c("z") > dz_least) & (c("y") < dz_most), **measures)


def select_v2_coherence(cells: DataFrame, freqs: DataFrame, band: tuple[float, float], median: float = 0.9, mean: float = 0.9) -> DataFrame:
    """First stage of the second selection: coherence alone, on the nearest bins."""
    return _passed(in_slice(cells, freqs, *band), (F.col("a") > median) & (F.col("b") > mean), a=F.median("coh"), b=F.avg("coh"))


def select_v2_levels(cells: DataFrame, freqs: DataFrame, band: tuple[float, float], least: float = 0.6, dp: tuple[float, float] = (20, 50), noise: tuple[float, float] = (0.02, 0.05), noise_most: float = 50, motion: tuple[float, float] = (-180, -110)) -> DataFrame:
    """Second stage: the least coherence, levels of pressure in the band and in the noise band, the level of acceleration."""
    ends = nearest_slice(freqs, *band).crossJoin(nearest_slice(freqs, *noise).toDF("n1", "n2"))  # one row
    rows = cells.crossJoin(F.broadcast(ends))
    inside, near = F.col("k").between(F.col("k1"), F.col("k2") - 1), F.col("k").between(F.col("n1"), F.col("n2") - 1)
    c = F.col
    measures = {
        "m": F.min(F.when(inside, c("coh"))), "p": P.decibel(F.median(F.when(inside, c("dp")))), "q": P.decibel(F.median(F.when(near, c("dp")))),
        "z": F.avg(F.when(inside, P.decibel(P.acceleration(c("dz"), c("f"))))),
    }
    return _passed(rows, (c("m") > least) & (c("p") > dp[0]) & (c("p") < dp[1]) & (c("q") < noise_most) & (c("z") > motion[0]) & (c("z") < motion[1]), **measures)


def label_windows(cells: DataFrame, freqs: DataFrame, band: tuple[float, float], motion: float = -170, pressure: float = 25, coherence: float = 0.8) -> DataFrame:
    """(window_id, class): good where the medians of acceleration, pressure and coherence all pass; bad otherwise, also where one can't be told."""
    m = in_slice(cells, freqs, *band).groupBy("window_id").agg(P.decibel(F.median(P.acceleration(F.col("dz"), F.col("f")))).alias("z"), P.decibel(F.median("dp")).alias("p"), F.median("coh").alias("c"))
    good = F.coalesce((F.col("z") > motion) & (F.col("p") > pressure) & (F.col("c") > coherence), F.lit(False))
    return m.select("window_id", F.when(good, "good").otherwise("bad").alias("class"))


def split_by_coherence(cells: DataFrame, freqs: DataFrame, band: tuple[float, float], limit: float = 0.9) -> DataFrame:
    """(window_id, class): high or low mean coherence; a window exactly at the limit has no class."""
    m = in_slice(cells, freqs, *band).groupBy("window_id").agg(F.avg("coh").alias("m"))
    return m.select("window_id", F.when(F.col("m") > limit, "high").when(F.col("m") < limit, "low").alias("class"))


def band_series(cells: DataFrame, size: int = 10) -> DataFrame:
    """(window_id, acceleration, pressure, coherence): medians over the bins of ``cells``, smoothed over the windows with lines at the ends; densities then in dB."""
    medians = {"acceleration": F.median(P.acceleration(F.col("dz"), F.col("f"))), "pressure": F.median("dp"), "coherence": F.median("coh")}
    rows = cells.groupBy(F.col("window_id").alias("seq")).agg(*[v.alias(k) for k, v in medians.items()])
    long = rows.select("seq", F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(k).alias("v")) for k in medians])).alias("x")).select("x.component", "seq", "x.v")
    wide = windows.smooth(long, size, edges=True).groupBy("seq").pivot("component", list(medians)).agg(F.first("smooth"))
    return wide.select(F.col("seq").alias("window_id"), P.decibel(F.col("acceleration")).alias("acceleration"), P.decibel(F.col("pressure")).alias("pressure"), "coherence")


def optimise_rms(curves: DataFrame, freqs: DataFrame, band: tuple[float, float], percent: float = 10, alpha: float = 0.9, beta: float = 0.5) -> DataFrame:
    """Windows of ``curves`` (window_id, k, f, c, coh) whose RMS is near that of the median curve and whose coherence has a median over alpha and a mean over beta, both under one."""
    inside = in_slice(curves, freqs, *band)
    curve = inside.groupBy("k").agg(F.median("c").alias("m")).agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("r0"))
    own = inside.groupBy("window_id").agg(F.sqrt(F.avg(F.col("c") * F.col("c"))).alias("r"), F.median("coh").alias("a"), F.avg("coh").alias("b"))
    near = (F.col("r") > F.col("r0") * (1 - percent / 100)) & (F.col("r") < F.col("r0") * (1 + percent / 100))
    return own.crossJoin(F.broadcast(curve)).where(near & (F.col("a") > alpha) & (F.col("a") < 1) & (F.col("b") > beta) & (F.col("b") < 1)).select("window_id")  # one row is broadcast


def compliance(cells: DataFrame, selected: DataFrame, depth: float, band: tuple[float, float], version: int = 2, gain: float = 0.66) -> DataFrame:
    """(window_id, k, f, coh, c): the response of the selected windows inside the output band.

    Version 1 divides the root of the pressure density by the gain; version 2 scales that density by its square first.
    """
    rows = cells.join(selected, "window_id", "left_semi").where(F.col("f").between(*band) & (F.col("f") > 0))
    d, k = F.lit(float(depth)), P.wavenumber(F.col("f"), F.lit(float(depth)))
    c = P.compliance_v1(k, F.col("coh"), F.col("f"), d, F.col("dz"), F.col("dp"), gain) if version == 1 else P.compliance_v2(k, F.col("coh"), F.col("f"), d, F.col("dz"), F.col("dp") * gain**2)
    return rows.withColumn("c", c).select("window_id", "k", "f", "coh", "c")


def summary(curves: DataFrame, overlaps: int) -> DataFrame:
    """Per bin over the windows: n, median, mean, standard deviation, range, and the theoretical uncertainty of the first window with ``overlaps`` averages."""
    first = curves.agg(F.min("window_id").alias("first"))
    rows = curves.crossJoin(F.broadcast(first))  # one row
    theory = F.max(F.when(F.col("window_id") == F.col("first"), P.uncertainty_theory(F.col("c"), F.col("coh"), F.lit(overlaps))))
    return rows.groupBy("k", "f").agg(F.count("*").alias("n"), F.median("c").alias("median"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), (F.max("c") - F.min("c")).alias("range"), theory.alias("theory"))


def number_of_averages(values: int, segment: int, overlap: float = 0.9) -> int:
    """Segments of a window at an overlap of that share."""
    shared = int(overlap * segment)
    return int((values - shared) / (segment - shared))


def averages(values: Column, segment: Column, overlap: float = 0.9) -> Column:
    """``number_of_averages`` of columns."""
    shared = F.floor(overlap * segment)
    return F.floor((values - shared) / (segment - shared))


def first_window(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of each key's first window."""
    first = rows.groupBy(*keys).agg(F.min("window_id").alias("window_id"))
    return rows.join(F.broadcast(first) if not keys else first, [*keys, "window_id"], "left_semi")  # without keys a single row
