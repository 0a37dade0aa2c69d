"""Calibration of a pressure gauge against a seismometer: the ratio of their spectra while earthquakes shake both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectral


def event_windows(windows: DataFrame, spans: DataFrame, slot: float = 86_400.0) -> DataFrame:
    """``windows`` (window_id, t0, t1 in seconds) that lie inside a span (t_start, t_end in seconds); windows and spans meet by slots of time."""
    cut = spans.select("t_start", "t_end", F.explode(F.sequence(F.floor(F.col("t_start") / slot), F.floor(F.col("t_end") / slot))).alias("_slot"))
    at = windows.withColumn("_slot", F.floor(F.col("t0") / slot))
    return at.join(cut, [at["_slot"] == cut["_slot"], F.col("t0") >= F.col("t_start"), F.col("t1") <= F.col("t_end")], "left_semi").drop("_slot")


def gauge_ratio(segments: DataFrame, reference: str, gauge: str, size: int, fs: float, band: tuple[float, float] = (0.03, 0.07), coherence: float = 0.9, kind: str = "hann", spread: float = 3.0) -> DataFrame:
    """One row (gain, deviation, n, n_kept) from segments (component, window_id, seg, data): the gauge's amplitude over the reference's.

    Per window and bin of the band the gain is the modulus of the cross spectrum over the reference's density; bins under
    ``coherence`` are left out.  The gain is the median of those within ``spread`` deviations of the median, a deviation being
    1.4826 times the median distance from it: some windows may be wrong altogether.  Without any such bin: nulls and zero.
    """
    spectra = spectral.fourier(segments.where(F.col("component").isin(reference, gauge)), size, kind)
    crossed = spectral.cross(spectra, [(reference, gauge)], size, fs, kind, by="window_id", unit=("window_id", "seg"))
    ratios = crossed.where(F.col("f").between(*band) & (F.col("coh2") >= coherence**2) & (F.col("pxx") > 0)).select((F.hypot("re", "im") / F.col("pxx")).alias("g"))
    middle = ratios.agg(F.median("g").alias("m"))
    away = ratios.crossJoin(F.broadcast(middle)).withColumn("d", F.abs(F.col("g") - F.col("m")))  # one row
    scale = away.agg(F.max("m").alias("m"), (1.4826 * F.median("d")).alias("s"), F.count("*").alias("n"))
    kept = F.when(F.abs(F.col("g") - F.col("m")) <= spread * F.col("s"), F.col("g"))
    rows = ratios.crossJoin(F.broadcast(scale)).agg(F.median(kept).alias("gain"), F.max("s").alias("deviation"), F.count(kept).alias("n_kept"))
    return scale.select("n").crossJoin(F.broadcast(rows)).select("gain", "deviation", "n", "n_kept")
