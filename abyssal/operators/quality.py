"""Window quality: conditional aggregates in one pass per window, cheap tests first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(value: str, f: str, lo: float, hi: float) -> Column:
    return F.when(F.col(f).between(lo, hi), F.col(value))


def keep(windows: DataFrame, measures: dict[str, Column], test: Column, key: str = "window_id") -> DataFrame:
    """The rows of windows that pass: measures per window, then a semi-join back."""
    passed = windows.groupBy(key).agg(*[v.alias(k) for k, v in measures.items()]).where(test).select(key)
    return windows.join(passed, key, "left_semi")


def band_measures(p: str, f: str, lo: float, hi: float) -> dict[str, Column]:
    b = band(p, f, lo, hi)
    return {"median": F.median(b), "mean": F.avg(b), "least": F.min(b)}


def optimise(windows: DataFrame, alpha: float, beta: float, zeta: float, lo: float, hi: float, lo2: float, hi2: float) -> DataFrame:
    """Windows with a high mean and minimum of coherence in one band and a low mean in another."""
    one, two = band("coh", "f", lo, hi), band("coh", "f", lo2, hi2)
    return keep(windows, {"a": F.avg(one), "b": F.avg(two), "z": F.min(one)}, (F.col("a") > alpha) & (F.col("b") < beta) & (F.col("z") > zeta))


def optimise_rms(windows: DataFrame, value: str, lo: float, hi: float, percent: float) -> DataFrame:
    """Windows whose RMS in a band lies within ``percent`` of the RMS of the median curve over all windows."""
    inside = windows.where(F.col("f").between(lo, hi))
    curve = inside.groupBy("k").agg(F.median(value).alias("m")).agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("r0"))
    own = inside.groupBy("window_id").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("r"))
    share = percent / 100
    passed = own.crossJoin(F.broadcast(curve)).where((F.col("r") > F.col("r0") * (1 - share)) & (F.col("r") < F.col("r0") * (1 + share))).select("window_id")  # one row is broadcast
    return windows.join(passed, "window_id", "left_semi")


def label(windows: DataFrame, test: Column, key: str = "window_id") -> DataFrame:
    return windows.withColumn("class", F.when(F.coalesce(test, F.lit(False)), "good").otherwise("bad"))
