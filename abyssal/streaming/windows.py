"""The time windows on unbounded input: extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(samples: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, mean and RMS per component and event-time window; state is dropped once the watermark passes."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = samples.withWatermark("ts", late).groupBy(w.alias("w"), "component").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return out.select("component", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n", "mean", "rms")


def gaps(samples: DataFrame, longest: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """Unbroken stretches per component: a session ends after ``longest`` without a sample."""
    s = F.session_window("ts", longest)
    return samples.withWatermark("ts", late).groupBy(s.alias("s"), "component").agg(F.count("*").alias("n")).select("component", F.col("s.start").alias("t_start"), F.col("s.end").alias("t_end"), "n")
