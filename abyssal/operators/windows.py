"""Windows on the time axis, gap filling, trimming, detrending, decimation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Places of a block: what is carried along a trace goes from block to block, one row each, so no task orders a whole trace.
BLOCK = 86_400


def _seconds(ts: str = "ts") -> Column:
    return F.unix_micros(ts) / 1e6


def trim_common(samples: DataFrame, components: list[str]) -> DataFrame:
    """Samples of ``components`` inside their common interval, both ends included."""
    picked = samples.where(F.col("component").isin(components))
    ends = picked.groupBy("component").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return picked.crossJoin(F.broadcast(ends)).where(F.col("ts").between(F.col("a"), F.col("b"))).drop("a", "b")


def tumbling(samples: DataFrame, seconds: float) -> DataFrame:
    """``window_id`` of tumbling windows anchored at the first sample; an incomplete tail is dropped."""
    span = samples.agg(F.min(_seconds()).alias("t0"), F.max(_seconds()).alias("t1"))
    out = samples.crossJoin(F.broadcast(span)).withColumn("window_id", F.floor((_seconds() - F.col("t0")) / seconds))
    return out.where(F.col("t0") + (F.col("window_id") + 1) * seconds <= F.col("t1")).drop("t0", "t1")


def sliding(samples: DataFrame, seconds: float, step: float) -> DataFrame:
    """One row per sample and window [start, start + seconds] that holds it; only windows that end by the last sample.  A sample meets at most seconds / step + 1 windows."""
    if step <= 0:
        raise ValueError("the overlap must be shorter than the window")
    span = samples.agg(F.min(_seconds()).alias("t0"), F.max(_seconds()).alias("t1"))
    at = _seconds() - F.col("t0")
    last = F.floor((F.col("t1") - F.col("t0") - seconds) / step)
    lo, hi = F.greatest(F.lit(0).cast("long"), F.ceil((at - seconds) / step)), F.least(last, F.floor(at / step))
    return samples.crossJoin(F.broadcast(span)).where(lo <= hi).select(*samples.columns, F.explode(F.sequence(lo, hi)).alias("window_id"))


def count_windows(n: Column, size: int, step: int, drop_last: bool = False) -> Column:
    """Windows of a matrix view: 1 + (n - size) div step, or (n - step) div step in the variant that leaves the last out."""
    return F.floor((n - step) / step) if drop_last else 1 + F.floor((n - size) / step)


def matrix(segments: DataFrame, size: int, step: int, drop_last: bool = False) -> DataFrame:
    """Each segment cut into rows of ``size`` values every ``step``; too short segments give none."""
    n = count_windows(F.size("data"), size, step, drop_last)
    starts = F.when((F.size("data") >= size) & (n > 0), F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    return segments.select(*[c for c in segments.columns if c != "data"], "data", F.explode(starts).alias("seg")).withColumn("data", F.slice("data", (F.col("seg") * step + 1).cast("int"), size))


def buckets_with_gap(samples: DataFrame, seconds: float) -> DataFrame:
    """``bucket`` of files of ``seconds`` with one second between the end of one and the start of the next; samples in between are dropped."""
    span = samples.agg(F.min(_seconds()).alias("t0"))
    at = _seconds() - F.col("t0")
    return samples.crossJoin(F.broadcast(span)).where(F.pmod(at, F.lit(seconds + 1)) <= seconds).withColumn("bucket", F.floor(at / (seconds + 1))).drop("t0")


def hourly(samples: DataFrame, origin: int = 1_704_067_200) -> DataFrame:
    """Regular trace (component, seq, v): hourly means, hours counted from ``origin``."""
    return samples.groupBy("component", F.floor((F.unix_seconds("ts") - origin) / 3600).alias("seq")).agg(F.avg("v").alias("v"))


def newest(samples: DataFrame, *keys: str, by: str) -> DataFrame:
    """Fragments laid over one another: per key the value loaded last."""
    return samples.groupBy(*keys).agg(F.max_by("v", by).alias("v"))


def carried(trace: DataFrame, block: int = BLOCK, **values: Column) -> DataFrame:
    """``trace`` (component, seq, ...) with, for each ``name`` of ``values``, ``name_before``: the last non-null value at or before a place, and ``name_after``: the first at or after.

    A scan of two levels: inside each block of places, and over one row a block with its first and last value, which is
    joined back by the block.
    """
    rows = trace.withColumns({"_block": F.floor(F.col("seq") / block), **{f"_{n}": v for n, v in values.items()}})
    w = Window.partitionBy("component", "_block").orderBy("seq")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    inside = rows.select("*", *[F.last(f"_{n}", True).over(back).alias(f"_{n}0") for n in values], *[F.first(f"_{n}", True).over(ahead).alias(f"_{n}1") for n in values])
    known = lambda n: F.col(f"_{n}").isNotNull()
    state = rows.groupBy("component", "_block").agg(*[F.max_by(f"_{n}", F.when(known(n), F.col("seq"))).alias(f"_{n}l") for n in values], *[F.min_by(f"_{n}", F.when(known(n), F.col("seq"))).alias(f"_{n}f") for n in values])
    over = Window.partitionBy("component").orderBy("_block")
    earlier, later = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    carry = state.select("component", "_block", *[F.last(f"_{n}l", True).over(earlier).alias(f"_{n}e") for n in values], *[F.first(f"_{n}f", True).over(later).alias(f"_{n}n") for n in values])
    out = inside.join(carry, ["component", "_block"])
    told = {f"{n}_before": F.coalesce(f"_{n}0", f"_{n}e") for n in values} | {f"{n}_after": F.coalesce(f"_{n}1", f"_{n}n") for n in values}
    return out.select(*trace.columns, *[v.alias(k) for k, v in told.items()])


def haloed(trace: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """``trace`` in blocks that also hold the ``before`` places ahead of them and the ``after`` behind: columns ``_block``, and ``_own`` for the block's own places."""
    if max(before, after) > block:
        raise ValueError("a block must be as long as what reaches into it")
    own, at = F.floor(F.col("seq") / block), F.pmod(F.col("seq"), F.lit(block))
    to = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= block - before, own + 1)))
    return trace.select("*", own.alias("_home"), F.explode(to).alias("_block")).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def fill_gaps(trace: DataFrame, block: int = BLOCK) -> DataFrame:
    """Dense trace: missing places between the first and last are interpolated linearly."""
    ends = trace.groupBy("component").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    blocks = ends.select("component", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("_block"))
    grid = blocks.select("component", F.explode(F.sequence(F.greatest("a", F.col("_block") * block), F.least("b", (F.col("_block") + 1) * block - 1))).alias("seq"))
    known = F.when(F.col("v").isNotNull(), F.struct("seq", "v"))
    out = carried(grid.join(trace, ["component", "seq"], "left").select("component", "seq", "v"), block, at=known)
    line = F.col("at_before.v") + (F.col("at_after.v") - F.col("at_before.v")) * (F.col("seq") - F.col("at_before.seq")) / F.nullif(F.col("at_after.seq") - F.col("at_before.seq"), F.lit(0))
    return out.select("component", "seq", F.coalesce("v", line).alias("v"))


def cut(trace: DataFrame, size: int, step: int) -> DataFrame:
    """Segments of a dense trace: (component, window_id, data); a value meets at most size / step + 1 of them; incomplete ones are dropped."""
    at = F.col("seq")
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((at - size + 1) / step))
    rows = trace.select("component", F.struct("seq", "v").alias("x"), F.explode(F.sequence(lo, F.floor(at / step))).alias("window_id"))
    out = rows.groupBy("component", "window_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return out.where(F.size("x") == size).select("component", "window_id", F.transform("x", lambda x: x["v"]).alias("data"))


def detrend_mean(data: Column) -> Column:
    mean = F.aggregate(data, F.lit(0.0), lambda a, x: a + x) / F.size(data)
    return F.zip_with(data, F.array_repeat(mean, F.size(data)), lambda x, m: x - m)


def detrend_line(data: Column) -> Column:
    """Less the line through the first and last value."""
    a, n = F.element_at(data, 1), F.size(data)
    slope = (F.element_at(data, -1) - a) / (n - 1)
    return F.transform(data, lambda x, i: x - a - slope * i)


def lowpass(every: int, attenuation: float = 70.0, width: float = 0.4) -> list[float]:
    """Taps of a windowed sinc that leaves what ``every``-th places can hold: a Kaiser window for the attenuation in dB, the stop band from the new Nyquist frequency on.

    ``width`` is the transition's share of the pass band below that; the taps add up to one.
    """
    edge = math.pi / every
    half = math.ceil((attenuation - 8) / (2.285 * width * edge) / 2)
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * max(attenuation - 21, 0) ** 0.4 + 0.07886 * max(attenuation - 21, 0)
    n, cutoff = np.arange(-half, half + 1), edge * (1 - width / 2)
    taps = np.sinc(n * cutoff / math.pi) * np.kaiser(2 * half + 1, beta)
    return (taps / taps.sum()).tolist()


def decimate(trace: DataFrame, taps: list[float], every: int, block: int = BLOCK) -> DataFrame:
    """FIR low-pass over the rows around each place, then every ``every``-th; places without all taps are dropped.  Blocks carry the rows that reach into them."""
    half = len(taps) // 2
    w = Window.partitionBy("component", "_block").orderBy("seq").rowsBetween(-half, half)
    near = haloed(trace, half, half, max(block, half)).withColumn("_x", F.collect_list("v").over(w))
    whole = near.where("_own").where((F.pmod("seq", F.lit(every)) == 0) & (F.size("_x") == len(taps)))
    total = F.aggregate(F.zip_with("_x", F.array(*map(F.lit, taps)), lambda x, t: x * t), F.lit(0.0), lambda acc, x: acc + x)
    return whole.select("component", "seq", total.alias("v"))


def decimate_chain(trace: DataFrame, stages: tuple[int, ...] = (5, 5, 2), attenuation: float = 70.0, block: int = BLOCK) -> DataFrame:
    """(component, seq, v): stages of low-pass and decimation, one after another; ``seq`` stays that of the first trace, so kept places are their product apart."""
    so_far = 1
    for every in stages:
        trace = decimate(trace, lowpass(every, attenuation), every, block).withColumn("seq", F.expr(f"seq div {every}"))
        so_far *= every
    return trace.withColumn("seq", F.col("seq") * so_far)


def fill_outliers(trace: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """Values over ``limit`` take the last good one before them; a leading run takes the trace's last value."""
    out = carried(trace, block, good=F.when(F.col("v") <= limit, F.col("v")))
    tail = trace.groupBy("component").agg(F.max_by("v", "seq").alias("_tail"))
    return out.join(tail, "component").withColumn("v", F.coalesce("good_before", "_tail")).select(*trace.columns)


def normalise_azimuth(angle: Column, azimuth: Column) -> tuple[Column, Column]:
    return F.abs(angle), F.pmod(F.when(angle < 0, azimuth + 180).otherwise(azimuth), F.lit(360.0))


def azimuth_outlier(azimuth: Column, mean: Column, intended: bool = False) -> Column:
    """The rule mean / 1.5 > azimuth > mean * 1.5, which nothing meets; ``intended``: below the one or above the other."""
    low, high = azimuth < mean / 1.5, azimuth > mean * 1.5
    return low | high if intended else low & high


def smooth(trace: DataFrame, size: int = 10, block: int = BLOCK, edges: bool = False) -> DataFrame:
    """Order-1 Savitzky-Golay: in the interior a moving mean of ``size``, null where the frame isn't full.  Blocks carry the rows that reach into them.

    With ``edges`` the first and last ``size // 2`` places of a dense trace take the line through its first and last ``size``
    places; a shorter trace has none.
    """
    before, after = size // 2 - 1, size // 2
    w = Window.partitionBy("component", "_block").orderBy("seq").rowsBetween(-before, after)
    near = haloed(trace, before, after, max(block, size)).withColumn("smooth", F.when(F.count("v").over(w) == size, F.avg("v").over(w)))
    out = near.where("_own").drop("_own", "_block")
    if not edges:
        return out
    ends = trace.groupBy("component").agg(F.min("seq").alias("_a"), F.max("seq").alias("_b"))  # a row a channel
    at = trace.join(ends, "component").select("component", "seq", "v", F.when(F.col("seq") < F.col("_a") + size, "a").alias("_first"), F.when(F.col("seq") > F.col("_b") - size, "b").alias("_last"))
    parts = at.select("component", "seq", "v", F.explode(F.array_compact(F.array("_first", "_last"))).alias("_end"))
    line = parts.groupBy("component").pivot("_end", ["a", "b"]).agg(F.count("v").alias("n"), F.regr_slope("v", "seq").alias("m"), F.regr_intercept("v", "seq").alias("c"))
    rows = out.join(ends, "component").join(line, "component", "left")
    on = lambda e: F.when(F.col(f"{e}_n") == size, F.col(f"{e}_c") + F.col(f"{e}_m") * F.col("seq"))
    half = size // 2
    value = F.when(F.col("seq") < F.col("_a") + half, on("a")).when(F.col("seq") > F.col("_b") - half, on("b")).otherwise(F.col("smooth"))
    return rows.withColumn("smooth", value).select(*out.columns)
