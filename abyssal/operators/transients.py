"""Periodic transients whose period is no multiple of the step and isn't known exactly: timing, shape, removal.

A channel's glitches come every ``period`` seconds from ``reference`` on.  The trace is folded on them, the mean shape is laid
against every cycle at all shifts up to ``reach`` steps, and a line through the best shifts of the cycles corrects period and
reference; again, with the shape that follows.  A channel is a row of ``spec``; a cycle's sums are added up before they are
shuffled, and what remains is a row a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import windows


def folded(trace: DataFrame, spec: DataFrame, step: float) -> DataFrame:
    """``trace`` (component, seq, v) with ``cycle`` and ``place``: the glitch nearest to each place, and the steps after it (before it: negative), so that what ``reference`` points at lies in the middle of a cycle."""
    at = F.col("seq") * step - F.col("reference")
    rows = trace.join(spec, "component")  # a row a channel: Spark sends it to all tasks where it is small
    cycle = F.floor(at / F.col("period") + 0.5)
    return rows.withColumn("cycle", cycle).withColumn("place", F.floor((at - cycle * F.col("period")) / step + 0.5).cast("long"))


def shape(fold: DataFrame, clear: Column | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """(component, place, shape): the mean of all cycles, of the places where ``clear`` holds and the value lies inside ``clip``."""
    rows = fold if clear is None else fold.where(clear)
    rows = rows if clip is None else rows.where(F.col("v").between(*clip))
    return rows.groupBy("component", "place").agg(F.avg("v").alias("shape"))


def timing(trace: DataFrame, spec: DataFrame, step: float, reach: int = 5, rounds: int = 3, part: float = 0.2, clear: Column | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """``spec`` (component, period, reference) with period and reference fitted in so many ``rounds``.

    Only places where the shape exceeds ``part`` of its largest distance from its mean are laid against the cycles.  A cycle
    counts where it has all of them; a channel with fewer than two such cycles keeps what it had.
    """
    spec = spec.select("component", F.col("period").cast("double").alias("period"), F.col("reference").cast("double").alias("reference"))
    for _ in range(rounds):
        fold = folded(trace if clear is None else trace.where(clear), spec, step)
        mean = shape(fold, None, clip)
        level = mean.groupBy("component").agg(F.avg("shape").alias("m"))
        away = mean.join(level, "component").withColumn("w", F.col("shape") - F.col("m"))
        top = away.groupBy("component").agg((part * F.max(F.abs("w"))).alias("least"))
        told = away.join(top, "component").where(F.abs("w") >= F.col("least")).select("component", F.col("place").alias("p"), "w")
        # the shape at every shift: a place of a cycle meets the places around it
        shifts = told.select("component", "w", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"), "p").withColumn("place", F.col("p") + F.col("lag"))
        need = told.groupBy("component").agg(F.count("*").alias("need"))
        sums = fold.select("component", "cycle", "place", "v").join(shifts.select("component", "place", "lag", "w"), ["component", "place"])
        fits = sums.groupBy("component", "cycle", "lag").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.count("*").alias("n")).join(need, "component").where("n = need")
        # a parabola through the best shift and its neighbours places it between steps
        near = fits.groupBy("component", "cycle").agg(F.max_by("lag", "s").alias("best"), F.map_from_entries(F.collect_list(F.struct("lag", "s"))).alias("by"))
        a, b, c = (F.try_element_at("by", F.col("best") + d) for d in (-1, 0, 1))
        fine = F.when((a - 2 * b + c) < 0, 0.5 * (a - c) / (a - 2 * b + c)).otherwise(0.0)
        late = near.select("component", "cycle", ((F.col("best") + F.coalesce(fine, F.lit(0.0))) * step).alias("late"))
        line = late.groupBy("component").agg(F.regr_slope("late", "cycle").alias("slope"), F.regr_intercept("late", "cycle").alias("shift"))
        spec = staged(spec.join(line, "component", "left").select("component", (F.col("period") + F.coalesce("slope", F.lit(0.0))).alias("period"), (F.col("reference") + F.coalesce("shift", F.lit(0.0))).alias("reference")), "timing")
    return spec


def remove(trace: DataFrame, spec: DataFrame, step: float, clear: Column | None = None, clip: tuple[float, float] | None = None) -> DataFrame:
    """(component, seq, v, clean): the trace less its shape; the shape of the places that are clear and unclipped is taken off everywhere.

    A place between two steps of the shape takes the line between them.  Channels without a row in ``spec`` stay as they are.
    """
    fold = folded(trace, spec, step)
    mean = shape(fold, clear, clip)
    at = (F.col("seq") * step - F.col("reference") - F.col("cycle") * F.col("period")) / step
    low = F.floor(at)
    rows = fold.select("component", "seq", "v", low.alias("_p"), (at - low).alias("_share"))
    # every place of a channel's shape with the next one; the last meets the first of the next cycle
    one, two = mean.select("component", F.col("place").alias("_p"), F.col("shape").alias("_a")), mean.select("component", (F.col("place") - 1).alias("_p"), F.col("shape").alias("_b"))
    out = rows.join(one, ["component", "_p"], "left").join(two, ["component", "_p"], "left")
    value = F.coalesce(F.col("_a") * (1 - F.col("_share")) + F.col("_b") * F.col("_share"), "_a", "_b", F.lit(0.0))
    cleaned = out.select("component", "seq", "v", (F.col("v") - value).alias("clean"))
    rest = trace.join(spec.select("component"), "component", "left_anti").select("component", "seq", "v", F.col("v").alias("clean"))
    return cleaned.unionByName(rest)


def high_pass(trace: DataFrame, size: int, block: int = windows.BLOCK) -> DataFrame:
    """``trace`` less its moving mean of ``size`` places, which leaves glitches and takes drift away; ends shorten the mean."""
    from pyspark.sql import Window

    half = size // 2
    w = Window.partitionBy("component", "_block").orderBy("seq").rangeBetween(-half, half)
    near = windows.haloed(trace, half, half, max(block, half)).withColumn("_m", F.avg("v").over(w))
    return near.where("_own").select("component", "seq", (F.col("v") - F.col("_m")).alias("v"))
