"""Interval exclusion, span merging, periodic transients, tilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spans_from_events(catalogue: DataFrame, least: float, seconds_per_unit: float) -> DataFrame:
    """(t_start, t_end) to leave out after events (ts, magnitude): so many seconds per unit of magnitude over ``least``; overlaps merged."""
    end = F.timestamp_micros((F.unix_micros("ts") + (F.col("magnitude") - least) * seconds_per_unit * 1e6).cast("long"))
    return merge_spans(catalogue.where(F.col("magnitude") >= least).select(F.col("ts").alias("t_start"), end.alias("t_end")))


def merge_spans(spans: DataFrame, *keys: str, hours: int = 24) -> DataFrame:
    """Unions of overlapping or touching spans, per ``keys``.

    Spans are merged within the slots of ``hours`` in which they start, so that no task orders all of them; a slot's reach
    is then compared with that of the slots before it, one row each, and only what still overlaps is joined.
    """
    at = spans.select(*keys, "t_start", "t_end", F.floor(F.unix_seconds("t_start") / (hours * 3600)).alias("slot"))
    once = _islands(at, *keys, "slot")
    # furthest end of all earlier slots: a running maximum over one row a slot
    ends = once.groupBy(*keys, "slot").agg(F.max("t_end").alias("reach"))
    before = ends.select(*keys, "slot", F.max("reach").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    rows = once.join(before, [*keys, "slot"])
    # an island that no earlier slot reaches starts a new union; numbering them needs only how many a slot starts
    fresh = rows.withColumn("new", F.when(F.col("before").isNull() | (F.col("t_start") > F.col("before")), 1).otherwise(0))
    counts = fresh.groupBy(*keys, "slot").agg(F.sum("new").alias("n"))
    first = counts.select(*keys, "slot", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.col("first") + F.sum("new").over(Window.partitionBy(*keys, "slot").orderBy("t_start"))
    return fresh.join(first, [*keys, "slot"]).withColumn("island", number).groupBy(*keys, "island").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end")).drop("island")


def _islands(spans: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t_start", "t_end")
    reach = F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("t_start") > reach), 1).otherwise(0)
    return spans.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy(*keys, "island").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end")).drop("island")


def exclude(samples: DataFrame, spans: DataFrame, zero: bool = False, hours: int = 24) -> DataFrame:
    """Samples outside all (merged) spans; with ``zero`` those inside stay with value 0.

    Spans are cut into days, so that the join is an equi-join on the day with a range test: neither side is broadcast
    unless Spark measures it small.
    """
    slot = hours * 3600
    cut = spans.select("t_start", "t_end", F.explode(F.sequence(F.floor(F.unix_seconds("t_start") / slot), F.floor(F.unix_seconds("t_end") / slot))).alias("slot"))
    at = samples.withColumn("slot", F.floor(F.unix_seconds("ts") / slot))
    inside = [at["slot"] == cut["slot"], at["ts"] >= cut["t_start"], at["ts"] <= cut["t_end"]]
    if not zero:
        return at.join(cut, inside, "left_anti").drop("slot")
    # spans are merged, so a sample meets one at most
    hit = at.join(cut.withColumnRenamed("slot", "_slot"), [F.col("slot") == F.col("_slot"), *inside[1:]], "left")
    return hit.withColumn("v", F.when(F.col("_slot").isNotNull(), 0.0).otherwise(F.col("v"))).select(*samples.columns)


def remove_periodic(trace: DataFrame, period: int, reference: int = 0) -> DataFrame:
    """A trace less its mean shape over a period: fold on phase, average, subtract."""
    phase = F.pmod(F.col("seq") - reference, F.lit(period))
    folded = trace.withColumn("phase", phase)
    shape = folded.groupBy("component", "phase").agg(F.avg("v").alias("shape"))
    return folded.join(shape, ["component", "phase"]).select("component", "seq", "v", (F.col("v") - F.col("shape")).alias("clean"))


def remove_transients(trace: DataFrame, spec: DataFrame, clear) -> DataFrame:
    """A trace less each channel's mean shape over its own period: ``spec`` (component, period, reference) is a row a channel.

    The shape is the mean of the places where ``clear`` holds; it is taken off everywhere.
    """
    folded = trace.join(F.broadcast(spec), "component").withColumn("phase", F.pmod(F.col("seq") - F.col("reference"), F.col("period")))
    shape = folded.where(clear).groupBy("component", "phase").agg(F.avg("v").alias("shape"))
    return folded.join(shape, ["component", "phase"]).select("component", "seq", "v", (F.col("v") - F.col("shape")).alias("clean"))


def tilt(wide: DataFrame, z: str, h1: str, h2: str, *keys: str) -> DataFrame:
    """Least squares of the vertical on two horizontals from covariances: coefficients, azimuth, angle and the variance ratio before / after."""
    c = lambda a, b: F.covar_pop(a, b)
    m = wide.groupBy(*keys).agg(F.var_pop(z).alias("zz"), F.var_pop(h1).alias("aa"), F.var_pop(h2).alias("bb"), c(h1, h2).alias("ab"), c(z, h1).alias("za"), c(z, h2).alias("zb"))
    det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
    m = m.withColumn("b1", (F.col("za") * F.col("bb") - F.col("zb") * F.col("ab")) / det).withColumn("b2", (F.col("zb") * F.col("aa") - F.col("za") * F.col("ab")) / det)
    left = F.col("zz") - F.col("b1") * F.col("za") - F.col("b2") * F.col("zb")
    return m.select(*keys, "b1", "b2", F.degrees(F.atan2("b2", "b1")).alias("azimuth"), F.degrees(F.atan(F.hypot("b1", "b2"))).alias("angle"), (F.col("zz") / F.nullif(left, F.lit(0.0))).alias("variance_ratio"))


def remove_coherent(wide: DataFrame, z: str, h: str, *keys: str) -> DataFrame:
    """Per frequency cell, the vertical less what the horizontal predicts: columns ``{z}_re, {z}_im, {h}_re, {h}_im``; the transfer function is averaged over ``keys``."""
    a, b, c, d = (F.col(x) for x in (f"{h}_re", f"{h}_im", f"{z}_re", f"{z}_im"))
    mean = wide.groupBy(*keys).agg(F.avg(a * a + b * b).alias("p"), F.avg(a * c + b * d).alias("re"), F.avg(a * d - b * c).alias("im"))
    t = wide.join(mean, list(keys))
    p = F.nullif(F.col("p"), F.lit(0.0))
    return t.withColumn(f"{z}_re", c - (F.col("re") * a - F.col("im") * b) / p).withColumn(f"{z}_im", d - (F.col("re") * b + F.col("im") * a) / p).drop("p", "re", "im")
