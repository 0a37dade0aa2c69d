"""Relations of the posterior: filters, profiles, densities, histograms, chain diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted(chain: DataFrame, thresholds: DataFrame, burnin: int, on: str = "chain_id") -> DataFrame:
    """Iterations after burn-in under the threshold of their own station."""
    return chain.join(thresholds, on).where((F.col("iter") >= burnin) & (F.col("misfit") < F.col("threshold")))


def accepted_profiles(profiles: DataFrame, chain: DataFrame, thresholds: DataFrame, burnin: int = 0) -> DataFrame:
    """``profiles`` (station, model_id, and what else they have) of the models of ``chain`` (station, iter, misfit) that lie under their station's own threshold after burn-in; ``iter`` is the model's id."""
    good = accepted(chain, thresholds, burnin, "station").select("station", F.col("iter").alias("model_id"))
    return profiles.join(good, ["station", "model_id"], "left_semi")


def station_products(good: DataFrame) -> DataFrame:
    """(station, cell, n, median, mean, std) of accepted profiles."""
    return good.groupBy("station", "cell").agg(F.count("*").alias("n"), F.median("vs").alias("median"), F.avg("vs").alias("mean"), F.stddev_pop("vs").alias("std"))


def with_curves(products: DataFrame, curves: DataFrame, starts: DataFrame) -> DataFrame:
    """``products`` with the start profile of the station (``starts``: station, cell, start) and a row for each reference curve (``curves``: curve, cell, v)."""
    return products.join(starts, ["station", "cell"], "left").join(curves, "cell", "left")


def thin(chain: DataFrame, burnin: int, total: int, wanted: int = 1000) -> DataFrame:
    step = max(1, (total - burnin) // wanted)
    return chain.where((F.col("iter") >= burnin) & (F.pmod(F.col("iter") - burnin, F.lit(step)) == 0))


def bucket(v: Column, lo: float, hi: float, n: int) -> Column:
    """Equal-width bin from 0; the upper end belongs to the last bin; null outside."""
    b = F.floor((v - lo) / ((hi - lo) / n))
    return F.when((v >= lo) & (v <= hi), F.least(b, F.lit(n - 1).cast("long")))


def density(profile: DataFrame, *keys: str, lo: float = 0, hi: float = 5000, n: int = 100) -> DataFrame:
    """Share of each value bin per depth (``keys``: the depth, and the station if there are several), scaled to the fullest bin there."""
    counts = profile.withColumn("bin", bucket(F.col("vs"), lo, hi, n)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


def ranged_histogram(rows: DataFrame, key: str, value: str, n: int = 20, density: bool = False) -> DataFrame:
    """Histogram of n bins over each key's own range; with ``density`` the bins of a key have the area one."""
    ends = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("total"))
    width = F.nullif((F.col("hi") - F.col("lo")) / n, F.lit(0.0))
    b = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(n - 1).cast("long")), F.lit(0).cast("long"))
    out = rows.join(ends, key).groupBy(key, b.alias("bin")).agg(F.count("*").alias("n"), F.max(F.col("total") * width).alias("area"))
    return out.select(key, "bin", "n", *([(F.col("n") / F.col("area")).alias("density")] if density else []))


def acf_full(trace: DataFrame) -> DataFrame:
    """(component, lag, acf) at every lag: pairs of places of a channel, summed by lag before the shuffle.  The work is the square of a trace's length."""
    means = trace.groupBy("component").agg(F.avg("v").alias("m"))
    d = trace.join(means, "component").select("component", "seq", (F.col("v") - F.col("m")).alias("d"))
    c0 = d.groupBy("component").agg(F.sum(F.col("d") * F.col("d")).alias("c0"))
    other = d.select("component", F.col("seq").alias("to"), F.col("d").alias("e"))
    sums = d.join(other, "component").where("to >= seq").groupBy("component", (F.col("to") - F.col("seq")).alias("lag")).agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    return sums.join(c0, "component").select("component", "lag", (F.col("s") / F.nullif("c0", F.lit(0.0))).alias("acf"))


def acf_fft(trace: DataFrame, columns: int = 1 << 16) -> DataFrame:
    """(component, lag, acf) at every lag, as ``acf_full``, in n log n: transform, squared modulus, inverse, padded with zeros to twice the length.

    The transform is dealt over tasks in four steps: a trace of N = R * C places is a table of R rows, whose place ``seq`` is
    row ``seq % R``; rows are transformed, turned, regrouped by column, transformed again.  The power is turned back in the
    same task, so a trace is shuffled three times, and no task holds more than some ``columns`` values, a row or a column.
    Places count from the trace's first one and must be dense; null values are an error.
    """
    ends = trace.groupBy("component").agg(F.min("seq").alias("a"), F.count("*").alias("n"), F.avg("v").alias("m"), F.count("v").alias("known"), F.max("seq").alias("b"))
    facts = ends.agg(F.max("n"), F.max(F.when((F.col("known") < F.col("n")) | (F.col("b") - F.col("a") + 1 != F.col("n")), 1))).first()
    if facts[1]:
        raise ValueError("a trace has gaps or null values")
    bits = max(2, (2 * (facts[0] or 1) - 1).bit_length())
    rows, cols = 1 << bits // 2, 1 << bits - bits // 2
    wide = min(cols, max(1, columns // rows))  # columns of a group

    def complex_rows(b: pa.RecordBatch, name: str) -> np.ndarray:
        return np.asarray(b.column(name).flatten()).reshape(b.num_rows, -1)

    def pieces(b: pa.RecordBatch, z: np.ndarray, names: list[str]) -> pa.RecordBatch:
        """Rows of the table cut into groups of columns: component, group, row, real and imaginary parts."""
        n, groups = len(z), z.shape[1] // wide
        parts = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), wide).cast(pa.list_(pa.float64())) for x in (z.real, z.imag)]
        at = pa.array(np.repeat(np.arange(n), groups))
        return pa.RecordBatch.from_arrays([b.column("component").take(at), pa.array(np.tile(np.arange(groups), n)), pa.array(np.repeat(b.column("r").to_numpy(), groups)), *parts], names=names)

    def first(batches):
        for b in batches:
            x = np.zeros((b.num_rows, cols))
            lists, at = b.column("x"), b.column("r").to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            i = np.repeat(np.arange(b.num_rows), n)
            x[i, lists.flatten().field("c").to_numpy()] = lists.flatten().field("d").to_numpy()
            z = np.fft.fft(x, axis=1) * np.exp(-2j * np.pi * at[:, None] * np.arange(cols) / (rows * cols))
            yield pieces(b, z, ["component", "g", "r", "re", "im"])

    def second(table: pa.Table) -> pa.Table:
        t = table.sort_by("r").combine_chunks()
        z = np.stack([np.asarray(t.column(c).chunk(0).flatten()).reshape(rows, wide) for c in ("re", "im")])
        g = t.column("g")[0].as_py()
        k = g * wide + np.arange(wide)
        power = np.abs(np.fft.fft(z[0] + 1j * z[1], axis=0)) ** 2
        back = np.fft.ifft(power, axis=0) * np.exp(2j * np.pi * np.arange(rows)[:, None] * k / (rows * cols))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), wide).cast(pa.list_(pa.float64())) for x in (back.real, back.imag)]
        return pa.table([t.column("component"), t.column("g"), pa.array(np.arange(rows)), *lists], names=["component", "g", "r", "re", "im"])

    def third(batches):
        for b in batches:
            n = b.num_rows
            z = [np.asarray(b.column(c).flatten().flatten()).reshape(n, cols) for c in ("re", "im")]
            s = np.fft.ifft(z[0] + 1j * z[1], axis=1).real
            lag = b.column("r").to_numpy()[:, None] + rows * np.arange(cols)
            keep = lag < b.column("n").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([b.column("component").take(pa.array(np.repeat(np.arange(n), keep.sum(1)))), pa.array(lag[keep]), pa.array(s[keep])], names=["component", "lag", "s"])

    place = F.col("seq") - F.col("a")
    # a row a channel
    x = trace.join(ends, "component").select("component", F.pmod(place, F.lit(rows)).cast("long").alias("r"), F.floor(place / rows).cast("long").alias("c"), (F.col("v") - F.col("m")).alias("d"))
    table = x.groupBy("component", "r").agg(F.collect_list(F.struct("c", "d")).alias("x"))
    every = ends.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("r")).join(table, ["component", "r"], "left")
    every = every.select("component", "r", F.coalesce("x", F.array().cast("array<struct<c:bigint,d:double>>")).alias("x"))
    schema = "component {}, g long, r long, re array<double>, im array<double>".format(dict(trace.dtypes)["component"])
    turned = every.mapInArrow(first, schema).groupBy("component", "g").applyInArrow(second, schema)
    lists = turned.groupBy("component", "r").agg(F.sort_array(F.collect_list(F.struct("g", "re", "im"))).alias("x")).join(ends.select("component", "n"), "component")
    sums = lists.select("component", "r", "n", F.col("x.re").alias("re"), F.col("x.im").alias("im")).mapInArrow(third, "component {}, lag long, s double".format(dict(trace.dtypes)["component"]))
    c0 = sums.where("lag = 0").select("component", F.col("s").alias("c0"))
    # a trace of one value has only rounding left, where the plain sums have zeros
    flat = ends.select("component", F.abs("m").alias("m"), "n")
    return sums.join(c0.join(flat, "component"), "component").select("component", "lag", F.when(F.col("c0") > F.col("n") * (F.col("m") * 1e-13) ** 2, F.col("s") / F.nullif("c0", F.lit(0.0))).alias("acf"))


def lcurve(chains: DataFrame, burnin: float = 0.8) -> DataFrame:
    """(chain_id, alpha, misfit): the median misfit of each chain after that share of the iterations."""
    last = chains.agg((burnin * F.max("iter")).alias("b"))
    return chains.crossJoin(F.broadcast(last)).where("iter >= b").groupBy("chain_id", "alpha").agg(F.median("misfit").alias("misfit"))  # one row is broadcast


def acf(trace: DataFrame, lags: int) -> DataFrame:
    """Autocorrelation up to ``lags``: one pass of leads over the ordered trace."""
    w = Window.partitionBy("component").orderBy("seq")
    d = trace.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("component")))
    products = [(F.col("d") * F.lead("d", j).over(w)).alias(f"c{j}") for j in range(lags + 1)]
    sums = d.select("component", *products).groupBy("component").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(lags + 1)])
    pairs = F.array(*[F.struct(F.lit(j).alias("lag"), (F.col(f"c{j}") / F.nullif(F.col("c0"), F.lit(0.0))).alias("acf")) for j in range(lags + 1)])
    return sums.select("component", F.explode(pairs).alias("x")).select("component", "x.lag", "x.acf")


def effective_size(acfs: DataFrame, n: Column) -> DataFrame:
    """n / (1 + 2 sum of the lags whose pair with the next is positive)."""
    nxt = F.lead("acf").over(Window.partitionBy("component").orderBy("lag"))
    return acfs.withColumn("pos", F.when(F.col("acf") + nxt > 0, F.col("acf"))).groupBy("component").agg((n / (1 + 2 * F.coalesce(F.sum("pos"), F.lit(0.0)))).alias("neff"))
