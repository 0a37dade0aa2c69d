"""Posterior products per station, reference curves, noise models and small relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import clean, earth, posterior, windows
from ..sources.traces import layer_tasks, read_chain, read_layers, read_samples
from .models import GRID, L, RS, cells, raster
from .registry import query
from .series import EM, S, T, power, trace

#: Station of a model: its order's customer, one of eight.
ST = RS + ", st AS (SELECT o_orderkey AS model_id, o_custkey % 8 AS station FROM orders), sr AS (SELECT station, model_id, cell, vs FROM rs JOIN st USING (model_id))"


def models_of(spark, sf):
    """(station, model_id) of every order."""
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.pmod("o_custkey", F.lit(8)).alias("station"), F.col("o_orderkey").alias("model_id"))


def rasters(spark, sf, models, tasks):
    """(station, model_id, cell, vs): the rasterised layers of ``models`` (station, model_id), which meet layers, not cells, in ``tasks`` tasks."""
    deep = earth.depths(read_layers(spark, sf, tasks))
    return earth.cut(deep.join(models.repartition(tasks, "model_id"), "model_id"), 1000, "station", "model_id")


def stations(spark, sf):
    """The rasterised models of every station."""
    return rasters(spark, sf, models_of(spark, sf), layer_tasks(spark, sf))


@query("station_profiles", f"WITH {ST} SELECT station, cell, median(vs) AS median, stddev_pop(vs) AS std, avg(vs) AS mean, count(*) AS n FROM sr GROUP BY ALL", "median std mean", 4)
def _(spark, sf):
    return stations(spark, sf).groupBy("station", "cell").agg(F.median("vs").alias("median"), F.stddev_pop("vs").alias("std"), F.avg("vs").alias("mean"), F.count("*").alias("n"))


@query("station_density", f"WITH {ST}, b AS (SELECT station, cell, CAST(least(floor(vs / 50), 99) AS BIGINT) AS bin, count(*) AS n FROM sr WHERE vs BETWEEN 0 AND 5000 GROUP BY ALL) SELECT station, cell, bin, n, n / max(n) OVER (PARTITION BY station, cell) AS p FROM b", "p")
def _(spark, sf):
    return posterior.density(stations(spark, sf), "station", "cell")


@query("station_density_fine", f"WITH {ST}, b AS (SELECT station, cell, CAST(least(floor(vs / 1), 4999) AS BIGINT) AS bin, count(*) AS n FROM sr WHERE vs BETWEEN 0 AND 5000 GROUP BY ALL) SELECT station, cell, bin, n, n / max(n) OVER (PARTITION BY station, cell) AS p FROM b", "p")
def _(spark, sf):
    """Five thousand bins of equal count whatever the range."""
    return posterior.density(stations(spark, sf), "station", "cell", n=5000)


@query("station_serpentinisation", f"WITH {ST}, m AS (SELECT station, cell, median(vs) AS median, stddev_pop(vs) AS std FROM sr GROUP BY ALL) SELECT station, cell, median, std, least((9000 - 2 * median) / 30, 100) AS percent, least((9000 - 2 * median) / 30, 100) - std / 50 AS lo, least((9000 - 2 * median) / 30, 100) + std / 50 AS hi FROM m", "median std percent lo hi", 4)
def _(spark, sf):
    m = stations(spark, sf).groupBy("station", "cell").agg(F.median("vs").alias("median"), F.stddev_pop("vs").alias("std"))
    percent, band = P.serpentinised(F.col("median")), F.col("std") / 50
    return m.select("*", percent.alias("percent"), (percent - band).alias("lo"), (percent + band).alias("hi"))


@query("station_top_profile", f"WITH {ST} SELECT station, model_id, avg(vs) AS vs FROM sr WHERE cell < 10 GROUP BY ALL", "vs", 4)
def _(spark, sf):
    """The first ten kilometres of every model."""
    return stations(spark, sf).where("cell < 10").groupBy("station", "model_id").agg(F.avg("vs").alias("vs"))


@query("classify_against_prior", f"WITH {RS}, pr AS (SELECT avg(3000 + i / 16 * 3000) AS v0 FROM range(16) r(i)) SELECT model_id, CASE WHEN avg(vs) < any_value(v0) THEN 'red' ELSE 'green' END AS class FROM rs, pr GROUP BY model_id")
def _(spark, sf):
    """Models slower or faster than the mean of the starting model."""
    prior = earth.geometric_prior(spark).agg(F.avg("vs").alias("v0"))
    m = raster(spark, sf).groupBy("model_id").agg(F.avg("vs").alias("m")).crossJoin(F.broadcast(prior))  # one row
    return m.select("model_id", F.when(F.col("m") < F.col("v0"), "red").otherwise("green").alias("class"))


_CURVES = [(0, 0, 8, 2500.0), (1, 0, 12, 3100.0), (2, 2, 9, 3300.0), (4, 0, 15, 3900.0)]
_SHOWN = [(0, 0), (0, 1), (0, 2), (3, 4), (5, 4)]


@query("station_reference_overlay", f"WITH {ST}, ref(model, lo, hi, v) AS (VALUES {', '.join(map(str, _CURVES))}), sh(station, model) AS (VALUES {', '.join(map(str, _SHOWN))}), pf AS (SELECT station, cell, avg(vs) AS vs FROM sr GROUP BY ALL) SELECT pf.station, pf.cell, pf.vs, coalesce(x.model, -1) AS model, x.v FROM pf LEFT JOIN (SELECT station, model, v, unnest(range(lo, hi)) AS cell FROM sh JOIN ref USING (model)) x ON pf.station = x.station AND pf.cell = x.cell", "vs v", 4)
def _(spark, sf):
    """Reference curves over the profiles of the stations that they belong to."""
    ref = spark.createDataFrame(_CURVES, "model int, lo int, hi int, v double")
    shown = spark.createDataFrame(_SHOWN, "station int, model int")
    curves = ref.select("model", "v", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("cell")).join(shown, "model")
    return stations(spark, sf).groupBy("station", "cell").agg(F.avg("vs").alias("vs")).join(curves, ["station", "cell"], "left").select("station", "cell", "vs", F.coalesce("model", F.lit(-1)).alias("model"), "v")


@query("hist_layer_density", f"WITH {L}, k AS (SELECT * FROM l WHERE layer_idx <= (SELECT max(layer_idx) - 2 FROM l)), e AS (SELECT layer_idx, min(vs) AS lo, max(vs) AS hi, count(*) AS total FROM k GROUP BY 1) SELECT layer_idx, CAST(coalesce(least(floor((vs - lo) / nullif((hi - lo) / 20, 0)), 19), 0) AS BIGINT) AS bin, count(*) AS n, count(*) / (any_value(total) * nullif((any_value(hi) - any_value(lo)) / 20, 0)) AS density FROM k JOIN e USING (layer_idx) GROUP BY 1, 2", "density", 8)
def _(spark, sf):
    """Histograms of the velocities per layer, each over its own range, as densities; the last two layers are left out."""
    layers = read_layers(spark, sf)
    last = layers.agg((F.max("layer_idx") - 2).alias("last"))
    kept = layers.crossJoin(F.broadcast(last)).where("layer_idx <= last")  # one row
    return posterior.ranged_histogram(kept, "layer_idx", "vs", 20, density=True)


@query("hist2d_ranged", f"WITH {L}, e AS (SELECT layer_idx, min(thick) AS t0, max(thick) AS t1, min(vs) AS v0, max(vs) AS v1, count(*) AS total FROM l GROUP BY 1), b AS (SELECT layer_idx, CAST(coalesce(least(floor((thick - t0) / nullif((t1 - t0) / 10, 0)), 9), 0) AS BIGINT) AS bx, CAST(coalesce(least(floor((vs - v0) / nullif((v1 - v0) / 10, 0)), 9), 0) AS BIGINT) AS bv, (t1 - t0) / 10 * (v1 - v0) / 10 AS area, total FROM l JOIN e USING (layer_idx)) SELECT layer_idx, bx, bv, count(*) AS n, count(*) / (any_value(total) * nullif(any_value(area), 0)) * 1e6 AS density FROM b GROUP BY 1, 2, 3", "density", 5)
def _(spark, sf):
    """Thickness against velocity per layer, ten bins each over the layer's own ranges."""
    layers = read_layers(spark, sf)
    ends = layers.groupBy("layer_idx").agg(F.min("thick").alias("t0"), F.max("thick").alias("t1"), F.min("vs").alias("v0"), F.max("vs").alias("v1"), F.count("*").alias("total"))
    place = lambda x, lo, hi: F.coalesce(F.least(F.floor((F.col(x) - F.col(lo)) / F.nullif((F.col(hi) - F.col(lo)) / 10, F.lit(0.0))), F.lit(9).cast("long")), F.lit(0).cast("long"))
    b = layers.join(ends, "layer_idx").select("layer_idx", place("thick", "t0", "t1").alias("bx"), place("vs", "v0", "v1").alias("bv"), ((F.col("t1") - F.col("t0")) / 10 * (F.col("v1") - F.col("v0")) / 10).alias("area"), "total")
    n = b.groupBy("layer_idx", "bx", "bv").agg(F.count("*").alias("n"), F.max("area").alias("area"), F.max("total").alias("total"))
    return n.select("layer_idx", "bx", "bv", "n", (F.col("n") / (F.col("total") * F.nullif("area", F.lit(0.0))) * 1e6).alias("density"))


# --- noise models: fixed values, Peterson (1993): period, A, B of A + B log10(period) from that period on ------------------
LOW_NOISE = [
    (0.1, -162.36, 5.64), (0.17, -166.7, 0.0), (0.4, -170.0, -8.3), (0.8, -166.4, 28.9), (1.24, -168.6, 52.48), (2.4, -159.98, 29.81), (4.3, -141.1, 0.0), (5.0, -71.36, -99.77),
    (6.0, -97.26, -66.49), (10.0, -132.18, -31.57), (12.0, -205.27, 36.16), (15.6, -37.65, -104.33), (21.9, -114.37, -47.1), (31.6, -160.58, -16.28), (45.0, -187.5, 0.0), (70.0, -216.47, 15.7),
    (101.0, -185.0, 0.0), (154.0, -168.34, -7.61), (328.0, -217.43, 11.9), (600.0, -258.28, 26.6), (10000.0, -346.88, 48.75),
]
HIGH_NOISE = [
    (0.1, -108.73, -17.23), (0.22, -150.34, -80.5), (0.32, -122.31, -23.87), (0.8, -116.85, 32.51), (3.8, -108.48, 18.08), (4.6, -74.66, -32.95), (6.3, 0.66, -127.18), (7.9, -93.37, -22.42),
    (15.4, 73.54, -162.98), (20.0, -151.52, 10.01), (354.8, -206.66, 31.63),
]


@query("noise_overlay", f"WITH {EM}, nm(model, period, a, b) AS (VALUES {', '.join(f'({m!r}, {p}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)' for m, rows in (('low', LOW_NOISE), ('high', HIGH_NOISE)) for p, a, b in rows)}), d AS (SELECT station, k, 64 / k AS period, 10 * log10(avg(p)) AS db FROM ep WHERE k > 0 GROUP BY station, k) SELECT station, k, db, model, a + b * log10(d.period) AS level, db > a + b * log10(d.period) AS above FROM d JOIN nm ON nm.period <= d.period QUALIFY row_number() OVER (PARTITION BY station, k, model ORDER BY nm.period DESC) = 1", "db level", 5)
def _(spark, sf):
    """Spectra against the low and high noise model: the segment of the curve in force at each period."""
    table = spark.createDataFrame([(m, p, a, b) for m, rows in (("low", LOW_NOISE), ("high", HIGH_NOISE)) for p, a, b in rows], "model string, p0 double, a double, b double")
    upto = table.withColumn("p1", F.coalesce(F.lead("p0").over(Window.partitionBy("model").orderBy("p0")), F.lit(float("inf"))))
    d = power(spark, sf).where("k > 0").groupBy("station", "k").agg(P.decibel(F.avg("p")).alias("db")).withColumn("period", 64 / F.col("k"))
    level = F.col("a") + F.col("b") * F.log10("period")
    return d.join(F.broadcast(upto), (F.col("period") >= F.col("p0")) & (F.col("period") < F.col("p1"))).select("station", "k", "db", "model", level.alias("level"), (F.col("db") > level).alias("above"))  # 32 fixed rows


# --- small relations ----------------------------------------------------------------------------------------------------
@query("date_ticks", f"WITH {S}, e AS (SELECT min(epoch(ts)) AS a, max(epoch(ts)) AS b, count(*) AS n FROM s) SELECT i, strftime(to_timestamp(floor(a + (b - a) * i / 6)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS tick, CAST(floor(i * n / 6) AS BIGINT) AS place FROM e, range(7) r(i)")
def _(spark, sf):
    e = read_samples(spark, sf).agg(F.min(F.unix_micros("ts") / 1e6).alias("a"), F.max(F.unix_micros("ts") / 1e6).alias("b"), F.count("*").alias("n"))
    rows = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    at = F.timestamp_seconds(F.floor(F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 6))
    return rows.select(F.col("i").cast("long").alias("i"), F.date_format(at, "yyyy-MM-dd").alias("tick"), F.floor(F.col("i") * F.col("n") / 6).alias("place"))


@query("sorted_samples", f"WITH {S} SELECT component, place, sample_id FROM (SELECT component, sample_id, row_number() OVER (PARTITION BY component ORDER BY ts, sample_id) AS place FROM s) WHERE place BETWEEN 101 AND 200")
def _(spark, sf):
    """Samples in the order of channel and time; a slice of places of each channel."""
    place = F.row_number().over(Window.partitionBy("component").orderBy("ts", "sample_id"))
    return read_samples(spark, sf).withColumn("place", place).where("place between 101 and 200").select("component", "place", "sample_id").orderBy("component", "place")


@query("located_components", f"WITH {S} SELECT component, '00' AS location, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    return read_samples(spark, sf).withColumn("location", F.lit("00")).groupBy("component", "location").agg(F.count("*").alias("n"))


@query("cleaning_residual", f"WITH {T} SELECT component, seq, -avg(v) OVER (PARTITION BY component, seq % 24) AS residual FROM t", "residual", 7)
def _(spark, sf):
    """Cleaned less raw, place by place."""
    t = trace(spark, sf)
    cleaned = clean.remove_periodic(t, 24).select("component", "seq", "clean")
    return t.join(cleaned, ["component", "seq"]).select("component", "seq", (F.col("clean") - F.col("v")).alias("residual"))


_PERIODS = [("Z", 24), ("H", 12), ("1", 8), ("2", 6), ("E", 24)]


@query("transients_by_component", f"WITH {T}, p(component, period, reference) AS (VALUES {', '.join(f'({c!r}, {n}, 3)' for c, n in _PERIODS)}), x AS (SELECT * FROM t JOIN p USING (component)) SELECT x.component, x.seq, x.v - s.shape AS clean FROM x JOIN (SELECT component, ((seq - reference) % period + period) % period AS q, avg(v) AS shape FROM x WHERE NOT seq BETWEEN 100 AND 140 GROUP BY ALL) s ON s.component = x.component AND s.q = ((x.seq - x.reference) % x.period + x.period) % x.period", "clean", 7)
def _(spark, sf):
    """Each channel's own period and reference; the mean shape leaves out a span, and is taken off everywhere."""
    spec = spark.createDataFrame([(c, n, 3) for c, n in _PERIODS], "component string, period int, reference int")
    return clean.remove_transients(trace(spark, sf), spec, ~F.col("seq").between(100, 140)).select("component", "seq", "clean")


@query("azimuth_outliers", f"WITH {T}, m AS (SELECT component, avg(v) AS m FROM t GROUP BY 1) SELECT component, seq, v < m / 1.5 OR v > m * 1.5 AS outlier FROM t JOIN m USING (component)")
def _(spark, sf):
    t = trace(spark, sf)
    return t.join(F.broadcast(t.groupBy("component").agg(F.avg("v").alias("m"))), "component").select("component", "seq", windows.azimuth_outlier(F.col("v"), F.col("m"), True).alias("outlier"))  # a row a channel


@query("gravity_acceleration", f"WITH {GRID} SELECT station, k, 2 * pi() * 6.6743e-11 * 1025 * exp(-wn * depth) * (psd_p * cosh(wn * depth) / (1025 * 9.8)) * 1e9 AS aw FROM c", "aw", 6)
def _(spark, sf):
    d = cells(spark, sf)
    return d.select("station", "k", (P.water_acceleration(F.col("psd_p"), F.col("wn"), F.col("depth")) * 1e9).alias("aw"))


@query("geometric_grid", "SELECT n_nationkey AS nation, n_nationkey % 8 AS i, 340 * pow(600.0::DOUBLE / 340, (n_nationkey % 8) / 7) AS v FROM nation", "v")
def _(spark, sf):
    """Values in a constant ratio, one for each nation in turn."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.pmod("n_nationkey", F.lit(8)).alias("i"))
    return rows.withColumn("v", P.geometric(F.col("i"), 340.0, 600.0, 8))


_FIT = "x AS (SELECT label, vec_id, n, CAST(embedding[n + 1] AS DOUBLE) AS d FROM embeddings, range(64) r(n)), m AS (SELECT label, n, avg(d) AS m, stddev_pop(d) / 20 AS s FROM x GROUP BY ALL), rg AS (SELECT vec_id, CASE WHEN t >= 0 THEN sqrt(t) END AS rough FROM (SELECT vec_id, (1.5 * CAST(embedding[64] AS DOUBLE) - 0.5 * CAST(embedding[63] AS DOUBLE) + 0.5 * CAST(embedding[2] AS DOUBLE) - 1.5 * CAST(embedding[1] AS DOUBLE)) / 2 AS t FROM embeddings))"


@query("likelihood_with_roughness", f"WITH {_FIT}, r AS (SELECT vec_id, sqrt(sum(pow((d - m) / s, 2))) AS norm, sqrt(sum(pow(m, 2))) AS model FROM x JOIN m USING (label, n) GROUP BY vec_id) SELECT vec_id, -0.5 * (norm + 0.25 * coalesce(rough, 0)) AS data_rough, -0.5 * (norm + 0.1 * model + 0.25 * coalesce(rough, 0) + 0.05 * norm) AS every_term FROM r JOIN rg USING (vec_id)", "data_rough every_term", 6)
def _(spark, sf):
    """Logarithms of the likelihoods with the roughness of each vector, and with all terms; the uncertainty defaults to a twentieth of the spread."""
    from ..sources.traces import read_segments

    segments = read_segments(spark, sf)
    x = segments.select("station", F.col("window_id").alias("vec_id"), F.posexplode("data").alias("n", "d"))
    m = x.groupBy("station", "n").agg(F.avg("d").alias("m"), P.default_sigma(F.col("d")).alias("s"))
    rough = segments.select(F.col("window_id").alias("vec_id"), F.coalesce(P.roughness(F.col("data")), F.lit(0.0)).alias("rough"))
    r = x.join(m, ["station", "n"]).groupBy("vec_id").agg(P.misfit_norm(F.col("d"), F.col("m"), F.col("s")).alias("norm"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("model"))
    c = F.col
    return r.join(rough, "vec_id").select("vec_id", P.log_likelihood(c("norm"), (0.25, c("rough"))).alias("data_rough"), P.log_likelihood(c("norm"), (0.1, c("model")), (0.25, c("rough")), (0.05, c("norm"))).alias("every_term"))


@query("acf_all_lags", f"WITH {T}, d AS (SELECT component, seq, v - avg(v) OVER (PARTITION BY component) AS d FROM t), z AS (SELECT component, sum(d * d) AS c0, count(*) AS n FROM d GROUP BY 1), c AS (SELECT a.component, b.seq - a.seq AS lag, sum(a.d * b.d) AS s FROM d a JOIN d b ON a.component = b.component AND b.seq >= a.seq GROUP BY ALL) SELECT component, lag, s / c0 AS acf FROM c JOIN z USING (component)", "acf", 5)
def _(spark, sf):
    return posterior.acf_fft(trace(spark, sf))


@query("neff_all_lags", f"WITH {T}, d AS (SELECT component, seq, v - avg(v) OVER (PARTITION BY component) AS d FROM t), z AS (SELECT component, sum(d * d) AS c0, count(*) AS n FROM d GROUP BY 1), c AS (SELECT a.component, b.seq - a.seq AS lag, sum(a.d * b.d) AS s FROM d a JOIN d b ON a.component = b.component AND b.seq >= a.seq GROUP BY ALL), q AS (SELECT component, lag, n, s / c0 AS acf, lead(s / c0) OVER (PARTITION BY component ORDER BY lag) AS nx FROM c JOIN z USING (component)) SELECT component, any_value(n) / (1 + 2 * coalesce(sum(CASE WHEN acf + nx > 0 THEN acf END), 0)) AS neff FROM q GROUP BY component", "neff", 4)
def _(spark, sf):
    """Effective sample size with the trace's own length and all its lags."""
    t = trace(spark, sf)
    n = t.groupBy("component").agg(F.count("*").alias("n"))
    return posterior.effective_size(posterior.acf_fft(t).join(F.broadcast(n), "component"), F.first("n"))  # a row a channel


@query("chain_acceptance", "SELECT chain_id, sum(CASE WHEN ok THEN 1 ELSE 0 END) / (max(i) + 1) AS rate FROM (SELECT o_custkey % 10 AS chain_id, o_orderstatus = 'F' AS ok, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS i FROM orders) GROUP BY 1", "rate")
def _(spark, sf):
    """Share of accepted proposals by the chain's own flag; the start counts as an iteration."""
    c = spark.read.parquet(f"{sf}/orders.parquet").select(F.pmod("o_custkey", F.lit(10)).alias("chain_id"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return c.groupBy("chain_id").agg((F.sum(F.col("accepted").cast("int")) / (F.count("*") + 1)).alias("rate"))


@query("lcurve_by_weight", "SELECT o_custkey % 10 AS chain_id, 0.01 * pow(1000, (o_custkey % 10) / 9) AS alpha, median(o_totalprice) AS misfit FROM orders WHERE o_orderkey >= (SELECT 0.8 * max(o_orderkey) FROM orders) GROUP BY 1, 2", "alpha misfit", 4)
def _(spark, sf):
    """The median misfit of each chain after burn-in against its weight of roughness."""
    chain = read_chain(spark, sf)
    return posterior.lcurve(chain.withColumn("alpha", P.geometric(F.col("chain_id"), 0.01, 10.0, 10)))
