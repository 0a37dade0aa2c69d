"""Queries on the response chain, layer models and posteriors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import earth, inference, posterior
from ..sources.shared import new_folder
from ..sources.traces import read_chain, read_layers, read_segments
from .registry import query
from .series import EM, power

# --- response chain: a grid of frequencies for each sea depth of the station dimension -------------------
GRID = """g AS (SELECT n_nationkey AS station, 500.0::DOUBLE + 150 * n_nationkey AS depth, k, k / 500 AS f FROM nation, range(33) r(k)),
w AS (SELECT *, pow(2 * pi() * f, 2) / 9.79329 AS w2g, pow(2 * pi() * f, 2) / 9.79329 * depth AS x FROM g),
kk AS (SELECT *, CASE WHEN f = 0 THEN 0 WHEN x > 2.96 THEN w2g ELSE sqrt(CASE WHEN 27 - 9 * x > 0 THEN 54 * x / (27 - 9 * x + sqrt(pow(27 - 9 * x, 2) + 108 * x)) ELSE (sqrt(pow(27 - 9 * x, 2) + 108 * x) - (27 - 9 * x)) / 2 END) / depth END AS wn FROM w),
c AS (SELECT *, pi() * 6.6743e-11 / 9.8 * (1 + exp(-2 * wn * depth)) AS ratio, pow(2 * pi() * f, 2) / (pow(2 * pi() * f, 2) + 3.07e-5) AS ad, 0.9 + f AS coh, 2.0 + k AS psd_p, 3.0 + 2 * k AS psd_z FROM kk WHERE k > 0)"""


def grid(spark, sf):
    stations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("station"), (500.0 + 150 * F.col("n_nationkey")).alias("depth"))
    g = stations.select("station", "depth", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k")).withColumn("f", F.col("k") / 500)
    return g.withColumn("wn", P.wavenumber(F.col("f"), F.col("depth")))


def cells(spark, sf):
    """The grid with a made-up coherence and spectra, a formula of the bin."""
    return grid(spark, sf).where("k > 0").withColumn("coh", 0.9 + F.col("f")).withColumn("psd_p", 2.0 + F.col("k")).withColumn("psd_z", 3.0 + 2 * F.col("k"))


#: Stations of priors; the last one is unknown.
PRIOR_STATIONS = (*earth.STATIONS, "XX01")


@query("wavenumber", f"WITH {GRID} SELECT station, k, wn * 1000 AS wn FROM kk", "wn")
def _(spark, sf):
    return grid(spark, sf).select("station", "k", (F.col("wn") * 1000).alias("wn"))


_Y = "CASE WHEN x > 1 THEN x ELSE sqrt(x) END"


@query("dispersion_exact", f"WITH RECURSIVE {GRID}, it AS (SELECT station, k, depth, x, 0 AS i, {_Y} AS y FROM kk WHERE k > 0 UNION ALL SELECT station, k, depth, x, i + 1, y - (y * tanh(y) - x) / (tanh(y) + y * (1 - tanh(y) * tanh(y))) FROM it WHERE i < 30) SELECT station, k, y / depth * 1000 AS wn FROM it WHERE i = 30 UNION ALL SELECT station, k, 0 FROM kk WHERE k = 0", "wn")
def _(spark, sf):
    return grid(spark, sf).select("station", "k", (P.wavenumber_exact(F.col("f"), F.col("depth")) * 1000).alias("wn"))


@query("gravity_terms", f"WITH {GRID} SELECT station, k, ratio * 1e12 AS ratio, ad, psd_p * cosh(wn * depth) / (1025 * 9.8) AS height FROM c", "ratio ad height", 7)
def _(spark, sf):
    d = cells(spark, sf)
    return d.select("station", "k", (P.gravity_ratio(F.col("wn"), F.col("depth")) * 1e12).alias("ratio"), P.mass_correction(F.col("f")).alias("ad"), P.water_height(F.col("psd_p"), F.col("wn"), F.col("depth")).alias("height"))


@query("corner_freqs", "SELECT n_nationkey AS station, sqrt(9.8 / (2 * pi() * 0.5 * (500 + 150 * n_nationkey))) AS f1, sqrt(9.8 / (2 * pi() * 2 * (500 + 150 * n_nationkey))) AS f2 FROM nation", "f1 f2")
def _(spark, sf):
    d = grid(spark, sf).select("station", "depth").distinct()
    return d.select("station", P.corner(F.col("depth"), 0.5).alias("f1"), P.corner(F.col("depth"), 2.0).alias("f2"))


@query("compliance_v1", f"WITH {GRID} SELECT station, k, wn * coh * ad * (ratio + sqrt(psd_z) / (sqrt(psd_p) * 0.66)) AS corrected, wn * coh * ad * sqrt(psd_z) / sqrt(psd_p) AS mass_only, wn * coh * (ratio + sqrt(psd_z) / sqrt(psd_p)) AS gravity_only, wn * coh * sqrt(psd_z) / (sqrt(psd_p) * 0.66) AS gain_only, wn * coh * sqrt(psd_z) / sqrt(psd_p) AS plain FROM c", "corrected mass_only gravity_only gain_only plain", 9)
def _(spark, sf):
    k, coh, f, depth, z, p = (F.col(c) for c in ("wn", "coh", "f", "depth", "psd_z", "psd_p"))
    root, ratio = F.sqrt(z) / F.sqrt(p), P.gravity_ratio(k, depth)
    return cells(spark, sf).select("station", "k", P.compliance_v1(k, coh, f, depth, z, p, 0.66).alias("corrected"), (k * coh * P.mass_correction(f) * root).alias("mass_only"), (k * coh * (ratio + root)).alias("gravity_only"), (k * coh * root / 0.66).alias("gain_only"), (k * coh * root).alias("plain"))


@query("compliance_v2", f"WITH {GRID} SELECT k, median(v) AS median, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS range FROM (SELECT k, wn * coh * ad * (ratio + sqrt(psd_z) / sqrt(psd_p)) AS v FROM c) GROUP BY k", "median mean std range", 9)
def _(spark, sf):
    v = P.compliance_v2(*(F.col(c) for c in ("wn", "coh", "f", "depth", "psd_z", "psd_p")))
    return cells(spark, sf).withColumn("v", v).groupBy("k").agg(F.median("v").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("range"))


@query("correction_effect", f"WITH {GRID} SELECT k, median(wn * coh * (ratio + sqrt(psd_z / psd_p))) - median(wn * coh * ad * sqrt(psd_z / psd_p)) AS gravity, median(wn * coh * sqrt(psd_z / psd_p) / 0.66) - median(wn * coh * ad * sqrt(psd_z / psd_p)) AS gain FROM c GROUP BY k", "gravity gain", 9)
def _(spark, sf):
    k, coh, root = F.col("wn"), F.col("coh"), F.sqrt(F.col("psd_z") / F.col("psd_p"))
    base = F.median(k * coh * P.mass_correction(F.col("f")) * root)
    return cells(spark, sf).groupBy("k").agg((F.median(k * coh * (P.gravity_ratio(k, F.col("depth")) + root)) - base).alias("gravity"), (F.median(k * coh * root / 0.66) - base).alias("gain"))


@query("compliance_simple", f"WITH {GRID} SELECT station, k, wn * coh * coh * sqrt(psd_z / psd_p) AS simple, wn * psd_z / psd_p * 0.66 AS admittance FROM c", "simple admittance", 9)
def _(spark, sf):
    k, coh, z, p = (F.col(c) for c in ("wn", "coh", "psd_z", "psd_p"))
    return cells(spark, sf).select("station", "k", P.compliance_simple(k, coh * coh, z, p).alias("simple"), P.admittance(k, z, p, 0.66).alias("admittance"))


@query("uncertainty_theory", f"WITH {GRID} SELECT station, k, psd_z * sqrt(1 - coh * coh) / (abs(coh) * sqrt(2 * 40)) AS theory, psd_z * sqrt(1 - coh) / abs(coh * sqrt(2 * 40)) AS alt FROM c", "theory alt")
def _(spark, sf):
    return cells(spark, sf).select("station", "k", P.uncertainty_theory(F.col("psd_z"), F.col("coh"), F.lit(40)).alias("theory"), P.uncertainty_alt(F.col("psd_z"), F.col("coh"), F.lit(40)).alias("alt"))


@query("uncertainty_std", f"WITH {EM} SELECT station, k, stddev_pop(p) AS std, max(p) - min(p) AS range FROM ep GROUP BY station, k", "std range", 8)
def _(spark, sf):
    return power(spark, sf).groupBy("station", "k").agg(F.stddev_pop("p").alias("std"), (F.max("p") - F.min("p")).alias("range"))


@query("coh_significance", "SELECT o_custkey AS chain, sqrt(1 - pow(0.05, 1 / (n / 2 - 1))) AS level FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 3", "level")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("chain")).agg(F.count("*").alias("n")).where("n > 3")
    return n.select("chain", P.coherence_significance(F.col("n")).alias("level"))


@query("vp_density", "SELECT p_partkey, p_retailprice * sqrt(3) AS vp, 310 * pow(p_retailprice * sqrt(3), 0.25) AS rho FROM part", "vp rho", 4)
def _(spark, sf):
    vs = F.col("p_retailprice")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", P.vp_from_vs(vs).alias("vp"), P.gardner_density(vs).alias("rho"))


_FIT = "x AS (SELECT label, vec_id, n, CAST(embedding[n + 1] AS DOUBLE) AS d FROM embeddings, range(64) r(n)), m AS (SELECT label, n, avg(d) AS m FROM x GROUP BY ALL), r AS (SELECT vec_id, sqrt(sum(pow((d - m) / 0.1, 2))) AS norm, sum(pow((d - m) / 0.1, 2)) AS total FROM x JOIN m USING (label, n) GROUP BY vec_id)"


@query("misfit_likelihood", f"WITH {_FIT} SELECT vec_id, norm AS misfit_norm, total AS misfit_sum, exp(-0.5 * norm) AS likelihood_norm, exp(-0.5 * total / 100) AS likelihood_sum, exp(-0.5 * (norm + 0.25 * 2)) AS likelihood_rough FROM r", "misfit_norm misfit_sum likelihood_norm likelihood_sum likelihood_rough", 8)
def _(spark, sf):
    x = read_segments(spark, sf).select("station", F.col("window_id").alias("vec_id"), F.posexplode("data").alias("n", "d"))
    fit = x.join(x.groupBy("station", "n").agg(F.avg("d").alias("m")), ["station", "n"])
    s = F.lit(0.1)
    r = fit.groupBy("vec_id").agg(P.misfit_norm(F.col("d"), F.col("m"), s).alias("misfit_norm"), P.misfit_sum(F.col("d"), F.col("m"), s).alias("misfit_sum"))
    return r.select("*", F.exp(-0.5 * F.col("misfit_norm")).alias("likelihood_norm"), F.exp(-0.5 * F.col("misfit_sum") / 100).alias("likelihood_sum"), F.exp(-0.5 * (F.col("misfit_norm") + 0.25 * 2)).alias("likelihood_rough"))


@query("roughness", "SELECT vec_id, CASE WHEN t >= 0 THEN sqrt(t) END AS roughness FROM (SELECT vec_id, (1.5 * CAST(embedding[64] AS DOUBLE) - 0.5 * CAST(embedding[63] AS DOUBLE) + 0.5 * CAST(embedding[2] AS DOUBLE) - 1.5 * CAST(embedding[1] AS DOUBLE)) / 2 AS t FROM embeddings)", "roughness")
def _(spark, sf):
    return read_segments(spark, sf).select(F.col("window_id").alias("vec_id"), P.roughness(F.col("data")).alias("roughness"))


@query("gauge_gain", f"WITH {EM}, b AS (SELECT station, window_id, avg(p) AS m, avg(sqrt(p) / pow(2 * pi() * f, 2)) AS r FROM ep WHERE f BETWEEN 0.1 AND 0.3 GROUP BY ALL) SELECT station, count(*) AS n, avg(r) AS gain FROM b WHERE m >= 0.02 GROUP BY station", "gain", 8)
def _(spark, sf):
    """Pressure-gauge gain: mean spectral ratio over windows that pass a level (own definition)."""
    b = power(spark, sf).where(F.col("f").between(0.1, 0.3)).groupBy("station", "window_id").agg(F.avg("p").alias("m"), F.avg(F.sqrt("p") / F.pow(2 * math.pi * F.col("f"), 2)).alias("r"))
    return b.where("m >= 0.02").groupBy("station").agg(F.count("*").alias("n"), F.avg("r").alias("gain"))


@query("logspace_grid", "SELECT o_custkey % 10 AS i, count(*) AS n, 0.01 * pow(1000, (o_custkey % 10) / 9) AS alpha FROM orders GROUP BY 1", "alpha")
def _(spark, sf):
    """The weight of each chain, a power of ten apart by ninths, and the chain's iterations."""
    return read_chain(spark, sf).groupBy(F.col("chain_id").alias("i")).agg(F.count("*").alias("n")).withColumn("alpha", 0.01 * F.pow(F.lit(1000.0), F.col("i") / 9))


# --- layer models ---------------------------------------------------------------------------------------
L = """l0 AS (SELECT l_orderkey AS model_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS layer_idx, l_quantity * 100 AS thick, 1000 + (l_partkey % 40) * 100.0::DOUBLE AS vs FROM lineitem),
l AS (SELECT *, sum(thick) OVER (PARTITION BY model_id ORDER BY layer_idx) AS bottom, sum(thick) OVER (PARTITION BY model_id ORDER BY layer_idx) - thick AS top FROM l0)"""
RS = L + ", rs AS (SELECT model_id, vs, unnest(range(CAST(ceil(top / 1000) AS BIGINT), CAST(ceil(bottom / 1000) AS BIGINT))) AS cell FROM l)"


def raster(spark, sf):
    return earth.rasterise(read_layers(spark, sf), 1000)


@query("layer_depths", f"WITH {L} SELECT model_id, layer_idx, top, bottom FROM l")
def _(spark, sf):
    return earth.depths(read_layers(spark, sf)).select("model_id", "layer_idx", "top", "bottom")


@query("total_depth", f"WITH {L} SELECT model_id, sum(thick) AS depth, count(*) AS n FROM l GROUP BY 1")
def _(spark, sf):
    return read_layers(spark, sf).groupBy("model_id").agg(F.sum("thick").alias("depth"), F.count("*").alias("n"))


@query("rasterise", f"WITH {RS} SELECT cell, count(*) AS n, avg(vs) AS vs FROM rs GROUP BY cell", "vs")
def _(spark, sf):
    return raster(spark, sf).groupBy("cell").agg(F.count("*").alias("n"), F.avg("vs").alias("vs"))


@query("profile_block_mean", f"WITH {L}, b AS (SELECT model_id, vs, top, bottom, unnest(range(CAST(floor(top / 1000) AS BIGINT), CAST(ceil(bottom / 1000) AS BIGINT))) AS block FROM l) SELECT model_id, block, sum(vs * (least(bottom, (block + 1) * 1000) - greatest(top, block * 1000))) / sum(least(bottom, (block + 1) * 1000) - greatest(top, block * 1000)) AS vs FROM b GROUP BY 1, 2", "vs", 4)
def _(spark, sf):
    return earth.block_mean(read_layers(spark, sf), 1000)


@query("posterior_filter_mean", f"WITH {RS}, ok AS (SELECT o_orderkey AS model_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey >= 1000 AND o_totalprice < abs(c_acctbal) * 30) SELECT cell, avg(vs) AS vs, count(*) AS n FROM rs SEMI JOIN ok USING (model_id) GROUP BY cell", "vs")
def _(spark, sf):
    chain = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("iter"), F.col("o_totalprice").alias("misfit"))
    limits = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("chain_id"), (F.abs("c_acctbal") * 30).alias("threshold"))
    ok = posterior.accepted(chain, limits, 1000).select(F.col("iter").alias("model_id"))
    return raster(spark, sf).join(ok, "model_id", "left_semi").groupBy("cell").agg(F.avg("vs").alias("vs"), F.count("*").alias("n"))


@query("posterior_median_std", f"WITH {RS} SELECT cell, median(vs) AS median, stddev_pop(vs) AS std FROM rs GROUP BY cell", "median std", 4)
def _(spark, sf):
    return raster(spark, sf).groupBy("cell").agg(F.median("vs").alias("median"), F.stddev_pop("vs").alias("std"))


@query("posterior_density", f"WITH {RS}, b AS (SELECT cell, CAST(least(floor(vs / 50), 99) AS BIGINT) AS bin, count(*) AS n FROM rs WHERE vs BETWEEN 0 AND 5000 GROUP BY 1, 2) SELECT cell, bin, n, n / max(n) OVER (PARTITION BY cell) AS p FROM b", "p")
def _(spark, sf):
    return posterior.density(raster(spark, sf), "cell")


@query("hist_layer", f"WITH {L}, e AS (SELECT layer_idx, min(vs) AS lo, max(vs) AS hi FROM l GROUP BY 1) SELECT layer_idx, CAST(coalesce(least(floor((vs - lo) / nullif((hi - lo) / 20, 0)), 19), 0) AS BIGINT) AS bin, count(*) AS n FROM l JOIN e USING (layer_idx) GROUP BY 1, 2")
def _(spark, sf):
    return posterior.ranged_histogram(read_layers(spark, sf), "layer_idx", "vs", 20)


@query("hist2d_layer", f"WITH {L}, b AS (SELECT layer_idx, CAST(least(floor((thick - 0) / 500), 9) AS BIGINT) AS bx, CAST(least(floor(vs / 500), 9) AS BIGINT) AS bv FROM l) SELECT layer_idx, bx, bv, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY layer_idx) * 500.0 * 500.0) * 1e6 AS density FROM b GROUP BY 1, 2, 3", "density")
def _(spark, sf):
    from pyspark.sql import Window

    b = read_layers(spark, sf).select("layer_idx", posterior.bucket(F.col("thick"), 0, 5000, 10).alias("bx"), posterior.bucket(F.col("vs"), 0, 5000, 10).alias("bv"))
    n = b.groupBy("layer_idx", "bx", "bv").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy("layer_idx")) * 500.0 * 500.0) * 1e6)


@query("classify_vs_prior", f"WITH {RS} SELECT model_id, CASE WHEN avg(vs) < 3000 THEN 'slow' ELSE 'fast' END AS class FROM rs GROUP BY model_id")
def _(spark, sf):
    m = raster(spark, sf).groupBy("model_id").agg(F.avg("vs").alias("m"))
    return m.select("model_id", F.when(F.col("m") < 3000, "slow").otherwise("fast").alias("class"))


@query("thin_nth", "SELECT o_orderkey AS iter, o_totalprice AS misfit FROM orders WHERE o_orderkey >= 1000 AND (o_orderkey - 1000) % 14 = 0")
def _(spark, sf):
    return posterior.thin(read_chain(spark, sf), 1000, 15_000).select("iter", "misfit")


@query("serpentinisation", f"WITH {RS} SELECT cell, least((9000 - 2 * median(vs)) / 30, 100) AS percent, stddev_pop(vs) / 50 AS band FROM rs GROUP BY cell", "percent band", 4)
def _(spark, sf):
    return raster(spark, sf).groupBy("cell").agg(P.serpentinised(F.median("vs")).alias("percent"), (F.stddev_pop("vs") / 50).alias("band"))


_REF = [(0, 0, 5, 2500.0, 1), (0, 3, 12, 3600.0, 2), (1, 0, 20, 3000.0, 1), (1, 4, 9, 4100.0, 2)]


@query("ref_model_overlay", f"WITH {RS}, ref(model, bin_lo, bin_hi, v, priority) AS (VALUES {', '.join(map(str, _REF))}), rc AS (SELECT model, cell, max_by(v, priority) AS v_ref FROM (SELECT *, unnest(range(bin_lo, bin_hi)) AS cell FROM ref) GROUP BY 1, 2), pf AS (SELECT cell, avg(vs) AS vs FROM rs GROUP BY 1) SELECT model, cell, vs, v_ref FROM pf JOIN rc USING (cell)", "vs v_ref")
def _(spark, sf):
    ref = spark.createDataFrame(_REF, "model_id int, bin_lo int, bin_hi int, v double, priority int")
    profile = raster(spark, sf).groupBy("cell").agg(F.avg("vs").alias("vs"))
    return earth.overlay(profile, ref).select(F.col("model_id").alias("model"), "cell", "vs", "v_ref")


@query("lcurve_agg", "SELECT o_custkey % 10 AS chain_id, median(o_totalprice) AS misfit, count(*) AS n FROM orders WHERE o_orderkey >= (SELECT 0.8 * max(o_orderkey) FROM orders) GROUP BY 1", "misfit", 4)
def _(spark, sf):
    chain = read_chain(spark, sf)
    last = chain.agg((0.8 * F.max("iter")).alias("b"))
    return chain.crossJoin(F.broadcast(last)).where("iter >= b").groupBy("chain_id").agg(F.median("misfit").alias("misfit"), F.count("*").alias("n"))  # one row is broadcast


@query("acceptance_rate", "SELECT o_custkey % 10 AS chain_id, sum(CASE WHEN o_totalprice <= p THEN 1 ELSE 0 END) / count(*) AS rate FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1", "rate")
def _(spark, sf):
    from pyspark.sql import Window

    before = F.lag("misfit").over(Window.partitionBy("chain_id").orderBy("iter"))
    c = read_chain(spark, sf).withColumn("ok", F.coalesce(F.col("misfit") <= before, F.lit(False)))
    return c.groupBy("chain_id").agg((F.sum(F.col("ok").cast("int")) / F.count("*")).alias("rate"))


# --- priors, forward model, chains ----------------------------------------------------------------------
def _prior_sql() -> str:
    known = ", ".join(f"('{r[0]}', {r[1]}, '{r[2]}', {r[3]}, {r[4]}, {r[5]}, {r[6]})" for r in earth.station_rows())
    other = ", ".join(f"({n}, {i}, {', '.join(map(str, map(float, r)))})" for n, rows in earth.GENERIC.items() for i, r in enumerate((*rows, earth.M4, earth.M4, earth.M2)))
    names = ", ".join(f"'{n}'" for n in PRIOR_STATIONS)
    m3 = "station = 'RR34' AND part = 'mantle' AND m > 2"
    return f"""WITH w AS (SELECT n_nationkey AS nation, [{names}][n_nationkey % {len(PRIOR_STATIONS)} + 1] AS station, CAST(3 + 3 * (n_nationkey % 5) AS INT) AS n_layer FROM nation),
k(station, layer_no, part, thick, rho, vp, vs) AS (VALUES {known}), g(n_layer, layer_no, thick, rho, vp, vs) AS (VALUES {other}),
u AS (SELECT DISTINCT station, n_layer, CASE WHEN n_layer IN (3, 6, 9, 12) THEN n_layer // 3 ELSE 4 END AS m FROM w),
e AS (SELECT station, n_layer, floor(thick / sub) AS thick, CASE WHEN {m3} THEN {earth.M3[1]} ELSE rho END AS rho, CASE WHEN {m3} THEN {earth.M3[2]} ELSE vp END AS vp, CASE WHEN {m3} THEN {earth.M3[3]} ELSE vs END AS vs, unnest(range(sub)) AS r FROM (SELECT *, CASE WHEN part = 'crust' THEN m ELSE 1 END AS sub FROM u JOIN k USING (station))
UNION ALL SELECT station, u.n_layer, thick, rho, vp, vs, 0 FROM u JOIN g USING (n_layer) WHERE station NOT IN (SELECT station FROM k))
SELECT nation, station, n_layer, count(*) AS layers, sum(thick) AS depth, sum(thick * rho) AS mass, sum(thick / vp) AS p_time, sum(thick / vs) AS s_time FROM w JOIN e USING (station, n_layer) GROUP BY ALL"""


@query("prior_lookup", _prior_sql(), "depth mass p_time s_time", 4)
def _(spark, sf):
    """The prior of every nation's stand-in station: layers, depth, mass and travel times."""
    k = F.col("n_nationkey")
    rows = spark.read.parquet(f"{sf}/nation.parquet")
    want = rows.select(k.alias("nation"), F.element_at(F.array(*map(F.lit, PRIOR_STATIONS)), (F.pmod(k, F.lit(len(PRIOR_STATIONS))) + 1).cast("int")).alias("station"), (3 + 3 * F.pmod(k, F.lit(5))).cast("int").alias("n_layer"))
    layers = want.join(earth.prior(spark, want.select("station", "n_layer").distinct()), ["station", "n_layer"])
    c = F.col
    return layers.groupBy("nation", "station", "n_layer").agg(F.count("*").alias("layers"), F.sum("thick").alias("depth"), F.sum(c("thick") * c("rho")).alias("mass"), F.sum(c("thick") / c("vp")).alias("p_time"), F.sum(c("thick") / c("vs")).alias("s_time"))


@query("prior_geometric", f"WITH {L}, p AS (SELECT i AS layer_idx, CASE WHEN i = 15 THEN 100000 ELSE 200 * pow(1.15, i) END AS thick, 3000 + i / 16 * 3000 AS vs, (3000 + i / 16 * 3000) * sqrt(3) AS vp, 310 * pow((3000 + i / 16 * 3000) * sqrt(3), 0.25) AS rho FROM range(16) r(i)) SELECT p.layer_idx, p.thick, p.vs, p.vp, p.rho, m.vs - p.vs AS away, m.n FROM p JOIN (SELECT layer_idx, avg(vs) AS vs, count(*) AS n FROM l GROUP BY 1) m ON m.layer_idx = p.layer_idx", "thick vs vp rho away", 4)
def _(spark, sf):
    """The geometric prior, and how far the models' mean lies from it, layer by layer."""
    mean = read_layers(spark, sf).groupBy("layer_idx").agg(F.avg("vs").alias("mean"), F.count("*").alias("n"))
    return earth.geometric_prior(spark).join(mean, "layer_idx").withColumn("away", F.col("mean") - F.col("vs")).drop("mean")


_FREQS = [0.005 + 0.002 * i for i in range(8)]


def _fold_sql() -> str:
    """The impedance of each stack carried upward, a layer a step."""
    omega = 2 * np.pi * np.array(_FREQS)
    at = ", ".join(f"({f!r}::DOUBLE, {float(w)!r}::DOUBLE, {float(k)!r}::DOUBLE)" for f, w, k in zip(_FREQS, omega, earth.gravity_wavenumber(omega, 3000.0), strict=True))
    wave = "sqrt(k * k - pow(w / vp, 2)) AS a, sqrt(k * k - pow(w / vs, 2)) AS b, 2 * rho * vs * vs * k AS m, 2 * rho * vs * vs * k * k - rho * w * w AS p, rho * vs * vs * (2 * k * k - pow(w / vs, 2)) AS s"
    return f"""WITH RECURSIVE l0 AS (SELECT l_orderkey AS model_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS layer_idx, l_quantity * 100 AS thick, 1000 + (l_partkey % 40) * 100.0::DOUBLE AS vs FROM lineitem),
ly AS (SELECT *, vs * sqrt(3) AS vp, 310 * pow(vs * sqrt(3), 0.25) AS rho FROM l0), fq(f, w, k) AS (VALUES {at}),
bottom AS (SELECT *, {wave} FROM (SELECT * FROM ly QUALIFY layer_idx = max(layer_idx) OVER (PARTITION BY model_id)), fq),
fold(model_id, f, w, k, layer, z11, z12, z21, z22) AS (
SELECT model_id, f, w, k, layer_idx, (m * a * k - s * a) / (a * b - k * k), (m * a * b - s * k) / (a * b - k * k), (m * b * a - p * k) / (a * b - k * k), (m * b * k - p * b) / (a * b - k * k) FROM bottom
UNION ALL
SELECT model_id, f, w, k, layer_idx, (v11 * u22 - v12 * u21) / (u11 * u22 - u12 * u21), (v12 * u11 - v11 * u12) / (u11 * u22 - u12 * u21), (v21 * u22 - v22 * u21) / (u11 * u22 - u12 * u21), (v22 * u11 - v21 * u12) / (u11 * u22 - u12 * u21) FROM
 (SELECT *, k + k * t11 - b * t21 AS u11, b + k * t12 - b * t22 AS u12, a * t11 - k * t21 - a AS u21, a * t12 - k * t22 - k AS u22, m * a * t11 - s * t21 - m * a AS v11, m * a * t12 - s * t22 - s AS v12, p + p * t11 - m * b * t21 AS v21, m * b + p * t12 - m * b * t22 AS v22 FROM
  (SELECT *, ea * ea * (a22 * b11 - a12 * b21) / d AS t11, ea * eb * (a22 * b12 - a12 * b22) / d AS t12, ea * eb * (a11 * b21 - a21 * b11) / d AS t21, eb * eb * (a11 * b22 - a21 * b12) / d AS t22 FROM
   (SELECT *, a11 * a22 - a12 * a21 AS d FROM
    (SELECT *, m * a - z11 * k - z12 * a AS a11, z11 * b + z12 * k - s AS a12, p - z21 * k - z22 * a AS a21, z21 * b + z22 * k - m * b AS a22, z11 * k - z12 * a + m * a AS b11, z11 * b - z12 * k + s AS b12, z21 * k - z22 * a - p AS b21, z21 * b - z22 * k - m * b AS b22, exp(-a * thick) AS ea, exp(-b * thick) AS eb FROM
     (SELECT fold.*, ly.layer_idx, ly.thick, {wave} FROM fold JOIN ly ON ly.model_id = fold.model_id AND ly.layer_idx = fold.layer - 1))))))
SELECT model_id, f, -k * z11 / (z11 * z22 - z12 * z21) * 1e12 AS compliance FROM fold WHERE layer = 1"""


@query("forward_compliance", _fold_sql(), "compliance", 1)
def _(spark, sf):
    """Compliance (times 1e12) of every order's stack of layers at eight frequencies: impedances carried upward by a fold over the layers."""
    rows = read_layers(spark, sf).withColumn("vp", P.vp_from_vs(F.col("vs"))).withColumn("rho", P.gardner_density(F.col("vs")))
    return earth.folded_compliance(earth.stacks(rows), _FREQS, 3000.0).withColumn("compliance", F.col("compliance") * 1e12)


def _mean_stack(spark, sf):
    """The mean model of all orders, layer by layer: thick and vs as arrays, one row."""
    mean = read_layers(spark, sf).groupBy("layer_idx").agg(F.avg("thick").alias("thick"), F.avg("vs").alias("vs"))
    return mean.agg(F.array_sort(F.collect_list(F.struct("layer_idx", "thick", "vs"))).alias("x")).select(F.col("x.thick").alias("thick"), F.col("x.vs").alias("vs"))


def _observed(spark, sf):
    """What the mean model would answer, with an error of two per cent; chains start four per cent slower."""
    stack = _mean_stack(spark, sf)
    ratio = math.sqrt(3)
    layers = F.zip_with("thick", "vs", lambda h, v: F.struct(h.alias("thick"), (310 * F.pow(v * ratio, 0.25)).alias("rho"), (v * ratio).alias("vp"), v.alias("vs")))
    freqs = np.linspace(0.007, 0.02, 6)
    k = earth.gravity_wavenumber(2 * np.pi * freqs, 3000.0)
    data = F.array(*[earth.stack_compliance(F.col("layers"), F.lit(float(q)), F.lit(float(2 * np.pi * f))) for f, q in zip(freqs, k, strict=True)])
    rows = stack.withColumn("layers", layers).withColumn("data", data)
    return rows.select(F.lit("mean").alias("station"), F.lit(1).alias("seed"), "data", F.array(*map(F.lit, freqs.tolist())).alias("freqs"), F.transform("data", lambda x: x / 50).alias("sigma"), "thick", F.transform("vs", lambda v: v * 0.96).alias("vs"), F.lit(3000.0).alias("water_depth"))


_WEIGHTS = [0.01 * 1000 ** (i / 9) for i in range(10)]


@query("mcmc_chain")
def _(spark, sf):
    """One chain per weight of roughness, as one array of models, in two rounds."""
    chains = inference.lcurve_chains(_observed(spark, sf), _WEIGHTS)
    return inference.invert_rounds(chains, 400, new_folder(spark, "chains"), every=200)


@query("lcurve_of_chains")
def _(spark, sf):
    """The median misfit after burn-in for each weight of roughness, of chains on the mean model's answer."""
    return inference.lcurve(_observed(spark, sf), _WEIGHTS, 1000, new_folder(spark, "chains"), every=500)
