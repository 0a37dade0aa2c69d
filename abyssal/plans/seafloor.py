"""Queries on start models, reference curves, gauge calibration, and what stations share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import calibration, compliance, earth, posterior, profiles
from ..sources.traces import layer_tasks, read_layers
from .registry import query
from .response import BAND, FS, SEGMENT, W, bins, cells, segments
from .series import _edged
from .station import ST, models_of, rasters

_NAMES = ("RR28", "RR29", "RR34", "RR36", "RR38", "RR40", "RR50", "RR52", "A422A")


def stations(spark, sf):
    """Nations stand in for stations, nine names in turn."""
    rows = spark.read.parquet(f"{sf}/nation.parquet")
    return rows.select(F.col("n_nationkey").alias("nation"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.pmod("n_nationkey", F.lit(len(_NAMES))) + 1).cast("int")).alias("station"))


def _values(table: dict) -> str:
    return ", ".join(f"('{name}', {lo}, {hi}, {v}::DOUBLE, {i})" for name, of in table.items() for i, (lo, hi, v) in enumerate(of))


_ST = "st AS (SELECT n_nationkey AS nation, [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][n_nationkey % {len(_NAMES)} + 1] AS station FROM nation)"
_LAID = "SELECT model_id, bin, coalesce(arg_max(v, priority) FILTER (bin >= bin_lo AND bin < bin_hi), 0) AS v FROM sl, range(100) r(bin) GROUP BY 1, 2"


@query("start_profiles", f"WITH {_ST}, sl(model_id, bin_lo, bin_hi, v, priority) AS (VALUES {_values(profiles.START)}), l AS ({_LAID}) SELECT nation, station, bin, v FROM st JOIN l ON model_id = CASE WHEN station IN ({', '.join(repr(k) for k in profiles.START if k != 'other')}) THEN station ELSE 'other' END", "v")
def _(spark, sf):
    return profiles.start_profiles(stations(spark, sf))


@query("family_profiles", f"WITH {_ST}, sl(model_id, bin_lo, bin_hi, v, priority) AS (VALUES {_values(profiles.FAMILY_START)}), l AS ({_LAID}) SELECT nation, station, r.bin, coalesce(v, 0) AS v FROM st JOIN range(100) r(bin) ON true LEFT JOIN l ON l.bin = r.bin AND model_id = CASE WHEN station IN ('RR28', 'RR29', 'RR34') THEN 'sediment' WHEN station IN ('RR36', 'RR38', 'RR40', 'RR50', 'RR52') THEN 'crust' END", "v")
def _(spark, sf):
    return profiles.family_profiles(stations(spark, sf))


_LY = "ly AS (SELECT l_orderkey AS model_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS layer_idx, l_quantity * 100 AS thick, 1000 + (l_partkey % 40) * 100.0::DOUBLE AS vs FROM lineitem)"


@query("reference_residual", f"""WITH {_LY}, sl(model_id, bin_lo, bin_hi, v, priority) AS (VALUES {_values(profiles.REFERENCE)}), ref AS (SELECT model_id, bin, v / sqrt(3) AS v FROM ({_LAID})),
d AS (SELECT *, sum(thick) OVER (PARTITION BY model_id ORDER BY layer_idx) AS bottom FROM ly), e AS (SELECT *, bottom - thick AS top FROM d),
c AS (SELECT model_id, unnest(range(CAST(ceil(top / 100) AS BIGINT), CAST(ceil(bottom / 100) AS BIGINT))) AS cell, vs FROM e),
m AS (SELECT cell, avg(vs) AS vs FROM c WHERE cell < 100 GROUP BY cell)
SELECT ref.model_id AS curve, cell, m.vs, m.vs - ref.v AS residual FROM m JOIN ref ON ref.bin = m.cell""", "vs residual", 5)  # fmt: skip
def _(spark, sf):
    """The mean model at each hundred metres, less the five reference curves."""
    mean = earth.rasterise(read_layers(spark, sf)).where("cell < 100").groupBy("cell").agg(F.avg("vs").alias("vs"))
    ref = profiles.reference_profiles(spark).select(F.col("model_id").alias("curve"), F.col("bin").alias("cell"), "v")
    return mean.join(ref, "cell").select("curve", "cell", "vs", (F.col("vs") - F.col("v")).alias("residual"))


def _override(name: str, at: int) -> str:
    cases = " ".join(f"WHEN u >= {o[0]} AND u < {o[1]} THEN {float(o[at])}::DOUBLE" for o in reversed(profiles.UNDER_SEDIMENT) if o[at] is not None)
    return f"CASE WHEN i = total - 1 THEN {profiles.HALF_SPACE[at - 2]}::DOUBLE {cases} ELSE {name} END AS {name}"


@query("sediment_prior", f"""WITH st AS (SELECT n_nationkey AS model_id, 200.0::DOUBLE AS first, 13 + n_nationkey % 3 AS n_layer, 1.17::DOUBLE AS power, 80.0::DOUBLE + n_nationkey AS sediment, 1 + n_nationkey % 4 AS k FROM nation),
g AS (SELECT *, n_layer + 1 + k AS total, unnest(range(n_layer + 1 + k)) AS i FROM st), h AS (SELECT *, i - k + 1 AS j, i - k AS u, i / greatest(k - 1, 1) AS step, list_sum(list_transform(range(k), lambda q: pow(sediment, q / greatest(k - 1, 1)))) AS share, first * pow(power, i - k + 1) AS x FROM g),
b AS (SELECT *, CASE WHEN i < k THEN sediment * pow(sediment, step) / share ELSE round_even(x / pow(2, floor(log2(x)) - 10), 0) * pow(2, floor(log2(x)) - 10) END AS thick, CASE WHEN i < k THEN 340 * pow(600 / 340, step) ELSE 1200 + j / total * 3000 END AS vs FROM h),
p AS (SELECT *, vs * sqrt(3) AS vp, 310 * pow(vs * sqrt(3), 0.25) AS rho FROM b)
SELECT model_id, CAST(i AS INT) AS layer_idx, {_override('thick', 2)}, {_override('rho', 3)}, {_override('vp', 4)}, {_override('vs', 5)} FROM p""", "thick rho vp vs", 5)  # fmt: skip
def _(spark, sf):
    """Priors with one to four sediment layers over overridden layers; nations stand in for stations."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    k = F.col("n_nationkey")
    models = n.select(k.alias("model_id"), F.lit(200.0).alias("first"), (13 + F.pmod(k, F.lit(3))).alias("n_layer"), F.lit(1.17).alias("power"), (80.0 + k).alias("sediment"), (1 + F.pmod(k, F.lit(4))).alias("n_sediment"))
    return profiles.sediment_prior(models)


@query("gauge_gain", f"""WITH {W}, gx AS (SELECT window_id, k, sqrt(pow(avg(a.hr * b.hr + a.hi * b.hi), 2) + pow(avg(a.hr * b.hi - a.hi * b.hr), 2)) / nullif(avg(b.hr * b.hr + b.hi * b.hi), 0) AS g,
  (pow(avg(a.hr * b.hr + a.hi * b.hi), 2) + pow(avg(a.hr * b.hi - a.hi * b.hr), 2)) / nullif(avg(a.hr * a.hr + a.hi * a.hi) * avg(b.hr * b.hr + b.hi * b.hi), 0) AS coh2
  FROM (SELECT * FROM s3 WHERE component = 'H') a JOIN (SELECT * FROM s3 WHERE component = 'Z') b USING (window_id, seg, k) WHERE k * 0.2 / 32 BETWEEN 0.02 AND 0.07 GROUP BY 1, 2),
gr AS (SELECT g FROM gx WHERE coh2 >= 0.4 * 0.4), gm AS (SELECT median(g) AS m FROM gr), gs AS (SELECT m, 1.4826 * median(abs(g - m)) AS s, count(*) AS n FROM gr, gm GROUP BY m)
SELECT (SELECT median(g) FROM gr, gs WHERE abs(g - m) <= 3 * s) AS gain, s AS deviation, n, (SELECT count(*) FROM gr, gs WHERE abs(g - m) <= 3 * s) AS n_kept FROM gs""", "gain deviation", 5)  # fmt: skip
def _(spark, sf):
    """The gauge's gain against the vertical in the windows of the hourly trace."""
    return calibration.gauge_ratio(segments(spark, sf), "Z", "H", SEGMENT, FS, (0.02, 0.07), 0.4)


# --- posterior products of the models under each station's own threshold -------------------------------------------
#: Thresholds of misfit, a row a station, and iterations of burn-in.
_BURNIN = 500
_GOOD = ST + f", good AS (SELECT sr.* FROM sr JOIN orders ON o_orderkey = model_id WHERE o_orderkey >= {_BURNIN} AND o_totalprice < 100000 + 30000 * station)"
_PRODUCTS = _GOOD + ", pd AS (SELECT station, cell, count(*) AS n, median(vs) AS median, avg(vs) AS mean, stddev_pop(vs) AS std FROM good GROUP BY ALL)"


def accepted(spark, sf):
    """The rasterised layers of the accepted models: models are told before their layers are fetched and cut."""
    tasks = layer_tasks(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    chain = orders.select(F.pmod("o_custkey", F.lit(8)).alias("station"), F.col("o_orderkey").alias("iter"), F.col("o_totalprice").alias("misfit"))
    limits = spark.createDataFrame([(i, 100_000.0 + 30_000 * i) for i in range(8)], "station long, threshold double")
    models = models_of(spark, sf).repartition(tasks, "station", "model_id")
    # a row a station is broadcast
    good = posterior.accepted_profiles(models, chain.repartition(tasks, "station", "iter"), F.broadcast(limits), _BURNIN)
    return rasters(spark, sf, good, tasks)


@query("accepted_products", f"WITH {_PRODUCTS} SELECT * FROM pd", "median mean std", 4)
def _(spark, sf):
    """Median, mean and deviation of each station's accepted profiles."""
    return posterior.station_products(accepted(spark, sf))


@query("accepted_density", f"WITH {_GOOD}, b AS (SELECT station, cell, CAST(least(floor(vs / 50), 99) AS BIGINT) AS bin, count(*) AS n FROM good WHERE vs BETWEEN 0 AND 5000 GROUP BY ALL) SELECT station, cell, bin, n, n / max(n) OVER (PARTITION BY station, cell) AS p FROM b", "p")
def _(spark, sf):
    """The density of each station's accepted profiles."""
    return posterior.density(accepted(spark, sf), "station", "cell")


@query("accepted_serpentinisation", f"WITH {_PRODUCTS} SELECT station, cell, median, least((9000 - 2 * median) / 30, 100) AS percent, least((9000 - 2 * median) / 30, 100) - std / 50 AS lo, least((9000 - 2 * median) / 30, 100) + std / 50 AS hi FROM pd", "median percent lo hi", 4)
def _(spark, sf):
    m = posterior.station_products(accepted(spark, sf))
    percent, band = P.serpentinised(F.col("median")), F.col("std") / 50
    return m.select("station", "cell", "median", percent.alias("percent"), (percent - band).alias("lo"), (percent + band).alias("hi"))


@query("accepted_with_curves", f"WITH {_PRODUCTS}, sl(model_id, bin_lo, bin_hi, v, priority) AS (VALUES {_values(profiles.REFERENCE)}), ref AS ({_LAID}), sa(model_id, bin_lo, bin_hi, v, priority) AS (VALUES {_values(profiles.START)}), sb AS ({_LAID.replace('FROM sl', 'FROM sa')}) SELECT station, cell, n, median, mean, sb.v AS start, ref.model_id AS curve, ref.v / sqrt(3) AS v FROM pd LEFT JOIN sb ON sb.bin = cell AND sb.model_id = [{', '.join(repr(x) for x in _NAMES[:8])}][station + 1] LEFT JOIN ref ON ref.bin = cell", "median mean start v", 4)
def _(spark, sf):
    """Each station's accepted median and mean over its start and the five reference curves."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(_NAMES[:8])], "nation long, station string")
    starts = profiles.start_profiles(names).select(F.col("nation").alias("station"), F.col("bin").alias("cell"), F.col("v").alias("start"))
    curves = profiles.reference_profiles(spark).select(F.col("model_id").alias("curve"), F.col("bin").alias("cell"), "v")
    rows = posterior.station_products(accepted(spark, sf))
    return posterior.with_curves(rows, curves, starts).select("station", "cell", "n", "median", "mean", "start", "curve", "v")


@query("accepted_against_prior", f"WITH {_GOOD}, sa(model_id, bin_lo, bin_hi, v, priority) AS (VALUES {_values(profiles.START)}), sb AS ({_LAID.replace('FROM sl', 'FROM sa')}), st2 AS (SELECT model_id, avg(v) AS v0 FROM sb WHERE bin < 60 GROUP BY 1), m AS (SELECT station, model_id, avg(vs) AS vs FROM good GROUP BY ALL) SELECT m.station, m.model_id, CASE WHEN vs < v0 THEN 'red' ELSE 'green' END AS class FROM m JOIN st2 ON st2.model_id = [{', '.join(repr(x) for x in _NAMES[:8])}][station + 1]")
def _(spark, sf):
    """Accepted models slower or faster than the mean of their station's start."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(_NAMES[:8])], "nation long, station string")
    start = profiles.start_profiles(names).where("bin < 60").groupBy(F.col("nation").alias("station")).agg(F.avg("v").alias("v0"))
    m = accepted(spark, sf).groupBy("station", "model_id").agg(F.avg("vs").alias("vs"))
    return m.join(start, "station").select("station", "model_id", F.when(F.col("vs") < F.col("v0"), "red").otherwise("green").alias("class"))


@query("band_series", f"""WITH {W}, bs AS (SELECT window_id AS seq, {{'acceleration': median(dz * pow(2 * pi() * f, 4)), 'pressure': median(dp), 'coherence': median(coh)}} AS x FROM ci GROUP BY 1),
bt AS (SELECT 'acceleration' AS component, seq, x.acceleration AS v FROM bs UNION ALL SELECT 'pressure', seq, x.pressure FROM bs UNION ALL SELECT 'coherence', seq, x.coherence FROM bs), {_edged('bt')},
w3 AS (SELECT seq, 10 * log10(max(smooth) FILTER (component = 'acceleration')) AS acceleration, 10 * log10(max(smooth) FILTER (component = 'pressure')) AS pressure, max(smooth) FILTER (component = 'coherence') AS coherence FROM sm GROUP BY 1)
SELECT seq AS window_id, acceleration, pressure, coherence, CASE WHEN coherence > 0.35 THEN 'good' ELSE 'bad' END AS class FROM w3""", "acceleration pressure coherence", 5)  # fmt: skip
def _(spark, sf):
    """Per window the smoothed band medians of acceleration, pressure and coherence, side by side, with their class."""
    inside = compliance.in_slice(cells(spark, sf), bins(spark), *BAND)
    return compliance.band_series(inside).withColumn("class", F.when(F.col("coherence") > 0.35, "good").otherwise("bad"))
