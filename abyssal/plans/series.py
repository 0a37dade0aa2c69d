"""Queries on traces: windows, filling, cleaning, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import clean, posterior, quality, rotation, spectral, transients, windows
from ..sources.traces import read_samples, read_segments
from .registry import query

# --- SQL building blocks -------------------------------------------------------------------------------
S = "s AS (SELECT event_id AS sample_id, CASE event_type WHEN 'click' THEN 'Z' WHEN 'view' THEN 'H' WHEN 'purchase' THEN '1' WHEN 'signup' THEN '2' WHEN 'error' THEN 'E' END AS component, ts, value AS v FROM events)"
H = S + ", h AS (SELECT component, CAST(floor((floor(epoch(ts)) - 1704067200) / 3600) AS BIGINT) AS seq, avg(v) AS v FROM s GROUP BY ALL)"
T = (
    H
    + """, g AS (SELECT component, unnest(range(min(seq), max(seq) + 1)) AS seq FROM h GROUP BY component),
fw AS (SELECT component, seq, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS s0, first_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS s1
  FROM g LEFT JOIN h USING (component, seq) WINDOW b AS (PARTITION BY component ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY component ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT component, seq, coalesce(v, v0 + (v1 - v0) * (seq - s0) / nullif(s1 - s0, 0)) AS v FROM fw)"""
)
SG = (
    T
    + """, c0 AS (SELECT component, seq, v, unnest(range(CAST(greatest(0, ceil((seq - 63) / 32)) AS BIGINT), seq // 32 + 1)) AS window_id FROM t),
c AS (SELECT *, seq - window_id * 32 AS n FROM c0 QUALIFY count(*) OVER (PARTITION BY component, window_id) = 64),
d AS (SELECT component, window_id, n, (v - avg(v) OVER (PARTITION BY component, window_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS x FROM c),
ft AS (SELECT component, window_id, k, sum(x * cos(2 * pi() * ((k * n) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((k * n) % 64) / 64)) AS im FROM d, range(33) r(k) GROUP BY ALL)"""
)
EM = """e AS (SELECT label AS station, vec_id AS window_id, n, CAST(embedding[n + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(n)),
ed AS (SELECT station, window_id, n, (v - avg(v) OVER (PARTITION BY window_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS x FROM e),
ef AS (SELECT station, window_id, k, sum(x * cos(2 * pi() * ((k * n) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((k * n) % 64) / 64)) AS im FROM ed, range(33) r(k) GROUP BY ALL),
ep AS (SELECT station, window_id, k, k / 64 AS f, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 24 AS p FROM ef)"""
CR = (
    SG
    + """, pr(x, y) AS (VALUES ('H', 'Z'), ('1', 'Z'), ('2', 'Z'), ('1', '2')),
cr AS (SELECT x, y, a.k, avg(a.re * a.re + a.im * a.im) AS pxx, avg(b.re * b.re + b.im * b.im) AS pyy, avg(a.re * b.re + a.im * b.im) AS re, avg(a.re * b.im - a.im * b.re) AS im
  FROM pr JOIN ft a ON a.component = x JOIN ft b ON b.component = y AND a.window_id = b.window_id AND a.k = b.k GROUP BY ALL),
cs AS (SELECT x, y, k, k / 64 AS f, pxx * z AS pxx, pyy * z AS pyy, re * z AS re, im * z AS im, coh2 FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 24 AS z, (re * re + im * im) / nullif(pxx * pyy, 0) AS coh2 FROM cr))"""
)
#: Places of a block: the hours of a day.
DAY = 24
PAIRS = [("H", "Z"), ("1", "Z"), ("2", "Z"), ("1", "2")]


def trace(spark, sf):
    return windows.fill_gaps(windows.hourly(read_samples(spark, sf)), DAY)


def segments(spark, sf):
    return windows.cut(trace(spark, sf), 64, 32)


def power(spark, sf):
    return spectral.periodogram(spectral.fourier(read_segments(spark, sf), 64), 64)


def crossed(spark, sf):
    return spectral.cross(spectral.fourier(segments(spark, sf), 64), PAIRS, 64)


@query("select_component", f"WITH {S} SELECT sample_id, v FROM s WHERE component = 'Z'")
def _(spark, sf):
    return read_samples(spark, sf).where("component = 'Z'").select("sample_id", "v")


@query("slice_inclusive", f"WITH {S} SELECT component, count(*) AS n FROM s WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' GROUP BY component")
def _(spark, sf):
    return read_samples(spark, sf).where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-06").cast("timestamp"))).groupBy("component").agg(F.count("*").alias("n"))


@query("trim_common", f"WITH {S}, p AS (SELECT * FROM s WHERE component IN ('Z', 'H', '1', '2')), e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(ts) AS a, max(ts) AS b FROM p GROUP BY component)) SELECT sample_id, component, v FROM p, e WHERE ts BETWEEN a AND b")
def _(spark, sf):
    return windows.trim_common(read_samples(spark, sf), ["Z", "H", "1", "2"]).select("sample_id", "component", "v")


@query("tumbling_complete", f"WITH {S}, e AS (SELECT min(epoch(ts)) AS t0, max(epoch(ts)) AS t1 FROM s) SELECT CAST(floor((epoch(ts) - t0) / 86400) AS BIGINT) AS window_id, count(*) AS n, avg(v) AS mean FROM s, e WHERE t0 + (floor((epoch(ts) - t0) / 86400) + 1) * 86400 <= t1 GROUP BY 1", "mean", 8)
def _(spark, sf):
    return windows.tumbling(read_samples(spark, sf), 86400).groupBy("window_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


@query("sliding_overlap", f"WITH {S}, e AS (SELECT min(epoch(ts)) AS t0, max(epoch(ts)) AS t1 FROM s), w AS (SELECT v, unnest(range(CAST(greatest(0, ceil((epoch(ts) - t0 - 7200) / 3600)) AS BIGINT), CAST(least(floor((t1 - t0 - 7200) / 3600), floor((epoch(ts) - t0) / 3600)) AS BIGINT) + 1)) AS window_id FROM s, e) SELECT window_id, count(*) AS n, sqrt(avg(v * v)) AS rms FROM w GROUP BY 1", "rms")
def _(spark, sf):
    return windows.sliding(read_samples(spark, sf), 7200, 3600).groupBy("window_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


@query("count_windows", f"WITH {T} SELECT component, CAST(1 + (count(*) - 64) // 32 AS BIGINT) AS full_count, CAST((count(*) - 32) // 32 AS BIGINT) AS short_count FROM t GROUP BY component")
def _(spark, sf):
    n = trace(spark, sf).groupBy("component").agg(F.count("*").alias("n"))
    return n.select("component", windows.count_windows(F.col("n"), 64, 32).alias("full_count"), windows.count_windows(F.col("n"), 64, 32, True).alias("short_count"))


@query("window_matrix", "SELECT vec_id AS window_id, seg, CAST(embedding[seg * 16 + 1] AS DOUBLE) AS first, CAST(embedding[seg * 16 + 32] AS DOUBLE) AS last FROM embeddings, range(3) r(seg)")
def _(spark, sf):
    return windows.matrix(read_segments(spark, sf), 32, 16).select("window_id", "seg", F.element_at("data", 1).alias("first"), F.element_at("data", -1).alias("last"))


@query("split_save_bucket", f"WITH {S}, e AS (SELECT min(epoch(ts)) AS t0 FROM s) SELECT CAST(floor((epoch(ts) - t0) / 601) AS BIGINT) AS bucket, count(*) AS n FROM s, e WHERE (epoch(ts) - t0) - 601 * floor((epoch(ts) - t0) / 601) <= 600 GROUP BY 1")
def _(spark, sf):
    return windows.buckets_with_gap(read_samples(spark, sf), 600).groupBy("bucket").agg(F.count("*").alias("n"))


@query("merge_newest", f"WITH {S} SELECT component, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, max_by(v, sample_id) AS v FROM s GROUP BY ALL")
def _(spark, sf):
    rows = read_samples(spark, sf).withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    return windows.newest(rows, "component", "hour", by="sample_id")


@query("gap_interpolate", f"WITH {T} SELECT * FROM t", "v", 8)
def _(spark, sf):
    return trace(spark, sf)


@query("detrend_line", "SELECT vec_id AS window_id, n, CAST(embedding[n + 1] AS DOUBLE) - CAST(embedding[1] AS DOUBLE) - (CAST(embedding[64] AS DOUBLE) - CAST(embedding[1] AS DOUBLE)) / 63 * n AS x FROM embeddings, range(64) r(n)", "x", 8)
def _(spark, sf):
    return read_segments(spark, sf).select("window_id", F.posexplode(windows.detrend_line(F.col("data"))).alias("n", "x"))


@query("detrend_mean", f"WITH {EM} SELECT window_id, n, v - avg(v) OVER (PARTITION BY window_id) AS x FROM e", "x", 8)
def _(spark, sf):
    return read_segments(spark, sf).select("window_id", F.posexplode(windows.detrend_mean(F.col("data"))).alias("n", "x"))


@query("fir_decimate", f"WITH {T} SELECT component, seq, y AS v FROM (SELECT component, seq, 0.1 * lag(v, 2) OVER w + 0.2 * lag(v, 1) OVER w + 0.4 * v + 0.2 * lead(v, 1) OVER w + 0.1 * lead(v, 2) OVER w AS y FROM t WINDOW w AS (PARTITION BY component ORDER BY seq)) WHERE seq % 5 = 0 AND y IS NOT NULL", "v", 8)
def _(spark, sf):
    return windows.decimate(trace(spark, sf), [0.1, 0.2, 0.4, 0.2, 0.1], 5, DAY)


#: Ten minutes between places, in seconds, and the blocks of a day.
_TEN, _TEN_DAY = 600, 144
_TT = T.replace("/ 3600) AS BIGINT) AS seq", f"/ {_TEN}) AS BIGINT) AS seq")


def _fir(stage: int, every: int, of: str) -> str:
    """SQL of one stage: every place's sum over taps, where all of them are there."""
    taps = windows.lowpass(every)
    rows = ", ".join(f"({i - len(taps) // 2}, {t!r}::DOUBLE)" for i, t in enumerate(taps))
    return f"p{stage}(j, c) AS (VALUES {rows}), f{stage} AS (SELECT a.component, a.seq // {every} AS seq, sum(b.v * c) AS v FROM {of} a JOIN p{stage} ON true JOIN {of} b ON b.component = a.component AND b.seq = a.seq + j WHERE a.seq % {every} = 0 GROUP BY ALL HAVING count(*) = {len(taps)})"


@query("decimate_by_fifty", f"WITH {_TT}, {_fir(1, 5, 't')}, {_fir(2, 5, 'f1')}, {_fir(3, 2, 'f2')} SELECT component, seq * 50 AS seq, v FROM f3", "v", 6)
def _(spark, sf):
    """Three stages of low-pass and decimation, 5, 5 and 2, on means of ten minutes."""
    s = read_samples(spark, sf)
    ten = s.groupBy("component", F.floor((F.unix_seconds("ts") - 1_704_067_200) / _TEN).alias("seq")).agg(F.avg("v").alias("v"))
    return windows.decimate_chain(windows.fill_gaps(ten, _TEN_DAY), block=_TEN_DAY)


@query("tukey_hann_taper", "SELECT vec_id AS window_id, n, v * CASE WHEN least(n, 63 - n) < 7.875 THEN 0.5 * (1 - cos(pi() * least(n, 63 - n) / 7.875)) ELSE 1 END AS tukey, v * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS hanning, v * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS hann FROM (SELECT vec_id, n, CAST(embedding[n + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(n))", "tukey hanning hann")
def _(spark, sf):
    """Every segment under each of the three tapers."""
    n, v = F.col("n"), F.col("v")
    rows = read_segments(spark, sf).select("window_id", F.posexplode("data").alias("n", "v"))
    return rows.select("window_id", "n", (v * P.tukey(n, 64, 0.25)).alias("tukey"), (v * P.hann(n, 64)).alias("hanning"), (v * P.hann(n, 64, True)).alias("hann"))


@query("spectrogram", f"WITH {SG} SELECT component, window_id, (32 + window_id * 32) AS t_mid, k, k / 64 AS f, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 24 AS p FROM ft", "f p")
def _(spark, sf):
    p = spectral.periodogram(spectral.fourier(segments(spark, sf), 64), 64)
    return p.select("component", "window_id", (32 + F.col("window_id") * 32).alias("t_mid"), "k", "f", "p")


@query("welch_psd_mean", f"WITH {SG} SELECT component, k, k / 64 AS f, avg((re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 24) AS p FROM ft GROUP BY ALL", "f p")
def _(spark, sf):
    return spectral.welch(spectral.periodogram(spectral.fourier(segments(spark, sf), 64), 64), "component")


@query("welch_psd_median", f"WITH {EM}, m AS (SELECT station, k, f, median(p) AS m, count(*) AS n FROM ep GROUP BY ALL) SELECT station, k, f, m / (1 + coalesce((SELECT sum(1 / (2 * i + 1) - 1 / (2 * i)) FROM range(1, (n - 1) // 2 + 1) r(i)), 0)) AS p FROM m", "f p", 8)
def _(spark, sf):
    return spectral.welch(power(spark, sf), "station", average="median")


@query("welch_psd_fft", f"WITH {EM} SELECT station, k, f, avg(p) AS p FROM ep GROUP BY ALL", "f p", 8)
def _(spark, sf):
    """The long-segment back end: numpy's FFT in Arrow batches."""
    return spectral.welch(spectral.periodogram(spectral.fourier_long(read_segments(spark, sf), 64), 64), "station")


@query("psd_db_accel", f"WITH {EM} SELECT station, k, 10 * log10(avg(p)) AS db, 10 * log10(avg(p) * pow(2 * pi() * k / 64, 4)) AS accel_db FROM ep WHERE k >= 1 GROUP BY station, k", "db accel_db", 5)
def _(spark, sf):
    w = spectral.welch(power(spark, sf).where("k >= 1"), "station")
    return w.select("station", "k", P.decibel(F.col("p")).alias("db"), P.decibel(P.acceleration(F.col("p"), F.col("f"))).alias("accel_db"))


@query("coherence_pairs", f"WITH {CR} SELECT x, y, k, coh2, sqrt(coh2) AS coh FROM cs", "coh2 coh")
def _(spark, sf):
    return crossed(spark, sf).select("x", "y", "k", "coh2", F.sqrt("coh2").alias("coh"))


@query("cross_spectrum", f"WITH {CR} SELECT x, y, k, f, pxx, pyy, re, im FROM cs", "f pxx pyy re im", 5)
def _(spark, sf):
    return crossed(spark, sf).drop("coh2")


@query("transfer_function", f"WITH {CR} SELECT x, y, k, 20 * log10(sqrt(re * re + im * im) / pxx) AS gain_db, degrees(atan2(im, re)) AS phase_deg FROM cs WHERE k BETWEEN 1 AND 31", "gain_db phase_deg", 4)
def _(spark, sf):
    return spectral.transfer(crossed(spark, sf)).where("k between 1 and 31").select("x", "y", "k", "gain_db", "phase_deg")


@query("nearest_bin", f"WITH {EM} SELECT arg_min(k, {{'a': abs(f - 0.1), 'k': k}}) AS k FROM ep")
def _(spark, sf):
    """The bin of the stations' spectra that lies nearest to a frequency."""
    return spectral.nearest_bin(power(spark, sf).select("k", "f").distinct(), 0.1)


@query("coherence_split", f"WITH {EM} SELECT window_id, CASE WHEN avg(p) > 0.02 THEN 'high' WHEN avg(p) < 0.02 THEN 'low' END AS class FROM ep WHERE f BETWEEN 0.1 AND 0.3 GROUP BY window_id")
def _(spark, sf):
    m = power(spark, sf).where(F.col("f").between(0.1, 0.3)).groupBy("window_id").agg(F.avg("p").alias("m"))
    return m.select("window_id", F.when(F.col("m") > 0.02, "high").when(F.col("m") < 0.02, "low").alias("class"))


@query("window_qc_v1", f"WITH {EM} SELECT window_id FROM ep GROUP BY window_id HAVING median(p) FILTER (f BETWEEN 0.1 AND 0.3) > 0.005 AND avg(p) FILTER (f BETWEEN 0.05 AND 0.4) > 0.01 AND avg(p) FILTER (f BETWEEN 0.05 AND 0.4) < 0.05")
def _(spark, sf):
    p = power(spark, sf)
    a, b = quality.band("p", "f", 0.1, 0.3), quality.band("p", "f", 0.05, 0.4)
    return quality.keep(p, {"m": F.median(a), "a": F.avg(b)}, (F.col("m") > 0.005) & (F.col("a") > 0.01) & (F.col("a") < 0.05)).select("window_id").distinct()


@query("window_qc_v2", f"WITH {EM}, one AS (SELECT window_id FROM ep WHERE f BETWEEN 0.1 AND 0.3 GROUP BY 1 HAVING median(p) > 0.004 AND avg(p) > 0.01) SELECT window_id, 10 * log10(median(p)) AS db FROM ep SEMI JOIN one USING (window_id) WHERE f BETWEEN 0.1 AND 0.3 GROUP BY 1 HAVING min(p) > 0.00001 AND 10 * log10(median(p)) BETWEEN -24 AND -10", "db")
def _(spark, sf):
    p = power(spark, sf).where(F.col("f").between(0.1, 0.3))
    first = quality.keep(p, {"m": F.median("p"), "a": F.avg("p")}, (F.col("m") > 0.004) & (F.col("a") > 0.01))
    return first.groupBy("window_id").agg(P.decibel(F.median("p")).alias("db"), F.min("p").alias("least")).where((F.col("least") > 0.00001) & F.col("db").between(-24, -10)).select("window_id", "db")


@query("good_bad_windows", f"WITH {EM} SELECT window_id, CASE WHEN 10 * log10(median(p * pow(2 * pi() * f, 4))) > -17 AND 10 * log10(median(p)) > -20 THEN 'good' ELSE 'bad' END AS class FROM ep WHERE f BETWEEN 0.1 AND 0.3 GROUP BY 1")
def _(spark, sf):
    p = power(spark, sf).where(F.col("f").between(0.1, 0.3)).groupBy("window_id").agg(P.decibel(F.median(P.acceleration(F.col("p"), F.col("f")))).alias("z"), P.decibel(F.median("p")).alias("h"))
    return quality.label(p, (F.col("z") > -17) & (F.col("h") > -20)).select("window_id", "class")


@query("optimizer", f"WITH {EM} SELECT window_id FROM ep GROUP BY 1 HAVING avg(p) FILTER (f BETWEEN 0.1 AND 0.2) > 0.012 AND avg(p) FILTER (f BETWEEN 0.3 AND 0.4) < 0.02 AND min(p) FILTER (f BETWEEN 0.1 AND 0.2) > 0.0001")
def _(spark, sf):
    p = power(spark, sf).withColumnRenamed("p", "coh")
    return quality.optimise(p, 0.012, 0.02, 0.0001, 0.1, 0.2, 0.3, 0.4).select("window_id").distinct()


@query("optimizer_rms", f"WITH {EM}, b AS (SELECT * FROM ep WHERE f BETWEEN 0.1 AND 0.3), r0 AS (SELECT sqrt(avg(m * m)) AS r0 FROM (SELECT median(p) AS m FROM b GROUP BY k)), r AS (SELECT window_id, sqrt(avg(p * p)) AS r FROM b GROUP BY 1) SELECT window_id FROM r, r0 WHERE r > r0 * 0.2 AND r < r0 * 1.8")
def _(spark, sf):
    return quality.optimise_rms(power(spark, sf), "p", 0.1, 0.3, 80).select("window_id").distinct()


@query("psd_energy_gate", f"WITH {EM}, ok AS (SELECT window_id FROM ep WHERE f BETWEEN 0.05 AND 0.2 GROUP BY 1 HAVING median(p) > 0.004 AND median(p) < 0.02) SELECT k, median(p) AS p, count(*) AS n FROM ep SEMI JOIN ok USING (window_id) GROUP BY k", "p", 8)
def _(spark, sf):
    p = power(spark, sf)
    m = F.median(quality.band("p", "f", 0.05, 0.2))
    return quality.keep(p, {"m": m}, (F.col("m") > 0.004) & (F.col("m") < 0.02)).groupBy("k").agg(F.median("p").alias("p"), F.count("*").alias("n"))


@query("badband_interp", f"WITH {EM}, m AS (SELECT station, k, f, avg(p) AS p FROM ep GROUP BY ALL), w AS (SELECT *, last_value(CASE WHEN NOT f BETWEEN 0.2 AND 0.25 THEN p END IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN NOT f BETWEEN 0.2 AND 0.25 THEN p END IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN NOT f BETWEEN 0.2 AND 0.25 THEN k END IGNORE NULLS) OVER b AS k0, first_value(CASE WHEN NOT f BETWEEN 0.2 AND 0.25 THEN k END IGNORE NULLS) OVER a AS k1 FROM m WINDOW b AS (PARTITION BY station ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY station ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT station, k, CASE WHEN f BETWEEN 0.2 AND 0.25 THEN v0 + (v1 - v0) * (k - k0) / (k1 - k0) ELSE p END AS p FROM w", "p", 8)
def _(spark, sf):
    return spectral.interpolate_band(spectral.welch(power(spark, sf), "station"), 0.2, 0.25, "station").select("station", "k", "p")


@query("stage_compare", f"WITH {EM}, m AS (SELECT station, k, avg(p) AS raw, avg(p) FILTER (window_id % 2 = 0) AS half FROM ep GROUP BY ALL) SELECT station, k, raw, half FROM m", "raw half", 8)
def _(spark, sf):
    p = power(spark, sf)
    both = p.withColumn("stage", F.lit("raw")).unionByName(p.where("window_id % 2 = 0").withColumn("stage", F.lit("half")))
    return both.groupBy("station", "k").pivot("stage", ["raw", "half"]).agg(F.avg("p"))


@query("savgol_smooth", f"WITH {T} SELECT component, seq, CASE WHEN count(v) OVER w = 10 THEN avg(v) OVER w END AS smooth FROM t WINDOW w AS (PARTITION BY component ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)", "smooth", 8)
def _(spark, sf):
    return windows.smooth(trace(spark, sf), block=DAY).select("component", "seq", "smooth")


#: SQL of a smoothed column of ``of`` (component, seq, v): moving mean, and lines at the ends.
def _edged(of: str) -> str:
    return f"""e0 AS (SELECT component, min(seq) AS a, max(seq) AS b FROM {of} GROUP BY 1),
e1 AS (SELECT component, regr_slope(v, seq) FILTER (seq < a + 10) AS ma, regr_intercept(v, seq) FILTER (seq < a + 10) AS ca, count(*) FILTER (seq < a + 10) AS na, regr_slope(v, seq) FILTER (seq > b - 10) AS mb, regr_intercept(v, seq) FILTER (seq > b - 10) AS cb, count(*) FILTER (seq > b - 10) AS nb FROM {of} JOIN e0 USING (component) GROUP BY 1),
e2 AS (SELECT component, seq, CASE WHEN count(v) OVER w = 10 THEN avg(v) OVER w END AS s FROM {of} WINDOW w AS (PARTITION BY component ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)),
sm AS (SELECT component, seq, CASE WHEN seq < a + 5 THEN CASE WHEN na = 10 THEN ca + ma * seq END WHEN seq > b - 5 THEN CASE WHEN nb = 10 THEN cb + mb * seq END ELSE s END AS smooth FROM e2 JOIN e0 USING (component) JOIN e1 USING (component))"""


@query("savgol_edges", f"WITH {T}, {_edged('t')} SELECT component, seq, smooth FROM sm", "smooth", 8)
def _(spark, sf):
    """The moving mean with a line at either end of the trace."""
    return windows.smooth(trace(spark, sf), block=DAY, edges=True).select("component", "seq", "smooth")


@query("transients_removed")
def _(spark, sf):
    """A daily shape of a period near 24 hours, timed on every channel's trace and taken off."""
    t = trace(spark, sf)
    spec = t.groupBy("component").agg(F.lit(24.1).alias("period"), F.lit(12.0).alias("reference"))
    return transients.remove(t, transients.timing(t, spec, 1.0, reach=2, rounds=2), 1.0)


@query("outlier_ffill", f"WITH {T} SELECT component, seq, coalesce(last_value(CASE WHEN v <= 60 THEN v END IGNORE NULLS) OVER (PARTITION BY component ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), last_value(v) OVER (PARTITION BY component ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM t", "v", 8)
def _(spark, sf):
    return windows.fill_outliers(trace(spark, sf), 60, DAY)


@query("azimuth_normalise", f"WITH {T} SELECT component, seq, abs(v - 50) AS angle, fmod(fmod(CASE WHEN v - 50 < 0 THEN v * 4 + 180 ELSE v * 4 END, 360) + 360, 360) AS azimuth FROM t", "angle azimuth", 8)
def _(spark, sf):
    angle, azimuth = windows.normalise_azimuth(F.col("v") - 50, F.col("v") * 4)
    return trace(spark, sf).select("component", "seq", angle.alias("angle"), azimuth.alias("azimuth"))


@query("variance_ratio", f"WITH {T} SELECT component, var_pop(v) / nullif(var_pop(v - 0.5 * p), 0) AS ratio, log10(var_pop(v) / nullif(var_pop(v - 0.5 * p), 0) + 10) AS colour FROM (SELECT component, v, lag(v) OVER (PARTITION BY component ORDER BY seq) AS p FROM t) WHERE p IS NOT NULL GROUP BY component", "ratio colour")
def _(spark, sf):
    from pyspark.sql import Window

    d = trace(spark, sf).withColumn("p", F.lag("v").over(Window.partitionBy("component").orderBy("seq"))).where("p is not null")
    r = d.groupBy("component").agg((F.var_pop("v") / F.nullif(F.var_pop(F.col("v") - 0.5 * F.col("p")), F.lit(0.0))).alias("ratio"))
    return r.withColumn("colour", F.log10(F.col("ratio") + 10))


_SPANS = f"{S}, cat AS (SELECT ts AS t_start, ts + to_microseconds(CAST((v - 80) * 60 * 1000000 AS BIGINT)) AS t_end FROM s WHERE component = 'E' AND v >= 80), mk AS (SELECT *, max(t_end) OVER (ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cat), isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_start > reach THEN 1 ELSE 0 END) OVER (ORDER BY t_start, t_end) AS island FROM mk), sp AS (SELECT min(t_start) AS t_start, max(t_end) AS t_end FROM isl GROUP BY island)"


def _spans(spark, sf):
    e = read_samples(spark, sf).where("component = 'E'").select("ts", F.col("v").alias("magnitude"))
    return clean.spans_from_events(e, 80, 60)


@query("span_merge", f"WITH {_SPANS} SELECT count(*) AS n, sum(epoch(t_end) - epoch(t_start)) AS seconds FROM sp", "seconds", 1)
def _(spark, sf):
    return _spans(spark, sf).agg(F.count("*").alias("n"), F.sum((F.unix_micros("t_end") - F.unix_micros("t_start")) / 1e6).alias("seconds"))


@query("interval_exclude_drop", f"WITH {_SPANS} SELECT sample_id FROM s WHERE NOT EXISTS (SELECT 1 FROM sp WHERE s.ts BETWEEN t_start AND t_end)")
def _(spark, sf):
    return clean.exclude(read_samples(spark, sf), _spans(spark, sf)).select("sample_id")


@query("interval_exclude_zero", f"WITH {_SPANS} SELECT sample_id, CASE WHEN EXISTS (SELECT 1 FROM sp WHERE s.ts BETWEEN t_start AND t_end) THEN 0 ELSE v END AS v FROM s")
def _(spark, sf):
    return clean.exclude(read_samples(spark, sf), _spans(spark, sf), zero=True).select("sample_id", "v")


@query("periodic_stack_remove", f"WITH {T} SELECT component, seq, v - avg(v) OVER (PARTITION BY component, seq % 24) AS clean FROM t", "clean", 8)
def _(spark, sf):
    return clean.remove_periodic(trace(spark, sf), 24).select("component", "seq", "clean")


def _wide(spark, sf):
    t = trace(spark, sf).withColumn("day", F.floor(F.col("seq") / 24))
    return t.groupBy("day", "seq").pivot("component", ["Z", "1", "2"]).agg(F.first("v")).where("`Z` is not null and `1` is not null and `2` is not null").select("day", "seq", F.col("Z").alias("z"), F.col("1").alias("a"), F.col("2").alias("b"))


def _plain(spark, sf):
    return _wide(spark, sf).drop("day")


@query("tilt_fit", f"WITH {T}, w AS (SELECT seq // 24 AS day, seq, max(v) FILTER (component = 'Z') AS z, max(v) FILTER (component = '1') AS a, max(v) FILTER (component = '2') AS b FROM t GROUP BY 1, 2 HAVING z IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), m AS (SELECT day, var_pop(z) AS zz, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(z, a) AS za, covar_pop(z, b) AS zb FROM w GROUP BY day), c AS (SELECT *, (za * bb - zb * ab) / nullif(aa * bb - ab * ab, 0) AS b1, (zb * aa - za * ab) / nullif(aa * bb - ab * ab, 0) AS b2 FROM m) SELECT day, b1, b2, degrees(atan2(b2, b1)) AS azimuth, degrees(atan(sqrt(b1 * b1 + b2 * b2))) AS angle, zz / nullif(zz - b1 * za - b2 * zb, 0) AS variance_ratio FROM c", "b1 b2 azimuth angle variance_ratio", 5)
def _(spark, sf):
    return clean.tilt(_wide(spark, sf), "z", "a", "b", "day")


_ROTATION = f"""WITH {T}, w AS (SELECT seq, max(v) FILTER (component = 'Z') AS z, max(v) FILTER (component = '1') AS a, max(v) FILTER (component = '2') AS b FROM t GROUP BY 1 HAVING z IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
o AS (SELECT *, unnest([seq // 24, seq // 24 - 1]) AS window_id FROM w),
m AS (SELECT window_id, count(*) AS n, var_pop(z) AS zz, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(z, a) AS za, covar_pop(z, b) AS zb FROM o GROUP BY 1),
c AS (SELECT *, (za * bb - zb * ab) / nullif(aa * bb - ab * ab, 0) AS b1, (zb * aa - za * ab) / nullif(aa * bb - ab * ab, 0) AS b2 FROM m),
r AS (SELECT window_id, n, CASE WHEN n < 24 THEN 'too few values' WHEN b1 IS NULL OR aa * bb - ab * ab < 1e-12 * aa * bb THEN 'singular' END AS error, b1, b2, zz, za, zb FROM c)"""


@query("rotation_windows", _ROTATION + " SELECT window_id, n, error, CASE WHEN error IS NULL THEN degrees(atan2(b2, b1)) END AS azimuth, CASE WHEN error IS NULL THEN degrees(atan(sqrt(b1 * b1 + b2 * b2))) END AS angle, CASE WHEN error IS NULL THEN zz * (1 + b1 * b1 + b2 * b2) / nullif(zz - b1 * za - b2 * zb, 0) END AS variance_ratio FROM r", "azimuth angle variance_ratio", 5)
def _(spark, sf):
    """The tilt of every window of two days, a day apart, and what its removal does to the vertical's variance."""
    return rotation.tilt_windows(_plain(spark, sf), "z", ("a", "b"), 2 * DAY).select("window_id", "n", "error", "azimuth", "angle", "variance_ratio")


@query("rotate_in_time", _ROTATION + ", x AS (SELECT seq, 0.5 - 0.5 * cos(2 * pi() * (seq - window_id * 24 + 0.5) / 48) AS g, CASE WHEN error IS NULL THEN (z - b1 * a - b2 * b) / sqrt(1 + b1 * b1 + b2 * b2) ELSE z END AS v FROM o JOIN r USING (window_id)) SELECT seq, sum(g * v) / sum(g) AS z FROM x GROUP BY seq", "z", 5)
def _(spark, sf):
    """The vertical with each window's tilt turned back, windows faded into each other."""
    return rotation.rotated(_plain(spark, sf), "z", ("a", "b"), 2 * DAY)


@query("clean_in_time")
def _(spark, sf):
    """Rotation, then what is coherent with the horizontals taken off in turn, in time."""
    wide = _plain(spark, sf)
    turned = rotation.rotated(wide, "z", ("a", "b"), 2 * DAY)
    return rotation.cleaned(turned.join(wide.drop("z"), "seq"), "z", ("a", "b"), 4 * DAY, DAY)


@query("coherent_noise_remove", f"WITH {SG}, q AS (SELECT z.window_id, z.k, z.re AS zr, z.im AS zi, h.re AS hr, h.im AS hi FROM ft z JOIN ft h USING (window_id, k) WHERE z.component = 'Z' AND h.component = '1'), m AS (SELECT k, avg(hr * hr + hi * hi) AS p, avg(hr * zr + hi * zi) AS re, avg(hr * zi - hi * zr) AS im FROM q GROUP BY k) SELECT window_id, k, zr - (re * hr - im * hi) / nullif(p, 0) AS z_re, zi - (re * hi + im * hr) / nullif(p, 0) AS z_im FROM q JOIN m USING (k) WHERE k BETWEEN 1 AND 31", "z_re z_im", 4)
def _(spark, sf):
    f = spectral.fourier(segments(spark, sf), 64).where("k between 1 and 31 and component in ('Z', '1')")
    wide = f.groupBy("window_id", "k").agg(*[F.max(F.when(F.col("component") == c, F.col(x))).alias(f"{n}_{x}") for c, n in (("Z", "z"), ("1", "h")) for x in ("re", "im")])
    return clean.remove_coherent(wide.where("z_re is not null and h_re is not null"), "z", "h", "k").select("window_id", "k", "z_re", "z_im")


@query("acf", f"WITH {T}, d AS (SELECT component, seq, v - avg(v) OVER (PARTITION BY component) AS d FROM t), z AS (SELECT component, sum(d * d) AS c0 FROM d GROUP BY 1) SELECT a.component, lag, sum(a.d * b.d) / any_value(c0) AS acf FROM d a, range(25) r(lag) JOIN d b ON b.component = a.component AND b.seq = a.seq + lag JOIN z ON z.component = a.component GROUP BY 1, 2", "acf")
def _(spark, sf):
    return posterior.acf(trace(spark, sf), 24)


@query("neff", f"WITH {T}, d AS (SELECT component, seq, v - avg(v) OVER (PARTITION BY component) AS d FROM t), z AS (SELECT component, sum(d * d) AS c0, count(*) AS n FROM d GROUP BY 1), c AS (SELECT a.component, lag, any_value(n) AS n, sum(a.d * b.d) / any_value(c0) AS acf FROM d a, range(25) r(lag) JOIN d b ON b.component = a.component AND b.seq = a.seq + lag JOIN z ON z.component = a.component GROUP BY 1, 2) SELECT component, any_value(n) / (1 + 2 * coalesce(sum(CASE WHEN acf + nx > 0 THEN acf END), 0)) AS neff FROM (SELECT *, lead(acf) OVER (PARTITION BY component ORDER BY lag) AS nx FROM c) GROUP BY component", "neff", 4)
def _(spark, sf):
    """The effective size by the first day's lags and the trace's own length; ``neff_all_lags`` takes every lag."""
    t = trace(spark, sf)
    n = t.groupBy("component").agg(F.count("*").alias("n"))
    return posterior.effective_size(posterior.acf(t, 24).join(n, "component"), F.first("n"))


@query("overlap_hist", f"WITH {S}, w AS (SELECT min(epoch(ts)) AS t FROM s GROUP BY component, floor(epoch(ts) / 3600)), e AS (SELECT min(t) AS lo, max(t) AS hi FROM w) SELECT CAST(least(floor((t - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM w, e GROUP BY 1")
def _(spark, sf):
    starts = read_samples(spark, sf).groupBy("component", F.floor(F.unix_seconds("ts") / 3600).alias("h")).agg(F.min(F.unix_micros("ts") / 1e6).alias("t")).withColumn("all", F.lit(1))
    return posterior.ranged_histogram(starts, "all", "t", 50).select("bin", "n")


@query("union_traces", f"WITH {S} SELECT stage, count(*) AS n, sum(v) AS total FROM (SELECT 'first' AS stage, v FROM s WHERE component = 'Z' UNION ALL SELECT 'second', v FROM s WHERE component = 'H') GROUP BY 1", "total", 4)
def _(spark, sf):
    s = read_samples(spark, sf)
    both = s.where("component = 'Z'").withColumn("stage", F.lit("first")).unionByName(s.where("component = 'H'").withColumn("stage", F.lit("second")))
    return both.groupBy("stage").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
