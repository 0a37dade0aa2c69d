"""Compliance from samples: segments inside windows, selection of windows on coherence and levels, both versions of the response."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compliance as C
from ..operators import spectral
from ..sources.shared import staged
from .registry import query
from .series import T, trace

#: Windows of 128 values every 64, seven segments of 32 in each; the hourly trace is read as if at 0.2 Hz, in 3000 m of water.
SIZE, STEP, SEGMENT, HOP, FS, DEPTH = 128, 64, 32, 16, 0.2, 3000.0
BAND, OUT = (0.02, 0.07), (0.005, 0.08)


def segments(spark, sf):
    return C.window_segments(trace(spark, sf), SIZE, STEP, SEGMENT, HOP)


def cells(spark, sf):
    return staged(C.window_cells(segments(spark, sf), "Z", "H", SEGMENT, FS, C.taper_share(2 / 3, FS, SEGMENT)), "cells")


def bins(spark):
    return spark.range(SEGMENT // 2 + 1).select(F.col("id").alias("k"), (F.col("id") * FS / SEGMENT).alias("f"))


_SCALE = "CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / (0.2::DOUBLE * {})"
_HANN, _TUKEY = (repr(spectral.window_power(x, SEGMENT)) + "::DOUBLE" for x in ("hann", "tukey"))
W = (
    T
    + f""", w0 AS (SELECT component, seq, v, unnest(range(CAST(greatest(0, ceil((seq - 127) / 64)) AS BIGINT), seq // 64 + 1)) AS window_id FROM t),
w1 AS (SELECT *, seq - window_id * 64 AS n FROM w0 QUALIFY count(*) OVER (PARTITION BY component, window_id) = 128),
s1 AS (SELECT component, window_id, seg, n - seg * 16 AS m, v - avg(v) OVER (PARTITION BY component, window_id, seg) AS x FROM w1, range(7) r(seg) WHERE n - seg * 16 BETWEEN 0 AND 31),
s2 AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * m / 32)) AS xh, x * CASE WHEN least(m, 31 - m) < 3.875 THEN 0.5 * (1 - cos(pi() * least(m, 31 - m) / 3.875)) ELSE 1 END AS xt FROM s1),
s3 AS (SELECT component, window_id, seg, k, sum(xh * cos(2 * pi() * ((k * m) % 32) / 32)) AS hr, -sum(xh * sin(2 * pi() * ((k * m) % 32) / 32)) AS hi, sum(xt * cos(2 * pi() * ((k * m) % 32) / 32)) AS tr, -sum(xt * sin(2 * pi() * ((k * m) % 32) / 32)) AS ti FROM s2, range(17) r(k) GROUP BY ALL),
wp AS (SELECT component, window_id, k, k * 0.2 / 32 AS f, median((tr * tr + ti * ti) * {_SCALE.format(_TUKEY)}) / (1 + 1 / 3 - 1 / 2 + 1 / 5 - 1 / 4 + 1 / 7 - 1 / 6) AS p, avg((hr * hr + hi * hi) * {_SCALE.format(_HANN)}) AS pm FROM s3 GROUP BY ALL),
wc AS (SELECT window_id, k, avg(a.tr * b.tr + a.ti * b.ti) * {_SCALE.format(_TUKEY)} AS csd, sqrt((pow(avg(a.tr * b.tr + a.ti * b.ti), 2) + pow(avg(a.tr * b.ti - a.ti * b.tr), 2)) / nullif(avg(a.tr * a.tr + a.ti * a.ti) * avg(b.tr * b.tr + b.ti * b.ti), 0)) AS coh
  FROM (SELECT * FROM s3 WHERE component = 'H') a JOIN (SELECT * FROM s3 WHERE component = 'Z') b USING (window_id, seg, k) GROUP BY window_id, k),
cl AS (SELECT z.window_id, z.k, z.f, coh, z.p AS dz, h.p AS dp, csd FROM (SELECT * FROM wp WHERE component = 'Z') z JOIN (SELECT * FROM wp WHERE component = 'H') h USING (window_id, k) JOIN wc USING (window_id, k)),
bn AS (SELECT k, k * 0.2 / 32 AS f FROM range(17) r(k)),
b1 AS (SELECT arg_min(k, {{'a': abs(f - 0.02), 'k': k}}) AS k1, arg_min(k, {{'a': abs(f - 0.07), 'k': k}}) AS k2, arg_min(k, {{'a': abs(f - 0.03), 'k': k}}) AS n1, arg_min(k, {{'a': abs(f - 0.05), 'k': k}}) AS n2 FROM bn),
ci AS (SELECT cl.* FROM cl, b1 WHERE k >= k1 AND k < k2)"""
)
_GRAV = "(pi() * 6.6743e-11 / 9.8 * (1 + exp(-2 * wn * 3000)))"
K = """kx AS (SELECT k, f, pow(2 * pi() * f, 2) / 9.79329 AS w2g, pow(2 * pi() * f, 2) / 9.79329 * 3000 AS x FROM bn WHERE f > 0 AND f BETWEEN 0.005 AND 0.08),
kw AS (SELECT k, CASE WHEN x > 2.96 THEN w2g ELSE sqrt(CASE WHEN 27 - 9 * x > 0 THEN 54 * x / (27 - 9 * x + sqrt(pow(27 - 9 * x, 2) + 108 * x)) ELSE (sqrt(pow(27 - 9 * x, 2) + 108 * x) - (27 - 9 * x)) / 2 END) / 3000 END AS wn, pow(2 * pi() * f, 2) / (pow(2 * pi() * f, 2) + 3.07e-5) AS ad FROM kx)"""
_V1 = "v1 AS (SELECT window_id FROM cl GROUP BY 1 HAVING median(coh) FILTER (f BETWEEN 0.02 AND 0.07) > 0.3 AND avg(coh) FILTER (f BETWEEN 0.03 AND 0.08) > 0.3 AND avg(dp) FILTER (f BETWEEN 0.03 AND 0.08) > 100 AND avg(dp) FILTER (f BETWEEN 0.03 AND 0.08) < 20000 AND avg(dz) FILTER (f BETWEEN 0.03 AND 0.08) > 1e-16 AND avg(dz) FILTER (f BETWEEN sqrt(9.8 / (2 * pi() * 2 * 3000)) AND sqrt(9.8 / (2 * pi() * 0.5 * 3000))) < 1e6)"
_V2 = """q1 AS (SELECT window_id FROM ci GROUP BY 1 HAVING median(coh) > 0.33 AND avg(coh) > 0.35),
v2 AS (SELECT window_id FROM cl SEMI JOIN q1 USING (window_id), b1 GROUP BY 1 HAVING min(coh) FILTER (k >= k1 AND k < k2) > 0.08 AND 10 * log10(median(dp) FILTER (k >= k1 AND k < k2)) BETWEEN 20.0000001 AND 40.9999999 AND 10 * log10(median(dp) FILTER (k >= n1 AND k < n2)) < 50 AND avg(10 * log10(dz * pow(2 * pi() * f, 4))) FILTER (k >= k1 AND k < k2) BETWEEN 0.0000001 AND 16.9999999)"""
_SUM = "SELECT k, f, count(*) AS n, median(c) AS median, avg(c) AS mean, stddev_pop(c) AS std, max(c) - min(c) AS range, max(c * sqrt(1 - coh * coh) / (abs(coh) * sqrt(2 * {}))) FILTER (window_id = (SELECT min(window_id) FROM cc)) AS theory FROM cc GROUP BY k, f"


def _v1(c):
    return C.select_v1(c, DEPTH, BAND, median=0.3, mean=0.3, dp=(100, 20000), dz_most=1e6)


def _v2(spark, c):
    first = C.select_v2_coherence(c, bins(spark), BAND, 0.33, 0.35)
    return C.select_v2_levels(c.join(first, "window_id", "left_semi"), bins(spark), BAND, 0.08, (20, 41), motion=(0, 17))


@query("window_spectra", f"WITH {W} SELECT component, window_id, k, f, pm AS p FROM wp", "f p", 4)
def _(spark, sf):
    """Welch's mean of the segments inside each window."""
    return C.window_psd(segments(spark, sf), SEGMENT, FS, "mean", "hann").select("component", "window_id", "k", "f", "p")


@query("window_psd_median", f"WITH {W} SELECT component, window_id, k, p FROM wp", "p", 4)
def _(spark, sf):
    """The median of tapered (Tukey) segments inside each window, less its bias."""
    return C.window_psd(segments(spark, sf), SEGMENT, FS).select("component", "window_id", "k", "p")


@query("coherogram", f"WITH {W} SELECT window_id, k, k * 0.2 / 32 AS f, coh FROM wc", "f coh")
def _(spark, sf):
    return C.window_coherence(segments(spark, sf), [("H", "Z")], SEGMENT, FS).select("window_id", "k", "f", "coh")


@query("coherogram_stages", f"""WITH {W}, st(stage, m) AS (VALUES (0, 1.0), (1, 0.5), (2, 0.0)),
sz AS (SELECT stage, z.window_id, z.seg, z.k, z.tr - m * o.tr AS tr, z.ti - m * o.ti AS ti FROM (SELECT * FROM s3 WHERE component = 'Z') z JOIN (SELECT * FROM s3 WHERE component = '1') o USING (window_id, seg, k), st)
SELECT stage, window_id, k, sqrt((pow(avg(a.tr * b.tr + a.ti * b.ti), 2) + pow(avg(a.tr * b.ti - a.ti * b.tr), 2)) / nullif(avg(a.tr * a.tr + a.ti * a.ti) * avg(b.tr * b.tr + b.ti * b.ti), 0)) AS coh FROM (SELECT * FROM s3 WHERE component = 'H') a JOIN sz b USING (window_id, seg, k) WHERE k BETWEEN 1 AND 15 GROUP BY stage, window_id, k""", "coh", 5)  # fmt: skip
def _(spark, sf):
    """Stages of cleaning of the vertical (less all, half and none of a horizontal) against the one pressure trace."""
    t = trace(spark, sf).where(F.col("component").isin("Z", "1", "H"))
    wide = t.groupBy("seq").pivot("component", ["Z", "1", "H"]).agg(F.first("v"))
    stages = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), v.alias("v")) for n, v in (("0", F.col("Z") - F.col("1")), ("1", F.col("Z") - 0.5 * F.col("1")), ("2", F.col("Z")), ("H", F.col("H")))])).alias("x")
    rows = wide.select("seq", stages).select("seq", "x.component", "x.v").where("v is not null")
    seg = C.window_segments(rows, SIZE, STEP, SEGMENT, HOP)
    coh = C.window_coherence(seg, [("H", "0"), ("H", "1"), ("H", "2")], SEGMENT, FS).where("k between 1 and 15")
    return coh.select(F.col("y").cast("int").alias("stage"), "window_id", "k", "coh")


@query("band_slice", f"WITH {W} SELECT DISTINCT k, f FROM ci", "f")
def _(spark, sf):
    """The bins of the windows' cells that the band takes."""
    own = cells(spark, sf).select("k", "f").distinct()
    return C.in_slice(own, own, *BAND)


@query("coherence_classes", f"WITH {W} SELECT window_id, CASE WHEN avg(coh) > 0.39 THEN 'high' WHEN avg(coh) < 0.39 THEN 'low' END AS class FROM ci GROUP BY 1")
def _(spark, sf):
    return C.split_by_coherence(cells(spark, sf), bins(spark), BAND, 0.39)


@query("coherence_class_means", f"WITH {W}, c AS (SELECT window_id, CASE WHEN avg(coh) > 0.39 THEN 'high' WHEN avg(coh) < 0.39 THEN 'low' END AS class FROM ci GROUP BY 1) SELECT 'all' AS class, k, avg(coh) AS coh FROM cl GROUP BY k UNION ALL SELECT class, k, avg(coh) FROM cl JOIN c USING (window_id) WHERE class = 'high' GROUP BY class, k", "coh")
def _(spark, sf):
    """Mean coherence of all windows and of those with a high one."""
    c = cells(spark, sf)
    high = c.join(C.split_by_coherence(c, bins(spark), BAND, 0.39).where("class = 'high'"), "window_id")
    both = c.withColumn("class", F.lit("all")).select("class", "k", "coh").unionByName(high.select("class", "k", "coh"))
    return both.groupBy("class", "k").agg(F.avg("coh").alias("coh"))


@query("window_classes", f"WITH {W} SELECT window_id, CASE WHEN 10 * log10(median(dz * pow(2 * pi() * f, 4))) > 13.37 AND 10 * log10(median(dp)) > 37.5 AND median(coh) > 0.34 THEN 'good' ELSE 'bad' END AS class FROM ci GROUP BY 1")
def _(spark, sf):
    return C.label_windows(cells(spark, sf), bins(spark), BAND, 13.37, 37.5, 0.34)


@query("window_selection_v1", f"WITH {W}, {_V1} SELECT window_id FROM v1")
def _(spark, sf):
    return _v1(cells(spark, sf))


@query("window_selection_v2", f"WITH {W}, {_V2} SELECT window_id FROM v2")
def _(spark, sf):
    return _v2(spark, cells(spark, sf))


@query("compliance_pipeline_v1", f"WITH {W}, {_V1}, {K}, cc AS (SELECT window_id, k, f, coh, wn * coh * ad * ({_GRAV} + sqrt(dz) / (sqrt(dp) * 0.66)) * 1000 AS c FROM cl SEMI JOIN v1 USING (window_id) JOIN kw USING (k)) {_SUM.format(25)}", "f median mean std range theory", 5)
def _(spark, sf):
    """From samples to compliance, first version: selection, response with gain, uncertainties."""
    c = cells(spark, sf)
    curves = C.compliance(c, _v1(c), DEPTH, OUT, 1).withColumn("c", F.col("c") * 1000)
    return C.summary(curves, C.number_of_averages(SIZE, SEGMENT))


@query("compliance_pipeline_v2", f"WITH {W}, {_V2}, {K}, cc AS (SELECT window_id, k, f, coh, wn * coh * ad * ({_GRAV} + sqrt(dz) / sqrt(dp * 0.66 * 0.66)) * 1000 AS c FROM cl SEMI JOIN v2 USING (window_id) JOIN kw USING (k)) {_SUM.format(25)}", "f median mean std range theory", 5)
def _(spark, sf):
    """From samples to compliance, second version: coherence first, then levels of the windows left."""
    c = cells(spark, sf)
    curves = C.compliance(c, _v2(spark, c), DEPTH, OUT, 2).withColumn("c", F.col("c") * 1000)
    return C.summary(curves, C.number_of_averages(SIZE, SEGMENT))


@query("compliance_rms_windows", f"WITH {W}, {K}, cc AS (SELECT window_id, k, f, coh, wn * coh * ad * ({_GRAV} + sqrt(dz) / sqrt(dp * 0.66 * 0.66)) AS c FROM ci JOIN kw USING (k)), r0 AS (SELECT sqrt(avg(m * m)) AS r0 FROM (SELECT median(c) AS m FROM cc GROUP BY k)), r AS (SELECT window_id, sqrt(avg(c * c)) AS r, median(coh) AS a, avg(coh) AS b FROM cc GROUP BY 1) SELECT window_id FROM r, r0 WHERE r > r0 * 0.6 AND r < r0 * 1.4 AND a > 0.3 AND a < 1 AND b > 0.3 AND b < 1")
def _(spark, sf):
    c = cells(spark, sf)
    return C.optimise_rms(C.compliance(c, c.select("window_id").distinct(), DEPTH, OUT, 2), bins(spark), BAND, 40, 0.3, 0.3)


@query("admittance_cross", f"WITH {W}, {K} SELECT window_id, k, wn * csd / dp * 0.66 * 1000 AS admittance FROM cl JOIN kw USING (k)", "admittance", 5)
def _(spark, sf):
    """The admittance from the real part of the cross spectrum."""
    from ..functions import physics as P

    rows = cells(spark, sf).where(F.col("f").between(*OUT) & (F.col("f") > 0))
    return rows.select("window_id", "k", (P.admittance(P.wavenumber(F.col("f"), F.lit(DEPTH)), F.col("csd"), F.col("dp"), 0.66) * 1000).alias("admittance"))


@query("first_window", f"WITH {W}, {_V2} SELECT window_id, k, coh FROM cl WHERE window_id = (SELECT min(window_id) FROM v2)", "coh")
def _(spark, sf):
    """The cells of the first accepted window."""
    c = cells(spark, sf)
    return C.first_window(c.join(_v2(spark, c), "window_id", "left_semi")).select("window_id", "k", "coh")


@query("spectrogram_rows", f"WITH {W} SELECT component, window_id, CAST(k AS INT) AS k, pm AS p FROM wp WHERE component = 'Z' AND k = 10 OR component = 'H' AND k = 5", "p", 4)
def _(spark, sf):
    """Two bins of the spectrograms as series over the windows."""
    p = C.window_psd(segments(spark, sf), SEGMENT, FS, "mean", "hann")
    return p.where("component = 'Z' and k = 10 or component = 'H' and k = 5").select("component", "window_id", F.col("k").cast("int").alias("k"), "p")


@query("window_averages", f"WITH {T} SELECT component, size, segment, CAST(trunc((size - trunc(0.9 * segment)) / (segment - trunc(0.9 * segment))) AS BIGINT) AS n FROM (SELECT component, count(*) AS size FROM t GROUP BY 1), (VALUES (512), (128), (32)) g(segment)")
def _(spark, sf):
    """Segments of a channel's whole trace at an overlap of nine tenths."""
    sizes = trace(spark, sf).groupBy("component").agg(F.count("*").alias("size"))
    rows = sizes.select("component", "size", F.explode(F.array(*map(F.lit, (512, 128, 32)))).alias("segment"))
    return rows.withColumn("n", C.averages(F.col("size"), F.col("segment")))
