"""Every registered query against its SQL, and analytic fixtures of the operators behind them."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal import catalog
from abyssal.functions import physics as P
from abyssal.operators import clean, earth, inference, posterior, quality, spectral, windows
from abyssal.sources import traces
from abyssal.streaming import windows as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{x:.8g}") + 0.0 if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = [sorted((tuple(map(plain, r)) for r in d[cols].itertuples(index=False, name=None)), key=repr) for d in (got, want)]
        assert rows[0] == rows[1]
    else:
        assert len(got)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["station", "k", "f", "p"]
    assert set(e.oracle_sql()) <= set(e.queries())


def wave(spark, x, n=64, component="Z"):
    return spark.createDataFrame([(component, i, x[i : i + n].tolist()) for i in range(0, len(x), n)], "component string, window_id long, data array<double>")


def test_sine_has_one_peak_and_white_noise_its_level(spark):
    n = np.arange(640)
    p = spectral.welch(spectral.periodogram(spectral.fourier(wave(spark, np.sin(2 * np.pi * 8 * n / 64)), 64), 64)).toPandas().set_index("k").p
    assert p.idxmax() == 8 and p.drop([7, 8, 9]).max() < 1e-9 * p.max()
    x = np.random.default_rng(1).normal(0, 3, 64 * 400)
    p = spectral.welch(spectral.periodogram(spectral.fourier_long(wave(spark, x), 64), 64, fs=2.0)).toPandas().set_index("k").p.sort_index()
    assert abs(p[4:30].mean() / (2 * 9 / 2.0) - 1) < 0.05


@pytest.mark.parametrize("kind", ["none", "hann", "hanning", "tukey"])
def test_both_transforms_agree_with_numpy(spark, kind):
    x = np.random.default_rng(2).normal(size=128)
    a, b = (f(wave(spark, x), 64, kind).orderBy("window_id", "k").toPandas() for f in (spectral.fourier, spectral.fourier_long))
    assert np.allclose(a[["re", "im"]], b[["re", "im"]], atol=1e-9)
    if kind == "none":
        assert np.allclose(a.re[:33] + 1j * a.im[:33], np.fft.rfft(x[:64] - x[:64].mean()), atol=1e-9)


def test_coherence_and_transfer_of_scaled_channel(spark):
    x = np.random.default_rng(3).normal(size=640)
    f = spectral.fourier(wave(spark, x, component="H").unionByName(wave(spark, 2 * x)), 64)
    t = spectral.transfer(spectral.cross(f, [("H", "Z")], 64)).where("k > 0").toPandas()
    assert np.allclose(t.coh2, 1) and np.allclose(t.gain_db, 20 * math.log10(2)) and np.allclose(t.phase_deg, 0, atol=1e-6)


def test_median_bias(spark):
    p = spark.createDataFrame([("a", i, 1, 0.1, float(i)) for i in range(1, 8)], "station string, w int, k int, f double, p double")
    assert abs(spectral.welch(p, "station", average="median").first().p - 4 / spectral.median_bias(7)) < 1e-12


def test_dispersion(spark):
    rows = spark.createDataFrame([(f / 1000, h) for f in range(0, 60, 3) for h in (100.0, 3000.0, 6000.0)], "f double, h double")
    for f, h, k, approx in rows.select("f", "h", P.wavenumber_exact(F.col("f"), F.col("h")), P.wavenumber(F.col("f"), F.col("h"))).collect():
        w2 = (2 * math.pi * f) ** 2
        assert abs(w2 - traces.G_DISPERSION * k * math.tanh(k * h)) < 1e-9 and abs(approx - k) <= 0.02 * k


def test_compliance_of_half_space_and_split_layers(spark):
    w = 2 * np.pi * np.array([0.01])
    k = w / math.sqrt(traces.G_DISPERSION * 100)
    rho, vp, vs = 2700.0, 5000.0, 2900.0
    mu = rho * vs**2
    lam = rho * vp**2 - 2 * mu
    one = earth.compliance(w, k, *map(np.array, ([1.0], [rho], [vp], [vs])))
    assert abs(one[0] / ((lam + 2 * mu) / (2 * mu * (lam + mu))) - 1) < 1e-3
    stack = lambda t: earth.compliance(w, k, np.array([*t, 1.0]), np.array([2500.0] * len(t) + [rho]), np.array([4500.0] * len(t) + [vp]), np.array([2200.0] * len(t) + [vs]))
    assert abs(stack([1000.0])[0] / stack([400.0, 600.0])[0] - 1) < 1e-9
    m = spark.createDataFrame([(1, [(1.0, rho, vp, vs)]), (2, [])], "model_id int, layers array<struct<thick:double,rho:double,vp:double,vs:double>>")
    assert earth.forward_compliance(m, [0.01], 100.0).count() == 2


def test_windows(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(i, "Z", t0 + dt.timedelta(seconds=60 * i), float(i)) for i in range(181)], "sample_id long, component string, ts timestamp, v double")
    assert [r.n for r in windows.tumbling(s, 3600).groupBy("window_id").agg(F.count("*").alias("n")).orderBy("window_id").collect()] == [60, 60, 60]
    assert [r.n for r in windows.sliding(s, 3600, 1800).groupBy("window_id").agg(F.count("*").alias("n")).orderBy("window_id").collect()] == [61] * 5
    with pytest.raises(ValueError):
        windows.sliding(s, 60, 0)
    assert windows.buckets_with_gap(s.withColumn("ts", F.col("ts") + F.expr("interval 500 milliseconds") * (F.col("sample_id") % 2)), 60).count() < 181
    one = spark.createDataFrame([("Z", 0, 1.0), ("Z", 4, 9.0)], "component string, seq long, v double")
    assert [r.v for r in windows.fill_gaps(one).orderBy("seq").collect()] == [1, 3, 5, 7, 9]
    bad = spark.createDataFrame([("Z", i, v) for i, v in enumerate([9.0, 1.0, 9.0, 9.0, 2.0, 3.0])], "component string, seq long, v double")
    assert [r.v for r in windows.fill_outliers(bad, 5).orderBy("seq").collect()] == [3, 1, 1, 1, 2, 3]


def test_exclusion_equals_brute_force(spark):
    t0, rng = dt.datetime(2024, 1, 1), np.random.default_rng(4)
    spans = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 400_000, 30), rng.integers(1, 90_000, 30), strict=True)]
    at = lambda x: t0 + dt.timedelta(seconds=int(x))
    samples = rng.integers(0, 500_000, 500).tolist()
    s = spark.createDataFrame([(i, at(x), 1.0) for i, x in enumerate(samples)], "sample_id long, ts timestamp, v double")
    sp = clean.merge_spans(spark.createDataFrame([(at(a), at(b)) for a, b in spans], "t_start timestamp, t_end timestamp"))
    want = {i for i, x in enumerate(samples) if not any(a <= x <= b for a, b in spans)}
    assert {r.sample_id for r in clean.exclude(s, sp).collect()} == want
    assert {r.sample_id for r in clean.exclude(s, sp, zero=True).where("v <> 0").collect()} == want


def test_posterior_bins_and_serpentinisation(spark):
    b = spark.createDataFrame([(0.0,), (4999.9,), (5000.0,), (5000.1,), (-1.0,)], "v double").select(posterior.bucket(F.col("v"), 0, 5000, 100).alias("b")).collect()
    assert [r.b for r in b] == [0, 99, 99, None, None]
    assert [r[0] for r in spark.createDataFrame([(4500.0,), (3000.0,), (2000.0,)], "m double").select(P.serpentinised(F.col("m"))).collect()] == [0, 100, 100]


def test_good_and_bad(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None)], "window_id int, x double")
    assert [r["class"] for r in quality.label(d, F.col("x") > 1).orderBy("window_id").collect()] == ["good", "bad"]


def test_chain_repeats_and_keeps_bounds():
    thick, vs, f = np.array([500.0, 800, 10_000]), np.array([2500.0, 3500, 4300]), np.linspace(0.008, 0.02, 5)
    w = 2 * np.pi * f
    d = earth.compliance(w, earth.gravity_wavenumber(w, 2000.0), thick, 310 * (vs * math.sqrt(3)) ** 0.25, vs * math.sqrt(3), vs)
    for policy in ("reflect", "redraw"):
        a, b = ([(i, m, ok, v.tolist(), h.sum()) for i, m, _, ok, h, v in inference.run_chain(1, d, f, d / 50, thick, vs, 2000.0, 300, policy=policy)] for _ in range(2))
        assert a == b and any(x[2] for x in a)
        assert all(0.5 * s <= x <= 1.1 * s + 1e-9 for r in a for x, s in zip(r[3], vs, strict=True)) and all(abs(r[4] - thick.sum()) < 1e-6 for r in a)


def test_streaming_gaps_and_windows_as_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("Z", t0 + dt.timedelta(minutes=m), 1.0) for m in (0, 5, 9, 40, 45)], "component string, ts timestamp, v double")
    assert sorted(r.n for r in stream.gaps(s).collect()) == [2, 3]
    assert stream.windowed_stats(s, "1 hour", "30 minutes").count() == 3


def test_models_of_a_batch_are_those_one_by_one(spark):
    rng = np.random.default_rng(9)
    models = [(i, [(float(t), 2500.0 + 10 * i, float(v) * 1.7, float(v)) for t, v in zip(rng.uniform(100, 3000, 2 + i % 4), rng.uniform(500, 4000, 2 + i % 4))]) for i in range(40)] + [(40, [])]
    freqs = [0.006, 0.01, 0.02]
    d = spark.createDataFrame(models, "model_id long, layers array<struct<thick:double,rho:double,vp:double,vs:double>>")
    got = {(r.model_id, r.f): r.compliance for r in earth.forward_compliance(d, freqs, 3000.0).collect()}
    omega = 2 * np.pi * np.array(freqs)
    k = earth.gravity_wavenumber(omega, 3000.0)
    for i, layers in models[:-1]:
        one = earth.compliance(omega, k, *np.array(layers).T)
        assert np.allclose([got[i, f] for f in freqs], one, rtol=1e-9)
    assert all(np.isnan(got[40, f]) for f in freqs)


def test_spans_that_reach_over_many_slots_are_one(spark):
    rng = np.random.default_rng(10)
    spans = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 3_000_000, 300), rng.choice([50, 4000, 400_000], 300, p=[0.6, 0.35, 0.05]))]
    want = []
    for a, b in sorted(spans):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    d = spark.createDataFrame(spans, "a long, b long").select(F.timestamp_seconds("a").alias("t_start"), F.timestamp_seconds("b").alias("t_end"))
    for hours in (1, 24, 24 * 30):
        got = clean.merge_spans(d, hours=hours).select(F.unix_seconds("t_start"), F.unix_seconds("t_end")).collect()
        assert sorted(map(list, got)) == want


def test_selection_of_windows_at_the_edges(spark):
    from abyssal.operators import compliance

    bins = spark.createDataFrame([(k, k / 10) for k in range(6)], "k long, f double")
    assert tuple(compliance.nearest_slice(bins, 0.15, 0.41).first()) == (1, 4)  # the lower of two
    rows = [(w, k, k / 10, c, 1.0, 1.0, 0.0) for w, c in ((1, 0.95), (2, 0.9), (3, 0.8), (4, None)) for k in range(6)]
    cells = spark.createDataFrame(rows, "window_id long, k long, f double, coh double, dz double, dp double, csd double")
    assert {r.window_id: r["class"] for r in compliance.split_by_coherence(cells, bins, (0.1, 0.4), 0.9).collect()} == {1: "high", 2: None, 3: "low", 4: None}
    assert [r.window_id for r in compliance.select_v2_coherence(cells, bins, (0.1, 0.4)).collect()] == [1]
    assert {r.window_id: r["class"] for r in compliance.label_windows(cells, bins, (0.1, 0.4), -100, -1, 0.8).collect()} == {1: "good", 2: "good", 3: "bad", 4: "bad"}


def test_empty_streams_and_files_by_station(spark, tmp_path):
    none = traces.empty_samples(spark)
    assert none.count() == 0 and windows.hourly(none).count() == 0
    assert windows.tumbling(none, 3600).count() == 0 and clean.exclude(none, clean.merge_spans(none.select(F.col("ts").alias("t_start"), F.col("ts").alias("t_end"))), zero=True).count() == 0
    rows = spark.createDataFrame([("A", "Z", 1.0), ("A", "H", 2.0), ("B", "Z", 3.0)], "station string, component string, v double")
    traces.save_by_station(rows, f"{tmp_path}/out", "station", "component")
    back = spark.read.parquet(f"{tmp_path}/out").where("station = 'A'")
    assert sorted((r.component, r.v) for r in back.collect()) == [("H", 2.0), ("Z", 1.0)]
    bands = quality.band_measures("p", "f", 0.1, 0.2)
    got = spark.createDataFrame([(0.1, 1.0), (0.2, 4.0), (0.3, 9.0)], "f double, p double").agg(*[v.alias(k) for k, v in bands.items()]).first()
    assert (got["median"], got["mean"], got["least"]) == (2.5, 2.5, 1.0)
