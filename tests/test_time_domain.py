"""Rotation, cleaning, scans, decimation and autocorrelation on traces with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.operators import posterior, rotation, windows


def wide(spark, n, **channels):
    rows = list(zip(range(n), *(map(float, x) for x in channels.values()), strict=True))
    return spark.createDataFrame(rows, "seq long, " + ", ".join(f"{c} double" for c in channels)).withColumn("station", F.lit("A")).repartition(3)


def column(df, name="z"):
    return np.array([r[name] for r in df.orderBy("seq").collect()])


def test_a_planted_tilt_is_turned_back(spark):
    rng = np.random.default_rng(1)
    n = 4000
    a, b, z = rng.normal(size=n) * 30, rng.normal(size=n) * 20, rng.normal(size=n)
    tilt = np.where(np.arange(n) < 2000, 0.05, 0.08)  # the tilt changes
    d = wide(spark, n, z=z + tilt * a - 0.02 * b, a=a, b=b)
    out = column(rotation.rotated(d, "z", ("a", "b"), 400, "station"))
    noise = tilt * a - 0.02 * b
    away = np.abs(np.arange(n) - 2000) > 400
    assert np.std((out - z)[away]) < 0.1 * np.std(noise) and np.std(noise) > 1
    w = {r.window_id: r for r in rotation.tilt_windows(d, "z", ("a", "b"), 400, "station").collect()}
    assert w[3].error is None and abs(w[3].angle - np.degrees(np.arctan(np.hypot(0.05, 0.02)))) < 0.4 and w[3].variance_ratio > 2
    assert w[-1].n == 200 and w[-1].error is None


def test_windows_rejoin_without_seams(spark):
    """Nothing to correct: the trace comes back, and at the borders of windows as well as between them."""
    x = np.cumsum(np.random.default_rng(2).normal(size=999))
    d = wide(spark, 999, z=x)
    assert np.allclose(column(rotation.rejoin(rotation.overlapped(d, 100), "z")), x)


def test_planted_coherent_noise_is_removed(spark):
    rng = np.random.default_rng(3)
    n = 1 << 14
    a, b = rng.normal(size=n), rng.normal(size=n)
    b = b + 0.5 * a  # the second channel repeats a part of the first
    z = 0.02 * rng.normal(size=n)
    noise = np.convolve(a, [0.5, 1.0, -0.3], "same") + np.convolve(b, [0.2, 0, 0.7], "same")
    d = wide(spark, n, z=z + noise, a=a, b=b)
    out = rotation.clean_windows(d, "z", ("a", "b"), 8192, 512, "station")
    clean = column(rotation.rejoin(out, "z", "station"))
    inner = slice(600, n - 600)
    assert np.std((clean - z)[inner]) < 0.01 * np.std(noise)
    steps = np.abs(np.diff((clean - z)[inner]))
    assert steps.max() < 0.15 * np.std(noise)
    told = out.select("window_id", "variance_ratio", "error").distinct().collect()
    assert all(r.error is None and r.variance_ratio > 100 for r in told if r.window_id in (0, 1, 2))


def test_windows_that_fail_pass_as_they_are(spark):
    x = np.arange(300.0)
    d = wide(spark, 300, z=x, a=x * 2, b=x * 4).where("seq <> 150")
    tilts = {r.window_id: r.error for r in rotation.tilt_windows(d, "z", ("a", "b"), 100).collect()}
    assert set(tilts.values()) == {"singular"}
    out = rotation.clean_windows(d, "z", ("a",), 100, 20)
    errors = {r.window_id: r.error for r in out.select("window_id", "error").distinct().collect()}
    assert errors[2] == "missing places" and errors[3] is None and errors[-1] is None  # places that lack at an end shorten a window
    got = {r.seq: r.z for r in rotation.rejoin(out.where("window_id = 2"), "z").collect()}
    assert all(abs(got[i] - i) < 1e-9 for i in range(110, 150))
    assert rotation.cleaned(d.limit(0), "z", ("a",), 100, 20).count() == 0 and rotation.rotated(d.limit(0), "z", ("a", "b"), 100).count() == 0


def trace(spark, **channels):
    return spark.createDataFrame([(c, i, None if v is None else float(v)) for c, x in channels.items() for i, v in x], "component string, seq long, v double").repartition(3)


@pytest.mark.parametrize("block", [1, 7, 24, 1000])
def test_scans_carry_values_over_blocks(spark, block):
    rng = np.random.default_rng(4)
    held = sorted(rng.choice(300, 60, replace=False).tolist())
    a = [(i - 40, float(rng.normal())) for i in held]
    d = trace(spark, a=a, b=[(5, 1.0)], c=[(-3, None), (0, 2.0), (500, 12.0)])
    got = {(r.component, r.seq): r.v for r in windows.fill_gaps(d, block).collect()}
    x = np.interp(np.arange(a[0][0], a[-1][0] + 1), [i for i, _ in a], [v for _, v in a])
    assert np.allclose([got["a", i] for i in range(a[0][0], a[-1][0] + 1)], x) and got["b", 5] == 1.0 and abs(got["c", 250] - 7.0) < 1e-12 and got["c", -2] is None
    e = trace(spark, a=[(i, v) for i, v in enumerate([9, 9, 1, 9, 9, 9, 2, 9, 3])], b=[(i, 9) for i in range(30)])
    got = {(r.component, r.seq): r.v for r in windows.fill_outliers(e, 5, block).collect()}
    assert [got["a", i] for i in range(9)] == [3, 3, 1, 1, 1, 1, 2, 2, 3] and {got["b", i] for i in range(30)} == {9}


@pytest.mark.parametrize("block", [10, 33, 1000])
def test_blocks_carry_what_reaches_into_them(spark, block):
    x = np.random.default_rng(5).normal(size=200)
    d = trace(spark, a=list(enumerate(x)))
    got = {r.seq: r.smooth for r in windows.smooth(d, 10, block).collect()}
    assert len(got) == 200 and all(got[i] is None if i < 4 or i > 194 else abs(got[i] - x[i - 4 : i + 6].mean()) < 1e-12 for i in range(200))
    taps = [0.1, 0.2, 0.4, 0.2, 0.1]
    got = {r.seq: r.v for r in windows.decimate(d, taps, 5, block).collect()}
    assert got.keys() == set(range(5, 198, 5)) and all(abs(v - x[i - 2 : i + 3] @ taps) < 1e-12 for i, v in got.items())
    with pytest.raises(ValueError):
        windows.haloed(d, 11, 0, 10)


def test_decimation_by_fifty(spark):
    """Sines over the new Nyquist frequency are under -60 dB, slow ones stay, and the chain equals plain convolutions."""
    n = np.arange(12_000)
    slow, fast = np.sin(2 * np.pi * n / 1000), np.sin(2 * np.pi * n * 0.013)
    for every in (2, 5):
        taps = np.array(windows.lowpass(every))
        gain = np.abs(np.fft.rfft(taps, 1 << 14))
        f = np.arange(len(gain)) / (1 << 14)
        assert gain[f >= 0.5 / every].max() < 1e-3 and np.abs(gain[f <= 0.29 / every] - 1).max() < 1e-3 and abs(taps.sum() - 1) < 1e-12
    d = trace(spark, slow=list(enumerate(slow)), fast=list(enumerate(fast)))
    got = {c: {r.seq: r.v for r in windows.decimate_chain(d, block=997).where(F.col("component") == c).collect()} for c in ("slow", "fast")}
    want = slow
    for every in (5, 5, 2):
        taps = windows.lowpass(every)
        want = np.convolve(want, taps, "same")[::every]
    places = sorted(got["slow"])
    assert len(places) > 150 and np.diff(places).tolist() == [50] * (len(places) - 1) and all(i % 50 == 0 for i in places)
    assert all(abs(got["slow"][i] - want[i // 50]) < 1e-9 for i in places) and all(abs(got["slow"][i] - slow[i]) < 1e-2 for i in places)
    assert max(map(abs, got["fast"].values())) < 1e-3


@pytest.mark.parametrize("columns", [1 << 16, 32, 4])
def test_autocorrelation_equals_all_pairs(spark, columns):
    rng = np.random.default_rng(6)
    d = trace(spark, a=list(enumerate(rng.normal(size=300), 7)), b=list(enumerate(np.cumsum(rng.normal(size=41)), -3)), c=[(0, 1.0)], d=[(i, 5.0) for i in range(10)])
    got = {(r.component, r.lag): r.acf for r in posterior.acf_fft(d, columns).collect()}
    want = {(r.component, r.lag): r.acf for r in posterior.acf_full(d).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want if k[0] in "ab") and got["d", 3] is None is want["d", 3]
    assert posterior.acf_fft(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        posterior.acf_fft(d.where("seq <> 9"))


def test_autocorrelation_of_a_million_places(spark):
    d = spark.range(1_000_000).select(F.lit("c").alias("component"), F.col("id").alias("seq"), F.sin(F.col("id") * 0.01).alias("v"))
    r = posterior.acf_fft(d).agg(F.count("*").alias("n"), F.max("acf").alias("hi"), F.min("acf").alias("lo"), F.max(F.when(F.col("lag") == 0, F.col("acf"))).alias("zero")).first()
    assert r.n == 1_000_000 and abs(r.zero - 1) < 1e-12 and r.hi < 1 + 1e-9 and -1 < r.lo < -0.9
