"""Profiles, priors, the gauge's gain and interval files on cases with known answers."""

from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal.operators import calibration, compliance, profiles, spectral
from abyssal.sources import intervals


def test_later_slices_override_earlier_ones(spark):
    got = {(r.model_id, r.bin): r.v for r in profiles.reference_profiles(spark).collect()}
    assert len(got) == 500 and abs(got["best fit", 8] - 4630 / 3**0.5) < 1e-9 and abs(got["best fit", 9] - 4870 / 3**0.5) < 1e-9 and abs(got["best fit", 18] - 6360 / 3**0.5) < 1e-9
    want = np.zeros(100)
    for lo, hi, v in profiles.REFERENCE["best fit"]:
        want[lo:hi] = v
    assert np.allclose([got["best fit", i] * 3**0.5 for i in range(100)], want)
    s = spark.createDataFrame([("RR28",), ("RR52",), ("XX",)], "station string")
    start = {(r.station, r.bin): r.v for r in profiles.start_profiles(s).collect()}
    assert start["RR28", 0] == 340 and start["RR28", 99] == 0 and start["XX", 99] == 4310 and start["RR52", 99] == 4330 and len(start) == 300
    mean = {(r.station, r.bin): r.v for r in profiles.family_profiles(s).collect()}
    assert mean["RR28", 1] == 340 and mean["RR52", 4] == 2540 and {mean["XX", i] for i in range(100)} == {0.0}
    assert profiles.start_profiles(s.limit(0)).count() == 0


def test_sediment_prior(spark):
    d = spark.createDataFrame([("a", 200.0, 13, 1.17, 80.0, 3), ("b", 150.0, 5, 1.2, 40.0, 1)], "model_id string, first double, n_layer int, power double, sediment double, n_sediment int")
    rows = {(r.model_id, r.layer_idx): r for r in profiles.sediment_prior(d).collect()}
    a = [rows["a", i] for i in range(17)]
    logs = np.geomspace(1, 80, 3)
    assert np.allclose([r.thick for r in a[:3]], 80 * logs / logs.sum()) and np.allclose([r.vs for r in a[:3]], np.geomspace(340, 600, 3))
    assert np.allclose([r.thick for r in a[3:14]], [float(np.float16(200 * 1.17 ** (j + 1))) for j in range(11)])
    assert [r.vs for r in a[4:14]] == [2700] * 3 + [3700] * 3 + [4050] * 4 and a[14].thick == 1638 and a[15].thick == 50_000 and (a[16].thick, a[16].vs) == (100_000, 4510)
    assert abs(a[3].vs - (1200 + 3000 / 17)) < 1e-9 and rows["b", 6].thick == 100_000 and rows["b", 5].vs == 3700 and len(rows) == 17 + 7


def segments(spark, x, size, hop):
    cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, size)[::hop]
    rows = [(c, w, s, row.tolist()) for c, windows in x.items() for w, v in enumerate(windows) for s, row in enumerate(cut(v))]
    return spark.createDataFrame(rows, "component string, window_id long, seg long, data array<double>").repartition(4)


def test_a_planted_gain_is_found(spark):
    """Windows of noise and one of a wrong gain among those of earthquakes."""
    rng = np.random.default_rng(2)
    ref = [rng.normal(size=4096) for _ in range(12)]
    gauge = [0.66 * v + 0.01 * rng.normal(size=4096) for v in ref]
    gauge[3], gauge[7] = 5 * ref[3], rng.normal(size=4096)
    d = segments(spark, {"Z": ref, "H": gauge}, 512, 256)
    r = calibration.gauge_ratio(d, "Z", "H", 512, 1.0).first()
    assert abs(r.gain - 0.66) < 0.0066 and r.n > r.n_kept > 100
    none = calibration.gauge_ratio(d.where("component = 'Z'"), "Z", "H", 512, 1.0).first()
    assert none.gain is None and none.n == none.n_kept == 0


def test_windows_inside_events(spark):
    w = spark.createDataFrame([(i, 3600.0 * i, 3600.0 * (i + 1)) for i in range(72)], "window_id long, t0 double, t1 double")
    s = spark.createDataFrame([(3600.0, 10_800.0), (80_000.0, 100_800.0)], "t_start double, t_end double")
    assert sorted(r.window_id for r in calibration.event_windows(w, s).collect()) == [1, 2, 23, 24, 25, 26, 27]


def test_cells_of_4096_values_equal_numpy(spark):
    """Densities, coherence and cross spectrum of windows under one taper of ``alpha``, by numpy."""
    rng = np.random.default_rng(3)
    n, hop, fs = 4096, 2048, 2.0
    p = [np.cumsum(rng.normal(size=4 * n)) * 0.01 + rng.normal(size=4 * n) for _ in range(3)]
    z = [0.3 * v + 0.1 * rng.normal(size=4 * n) for v in p]
    alpha = compliance.taper_share(5, fs, n)
    assert abs(alpha - 600 / 4096) < 1e-12 and compliance.taper_share(600, fs, n) == 1
    got = {(r.window_id, r.k): r for r in compliance.window_cells(segments(spark, {"Z": z, "H": p}, n, hop), "Z", "H", n, fs, alpha).collect()}
    assert len(got) == 3 * 2049
    i = np.arange(n)
    edge, near = alpha * (n - 1) / 2, np.minimum(i, n - 1 - i)
    w = np.where(near < edge, 0.5 * (1 - np.cos(np.pi * near / edge)), 1.0)
    scale = np.full(2049, 2.0) / (fs * (w * w).sum())
    scale[[0, -1]] /= 2
    for win in range(3):
        cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, n)[::hop]
        a, b = (np.fft.rfft((s - s.mean(1, keepdims=True)) * w, axis=1) for s in (cut(p[win]), cut(z[win])))
        bias = 1 + sum(1 / (2 * j + 1) - 1 / (2 * j) for j in range(1, (len(a) - 1) // 2 + 1))
        cross = (a.conj() * b).mean(0)
        for k in (1, 7, 100, 1024, 2048):
            r = got[win, k]
            assert np.isclose(r.dp, np.median(np.abs(a[:, k]) ** 2) * scale[k] / bias) and np.isclose(r.dz, np.median(np.abs(b[:, k]) ** 2) * scale[k] / bias)
            assert np.isclose(r.coh, np.abs(cross[k]) / np.sqrt((np.abs(a[:, k]) ** 2).mean() * (np.abs(b[:, k]) ** 2).mean())) and np.isclose(r.csd, cross[k].real * scale[k])


def test_short_and_long_transforms_agree(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(5)], "window_id long, data array<double>")
    for kind in ("hann", "tukey", "none", "hanning"):
        a, b = ({(r.window_id, r.k): (r.re, r.im) for r in f(d, 64, kind).collect()} for f in (spectral.fourier_short, spectral.fourier_long))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_default_thresholds_select_compliance_windows(spark):
    """The selection's own thresholds on generated windows: strong coherent pressure passes, a window without coherence doesn't."""
    rng = np.random.default_rng(5)
    n, fs = 1024, 1.0
    p = [rng.normal(size=8 * n) * 9 for _ in range(6)]
    z = [1e-7 * v + 1e-9 * rng.normal(size=8 * n) for v in p]
    z[4] = 1e-7 * rng.normal(size=8 * n) * 9
    cells = compliance.window_cells(segments(spark, {"Z": z, "H": p}, n, n // 2), "Z", "H", n, fs).cache()
    freqs = spark.range(n // 2 + 1).select(F.col("id").alias("k"), (F.col("id") * fs / n).alias("f"))
    band = (0.007, 0.02)
    first = compliance.select_v2_coherence(cells, freqs, band)
    assert sorted(r.window_id for r in first.collect()) == [0, 1, 2, 3, 5]
    left = compliance.select_v2_levels(cells.join(first, "window_id", "left_semi"), freqs, band)
    assert sorted(r.window_id for r in left.collect()) == [0, 1, 2, 3, 5]


def test_a_days_query_opens_a_days_files(spark, tmp_path):
    hour = 3600
    rows = [("Z3", s, c, datetime.fromtimestamp(1_704_067_200 + i * hour, UTC).replace(tzinfo=None), float(i)) for s in ("A1", "B2") for c in ("BHZ", "BDH") for i in range(24 * 4)]
    d = spark.createDataFrame(rows, "network string, station string, channel string, ts timestamp, v double")
    folder = f"{tmp_path}/day"
    intervals.write_intervals(d, folder)
    (tmp_path / "day" / "notes.parquet").write_bytes(b"")
    every = intervals.listed(spark, folder).collect()
    assert len(every) == 16
    start, end = datetime(2024, 1, 2), datetime(2024, 1, 3)
    paths = intervals.wanted(spark, folder, "A1", "BHZ", start, end)
    assert len(paths) == 1 and paths[0].endswith("Z3.A1.BHZ.20240102T000000.20240103T000000.parquet")
    got = intervals.read_intervals(spark, folder, "A1", "BHZ", start, end)
    assert len(got.inputFiles()) == 1 and [r.v for r in got.orderBy("ts").collect()] == list(map(float, range(24, 48))) and got.select("component", "file_name").distinct().count() == 1
    assert intervals.read_intervals(spark, folder).count() == len(rows) and intervals.read_intervals(spark, folder, station="none").count() == 0
    assert intervals.read_intervals(spark, folder, end=datetime(2024, 1, 1, 6)).count() == 4 * 6


@pytest.mark.parametrize("x", [0.1, 1.0, 234.0, 2047.5, 2049.0, 12345.6])
def test_half_precision(spark, x):
    assert spark.range(1).select(profiles.half_precision(F.lit(x)).alias("h")).first().h == float(np.float16(x))


def test_fold_of_layers_equals_the_matrices(spark):
    """Expressions against numpy's matrices: single half-spaces, thin and thick layers; nothing for stacks with a wave that doesn't decay."""
    from abyssal.operators import earth

    rng = np.random.default_rng(7)
    stacks = {i: [(float(h), 2700.0, float(v * 3**0.5), float(v)) for h, v in zip(rng.uniform(5, 9000, n), rng.uniform(600, 4500, n), strict=True)] for i, n in enumerate((1, 2, 3, 5, 9))}
    stacks |= {50: [(100.0, 2000.0, 300.0, 20.0), (1000.0, 2700.0, 5000.0, 2900.0)], 51: []}
    d = spark.createDataFrame(list(stacks.items()), "model_id long, layers array<struct<thick:double,rho:double,vp:double,vs:double>>")
    freqs = [0.005, 0.012, 0.02]
    got = {(r.model_id, r.f): r.compliance for r in earth.folded_compliance(d, freqs, 3000.0).collect()}
    want = {(r.model_id, r.f): r.compliance for r in earth.forward_compliance(d, freqs, 3000.0).collect()}
    assert len(got) == 21 and all(abs(got[i, f] / want[i, f] - 1) < 1e-5 for i in range(5) for f in freqs) and all(got[i, f] is None for i in (50, 51) for f in freqs)
    split = spark.createDataFrame([(1, [(300.0, 2700.0, 5000.0, 2900.0)] * 6), (2, [(900.0, 2700.0, 5000.0, 2900.0)] * 2)], d.schema)
    a = {(r.model_id, r.f): r.compliance for r in earth.folded_compliance(split, freqs, 100.0).collect()}
    assert all(abs(a[1, f] / a[2, f] - 1) < 1e-5 for f in freqs)
