"""Chains as arrays of models: bounds, state, an analytic posterior."""

import numpy as np
import pytest

from abyssal.operators import earth, inference

SCHEMA = "chain_id long, seed long, data array<double>, freqs array<double>, sigma array<double>, thick array<double>, vs array<double>, water_depth double, alpha double"


def chains(spark, n=6, layers=4):
    freqs = np.linspace(0.007, 0.02, 4)
    omega = 2 * np.pi * freqs
    rows = []
    for i in range(n):
        thick, vs = np.full(layers + i % 2, 1500.0), np.linspace(2000, 4200, layers + i % 2)
        vp = vs * 1.03 * 3**0.5
        data = earth.compliance(omega, earth.gravity_wavenumber(omega, 2500.0 + 100 * i), thick, 310 * vp**0.25, vp, vs * 1.03)
        rows.append((i, 7 * i, data.tolist(), freqs.tolist(), (data / 40).tolist(), thick.tolist(), vs.tolist(), 2500.0 + 100 * i, 0.25))
    return spark.createDataFrame(rows, SCHEMA)


def table(df):
    return {(r.chain_id, r.iter): (round(r.misfit, 9), r.accepted, tuple(r.thick), tuple(r.vs)) for r in df.collect()}


def test_resumed_equals_unbroken(spark, tmp_path):
    d = chains(spark)
    whole = table(inference.invert_rounds(d, 130, f"{tmp_path}/a", every=1000))
    assert len(whole) == 6 * 130
    parts = inference.invert_rounds(d, 60, f"{tmp_path}/b", every=30)  # two rounds, then two more in the same folder, then the rest
    assert table(parts) == {k: v for k, v in whole.items() if k[1] < 60}
    assert table(inference.invert_rounds(d, 120, f"{tmp_path}/b", every=30)) == {k: v for k, v in whole.items() if k[1] < 120}
    alone = table(inference.invert_rounds(d.where("chain_id = 3"), 130, f"{tmp_path}/c", every=64))
    same = lambda a, b: a[1] == b[1] and np.allclose(a[2], b[2], rtol=1e-9) and np.allclose(a[3], b[3], rtol=1e-9)
    assert all(same(v, whole[k]) for k, v in alone.items()) and len(alone) == 130
    thin = inference.invert_rounds(d, 130, f"{tmp_path}/d", every=50, keep=10)
    assert {r.iter for r in thin.select("iter").distinct().collect()} == {*range(0, 130, 10), 49, 99, 129}
    assert inference.invert_rounds(d.limit(0), 10, f"{tmp_path}/e").count() == 0


def test_moves_stay_inside_their_bounds_and_depth_is_kept():
    rows = [{"seed": s, "data": [0.0], "freqs": [0.01], "sigma": [1e9], "thick": [50.0, 60.0, 70.0, 80.0], "vs": [1000.0, 1100.0, 1200.0, 1300.0], "start_vs": [1000.0, 1100.0, 1200.0, 1300.0], "water_depth": 1.0, "alpha": 0.0} for s in range(5)]
    forward = lambda h, v: v[:, :1] * 0
    seen = [(h, v) for _, _, _, _, h, v in inference.run_chains(rows, 0, 3000, sigma_v=120, sigma_h=20, bounds=inference.Bounds(0.3, 0.2, 0.05, 0.05), forward=forward)]
    h, v = (np.stack(x) for x in zip(*seen, strict=True))
    assert np.allclose(h.sum(2), 260) and (h > 0).all() and (v[..., 3] == 1300).all()
    assert (v[..., 0] >= 700).all() and (v[..., 0] <= 1200).all() and v[..., 0].min() < 750 and v[..., 0].max() > 1150
    # a move of the last layer over the half-space that leaves its bounds is turned back
    assert 40 < np.abs(v[..., 2] - 1200).max() <= 60


def test_an_analytic_posterior_is_met():
    """With one value and the misfit as it is, the posterior is a Laplace distribution of scale 2 sigma."""
    rows = [{"seed": 100 + s, "data": [3000.0], "freqs": [0.01], "sigma": [40.0], "thick": [1e9, 1e9, 1.0], "vs": [3000.0, 4000.0, 4500.0], "start_vs": [3000.0, 4000.0, 4500.0], "water_depth": 1.0, "alpha": 0.0} for s in range(40)]
    v = np.stack([v[:, 0] for i, _, _, _, _, v in inference.run_chains(rows, 0, 6000, sigma_v=200, bounds=inference.Bounds(0.9, 0.9, 0.5, 0.5), forward=lambda h, v: v[:, :1]) if i >= 500])
    assert abs(v.mean() - 3000) < 5 and abs(np.abs(v - 3000).mean() / 80 - 1) < 0.05 and abs(np.median(np.abs(v - 3000)) / (80 * np.log(2)) - 1) < 0.06


def test_lcurve_of_chains(spark, tmp_path):
    d = chains(spark, 1).withColumnRenamed("chain_id", "station").drop("alpha")
    rows = {r.alpha: r.misfit for r in inference.lcurve(d, [0.01, 0.1, 10.0], 40, f"{tmp_path}/l", every=20).collect()}
    assert rows.keys() == {0.01, 0.1, 10.0} and all(np.isfinite(x) for x in rows.values())


@pytest.mark.parametrize("n", [1, 5])
def test_draws_depend_on_seed_and_iteration_alone(n):
    a = [inference._draws(3, b) for b in range(n)]
    assert all(np.array_equal(x, y) for x, y in zip(a[-1], inference._draws(3, n - 1), strict=True)) and not np.array_equal(a[0][0], inference._draws(4, 0)[0])
