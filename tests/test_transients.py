"""Planted glitches of an odd period are timed and removed."""

import numpy as np
from pyspark.sql import functions as F

from abyssal.operators import transients


def glitchy(n, period, reference, rng, size=300.0):
    """Drift, noise and a decaying glitch every ``period`` steps."""
    t = np.arange(n)
    since = np.mod(t - reference, period)
    shape = np.where(since < 60, size * np.exp(-since / 12) * np.sin(since / 5), 0)
    return shape, rng.normal(size=n) + 3 * np.sin(t / 40_000) + shape


def test_a_planted_glitch_is_timed_and_removed(spark):
    rng = np.random.default_rng(1)
    n, period, reference = 200_000, 3620.2, 517.3
    shape, x = glitchy(n, period, reference, rng)
    other, y = glitchy(n, 3619.7, 100.0, rng, 500.0)
    d = spark.createDataFrame([(c, i, float(v)) for c, z in (("Z", x), ("H", y), ("P", x[:50])) for i, v in enumerate(z)], "component string, seq long, v double").repartition(4)
    spec = spark.createDataFrame([("Z", 3620.0, 515.0), ("H", 3620.0, 98.0)], "component string, period double, reference double")
    got = {r.component: r for r in transients.timing(d, spec, 1.0, reach=12, rounds=4).collect()}
    cycles = n / period
    assert abs(got["Z"].period - period) * cycles < 1 and abs(got["H"].period - 3619.7) * cycles < 1
    late = [(got["Z"].reference + k * got["Z"].period) - (reference + k * period) for k in (0, 54)]
    assert abs(late[0] - late[1]) < 1 and max(map(abs, late)) < 12  # a common delay is no error: the shape begins where the reference says
    fitted = spark.createDataFrame([tuple(r) for r in got.values()], spec.schema)
    out = transients.remove(d, fitted, 1.0)
    rows = out.where("component = 'Z'").orderBy("seq").toPandas()
    assert len(rows) == n and np.std(rows.clean - (x - shape)) < 0.1 * np.std(shape)
    assert out.where("component = 'P' and v <> clean").count() == 0 and out.count() == d.count()


def test_shape_leaves_out_what_is_not_clear(spark):
    d = spark.createDataFrame([("Z", i, float(i % 10 == 3) + 1000.0 * (200 <= i < 300)) for i in range(1000)], "component string, seq long, v double")
    spec = spark.createDataFrame([("Z", 10.0, 0.0)], "component string, period double, reference double")
    clear = ~F.col("seq").between(200, 299)
    clean = {r.seq: r.clean for r in transients.remove(d, spec, 1.0, clear).collect()}
    assert all(abs(v - (1000.0 if 200 <= i < 300 else 0.0)) < 1e-9 for i, v in clean.items())
    assert {r.seq: r.clean for r in transients.remove(d, spec, 1.0, None, (-5, 5)).collect()}[250] == 1000.0
    assert transients.timing(d.limit(0), spec, 1.0).count() == 1 and transients.remove(d.limit(0), spec, 1.0).count() == 0


def test_high_pass_takes_drift_away(spark):
    n = 2000
    x = np.linspace(0, 100, n) + (np.arange(n) % 100 == 0) * 50
    d = spark.createDataFrame([("Z", i, float(v)) for i, v in enumerate(x)], "component string, seq long, v double")
    got = {r.seq: r.v for r in transients.high_pass(d, 201, 300).collect()}
    want = {i: x[i] - x[max(0, i - 100) : i + 101].mean() for i in range(n)}
    assert len(got) == n and all(abs(got[i] - want[i]) < 1e-9 for i in range(n))
