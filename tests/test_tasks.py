"""Memory of a task stays while the layers grow: they are dealt in proportion to their number, and joined before they are cut into cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abyssal import catalog
from abyssal.operators import earth
from abyssal.sources import traces


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["profile_block_mean", "forward_compliance", "station_top_profile", "accepted_density"])
def test_tasks_follow_the_layers(spark, sf, name, monkeypatch):
    want = _rows(catalog.QUERIES[name](spark, sf))
    monkeypatch.setattr(traces, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    got = catalog.QUERIES[name](spark, sf)
    assert n > 8 and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and _rows(got) == want
    assert traces.layer_tasks(spark, sf) == n == traces.read_layers(spark, sf).rdd.getNumPartitions()


@pytest.mark.parametrize("name", ["station_profiles", "station_serpentinisation", "station_reference_overlay", "station_density", "station_density_fine", "station_top_profile", "accepted_products", "accepted_serpentinisation", "accepted_with_curves", "accepted_density"])
def test_models_are_joined_before_cells_are_made(spark, sf, name):
    """From the top of the plan: no join on models stands above the generation of a model's cells."""
    lines = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, x in enumerate(lines) if "Generate explode(sequence(a#" in x)
    assert not any("Join" in x and "model_id" in x for x in lines[:cut]) and any("Join" in x and "model_id" in x for x in lines[cut:])


def test_stacks_of_unlike_sizes_in_one_batch(spark):
    """As the expression, for every size beside every other; a null in a layer makes null, not a value, and a batch has no lambda."""
    rng = np.random.default_rng(3)
    rows = [(i, [(float(h), 2700.0, float(v * 3**0.5), float(v)) for h, v in zip(rng.uniform(5, 9000, n), rng.uniform(900, 4500, n), strict=True)]) for i, n in enumerate(rng.integers(0, 8, 300).tolist())]
    rows += [(900, None), (901, [(100.0, None, 3000.0, 2000.0), (100.0, 2700.0, 3000.0, 2000.0)]), (902, [(100.0, 2700.0, 3000.0, 20.0)] * 2), (903, [None, (100.0, 2700.0, 3000.0, 2000.0)])]
    d = spark.createDataFrame(rows, "model_id long, layers array<struct<thick:double,rho:double,vp:double,vs:double>>")
    f = 0.012
    k = float(earth.gravity_wavenumber(np.array([2 * np.pi * f]), 3000.0)[0])
    want = dict(map(tuple, d.where("model_id < 900").select("model_id", earth.stack_compliance(F.col("layers"), F.lit(k), F.lit(2 * np.pi * f))).collect()))
    folded = earth.folded_compliance(d, [f, 0.015], 3000.0)
    got = {r.model_id: r.compliance for r in folded.where(F.col("f") == f).collect()}
    assert len(got) == 304 and all(got[i] is None for i in (900, 901, 902, 903))
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or abs(got[i] / want[i] - 1) < 1e-6) for i in range(300))
    assert "lambda" not in earth.folded_compliance(d, [f], 3000.0)._jdf.queryExecution().optimizedPlan().toString()
