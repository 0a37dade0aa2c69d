"""Metropolis-Hastings inversion: chains are the parallel axis, one group per chain."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .earth import compliance, gravity_wavenumber

CHAIN_SCHEMA = "chain_id long, iter int, misfit double, likelihood double, accepted boolean, thick array<double>, vs array<double>"


#: Tasks that run chains, at most.
MAX_TASKS = 10_000


def run_chain(seed, data, freqs, sigma, thick, vs, water_depth, iterations, sigma_v=5.0, sigma_h=5.0, alpha=0.25, low=-0.5, high=0.1, policy="reflect", poisson=0.25):
    """Yields (iter, misfit, likelihood, accepted, thick, vs), the state kept after each iteration; deterministic for a seed.

    A move perturbs one layer's Vs, inside ``low``/``high`` of its start (``policy``: reflect once, or redraw until
    inside), or one layer's thickness, which stays positive and whose change the next layer takes back, so that the
    depth of the stack is conserved.  Roughness of the Vs steps is weighted by ``alpha``.
    """
    rng, omega = np.random.default_rng(seed), 2 * np.pi * np.asarray(freqs)
    k, ratio = gravity_wavenumber(omega, water_depth), np.sqrt((1 - poisson) / (0.5 - poisson))
    lo, hi = np.asarray(vs) * (1 + low), np.asarray(vs) * (1 + high)

    def score(h, v):
        vp = v * ratio
        d = (data - compliance(omega, k, h, 310 * vp**0.25, vp, v)) / sigma
        miss = float(np.sqrt((d * d).sum()))
        return miss, -0.5 * (miss + alpha * float(np.sqrt((np.diff(v) ** 2).sum())) / 1000)

    h, v = np.array(thick, float), np.array(vs, float)
    miss, like = score(h, v)
    yield 0, miss, float(np.exp(like)), False, h, v
    for i in range(1, iterations):
        h2, v2, layer = h.copy(), v.copy(), int(rng.integers(0, len(h) - 1))
        if rng.integers(0, 2):
            while True:
                x = v[layer] + rng.normal() * sigma_v
                if policy == "reflect":
                    x = 2 * lo[layer] - x if x < lo[layer] else 2 * hi[layer] - x if x > hi[layer] else x
                    x = float(np.clip(x, lo[layer], hi[layer]))
                if lo[layer] <= x <= hi[layer]:
                    break
            v2[layer] = x
        else:
            step = rng.normal() * sigma_h
            if h[layer] + step > 0 and h[layer + 1] - step > 0:
                h2[layer] += step
                h2[layer + 1] -= step
        miss2, like2 = score(h2, v2)
        take = np.isfinite(like2) and (like2 >= like or rng.random() < np.exp(like2 - like))
        if take:
            h, v, miss, like = h2, v2, miss2, like2
        yield i, miss, float(np.exp(like)), bool(take), h, v


def invert(chains: DataFrame, iterations: int, **options) -> DataFrame:
    """``chains`` (chain_id, seed, data, freqs, sigma, thick, vs: arrays; water_depth, alpha) -> one row per iteration.

    A chain is a row: rows are spread over tasks, and a chain's iterations stream out in batches.
    """

    def each(batches):
        for b in batches:
            for r in b.to_pylist():
                held = []
                for x in run_chain(r["seed"], *(np.array(r[c], float) for c in ("data", "freqs", "sigma", "thick", "vs")), r["water_depth"], iterations, alpha=r["alpha"], **options):
                    held.append((r["chain_id"], *x[:4], x[4].tolist(), x[5].tolist()))
                    if len(held) == 4096:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    def _rows(held):
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["chain_id", "iter", "misfit", "likelihood", "accepted", "thick", "vs"])

    cols = ["chain_id", "seed", "data", "freqs", "sigma", "thick", "vs", "water_depth", "alpha"]
    # a stated number of partitions: adaptive execution would join the few rows, and so the chains, into one task
    tasks = max(1, min(chains.count(), MAX_TASKS))
    return chains.select(*cols).repartition(tasks, "chain_id").mapInArrow(each, CHAIN_SCHEMA)


# --- many chains at once, in rounds whose state is kept -----------------------------------------------------------

#: Chains that are one array of models, and iterations of a round.
CHAINS_A_TASK, ROUND = 64, 5000
#: Iterations whose random numbers are drawn together; what is drawn depends on the seed and the iteration alone.
DRAWN = 1024


@dataclass(frozen=True)
class Bounds:
    """Limits of a layer's Vs as shares of its start, and what a move over them does: it is drawn anew until it is inside, or turned back by its own length (and not made if it then leaves on the other side)."""

    low: float = 0.85
    high: float = 0.20
    deep_low: float = 0.10
    deep_high: float = 0.10

    def of(self, vs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower and upper limits, and whether a layer's moves are drawn anew: all but those of the last layer over the half-space."""
        deep = np.arange(vs.shape[1]) == vs.shape[1] - 2
        return vs * (1 - np.where(deep, self.deep_low, self.low)), vs * (1 + np.where(deep, self.deep_high, self.high)), ~deep


def _draws(seed: int, block: int) -> tuple[np.ndarray, ...]:
    g = np.random.Generator(np.random.Philox(key=int(seed) & (1 << 63) - 1, counter=[0, 0, block, 0]))
    return g.random(DRAWN), g.random(DRAWN), g.standard_normal(DRAWN), g.random(DRAWN)


def _drawn_anew(seed: int, i: int, at: float, low: float, high: float, step: float) -> float:
    g = np.random.Generator(np.random.Philox(key=int(seed) & (1 << 63) - 1, counter=[0, 1, i, 0]))
    while not low <= (x := at + g.standard_normal() * step) <= high:
        pass
    return x


def layered_forward(k: np.ndarray, omega: np.ndarray, poisson: float):
    """The compliance of models (thick, vs), a row each, with Vp by Poisson's ratio and density after Gardner."""
    ratio = np.sqrt((1 - poisson) / (0.5 - poisson))

    def forward(h: np.ndarray, v: np.ndarray) -> np.ndarray:
        vp = v * ratio
        return compliance(omega, k, h, 310 * vp**0.25, vp, v)

    return forward


def run_chains(rows: list[dict], first: int, n: int, sigma_v: float = 5.0, sigma_h: float = 5.0, bounds: Bounds = Bounds(), poisson: float = 0.25, forward=None):
    """Iterations ``first`` to ``first + n - 1`` of chains with as many layers and frequencies each: yields (iter, misfit, likelihood, accepted, thick, vs), arrays with a row a chain.

    ``rows`` hold the chain's constants and its state before ``first``; iteration 0 is the start itself.  A model is scored
    once for all chains.  The outcome depends on neither where rounds begin nor which chains run together.
    """
    of = lambda c: np.array([r[c] for r in rows], float)
    data, sigma, h, v, alpha = of("data"), of("sigma"), of("thick"), of("vs"), of("alpha")
    lo, hi, anew = bounds.of(of("start_vs"))
    if forward is None:
        omega = 2 * np.pi * of("freqs")
        k = np.stack([gravity_wavenumber(w, r["water_depth"]) for w, r in zip(omega, rows, strict=True)])
        forward = layered_forward(k, omega, poisson)
    each, seeds, layers = np.arange(len(rows)), [r["seed"] for r in rows], h.shape[1]

    def score(h, v):
        d = (data - forward(h, v)) / sigma
        miss = np.sqrt((d * d).sum(1))
        return miss, -0.5 * (miss + alpha * np.sqrt((np.diff(v, axis=1) ** 2).sum(1)) / 1000)

    miss, like = score(h, v)
    if first == 0:
        yield 0, miss, np.exp(like), np.zeros(len(rows), bool), h, v
    block = None
    for i in range(max(1, first), first + n):
        if i // DRAWN != block:
            block = i // DRAWN
            pick, kind, normal, chance = (np.stack(x) for x in zip(*(_draws(s, block) for s in seeds), strict=True))
        j = i % DRAWN
        layer = np.minimum((pick[:, j] * (layers - 1)).astype(int), layers - 2)
        speed = kind[:, j] < 0.5
        h2, v2 = h.copy(), v.copy()
        at, low, high = v[each, layer], lo[each, layer], hi[each, layer]
        x = at + normal[:, j] * sigma_v
        out = (x < low) | (x > high)
        back = at - normal[:, j] * sigma_v
        x = np.where(out, np.where((back < low) | (back > high), at, back), x)
        for c in np.flatnonzero(out & speed & anew[layer]):
            x[c] = _drawn_anew(seeds[c], i, at[c], low[c], high[c], sigma_v)
        v2[each, layer] = np.where(speed, x, at)
        step = np.where(speed, 0.0, normal[:, j] * sigma_h)
        step = np.where((h[each, layer] + step > 0) & (h[each, layer + 1] - step > 0), step, 0.0)
        h2[each, layer] += step
        h2[each, layer + 1] -= step
        miss2, like2 = score(h2, v2)
        with np.errstate(over="ignore", invalid="ignore"):
            take = np.isfinite(like2) & ((like2 >= like) | (chance[:, j] < np.exp(like2 - like)))
        h, v = np.where(take[:, None], h2, h), np.where(take[:, None], v2, v)
        miss, like = np.where(take, miss2, miss), np.where(take, like2, like)
        yield i, miss, np.exp(like), take, h, v


def _round(first: int, length: int, keep: int, options: dict):
    """A task's chains through one round."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chain_id"])
        ids, held = [r["chain_id"] for r in rows], []
        for i, *values in run_chains(rows, first, length, **options):
            if i % keep == 0 or i == first + length - 1:
                held.append((np.full(len(ids), i), *(np.array(x) for x in values)))
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        lists = [pa.array(list(x), pa.list_(pa.float64())) for x in cols[4:]]
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.bool_())
        return pa.table([pa.array(ids * len(held), pa.int64()), *(pa.array(x, t) for x, t in zip(cols[:4], kinds, strict=True)), *lists], names=["chain_id", "iter", "misfit", "likelihood", "accepted", "thick", "vs"])

    return run


def invert_rounds(chains: DataFrame, iterations: int, folder: str, every: int = ROUND, keep: int = 1, **options) -> DataFrame:
    """``chains`` (chain_id, seed, data, freqs, sigma, thick, vs, water_depth, alpha) -> CHAIN_SCHEMA, run in rounds of ``every`` iterations.

    A round is a table in ``folder``, written whole or not at all; its last iteration is the state from which the next round
    goes on.  Rounds that are there are not run again, so a run that was stopped goes on where it was, and a longer run
    extends a shorter one.  ``keep`` thins what is stored to each so many iterations (the last of a round always stays).
    Chains of equal numbers of layers and frequencies run as one array, ``CHAINS_A_TASK`` to a task.
    """
    spark = chains.sparkSession
    sized = chains.withColumns({"_layers": F.size("vs"), "_freqs": F.size("freqs")})
    n = sized.groupBy("_layers", "_freqs").agg(F.count("*").alias("_n"))
    dealt = sized.join(n, ["_layers", "_freqs"]).withColumn("_batch", F.pmod(F.xxhash64("chain_id"), F.ceil(F.col("_n") / CHAINS_A_TASK)))
    fs, path = _file_system(spark, folder)
    for r, first in enumerate(range(0, iterations, every)):
        if fs.exists(path(f"{folder}/round={r}/_SUCCESS")):
            continue
        length = min(every, iterations - first)
        start = dealt.withColumn("start_vs", F.col("vs"))
        if r:
            last = spark.read.schema(CHAIN_SCHEMA).parquet(f"{folder}/round={r - 1}").where(F.col("iter") == first - 1).select("chain_id", F.col("thick").alias("_h"), F.col("vs").alias("_v"))
            start = start.join(last, "chain_id").withColumns({"thick": F.col("_h"), "vs": F.col("_v")}).drop("_h", "_v")

        start.groupBy("_layers", "_freqs", "_batch").applyInArrow(_round(first, length, keep, options), CHAIN_SCHEMA).write.mode("overwrite").parquet(f"{folder}/round={r}")
    rounds = [f"{folder}/round={r}" for r in range(-(-iterations // every))]
    return spark.read.schema(CHAIN_SCHEMA).parquet(*rounds)


def _file_system(spark, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def lcurve_chains(observed: DataFrame, weights: list[float]) -> DataFrame:
    """``observed`` (station, seed, data, freqs, sigma, thick, vs, water_depth): a chain for each weight of roughness; ``chain_id`` counts the weights of a station's hash."""
    weight = F.posexplode(F.array(*map(F.lit, weights))).alias("place", "alpha")
    return observed.select("*", weight).withColumn("chain_id", F.pmod(F.xxhash64("station"), F.lit(1 << 40)) * len(weights) + F.col("place"))


def lcurve(observed: DataFrame, weights: list[float], iterations: int, folder: str, burnin: float = 0.8, **options) -> DataFrame:
    """(station, alpha, misfit): the median misfit after that share of the iterations, for each weight of roughness."""
    chains = lcurve_chains(observed, weights)
    rows = invert_rounds(chains, iterations, folder, **options).where(F.col("iter") >= burnin * (iterations - 1))
    return rows.join(chains.select("chain_id", "station", "alpha"), "chain_id").groupBy("station", "alpha").agg(F.median("misfit").alias("misfit"))
