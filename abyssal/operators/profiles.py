"""Start models and reference curves as bins of depth, from ordered slices of which the last one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics as P

BINS = 100

# Slices (first bin, end, Vs) of the starting profiles, a bin a hundred metres.
START = {
    "RR28": ((0, 1, 340), (1, 6, 2700), (6, 16, 3700), (16, 45, 4050), (45, 99, 4510)),
    "RR29": ((0, 1, 340), (1, 5, 2700), (5, 14, 3700), (14, 44, 4050), (44, 99, 4510)),
    "RR34": ((0, 2, 340), (2, 7, 2700), (7, 15, 3700), (15, 42, 4050), (42, 99, 4500)),
    "RR36": ((0, 4, 2700), (4, 15, 3700), (15, 42, 4050), (42, 99, 4370)),
    "RR38": ((0, 4, 2700), (4, 15, 3700), (15, 42, 4050), (42, 99, 4190)),
    "RR40": ((0, 4, 2700), (4, 13, 3700), (13, 42, 4050), (42, 100, 4360)),
    "RR50": ((0, 7, 2540), (7, 14, 3590), (14, 42, 3940), (42, 100, 4190)),
    "RR52": ((0, 7, 2660), (7, 14, 3670), (14, 42, 4022), (42, 100, 4330)),
    "other": ((0, 13, 2200), (13, 25, 2700), (25, 42, 3500), (42, 60, 3800), (60, 100, 4310)),
}
# Mean starting profiles and the stations that share one; other stations have none.
FAMILY_START = {
    "sediment": ((0, 2, 340), (2, 7, 2540), (7, 16, 3590), (16, 44, 3940), (44, 100, 4310)),
    "crust": ((0, 5, 2540), (5, 14, 3590), (14, 42, 3940), (42, 100, 4310)),
}
FAMILY = {"RR28": "sediment", "RR29": "sediment", "RR34": "sediment", "RR36": "crust", "RR38": "crust", "RR40": "crust", "RR50": "crust", "RR52": "crust"}
# Slices (first bin, end, Vp) of the reference curves; a later slice overrides an earlier one.
REFERENCE = {
    "SWIR-64-EW": ((0, 2, 3500), (2, 3, 4070), (3, 5, 4730), (5, 7, 5200), (7, 10, 5900), (10, 13, 6200), (13, 15, 6600), (15, 17, 6900), (17, 20, 7120), (20, 23, 7230), (23, 39, 7600), (39, 100, 7780)),
    "SWIR-64-NS": ((0, 1, 2938), (1, 4, 4214), (4, 7, 4994), (7, 10, 5881), (10, 13, 6414), (13, 19, 7018), (19, 23, 7374), (23, 28, 7589), (28, 35, 7770), (35, 100, 7846)),
    "SWIR-65-66E": ((0, 12, 3680), (12, 34, 6540), (34, 100, 6910)),
    "best fit": (
        (0, 1, 3500), (1, 2, 3730), (2, 3, 3910), (3, 5, 4060), (5, 7, 4230), (7, 8, 4420), (8, 19, 4630), (9, 10, 4870), (10, 11, 5080), (11, 12, 5280), (12, 13, 5460), (13, 14, 5610), (14, 15, 5760),
        (15, 16, 5910), (16, 17, 6060), (17, 18, 6210), (18, 20, 6360), (20, 21, 6520), (21, 22, 6670), (22, 23, 6850), (23, 24, 7030), (24, 25, 7200), (25, 27, 7370), (27, 28, 7510), (28, 35, 7640), (35, 100, 8000),
    ),
    "Atlantis Bank": ((0, 1, 5900), (1, 4, 6000), (4, 7, 6200), (7, 10, 6300), (10, 13, 6414), (13, 19, 6500), (19, 23, 6600), (23, 28, 6789), (28, 30, 6800), (30, 100, 8000)),
}
# Overrides (first layer, end, thickness or None, density, Vp, Vs) of the layers under the sediment, in order.
UNDER_SEDIMENT = ((1, 4, None, 2550, 5000, 2700), (4, 7, None, 2850, 6500, 3700), (7, 12, None, 3050, 7100, 4050), (11, 12, 1638, 3050, 7100, 4050), (12, 13, 50000, 3340, 8120, 4510))
HALF_SPACE = (100_000.0, 3340.0, 8120.0, 4510.0)


def slices(spark: SparkSession, table: dict[str, tuple]) -> DataFrame:
    """(model_id, bin_lo, bin_hi, v, priority): a row a slice, in the order in which they are laid."""
    rows = [(name, lo, hi, float(v), i) for name, of in table.items() for i, (lo, hi, v) in enumerate(of)]
    return spark.createDataFrame(rows, "model_id string, bin_lo int, bin_hi int, v double, priority int")


def laid(pieces: DataFrame, n: int = BINS) -> DataFrame:
    """(model_id, bin, v): every bin of every model with the value of the last slice that covers it; 0 where none does."""
    covered = pieces.where("bin_lo < bin_hi").select("model_id", "priority", "v", F.explode(F.sequence("bin_lo", F.col("bin_hi") - 1)).alias("bin"))
    last = covered.groupBy("model_id", "bin").agg(F.max_by("v", "priority").alias("v"))
    grid = pieces.select("model_id").distinct().select("model_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return grid.join(last, ["model_id", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def start_profiles(stations: DataFrame) -> DataFrame:
    """``stations`` (station) with the bins (bin, v) of the station's own start, or of the general one."""
    spark = stations.sparkSession
    known = F.when(F.col("station").isin(*[k for k in START if k != "other"]), F.col("station")).otherwise("other")
    return stations.withColumn("model_id", known).join(laid(slices(spark, START)), "model_id").select(*stations.columns, "bin", "v")


def family_profiles(stations: DataFrame) -> DataFrame:
    """``stations`` (station) with the bins of its family's mean start; 0 in every bin without a family."""
    spark = stations.sparkSession
    family = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[F.col("station")]
    rows = stations.withColumn("model_id", family).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    return rows.join(laid(slices(spark, FAMILY_START)), ["model_id", "bin"], "left").select(*stations.columns, "bin", F.coalesce("v", F.lit(0.0)).alias("v"))


def reference_profiles(spark: SparkSession, poisson: float = 0.25) -> DataFrame:
    """(model_id, bin, v): Vs of the five reference curves, from their Vp at Poisson's ratio."""
    ratio = ((1 - poisson) / (0.5 - poisson)) ** 0.5
    return laid(slices(spark, REFERENCE)).withColumn("v", F.col("v") / ratio)


def half_precision(x: Column) -> Column:
    """A positive number to the eleven binary digits of a half-precision float, ties to even."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(x)) - 10)
    return F.rint(x / unit) * unit


def sediment_prior(models: DataFrame) -> DataFrame:
    """``models`` (model_id, first, n_layer, power, sediment, n_sediment) -> their layers (model_id, layer_idx, thick, rho, vp, vs).

    Sediment layers rise geometrically in thickness and Vs (340 to 600) and fill ``sediment`` metres; below, thickness is
    first * power ** j in half precision and Vs rises by steps of 3000 over the number of layers from 1200, but for the overrides,
    of which the last one wins; then a half-space.
    """
    spark, c = models.sparkSession, F.col
    total = c("n_layer") + 1 + c("n_sediment")
    rows = models.withColumn("total", total).withColumn("layer_idx", F.explode(F.sequence(F.lit(0), total - 1))).withColumn("j", c("layer_idx") - c("n_sediment") + 1)
    step = c("layer_idx") / F.greatest(c("n_sediment") - 1, F.lit(1))
    share = F.aggregate(F.sequence(F.lit(0), F.greatest(c("n_sediment"), F.lit(1)) - 1), F.lit(0.0), lambda acc, i: acc + F.pow(c("sediment"), i / F.greatest(c("n_sediment") - 1, F.lit(1))))
    inside = c("layer_idx") < c("n_sediment")
    thick = F.when(inside, c("sediment") * F.pow(c("sediment"), step) / share).otherwise(half_precision(c("first") * F.pow(c("power"), c("j"))))
    vs = F.when(inside, 340 * F.pow(F.lit(600 / 340), step)).otherwise(1200 + c("j") / c("total") * 3000)
    base = rows.select("model_id", "layer_idx", "total", (c("j") - 1).alias("under"), thick.alias("thick"), P.gardner_density(vs).alias("rho"), P.vp_from_vs(vs).alias("vp"), vs.alias("vs"))
    laid_over = [(lo, hi, i, None if t is None else float(t), float(rho), float(vp), float(v)) for i, (lo, hi, t, rho, vp, v) in enumerate(UNDER_SEDIMENT)]
    over = spark.createDataFrame(laid_over, "lo int, hi int, priority int, t double, r double, p double, s double")
    each = over.select("priority", "t", "r", "p", "s", F.explode(F.sequence("lo", c("hi") - 1)).alias("under"))
    # of each property, the last slice that gives one
    last = each.groupBy("under").agg(*[F.max_by(x, F.when(c(x).isNotNull(), c("priority"))).alias(x) for x in ("t", "r", "p", "s")])
    joined = base.join(last, "under", "left")
    end = c("layer_idx") == c("total") - 1
    pick = lambda name, own, last_value: F.when(end, last_value).otherwise(F.coalesce(own, name)).alias(name)
    return joined.select("model_id", "layer_idx", *[pick(n, o, v) for n, o, v in zip(("thick", "rho", "vp", "vs"), ("t", "r", "p", "s"), HALF_SPACE, strict=True)])
