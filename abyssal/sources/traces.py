"""Traces and dimension tables as DataFrames.

A *sample* is one value of one channel (component, ts, v); a *trace* is regular: (component, seq, v); a *segment* is one
row of a fixed number of values, (station, window_id, data ARRAY<DOUBLE>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which component an event type plays.
COMPONENTS = {"click": "Z", "view": "H", "purchase": "1", "signup": "2", "error": "E"}
#: Gravity and constants of the response chain (fixed values).
G_DISPERSION, G_TERM, NEWTON, WATER = 9.79329, 9.8, 6.6743e-11, 1025.0
#: Layers that one task sorts.
TASK_ROWS = 250_000


def read_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, component, ts, v); column pruning and filters on ts and event type reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    component = F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv])[F.col("event_type")]
    return events.select(F.col("event_id").alias("sample_id"), component.alias("component"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


def read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("label").alias("station"), F.col("vec_id").alias("window_id"), F.col("embedding").cast("array<double>").alias("data"))


def layer_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the layers are dealt to: in proportion to their number, which the files' footers tell."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def read_layers(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """(model_id, layer_idx, thick, vs) from order lines: the layer key is the row's place in its order, since line numbers repeat.

    Models are dealt to ``tasks`` (``layer_tasks``), a stated number: sorts and sums of layers and of their cells take the memory
    of so many rows, whatever the size of the table.
    """
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = rows.repartition(tasks or layer_tasks(spark, sf_dir), "l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return rows.select(F.col("l_orderkey").alias("model_id"), place.alias("layer_idx"), (F.col("l_quantity") * 100).alias("thick"), (1000 + F.pmod(F.col("l_partkey"), F.lit(40)) * 100.0).alias("vs"))


def read_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain_id, iter, misfit, alpha) from orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.pmod("o_custkey", F.lit(10)).alias("chain_id"), F.col("o_orderkey").alias("iter"), F.col("o_totalprice").alias("misfit"))


def empty_samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "sample_id long, component string, ts timestamp, v double")


def save_by_station(df: DataFrame, path: str, *keys: str) -> None:
    """Partitioned sink; readers prune by the keys."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
