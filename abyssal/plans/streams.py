"""Queries on Structured Streaming: extensions, run over all files at hand and then ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..sources.traces import COMPONENTS
from ..streaming import windows as stream
from .registry import query
from .series import S


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    component = F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv])[F.col("event_type")]
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*").select(component.alias("component"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Windows that the watermark has closed, written by the stream and read back."""
    spark = df.sparkSession
    out = new_folder(spark, name)
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


_END = "(SELECT max(ts) - INTERVAL 2 HOUR FROM s)"


@query("stream_tumbling", f"WITH {S} SELECT component, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, avg(v) AS mean, sqrt(avg(v * v)) AS rms FROM s GROUP BY 1, 2 HAVING to_timestamp(floor(any_value(epoch(ts)) / 3600) * 3600 + 3600)::TIMESTAMP <= {_END}", "mean rms")
def _(spark, sf):
    out = _drain(stream.windowed_stats(_samples(spark, sf)), "tumbling")
    return out.select("component", F.floor(F.unix_seconds("w_start") / 3600).alias("hour"), "n", "mean", "rms")
