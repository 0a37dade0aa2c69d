"""Folders of files that each hold one channel of one interval, opened only where their names say they are wanted.

A file is named ``NETWORK.STATION.CHANNEL.START.END.parquet``, the times as ``YYYYMMDDThhmmss`` in UTC, the end not included.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = r"^([^.]+)\.([^.]+)\.([^.]+)\.(\d{8}T\d{6})\.(\d{8}T\d{6})\.parquet$"
_TIME = "yyyyMMdd'T'HHmmss"
SCHEMA = "ts timestamp, v double"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, network, station, channel, t_start, t_end) of a folder's interval files, by Spark's own listing: any store that Spark reads.  Other names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.regexp_extract(name, _NAME, i)
    rows = files.where(name.rlike(_NAME)).select("path", part(1).alias("network"), part(2).alias("station"), part(3).alias("channel"), F.to_timestamp(part(4), _TIME).alias("t_start"), F.to_timestamp(part(5), _TIME).alias("t_end"))
    return rows


def wanted(spark: SparkSession, folder: str, station: str | None = None, channel: str | None = None, start: datetime | None = None, end: datetime | None = None) -> list[str]:
    """The files that may hold samples of the station and channel in [start, end): names alone are looked at."""
    rows = listed(spark, folder)
    for column, value in (("station", station), ("channel", channel)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if end is None else rows.where(F.col("t_start") < F.lit(end))
    rows = rows if start is None else rows.where(F.col("t_end") > F.lit(start))
    return sorted(r.path for r in rows.select("path").collect())  # names of the files that are read, which the driver plans anyway


def read_intervals(spark: SparkSession, folder: str, station: str | None = None, channel: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """(network, station, channel, component, ts, v, file_name) in [start, end): a day's samples open a day's files.

    The component is the last letter of the channel.  A folder without files that are wanted gives an empty table.
    """
    paths = wanted(spark, folder, station, channel, start, end)
    schema = T._parse_datatype_string(SCHEMA)
    if not paths:
        return spark.createDataFrame([], "network string, station string, channel string, component string, ts timestamp, v double, file_name string")
    rows = spark.read.schema(schema).parquet(*paths).select("ts", "v", F.col("_metadata.file_name").alias("file_name"))
    part = lambda i: F.regexp_extract("file_name", _NAME, i)
    rows = rows.select(part(1).alias("network"), part(2).alias("station"), part(3).alias("channel"), F.substring(part(3), -1, 1).alias("component"), "ts", "v", "file_name")
    rows = rows if end is None else rows.where(F.col("ts") < F.lit(end))
    return rows if start is None else rows.where(F.col("ts") >= F.lit(start))


def write_intervals(samples: DataFrame, folder: str, hours: int = 24) -> None:
    """``samples`` (network, station, channel, ts, v) as one file a channel and interval of so many hours, without a shuffle of more than the samples' own.

    Spark writes partitioned folders; the files are then named after their interval by moves within the folder.
    """
    spark = samples.sparkSession
    slot = F.floor(F.unix_seconds("ts") / (hours * 3600))
    staged = f"{folder}/_staged"
    dealt = samples.withColumn("_slot", slot).repartition("network", "station", "channel", "_slot").sortWithinPartitions("network", "station", "channel", "_slot", "ts")
    dealt.write.partitionBy("network", "station", "channel", "_slot").parquet(staged)
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(staged)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        keys = dict(x.split("=", 1) for x in path.toString().split("/") if "=" in x)
        if "_slot" in keys:
            a, b = (datetime.fromtimestamp((int(keys["_slot"]) + i) * hours * 3600, UTC).strftime("%Y%m%dT%H%M%S") for i in (0, 1))
            name = f"{keys['network']}.{keys['station']}.{keys['channel']}.{a}.{b}.parquet"
            if not fs.rename(path, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")):
                raise OSError(f"can't name {name}")
    fs.delete(top, True)
