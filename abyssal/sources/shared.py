"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` (or the context's checkpoint folder) with its scheme, as every library names it.

    A temporary folder is set only in local mode, where driver and tasks are one process; a cluster without the setting
    is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="abyssal-"))
        top = context.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = full.partition(":")
    return (full if rest.startswith("//") else f"{scheme}://{rest}").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table that several steps read, written to the shared folder and read back: it is computed once, and its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
