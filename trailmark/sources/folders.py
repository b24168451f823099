"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs in this process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root := root or tempfile.mkdtemp(prefix="trailmark-"))
    return root


def shared_folder(spark: SparkSession) -> str:
    return f"{_root(spark)}/derived-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that it outlives its executors, and read from there.

    A checkpoint would run the last stage twice, once to count and once to write, and be read with all its columns.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
