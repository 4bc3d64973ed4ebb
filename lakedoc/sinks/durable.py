"""Cutting lineage without losing data to a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which all machines share.

    Only a local session without that setting gets a temporary one. Nothing is set or
    changed in the session.
    """
    context = spark.sparkContext
    root = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lakedoc-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in a shared folder and read it from there."""
    folder = shared_folder(df.sparkSession, "durable")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
