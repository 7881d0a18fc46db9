"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir. Only a session on one machine may leave that unset; it gets a temporary folder."""
    if not (folder := spark.sparkContext.getCheckpointDir()):
        if not (chosen := spark.conf.get("spark.checkpoint.dir", None)):
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            chosen = tempfile.mkdtemp(prefix="duoply-")
        spark.sparkContext.setCheckpointDir(chosen)
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and the same whatever is lost later."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
