"""Intermediate tables written once: later plans read files instead of computing a long lineage again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        folder = "/tmp/checkpoints/lexiquarry"
    return folder.rstrip("/")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written as Parquet and read back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
