"""Steps of an operator that are written once and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs in one process.
LOCAL_SHARED = "/tmp/checkpoints/shelfwise"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder the cluster shares and read it back: cuts lineage, survives lost executors.

    The step goes when the application ends.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "step")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
