"""Tables that a job writes on its way, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one of this machine, which serves local sessions only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{base.rstrip('/') if base else tempfile.mkdtemp(prefix='crawlsift-')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared folder, read again: what led to it is computed once, and survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
