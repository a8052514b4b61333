"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(context, "_millrace_scratch", None)
        if not folder:
            folder = context._millrace_scratch = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return folder.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> None:
    """Have an intermediate folder deleted when the application ends, as results may read it until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder per value of ``by``, until the application ends, and read it back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that nothing refers to any more; the last plan is held until another query ends."""
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark._jvm.System.gc()
