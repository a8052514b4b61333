"""Helpers that every operator of this package uses."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace import packages

#: Words are maximal runs of anything but these six characters (fixed by the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: bounds what a Python worker holds when texts are long.
ARROW_ROWS = 1024


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


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, until the application ends, and read it back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    The event queues hold the last query's plan until another query ends, so a trivial one goes first.
    """
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give the executors this package and bound the rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    packages.ship(spark)


#: Keys that a join broadcasts as hot, at most, and rows under which no key is hot.
HOT_KEYS, HOT_ROWS = 20_000, 100_000


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join with a table that has one row a key and tells in ``weight`` how many rows have it; ``weight`` itself is left out.

    Keys that hold more than 1 / ``HOT_KEYS`` of all rows are fewer than ``HOT_KEYS`` by that, so their facts are
    broadcast and their rows stay where they are; only the other rows are dealt out by key.
    """
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.where(F.col(weight) > least)
    if hot.isEmpty():
        return rows.join(facts.drop(weight), on, how)
    hot = F.broadcast(hot.drop(weight))
    others = rows.join(hot.select(*on), on, "left_anti").join(facts.where(F.col(weight) <= least).drop(weight), on, how)
    return rows.join(hot, on).unionByName(others)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def digest(column: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or ``wanted`` with as many underscores as avoid a clash (case-insensitively)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
