"""Bundles of text files from zip archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as T

#: Names that archives carry along and that don't count.
IGNORED = [".DS_Store", "__MACOSX"]


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """``bundle_id, zip_name, path, content`` of every text file of the archives under ``path``.

    An archive that can't be read gives one row with a null path whose content says why, so that it ends no job.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.infolist():
                            if not entry.is_dir():
                                out.append((name, entry.filename, z.read(entry).decode("utf-8", "replace")))
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                    out = [(name, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["zip_name", "path", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = files.mapInPandas(unpack, "zip_name string, path string, content string")
    return rows.withColumn("bundle_id", T.stem_or(F.col("zip_name"), F.lit(""))).select("bundle_id", "zip_name", "path", "content")


def flattened(files: DataFrame) -> DataFrame:
    """Hoist the files of a bundle whose root holds one folder and nothing else; one level only."""
    top = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    counted = ~top.isin(IGNORED)
    folder = F.contains(F.col("path"), F.lit("/"))
    roots = files.groupBy("bundle_id").agg(F.count_distinct(F.when(counted, top)).alias("_tops"), F.coalesce(F.bool_and(F.when(counted, folder)), F.lit(False)).alias("_folders"))
    inner = F.regexp_replace("path", "^[^/]*/", "")
    out = files.join(roots, "bundle_id").withColumn("path", F.when((F.col("_tops") == 1) & F.col("_folders") & counted, inner).otherwise(F.col("path")))
    return out.drop("_tops", "_folders")
