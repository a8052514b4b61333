"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; the archive is made on the driver and fetched from it."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_shipped.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._millrace_shipped = True
