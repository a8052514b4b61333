"""Tables that are kept for a while, by what they were made from."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a corpus and its vectors are kept.
CORPUS_SECONDS, VECTOR_SECONDS = 3_600, 86_400


def key_of(**options: object) -> str:
    """A key of a source's coordinates (sheet, columns, corpus signature, model), whatever their order."""
    told = "\0".join(f"{k}={options[k]}" for k in sorted(options))
    return hashlib.sha256(told.encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame], seconds: int = CORPUS_SECONDS, now: float | None = None) -> DataFrame:
    """What ``build`` gave for ``key`` in the last ``seconds``, else what it gives now, kept as Parquet in a shared folder.

    Where the folder can't be read or written, the table is built and not kept.  A version is written beside
    the others and counts once it is whole; versions that are out of date are deleted, but for the newest of
    them, which running queries may still read.
    """
    now = time.time() if now is None else now
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        held = sorted((int(s.getPath().getName().split("-")[0]), s.getPath()) for s in files.listStatus(path)) if files.exists(path) else []
        whole = [(made, p) for made, p in held if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        fresh = [p for made, p in whole if now - made < seconds]
        if fresh:
            return spark.read.parquet(fresh[-1].toString())
        for made, p in held[:-1]:
            if now - made >= seconds:
                files.delete(p, True)
        to = f"{folder}/{key}/{int(now)}-{uuid.uuid4().hex}"
        table = build()
        table.write.parquet(to)
        return spark.read.schema(table.schema).parquet(to)
    except Exception:  # by contract a cache that fails is passed over; a source that fails does so again below
        return build()
