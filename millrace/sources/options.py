"""Options by precedence: session settings, then the environment, then defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

PREFIX = "spark.millrace."
#: How many judge calls run at once.
DEFAULT_WORKERS = 6


def option(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """``spark.millrace.<name>``, else ``MILLRACE_<NAME>``, else the default; blank values don't count."""
    for value in (spark.conf.get(PREFIX + name, None), os.environ.get("MILLRACE_" + name.upper().replace(".", "_"))):
        if value is not None and value.strip():
            return value.strip()
    return default


def workers(asked: str | int | None, checks: int) -> int:
    """A number of workers within 1 and the number of checks; the default for what is no number."""
    try:
        wanted = int(asked) if asked is not None else DEFAULT_WORKERS
    except ValueError:
        wanted = DEFAULT_WORKERS
    return max(1, min(wanted, max(1, checks)))
