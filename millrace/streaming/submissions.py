"""Search of submissions as they arrive: an extension for streams of the batch search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import search


def watch(submissions: DataFrame, corpus: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Search each micro-batch of ``submissions (key, text)`` and write its matches under its batch number.

    A batch that is run again after a failure overwrites its own folder, so every submission is told once.
    """

    def search_batch(batch: DataFrame, number: int) -> None:
        search.dice_topk(batch, corpus).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return submissions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(search_batch).start()
