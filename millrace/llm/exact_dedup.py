"""Exact deduplication by stateful streaming, with DataFrame operations only.

The rows' digests stream through a keyed aggregation whose state lives in
RocksDB on the executors' disks and never expires.  Per digest it retains the
stable identifier and the content locator (file and row) of the row that stays,
and how many rows it has seen; a hot digest is combined before the shuffle, so
it costs one row per task.  Each row whose digest was seen more than once is then
checked against the full bytes of the row that stays; rows under a digest with
any difference are grouped anew by their whole text.  Digests that very many
rows have are broadcast to them and not dealt out.

With a ``state`` folder the state outlives the call: a later batch is held
against all that came before, in the same or another application.  The texts of
earlier rows are not kept a second time; where bytes are to be compared, they
are read through their locators from the files that they came from, which must
still be there.  A row of an earlier batch is not told again when a later one
with a larger identifier takes its place.

Edge cases: a null text counts as empty and equals an empty one; of rows with
the same largest identifier the last in row order stays, so repeated rows leave
one; null identifiers are smaller than all others; an empty table gives an
empty result; extra columns don't matter and their names may clash with ours.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._shared import digest, join_hot, materialize, scratch, text_or_empty, until_exit

#: Fixed settings of the state: on disk, with a bound on native memory per executor; stores of ended queries are let go soon.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _retained(rows: DataFrame, place: str, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """This batch's rows and all rows as written, and ``_digest, _keeper struct<_id, _row, _file, _batch>, _size`` of this batch's digests through the stream's state."""
    spark = rows.sparkSession
    source, keeper = f"{place}/digests", F.struct("_id", "_row", "_file", "_batch")
    rows = rows.withColumn("_batch", F.lit(batch))
    rows.write.mode("append").parquet(source)
    every = spark.read.schema(rows.schema).parquet(source)
    kept = every.where(F.col("_batch") == batch)
    if kept.isEmpty():
        return kept, every, kept.groupBy("_digest").agg(F.max(keeper).alias("_keeper"), F.count(F.lit(1)).alias("_size"))
    stream = spark.readStream.schema(rows.schema).parquet(source)
    state = stream.groupBy("_digest").agg(F.max(keeper).alias("_keeper"), F.count(F.lit(1)).alias("_size"))

    def keep(told: DataFrame, epoch: int) -> None:
        told.write.mode("overwrite").parquet(f"{place}/out/{batch}/epoch={epoch}")

    with _settings(spark, STATE):
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(keep).start()
        query.awaitTermination()
    out = spark.read.schema(state.schema).parquet(f"{place}/out/{batch}")
    # a digest is told again in each later step that adds to it; both columns only grow
    return kept, every, materialize(out.groupBy("_digest").agg(F.max("_keeper").alias("_keeper"), F.max("_size").alias("_size")), "state")


def _fetched(spark: SparkSession, located: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_digest, _id, _text`` of earlier rows, read through their locators; the driver holds no more than the files' names."""
    files = [r["_file"] for r in located.select("_file").distinct().collect()]
    if not all(files):
        raise ValueError("rows of an earlier batch came from no file, so their texts can't be compared")
    rows = located.select("_digest", "_id", "_file").distinct()
    if not files:
        return rows.select("_digest", "_id", F.lit("").alias("_text"))
    read = spark.read.parquet(*files).select(F.input_file_name().alias("_file"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    read = read.withColumn("_digest", F.unhex(digest(F.col("_text"))))
    same = (read["_file"] == rows["_file"]) & read["_id"].eqNullSafe(rows["_id"]) & (read["_digest"] == rows["_digest"])
    return rows.join(read, same).select(rows["_digest"], rows["_id"], "_text")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` of every row, dropped ones too; against earlier batches if there is a ``state`` folder."""
    spark, batch = docs.sparkSession, uuid.uuid4().hex
    place = state.rstrip("/") if state else f"{scratch(spark)}/millrace/state-{batch}"
    text = text_or_empty(text_col)
    binary = F.unhex(digest(text))
    rows, every, told = _retained(docs.select(binary.alias("_digest"), F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.input_file_name().alias("_file")), place, batch)
    if not state:
        until_exit(spark, place)
    # the full bytes of every hit against those of the row that stays; only hits are kept from the one pass over the texts
    several = told.where("_size > 1")
    hits = join_hot(docs.select(binary.alias("_digest"), F.col(id_col).alias("_id"), text.alias("_text")), several.select("_digest", F.col("_keeper._id").alias("_keep"), (F.col("_keeper._batch") == batch).alias("_here"), "_size"), ["_digest"], "_size")
    hits = materialize(hits, "hits")
    # written on their own, so that a hot digest's hits meet their one keeper without being dealt out
    keepers = hits.where(F.col("_here") & F.col("_id").eqNullSafe(F.col("_keep"))).select("_digest", F.col("_text").alias("_kept_text"))
    earlier = several.where(F.col("_keeper._batch") != batch).select("_digest", "_keeper.*") if state else None
    if state:
        keepers = keepers.unionByName(_fetched(spark, earlier, id_col, text_col).select("_digest", F.col("_text").alias("_kept_text")))
    keepers = keepers.dropDuplicates(["_digest"]).join(several.select("_digest", "_size").hint("shuffle_hash"), "_digest")
    wrong = materialize(join_hot(hits.select("_digest", "_text"), materialize(keepers, "keepers"), ["_digest"], "_size").where("_text != _kept_text").select("_digest"), "collisions").distinct()
    facts = told.select("_digest", F.col("_keeper._id").alias("_keep"), F.col("_keeper._row").alias("_keep_row"), (F.col("_keeper._batch") == batch).alias("_here"), F.col("_size").alias("_weight"), "_size")
    result = join_hot(rows, facts, ["_digest"], "_weight").select("_digest", "_id", "_keep", "_size", (F.col("_here") & (F.col("_row") == F.col("_keep_row"))).alias("_kept"))
    if not wrong.isEmpty():  # two texts under one digest: their rows are grouped by the text itself
        by_text = Window.partitionBy("_digest", "_text")
        under = hits.join(wrong, "_digest", "left_semi").select("_digest", "_id", "_text", F.lit(True).alias("_new"))
        if state:
            before = _fetched(spark, every.where(F.col("_batch") != batch).join(wrong, "_digest", "left_semi"), id_col, text_col)
            under = under.unionByName(before.withColumn("_new", F.lit(False)))
        odd = under.select("_digest", "_id", F.max("_id").over(by_text).alias("_keep"), F.count(F.lit(1)).over(by_text).alias("_size"), (F.row_number().over(by_text.orderBy(F.desc("_id"), "_new")) == 1).alias("_kept"), "_new")
        result = result.join(wrong, "_digest", "left_anti").unionByName(odd.where("_new").drop("_new"))
    return result.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    told = dedup(docs, id_col, text_col)
    stay = told.groupBy("text_sha256", id_col).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).where("_kept")
    stay = stay.select(F.col("text_sha256").alias("_sha"), F.col(id_col).alias("_stay"), "_rows")
    names = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct("*").alias("_doc"), digest(text_or_empty(text_col)).alias("_sha"))
    rows = rows.join(stay.hint("shuffle_hash"), (rows["_sha"] == stay["_sha"]) & F.col(f"_doc.`{id_col}`").eqNullSafe(F.col("_stay"))).select("_doc", stay["_sha"].alias("_sha"), "_stay", "_rows")
    # rows that repeat the one that stays, identifier and all, leave one
    single, repeated = rows.where("_rows = 1"), rows.where("_rows > 1").dropDuplicates(["_sha", "_stay"])
    return single.unionByName(repeated).select(*names)
