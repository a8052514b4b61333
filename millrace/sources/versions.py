"""Versions of a corpus as trees of digests: what changed is found without comparing all rows.

A version is three tables: rows with the digests of their key and text, buckets of
rows by the leading digits of their key's digest, and tops of buckets.  Two versions
are compared from the tops down: only buckets under tops that differ are read, and
only rows of buckets that differ.  Vectors are computed again for changed rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sources.vectors import embedded

#: Hex digits of a key's digest that tell its bucket and its top: some 16 million and 65,536 of them.
BUCKET, TOP = 6, 4


def _joined(*by: str) -> Column:
    """The digest of a group's digests in the order of ``by``."""
    each = F.array_sort(F.collect_list(F.struct(*by, "digest")))
    return F.sha2(F.array_join(F.transform(each, lambda r: r["digest"]), "").cast("binary"), 256)


class Version:
    """The tables of one version in a folder: ``rows (key, bucket, digest)``, ``buckets (bucket, top, digest)``, ``tops (top, digest)``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def signature(self) -> str:
        """One digest of the whole version."""
        return self.table("tops").agg(_joined("top").alias("d")).first()["d"]


def keep(corpus: DataFrame, folder: str) -> Version:
    """Write the version of ``corpus (key, text)``; keys are unique, a null text is an empty one."""
    version = Version(corpus.sparkSession, folder)
    key, text = F.col("key").cast("string"), F.coalesce("text", F.lit(""))
    # the key's length stands before it, so that key and text are told apart
    own = F.sha2(F.concat(F.length(key).cast("string"), F.lit(":"), key, text).cast("binary"), 256)
    rows = corpus.select("key", F.left(F.sha2(key.cast("binary"), 256), F.lit(BUCKET)).alias("bucket"), own.alias("digest"))
    rows.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{folder}/rows")
    buckets = version.table("rows").groupBy("bucket").agg(_joined("key").alias("digest"))
    buckets.select("bucket", F.left("bucket", F.lit(TOP)).alias("top"), "digest").write.mode("overwrite").parquet(f"{folder}/buckets")
    version.table("buckets").groupBy("top").agg(_joined("bucket").alias("digest")).write.mode("overwrite").parquet(f"{folder}/tops")
    return version


def _differing(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """``by`` and both digests where these differ or one is missing."""
    a, b = old.select(by, F.col("digest").alias("_old")), new.select(by, F.col("digest").alias("_new"))
    return a.join(b, by, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))


def changes(old: Version, new: Version) -> DataFrame:
    """``key, change`` (``added``, ``removed`` or ``changed``) of the rows that differ."""
    tops = _differing(old.table("tops"), new.table("tops"), "top").select("top")
    under = lambda v: v.table("buckets").join(F.broadcast(tops), "top", "left_semi")  # at most 16^TOP tops
    buckets = _differing(under(old), under(new), "bucket").select("bucket")
    within = lambda v: v.table("rows").join(buckets, "bucket", "left_semi")
    told = _differing(within(old), within(new), "key")
    return told.select("key", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))


def refreshed(vectors: DataFrame, texts: DataFrame, changed: DataFrame, provider: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``key, v`` of a new version: the old ``vectors`` of rows that stay, and new ones of the changed and added ``texts``."""
    stay = vectors.select("key", "v").join(changed, "key", "left_anti")
    return stay.unionByName(embedded(texts.join(changed.where("change <> 'removed'"), "key", "left_semi"), provider))
