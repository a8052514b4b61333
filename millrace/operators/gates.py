"""Gates over issues, matches and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def structure_ok(issues: DataFrame, bundles: DataFrame) -> DataFrame:
    """``bundle_id, structure_pass, static_pass, issues`` of every bundle, those without issues too."""
    critical = (F.col("severity") == "CRITICAL") & F.col("message").startswith("Missing ")
    severe = F.col("severity").isin("CRITICAL", "HIGH")
    folded = issues.groupBy("bundle_id").agg(F.bool_or(critical).alias("_c"), F.bool_or(severe).alias("_s"), F.count(F.lit(1)).alias("_n"))
    out = bundles.select("bundle_id").distinct().join(folded, "bundle_id", "left")
    return out.select("bundle_id", (~F.coalesce("_c", F.lit(False))).alias("structure_pass"), (~F.coalesce("_s", F.lit(False))).alias("static_pass"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_issues"))


def gated(bundles: DataFrame, static: DataFrame, rubric: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All gates of every bundle: ``structure_pass, static_pass, rubric_pass, similarity_pass, llm_pass, overall_pass, n_issues``.

    The static gate is over static and rubric issues; similarity fails on any flagged match (``hits`` by ``q_key``).
    """
    severe = F.col("severity").isin("CRITICAL", "HIGH")
    both = structure_ok(static.select("bundle_id", "severity", "message").unionByName(rubric.select("bundle_id", "severity", "message")), bundles)
    rubrics = rubric.groupBy("bundle_id").agg((~F.bool_or(severe)).alias("rubric_pass"))
    similar = hits.groupBy(F.col("q_key").alias("bundle_id")).agg((~F.coalesce(F.bool_or("flagged"), F.lit(False))).alias("similarity_pass"))
    out = both.join(rubrics, "bundle_id", "left").join(similar, "bundle_id", "left").join(llm_pass(verdicts).select("bundle_id", "llm_pass"), "bundle_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(True)) for c in ("rubric_pass", "similarity_pass")})
    return out.withColumn("overall_pass", overall(~F.col("similarity_pass"), *(F.col(c) for c in ("structure_pass", "rubric_pass", "llm_pass", "similarity_pass", "static_pass"))))


def overall(blocked: Column, structure: Column, rubric: Column, llm: Column, similar: Column, static: Column) -> Column:
    """All gates hold; a judge that did not run (null) doesn't fail."""
    return ~blocked & structure & rubric & F.coalesce(llm, F.lit(True)) & similar & static


def llm_pass(verdicts: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``key, rejects, needs_work, errors, ran, llm_pass``: only REJECT and NEEDS_WORK fail; null where no check ran."""
    ran = F.col("verdict") != "SKIPPED"
    rejects, needs = F.count_if(F.col("verdict") == "REJECT"), F.count_if(F.col("verdict") == "NEEDS_WORK")
    out = verdicts.groupBy(key).agg(rejects.alias("rejects"), needs.alias("needs_work"), F.count_if(F.col("verdict") == "ERROR").alias("errors"), F.count_if(F.coalesce(ran, F.lit(True)) & F.col("check_key").isNotNull()).alias("ran"))
    return out.withColumn("llm_pass", F.when(F.col("ran") > 0, (F.col("rejects") == 0) & (F.col("needs_work") == 0)))
