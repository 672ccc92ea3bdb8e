"""Error reviews, ablation summaries, checksums of runs, and the audit after extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_mismatches(predictions: DataFrame, review: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, reason): every misprediction must be listed once, and every listed error be one, with equal values."""
    wrong = predictions.filter(F.col("true_label") != F.col("predicted_label")).select(key, F.col("true_label").alias("t0"), F.col("predicted_label").alias("p0"), F.lit(True).alias("here"))
    listed = review.groupBy(key).agg(F.count("*").alias("n"), F.first("true_label").alias("t1"), F.first("predicted_label").alias("p1"))
    j = wrong.join(listed, key, "full_outer")
    reason = (
        F.when(F.col("here").isNull(), "not an error").when(F.col("n").isNull(), "not listed").when(F.col("n") > 1, "listed twice")
        .when((F.col("t0") != F.col("t1")) | (F.col("p0") != F.col("p1")), "values differ")
    )
    return j.withColumn("reason", reason).filter("reason is not null").select(key, "reason")


def group_summary(ablation: DataFrame, whole: str = "all_enabled") -> DataFrame:
    """Ablation rows with their test metrics less those of the row of all features."""
    base = ablation.filter(F.col("feature_group") == whole).select("test_f1", "test_accuracy").first() or (None, None)
    less = {f"delta_{k}": F.col(f"test_{k}") - F.lit(v).cast("double") for k, v in zip(("f1", "accuracy"), base, strict=True)}
    return ablation.withColumns(less)


def reuse_checksums(predictions: DataFrame, earlier: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions with the input checksums of an earlier run over the same samples; raises if the runs differ."""
    from pixelmill.operators.dedup import compare_runs

    bad = compare_runs(predictions, earlier, key, "score", "true_label").limit(5).collect()
    if bad:
        raise ValueError(f"runs differ: {[(r[0], r[1]) for r in bad]}")
    sums = earlier.select(key, F.col("input_sha256").alias("__sha"))
    out = predictions.join(sums, key, "left")
    if not out.filter(~F.coalesce(F.col("__sha").rlike("^[0-9a-f]{64}$"), F.lit(False))).isEmpty():
        raise ValueError("checksums of the earlier run are incomplete")
    return out.withColumn("input_sha256", F.col("__sha")).drop("__sha")


def extraction_audit(images: DataFrame, long_: DataFrame, label: str = "label", key: str = "sample_id") -> dict[str, DataFrame]:
    """Tables after extraction: unavailable features, regions per class, terciles of the mean region count per class."""
    failed = long_.filter("status <> 'ok'").groupBy("feature", "reason").agg(F.count("*").alias("n"))
    per = images.join(long_.groupBy(key).agg(F.count_distinct("region_id").alias("regions")), key, "left").withColumn("regions", F.coalesce("regions", F.lit(0)))
    from pixelmill.operators.profiles import terciles

    return {"failed": failed, "regions": per.groupBy(label, "regions").agg(F.count("*").alias("n")), "terciles": terciles(per, "regions", label)}
