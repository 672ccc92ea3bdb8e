"""Counts, cross-tables, quality profiles and class summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.evaluation import quantiles


def cross_table(df: DataFrame, label: str, dims: list[str]) -> DataFrame:
    """(dimension, value, label, n) for several dimensions in one grouping-sets pass."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims))
    return df.select(F.col(label).alias("label"), F.inline(cells)).groupBy("dimension", "value", "label").agg(F.count("*").alias("n"))


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features))
    return df.select(*keys, F.inline(cells))


def quality_profile(df: DataFrame, features: list[str], split: str, label: str) -> DataFrame:
    """Per feature (level all), split and label: rows, nulls, non-finite, least, greatest, distinct finite values, constant."""
    long_ = unpivot(df, [split, label], features)
    fin = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    g = F.grouping_id()
    out = long_.groupingSets([["feature"], ["feature", split], ["feature", label]], "feature", split, label).agg(
        g.alias("gid"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count_if(F.col("value").isNotNull() & fin.isNull()).alias("nonfinite"), F.min(fin).alias("least"), F.max(fin).alias("greatest"),
        F.count_distinct(fin).alias("unique_values"),
    )
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "split").otherwise("label")
    member = F.when(F.col("gid") == 1, F.col(split).cast("string")).when(F.col("gid") == 2, F.col(label).cast("string"))
    return out.select("feature", level.alias("level"), member.alias("member"), "n", "nulls", "nonfinite", "least", "greatest", "unique_values", (F.col("unique_values") <= 1).alias("constant"))


def flag_histogram(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def terciles(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, bucket, n): low, medium, high by exact thirds over all rows; nulls are unavailable."""
    q = quantiles(df, value, [], [1 / 3, 2 / 3]).first() or [None, None]
    v = F.col(value)
    bucket = F.when(v.isNull(), "unavailable").when(v <= F.lit(q[0]), "low").when(v <= F.lit(q[1]), "medium").otherwise("high")
    return df.select(F.col(by), bucket.alias("bucket")).groupBy(by, "bucket").agg(F.count("*").alias("n"))


def class_summary(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, feature): count, least, greatest, mean, median, IQR, missing rate."""
    long_ = unpivot(df, [label], features)
    q = quantiles(long_, "value", [label, "feature"], [0.25, 0.5, 0.75]).select(F.col(label).alias("__l"), F.col("feature").alias("__f"), "q0", "q1", "q2")
    per = long_.groupBy(label, "feature").agg(
        F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean"),
        F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"),
    )
    out = per.join(q, F.col(label).eqNullSafe(F.col("__l")) & (F.col("feature") == F.col("__f")), "left")
    return out.select(label, "feature", "n", "least", "greatest", "mean", F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("iqr"), "missing_rate")


def class_separation(df: DataFrame, label: str, dims: list[str]) -> DataFrame:
    """(dimension, separated): both classes have values and share none."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims))
    values = df.select(F.col(label).alias("label"), F.inline(cells)).filter("value is not null").distinct()
    per = values.groupBy("dimension", "value").agg(F.count_distinct("label").alias("k"), F.min("label").alias("lo"))
    out = per.groupBy("dimension").agg(F.max("k").alias("most"), F.count_distinct(F.when(F.col("k") == 1, F.col("lo"))).alias("kinds"))
    return out.select("dimension", ((F.col("most") == 1) & (F.col("kinds") > 1)).alias("separated"))


def audit(df: DataFrame, expected: dict[str, int], label: str) -> DataFrame:
    """(label, n, expected, ok): counts of each class against what the configuration wants."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "label string, expected long")
    n = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return want.join(n, "label", "full_outer").select("label", F.coalesce("n", F.lit(0)).alias("n"), "expected", F.coalesce("n", F.lit(0)).eqNullSafe(F.col("expected")).alias("ok"))
