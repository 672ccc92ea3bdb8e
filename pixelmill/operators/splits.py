"""Group-aware splits: folds over group counts, chosen near a target size and label share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_fold(df: DataFrame, fold: str, label: str, target: float) -> DataFrame:
    """The fold with the least |rows share - target| + sum over labels of |share of the label's rows - target|, then the lowest."""
    cells = df.groupBy(F.col(fold).alias("fold"), F.col(label).alias("label")).agg(F.count("*").alias("c"))
    whole = cells.groupBy("label").agg(F.sum("c").alias("all_n"))
    folds = cells.select("fold").distinct()
    grid = folds.crossJoin(F.broadcast(whole)).join(cells, ["fold", "label"], "left")  # folds x labels, a handful of rows
    share = lambda of, all_: F.abs(F.coalesce(F.sum(of), F.lit(0)) / F.greatest(F.sum(all_), F.lit(1)) - F.lit(target))
    off = F.sum(F.abs(F.coalesce("c", F.lit(0)) / F.greatest("all_n", F.lit(1)) - F.lit(target)))
    g = grid.groupBy("fold").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (share("c", "all_n") + off).alias("loss"))
    return g.orderBy(F.round("loss", 12), "fold").limit(1)


def with_folds(df: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """Add fold: groups of one label in hashed order go round the folds, so labels stay balanced and groups whole.

    Groups are ranked inside hash ranges with exact counts of the ranges before, not in one window.
    """
    g = df.groupBy(group).agg(F.min(label).alias("__label"))
    h = F.xxhash64(group, F.lit(seed))
    parts = 256
    g = g.withColumn("__part", F.pmod(h, F.lit(parts)).cast("int")).withColumn("__h", h)
    sizes = g.groupBy("__label", "__part").agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy("__label").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__label", "__part", before.alias("__before"))
    n = F.row_number().over(Window.partitionBy("__label", "__part").orderBy("__h", group)) - 1
    g = g.withColumn("__n", n).join(sizes, ["__label", "__part"]).select(group, F.pmod(F.col("__n") + F.col("__before"), F.lit(folds)).cast("int").alias("fold"))
    return df.join(g, group)


def _folds(df: DataFrame, group: str, label: str, most: int, fewest: int) -> int:
    """At most ``most`` folds, no more than a label has rows (and at least two where groups allow it); raises below ``fewest``."""
    r = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("rows")).first()  # a row for each label
    groups = df.select(group).distinct().limit(most).count()
    n = min(most, max(2, groups, r["rows"]), r["rows"])
    if n < fewest:
        raise ValueError("not enough rows of a label for a split by groups")
    return n


def group_split(df: DataFrame, group: str, label: str, seed: int, least: int = 12, sha: str | None = None) -> DataFrame:
    """Add split: test is the best of at most seven folds near 0.15, validation the best of six of the rest, else train.

    Raises for too few rows, for groups with more than one label, for repeated checksums (``sha``), and if a
    split lacks a label.
    """
    if sha is not None and not df.groupBy(sha).count().filter("count > 1").isEmpty():
        raise ValueError("exact duplicates have to be resolved before splitting")
    if df.limit(least).count() < least:
        raise ValueError(f"splitting needs at least {least} rows")
    mixed = df.groupBy(group).agg(F.count_distinct(label).alias("k")).filter("k > 1")
    if not mixed.isEmpty():
        raise ValueError("groups with more than one label")
    first = with_folds(df, group, label, _folds(df, group, label, 7, 3), seed)
    t = best_fold(first, "fold", label, 0.15).first()["fold"]
    others = first.filter(F.col("fold") != t).drop("fold")
    rest = with_folds(others, group, label, _folds(others, group, label, 6, 2), seed + 1)
    v = best_fold(rest, "fold", label, 0.15 / 0.85).first()["fold"]
    names = F.when(F.col("fold") == v, "validation").otherwise("train")
    out = rest.withColumn("split", names).drop("fold").unionByName(first.filter(F.col("fold") == t).drop("fold").withColumn("split", F.lit("test")))
    labels = df.select(label).distinct().count()
    lacking = out.groupBy("split").agg(F.count_distinct(label).alias("k")).filter(F.col("k") < max(2, labels))
    if out.select("split").distinct().count() < 3 or not lacking.isEmpty():
        raise ValueError("a split does not contain both labels")
    return out
