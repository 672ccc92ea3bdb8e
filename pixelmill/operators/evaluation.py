"""Metrics, thresholds, rank statistics and contributions, as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 100_000  # ranges of all pairs of columns together: their cuts and totals are broadcast


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp and their ratios; 1 is positive, a division by zero gives 0."""
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p))
    out = df.groupBy(*(by or [])).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return out.withColumns({"accuracy": ratio(tn + tp, tn + fp + fn + tp), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f_score(tp, fp, fn)})


def threshold_sweep(df: DataFrame, label: str, score: str, default: float) -> DataFrame:
    """(threshold, tp, fp, fn, precision, f1) at every finite score and the default; score >= threshold is positive.

    Scores are aggregated first; the cumulative counts come from exact counts of ranges of scores, so
    no task holds all scores.
    """
    s = F.col(score)
    rows = df.filter(s.isNotNull() & ~F.isnan(s)).groupBy(s.alias("threshold")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"))
    rows = rows.unionByName(df.sparkSession.createDataFrame([(float(default), 0, 0)], "threshold double, pos long, n long")).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    out = running_totals(rows, "threshold", ["pos", "n"], descending=True)
    total = df.agg(F.coalesce(F.sum(F.when(~F.isnan(s), F.col(label))), F.lit(0)).alias("t")).first()["t"]
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    fn = F.lit(total) - tp
    out = out.filter(F.abs("threshold") < float("inf"))
    return out.select("threshold", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), ratio(tp, tp + fp).alias("precision"), f_score(tp, fp, fn).alias("f1"))


def running_totals(df: DataFrame, key: str, values: list[str], descending: bool = False, ranges: int | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Add cum_<v>: the sum over keys up to and including this one, within ``by``, without a window over a whole column.

    Keys are cut at approximate quantiles of each ``by``; exact totals of the ranges before (a row for each range)
    are added to a window inside each range. Where a key belongs is a binary search in its array of cuts.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10000))).alias("__cuts"))
    steps = F.array(*(F.lit(1 << b) for b in range(max(1, n).bit_length(), -1, -1)))
    below = lambda at, step: F.coalesce(F.get(F.col("__cuts"), at + step - 1) < F.col(key), F.lit(False))
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))
    df = (df.join(F.broadcast(cuts), by) if by else df.crossJoin(F.broadcast(cuts))).withColumn("__part", part).drop("__cuts")  # a row for each ``by``
    w = Window.partitionBy(*by, "__part").orderBy(F.col(key).desc() if descending else F.col(key))
    sums = df.groupBy(*by, "__part").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    order = Window.partitionBy(*by).orderBy(F.col("__part").desc() if descending else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__part", *(F.coalesce(F.sum(f"__t_{v}").over(order), F.lit(0)).alias(f"__b_{v}") for v in values))
    out = df.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values}).join(F.broadcast(before), [*by, "__part"])
    return out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"__b_{v}") for v in values}).drop("__part", *(f"__b_{v}" for v in values))


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation; nulls don't count, groups without values have no row.

    Distinct values are counted and their running totals taken range by range, so no task holds a group's values.
    Groups (null keys are one) have to be few: a row of each is broadcast.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0))
    counts = df.filter(F.col(value).isNotNull()).groupBy(group.alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("k"))
    totals = counts.groupBy("__g").agg(F.sum("k").alias("n"))
    c = running_totals(counts, "__v", ["k"], by=["__g"]).join(F.broadcast(totals), "__g")
    at = [(F.col("n") - 1) * p for p in shares]
    first = lambda i: F.min(F.when(F.col("cum_k") > i, F.col("__v")))
    ends = [e for i, a in enumerate(at) for e in (first(F.floor(a)).alias(f"lo{i}"), first(F.ceil(a)).alias(f"hi{i}"))]
    out = c.groupBy("__g", "n").agg(*ends)
    between = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (a - F.floor(a))).alias(f"q{i}") for i, a in enumerate(at)]
    return out.select(*(F.col(f"__g.{b}").alias(b) for b in by), *between)


def best_threshold(df: DataFrame, label: str, score: str, default: float) -> DataFrame:
    """The threshold of the greatest F1, then precision, then nearness to the default, then value."""
    sweep = threshold_sweep(df, label, score, default)
    best = sweep.orderBy(F.desc("f1"), F.desc("precision"), F.asc(F.abs(F.col("threshold") - default)), F.desc("threshold")).limit(1)
    none = F.col("f1") <= 0
    return best.select(
        F.when(none, F.lit(float(default))).otherwise(F.col("threshold")).alias("threshold"), "f1", "precision",
        F.when(none, "estimator_default_no_validation_signal").otherwise("validation_f1").alias("method"),
    )


def average_ranks(df: DataFrame, value: str, by: list[str], ranges: int | None = None) -> DataFrame:
    """Add rank: the mean rank of equal values within ``by``, from running counts of distinct values; null values have none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranks = running_totals(counts, value, ["__n"], ranges=ranges, by=by).select(*by, value, (F.col("cum___n") - (F.col("__n") - 1) / 2).alias("rank"))
    return df.join(ranks, [*by, value], "left")


def cliffs_delta(long_: DataFrame, label: str = "label") -> DataFrame:
    """(feature, delta) of class 1 against class 0 from rank sums."""
    v = long_.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    r = average_ranks(v, "value", ["feature"])
    g = r.groupBy("feature").agg(
        F.sum(F.when(F.col(label) == 1, F.col("rank"))).alias("r1"), F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )
    n1, n0 = F.col("n1"), F.col("n0")
    return g.select("feature", F.try_divide(2 * (F.col("r1") - n1 * (n1 + 1) / 2), (n1 * n0).cast("double")).alias("delta")).withColumn("delta", F.col("delta") - 1)


def spearman_pairs(df: DataFrame, features: list[str], least: float = 0.9, id_col: str = "sample_id") -> DataFrame:
    """(a, b, rho, n) of feature pairs with |rho| >= least; ranks within rows where both have values."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in pairs))
    long_ = df.select(F.inline(cells)).filter("x is not null and y is not null")

    ranges = max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES // max(1, len(pairs))))
    rx = average_ranks(long_, "x", ["a", "b"], ranges).withColumnRenamed("rank", "rx")
    r = average_ranks(rx, "y", ["a", "b"], ranges).withColumnRenamed("rank", "ry")
    out = r.groupBy("a", "b").agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
    return out.filter((F.col("n") >= 2) & (F.abs("rho") >= least))


def contributions(df: DataFrame, key: str, coefficients: dict[str, float], groups: dict[str, str]) -> DataFrame:
    """(key, feature, group, contribution) of a linear model; missing values contribute nothing."""
    cells = F.array(*(
        F.struct(F.lit(f).alias("feature"), F.lit(groups[f]).alias("group"), (F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) * F.lit(c)).alias("contribution"))
        for f, c in coefficients.items()
    ))
    return df.select(key, F.inline(cells))


def top_contributions(parts: DataFrame, key: str, n: int) -> DataFrame:
    """The n greatest positive and least negative contributions of each row."""
    sign = F.when(F.col("contribution") > 0, "positive").when(F.col("contribution") < 0, "negative")
    w = Window.partitionBy(key, "sign").orderBy(F.desc(F.abs("contribution")), "feature")
    return parts.withColumn("sign", sign).filter("sign is not null").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def group_contributions(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key, "group").agg(F.sum("contribution").alias("contribution"))


def metric_mismatches(predictions: DataFrame, stated: dict[str, float], label: str, predicted: str) -> DataFrame:
    """Stated metrics that differ from those recomputed from the predictions."""
    m = confusion(predictions, label, predicted)
    cells = F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("stated"), F.col(k).cast("double").alias("computed")) for k, v in stated.items()))
    d = F.abs(F.col("stated") - F.col("computed"))
    return m.select(F.inline(cells)).filter(d > F.greatest(1e-9 * F.greatest(F.abs("stated"), F.abs("computed")), F.lit(1e-12)))
