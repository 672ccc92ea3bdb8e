"""Queries over labels and scores: metrics, thresholds, ranks, contributions, preprocessing, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators import evaluation as E
from pixelmill.operators import models as M
from pixelmill.operators import profiles as P
from pixelmill.operators import splits as SP
from pixelmill.plans.region_queries import rounded
from pixelmill.plans.tables import MANIFEST_SQL, SCORED_SQL, manifest, scored

COEFFICIENTS = {"score": 2.5, "length": -0.001, "square": 1e-07, "noise": 0.25}
GROUPS = {"score": "signal", "length": "size", "square": "size", "noise": "signal"}
FEATURES = list(COEFFICIENTS)


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return rounded(E.confusion(s, "label", "predicted", ["toxic"]))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.threshold_sweep(scored(spark, sf_dir), "label", "score", 0.5), 9)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.best_threshold(scored(spark, sf_dir), "label", "score", 0.5), 9)


def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.cliffs_delta(P.unpivot(scored(spark, sf_dir), ["label"], FEATURES)), 6)


def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.spearman_pairs(scored(spark, sf_dir), FEATURES, 0.0), 6)


def topk_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = E.contributions(scored(spark, sf_dir), "sample_id", COEFFICIENTS, GROUPS)
    return rounded(E.top_contributions(parts, "sample_id", 2).select("sample_id", "sign", "place", "feature", "contribution"))


def group_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = E.contributions(scored(spark, sf_dir), "sample_id", COEFFICIENTS, GROUPS)
    return rounded(E.group_contributions(parts, "sample_id"))


def mean_abs_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = E.contributions(scored(spark, sf_dir), "sample_id", COEFFICIENTS, GROUPS)
    return rounded(parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")))


def metric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return E.metric_mismatches(s, {"f1": -1.0, "tp": -1.0}, "label", "predicted").select("metric", "stated")


def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    model = M.MedianImputer(["square", "noise"]).fit(s)
    return rounded(model.transform(s).select("sample_id", "square", "noise", *model.indicators), 4)


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("flat", F.lit(2.0))
    return rounded(M.Standardizer(["length", "noise", "flat"]).fit(s).transform(s).select("sample_id", "length", "noise", "flat"))


def fold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("fold", (F.col("group_id") % 7).cast("int"))
    return SP.best_fold(m, "fold", "label", 0.15).select("fold", "n")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir).withColumn("label", F.when(F.col("group_id") % 3 == 0, "ai_generated").otherwise("non_ai_generated"))
    return SP.group_split(m.drop("split"), "group_id", "label", 42).select("sample_id", "group_id", "label", "split")


def fit_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_with(M.candidate("lr", {"C": 1.0}, FEATURES), scored(spark, sf_dir), "label").select("sample_id", "label", "model_score")


def fit_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_with(M.candidate("rf", {"trees": 20, "depth": 10, "leaf": 1}, FEATURES), scored(spark, sf_dir), "label").select("sample_id", "label", "model_score")


def fit_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_with(M.candidate("svm_linear", {"C": 1.0}, FEATURES), scored(spark, sf_dir), "label").select("sample_id", "label", "model_score")


def fit_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_with(M.candidate("svm_rbf", {"C": 1.0, "gamma": "scale"}, FEATURES), scored(spark, sf_dir), "label").select("sample_id", "label", "model_score")


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.permutation_linear(scored(spark, sf_dir), "sample_id", "label", COEFFICIENTS, -1.0, 0.0, repeats=5, seed=42)


QUERIES = {
    f.__name__: f
    for f in (
        confusion_metrics, threshold_sweep, best_threshold, cliffs_delta, spearman_pairs, topk_contrib, group_contrib, mean_abs_contrib, metric_consistency, median_impute,
        standardize, fold_choice, group_split, fit_lr, fit_rf, fit_svm, fit_rbf, permutation,
    )
}

W = f"WITH {SCORED_SQL}"
SWEEP = f"""{W}, t AS (SELECT DISTINCT score AS threshold FROM scored UNION SELECT 0.5::DOUBLE),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM t, scored GROUP BY threshold),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM c)"""
LONG = f"""{W}, long AS (SELECT sample_id, label, 'score' AS feature, score AS value FROM scored UNION ALL SELECT sample_id, label, 'length', length FROM scored
UNION ALL SELECT sample_id, label, 'square', square FROM scored UNION ALL SELECT sample_id, label, 'noise', noise FROM scored)"""
PARTS = f"""{LONG}, k AS (SELECT * FROM (VALUES ('score', 'signal', 2.5::DOUBLE), ('length', 'size', -0.001::DOUBLE), ('square', 'size', 1e-07::DOUBLE), ('noise', 'signal', 0.25::DOUBLE)) t(feature, "group", c)),
parts AS (SELECT sample_id, feature, "group", coalesce(value, 0.0::DOUBLE) * c AS contribution FROM long JOIN k USING (feature))"""

ORACLE = {
    "fold_choice": f"""WITH {MANIFEST_SQL}, f AS (SELECT group_id % 7 AS fold, label, count(*) AS c FROM manifest GROUP BY 1, 2),
a AS (SELECT label, count(*) AS n FROM manifest GROUP BY 1), g AS (SELECT DISTINCT fold FROM f),
s AS (SELECT g.fold, sum(coalesce(c, 0)) AS n, abs(sum(coalesce(c, 0)) / (SELECT count(*) FROM manifest) - 0.15) + sum(abs(coalesce(c, 0) / a.n - 0.15)) AS loss
  FROM g CROSS JOIN a LEFT JOIN f ON f.fold = g.fold AND f.label = a.label GROUP BY g.fold)
SELECT CAST(fold AS INTEGER) AS fold, CAST(n AS BIGINT) AS n FROM s ORDER BY round(loss, 12), fold LIMIT 1""",
    "confusion_metrics": f"""{W}, c AS (SELECT toxic, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn,
count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM scored GROUP BY toxic)
SELECT toxic, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "threshold_sweep": f"{SWEEP} SELECT round(threshold, 9) AS threshold, tp, fp, fn, round(p, 9) AS precision, round(f, 9) AS f1 FROM m",
    "best_threshold": f"""{SWEEP}, b AS (SELECT * FROM m ORDER BY f DESC, p DESC, abs(threshold - 0.5), threshold DESC LIMIT 1)
SELECT CASE WHEN f <= 0 THEN 0.5 ELSE round(threshold, 9) END AS threshold, round(f, 9) AS f1, round(p, 9) AS precision, CASE WHEN f <= 0 THEN 'estimator_default_no_validation_signal' ELSE 'validation_f1' END AS method FROM b""",
    "cliffs_delta": f"""{LONG}, v AS (SELECT feature, label, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT feature, label, sum(n) AS n FROM v GROUP BY 1, 2),
s AS (SELECT a.feature, sum(a.n * b.n * CASE WHEN b.value < a.value THEN 1 WHEN b.value > a.value THEN -1 ELSE 0 END) AS s FROM v a JOIN v b ON a.feature = b.feature AND a.label = 1 AND b.label = 0 GROUP BY 1)
SELECT s.feature, round(CAST(s AS DOUBLE) / (x.n * y.n), 6) AS delta FROM s JOIN t x ON x.feature = s.feature AND x.label = 1 JOIN t y ON y.feature = s.feature AND y.label = 0""",
    "spearman_pairs": f"""{LONG}, p AS (SELECT x.feature AS a, y.feature AS b, x.value AS x, y.value AS y FROM long x JOIN long y ON x.sample_id = y.sample_id
WHERE x.value IS NOT NULL AND y.value IS NOT NULL AND (x.feature, y.feature) IN (('score', 'length'), ('score', 'square'), ('score', 'noise'), ('length', 'square'), ('length', 'noise'), ('square', 'noise'))),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT a, b, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY a, b""",
    "topk_contrib": f"""{PARTS}, s AS (SELECT *, CASE WHEN contribution > 0 THEN 'positive' WHEN contribution < 0 THEN 'negative' END AS sign FROM parts),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, sign ORDER BY abs(contribution) DESC, feature) AS INT) AS place FROM s WHERE sign IS NOT NULL)
SELECT sample_id, sign, place, feature, round(contribution, 6) AS contribution FROM n WHERE place <= 2""",
    "group_contrib": f"""{PARTS} SELECT sample_id, "group", round(sum(contribution), 6) AS contribution FROM parts GROUP BY 1, 2""",
    "mean_abs_contrib": f"{PARTS} SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs FROM parts GROUP BY 1",
    "metric_consistency": "SELECT * FROM (VALUES ('f1', -1.0::DOUBLE), ('tp', -1.0::DOUBLE)) t(metric, stated)",
    "median_impute": f"""{W} SELECT sample_id, round(coalesce(square, (SELECT quantile_cont(square, 0.5) FROM scored)), 4) AS square, round(noise, 4) AS noise, CAST(square IS NULL AS DOUBLE) AS missing_square FROM scored""",
    "standardize": f"""{W}, m AS (SELECT avg(length) AS la, stddev_pop(length) AS ls, avg(noise) AS na, stddev_pop(noise) AS ns FROM scored)
SELECT sample_id, round((length - la) / CASE WHEN ls = 0 THEN 1 ELSE ls END, 6) AS length, round((noise - na) / CASE WHEN ns = 0 THEN 1 ELSE ns END, 6) AS noise, 0.0::DOUBLE AS flat FROM scored, m""",
}
