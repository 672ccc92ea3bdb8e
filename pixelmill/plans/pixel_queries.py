"""Stencil queries over 8 x 8 gray images made of the 64 components of each vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators import pixels as X
from pixelmill.plans.region_queries import rounded
from pixelmill.plans.tables import table

N = 8


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    gray = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("long"))
    return e.select("vec_id", gray.alias("px"))


def pixel_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _images(spark, sf_dir).withColumns({"gx": X.sobel(F.col("px"), N, N, "x"), "gy": X.sobel(F.col("px"), N, N, "y")})
    mag = F.zip_with("gx", "gy", lambda a, b: F.sqrt((a * a + b * b).cast("double")))
    d = d.withColumn("mag", mag)
    return rounded(d.select("vec_id", X.mean(F.col("mag")).alias("mean"), F.sqrt(X.variance(F.col("mag"))).alias("std"), X.mean(F.zip_with("gx", "gy", lambda a, b: a * a + b * b)).alias("tenengrad")))


def pixel_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _images(spark, sf_dir).withColumn("lap", X.laplacian(F.col("px"), N, N))
    return rounded(d.select("vec_id", X.variance(F.col("lap")).alias("variance")))


def pixel_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _images(spark, sf_dir)
    flat = d.select("vec_id", F.explode("px").alias("g")).groupBy("vec_id").agg(F.stddev_pop("g").alias("gray_std"), F.percentile("g", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return rounded(flat.select("vec_id", "gray_std", (F.col("q")[1] - F.col("q")[0]).alias("p10_p90_range")))


def pixel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_images(spark, sf_dir).select("vec_id", X.entropy(F.col("px")).alias("entropy")))


def pixel_glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("level")
    d = _images(spark, sf_dir).withColumn("level", X.levels(F.col("px")))
    return rounded(d.select("vec_id", X.cooccurrence(px, N, N, lambda d: d * d).alias("contrast"), X.cooccurrence(px, N, N, lambda d: 1 / (1 + d * d)).alias("homogeneity")))


def region_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 34 region features of the 8 x 8 images by the raster kernels."""
    from pixelmill.operators.features import region_features_of_grays

    d = _images(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), F.lit(N).alias("height"), F.lit(N).alias("width"), F.col("px").cast("array<int>").alias("px"))
    return region_features_of_grays(d)


QUERIES = {f.__name__: f for f in (pixel_sobel, pixel_laplacian, pixel_contrast, pixel_entropy, pixel_glcm, region_kernels)}

IMAGES = "img AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS g FROM embeddings)"


def _ref(y: int, x: int) -> str:
    y, x = abs(y), abs(x)
    y, x = (2 * N - 2 - y if y >= N else y), (2 * N - 2 - x if x >= N else x)
    return f"g[{y * N + x + 1}]"


def _cells(f) -> str:
    return "[" + ", ".join(f(y, x) for y in range(N) for x in range(N)) + "]"


GX = _cells(lambda y, x: " + ".join(f"{k} * ({_ref(y + d, x + 1)} - {_ref(y + d, x - 1)})" for d, k in ((-1, 1), (0, 2), (1, 1))))
GY = _cells(lambda y, x: " + ".join(f"{k} * ({_ref(y + 1, x + d)} - {_ref(y - 1, x + d)})" for d, k in ((-1, 1), (0, 2), (1, 1))))
LAP = _cells(lambda y, x: f"{_ref(y - 1, x)} + {_ref(y + 1, x)} + {_ref(y, x - 1)} + {_ref(y, x + 1)} - 4 * {_ref(y, x)}")


def _angle(dy: int, dx: int, name: str) -> str:
    return f"""{name} AS (SELECT a.vec_id, avg(power(a.v - b.v, 2)) AS c, avg(1 / (1 + power(a.v - b.v, 2))) AS h FROM lv a JOIN lv b ON a.vec_id = b.vec_id AND b.y = a.y + ({dy}) AND b.x = a.x + ({dx}) GROUP BY a.vec_id)"""


ORACLE = {
    "pixel_sobel": f"""WITH {IMAGES}, s AS (SELECT vec_id, unnest({GX}) AS gx, unnest({GY}) AS gy FROM img)
SELECT vec_id, round(avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))), 6) AS mean, round(stddev_pop(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))), 6) AS std, round(avg(CAST(gx * gx + gy * gy AS DOUBLE)), 6) AS tenengrad FROM s GROUP BY vec_id""",
    "pixel_laplacian": f"WITH {IMAGES}, s AS (SELECT vec_id, unnest({LAP}) AS v FROM img) SELECT vec_id, round(var_pop(CAST(v AS DOUBLE)), 6) AS variance FROM s GROUP BY vec_id",
    "pixel_contrast": f"""WITH {IMAGES}, s AS (SELECT vec_id, unnest(g) AS v FROM img) SELECT vec_id, round(stddev_pop(CAST(v AS DOUBLE)), 6) AS gray_std,
round(quantile_cont(CAST(v AS DOUBLE), 0.9) - quantile_cont(CAST(v AS DOUBLE), 0.1), 6) AS p10_p90_range FROM s GROUP BY vec_id""",
    "pixel_entropy": f"""WITH {IMAGES}, s AS (SELECT vec_id, unnest(g) AS v FROM img), n AS (SELECT vec_id, v, count(*) / 64.0::DOUBLE AS p FROM s GROUP BY 1, 2)
SELECT vec_id, round(-sum(p * log2(p)), 6) AS entropy FROM n GROUP BY vec_id""",
    "pixel_glcm": f"""WITH {IMAGES}, lv AS (SELECT vec_id, (i // 8) AS y, i % 8 AS x, floor(g[i + 1] * 16 / 256) AS v FROM img, range(64) t(i)),
{_angle(0, 1, "a0")}, {_angle(-1, 1, "a1")}, {_angle(-1, 0, "a2")}, {_angle(-1, -1, "a3")}
SELECT a0.vec_id, round((a0.c + a1.c + a2.c + a3.c) / 4, 6) AS contrast, round((a0.h + a1.h + a2.h + a3.h) / 4, 6) AS homogeneity FROM a0 JOIN a1 USING (vec_id) JOIN a2 USING (vec_id) JOIN a3 USING (vec_id)""",
}
