"""Region and image-row queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import scalars as S
from pixelmill.operators import regions as R
from pixelmill.plans.tables import REGIONS_SQL, regions, table


DIGITS = 11  # shares of 1024 and 1536 have no ties at this digit


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def geometry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.geometry_features(regions(spark, sf_dir)).select("sample_id", "region_id", *R.GEOMETRY))


def region_agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.aggregate_features(R.geometry_features(regions(spark, sf_dir)), list(R.GEOMETRY)), DIGITS)


def region_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.aggregate_wide(R.geometry_features(regions(spark, sf_dir)), list(R.GEOMETRY), sep="_"), DIGITS)


def region_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same row by a pivot of the long table."""
    long_ = R.to_long(R.geometry_features(regions(spark, sf_dir)), ["sample_id"], ["aspect_ratio", "center_y"])
    return rounded(R.wide_row(R.aggregate_long(long_), ["aspect_ratio", "center_y"], stats=("mean", "max"), sep="_"), DIGITS)


def pilot_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_ = R.to_long(R.geometry_features(regions(spark, sf_dir)), ["sample_id"], ["area_ratio", "aspect_ratio"])
    return rounded(R.aggregate_long(long_, stats=("mean", "std", "min", "max", "median")), DIGITS)


def pair_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.pair_iou(regions(spark, sf_dir)), DIGITS)


def nearest_gap_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.nearest_gap(regions(spark, sf_dir), "x"), DIGITS)


def nearest_gap_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.nearest_gap(regions(spark, sf_dir), "y"), DIGITS)


def union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.union_area(regions(spark, sf_dir)), DIGITS)


def region_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.density(regions(spark, sf_dir)), DIGITS)


def centroid_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.centroid_dispersion(regions(spark, sf_dir)), DIGITS)


def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.row_alignment(regions(spark, sf_dir)), 8)


def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    out = R.image_row(regions(spark, sf_dir), images)
    return rounded(out.select("sample_id", "region_count", "area_sum_ratio", "union_coverage", "mean_iou", "dispersion_x", "dispersion_y", "nearest_gap_x", "nearest_gap_y", "no_detection"), DIGITS)


def box_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {k: F.col(k) for k in ("x", "y", "w", "h", "iw", "ih")}
    out = regions(spark, sf_dir).withColumn("box", S.padded_box(c["x"], c["y"], c["w"], c["h"], c["iw"], c["ih"]))
    return out.select("region_id", *(F.col(f"box.{k}").cast("long").alias(f"pad_{k}") for k in ("x", "y", "w", "h")))


def box_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir).withColumn("box", S.clip_box(F.col("x") - 40, F.col("y") - 60, F.col("w"), F.col("h"), F.lit(800), F.lit(1200)))
    return r.filter("box is not null").select("region_id", *(F.col(f"box.{k}").cast("long").alias(f"clip_{k}") for k in ("x", "y", "w", "h")))


def region_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = regions(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("regions"))
    label = F.when(F.col("sample_id") % 3 == 0, "ai_generated").otherwise("non_ai_generated")
    return n.groupBy(label.alias("label"), "regions").agg(F.count("*").alias("images"))


QUERIES = {
    f.__name__: f
    for f in (
        geometry_features, region_agg8, region_wide, region_pivot, pilot_aggregate, pair_iou, nearest_gap_h, nearest_gap_v, union_area, region_density, centroid_dispersion,
        row_alignment, image_layout, box_padding, box_clip, region_histogram,
    )
}

FEATURES_SQL = f"""{REGIONS_SQL},
features AS (
  SELECT *, CAST(w * h AS DOUBLE) / greatest(1, iw * ih) AS area_ratio, CAST(w AS DOUBLE) / iw AS width_ratio, CAST(h AS DOUBLE) / ih AS height_ratio,
         CASE WHEN h > 0 THEN CAST(w AS DOUBLE) / h END AS aspect_ratio, (x + CAST(w AS DOUBLE) / 2) / iw AS center_x, (y + CAST(h AS DOUBLE) / 2) / ih AS center_y
  FROM regions),
long AS (UNPIVOT (SELECT sample_id, area_ratio, width_ratio, height_ratio, aspect_ratio, center_x, center_y FROM features)
         ON area_ratio, width_ratio, height_ratio, aspect_ratio, center_x, center_y INTO NAME feature VALUE value)"""
STAT_SQL = {
    "mean": "avg({v})", "median": "quantile_cont({v}, 0.5)", "std": "stddev_pop({v})", "iqr": "quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)",
    "min": "min({v})", "max": "max({v})", "p10": "quantile_cont({v}, 0.1)", "p90": "quantile_cont({v}, 0.9)",
}


def _stats(v: str, names: tuple[str, ...], suffix: str = "") -> str:
    return ", ".join(f"round({STAT_SQL[s].format(v=v)}, {DIGITS}) AS {suffix}{s}" for s in names)


PAIRS_SQL = """pairs AS (
  SELECT a.sample_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y \"by\", b.w bw, b.h bh, a.iw, a.ih
  FROM regions a JOIN regions b ON a.sample_id = b.sample_id AND a.ord < b.ord)"""


def _gap(p: str, s: str, q: str, r: str, side: str) -> str:
    a, b = "a", "b"
    n = lambda t, k: '"by"' if (t, k) == ("b", "y") else t + k
    return f"""WITH {REGIONS_SQL}, {PAIRS_SQL},
gaps AS (SELECT sample_id, greatest({n(b, p)} - ({n(a, p)} + {n(a, s)}), {n(a, p)} - ({n(b, p)} + {n(b, s)})) AS g, {side} AS side FROM pairs
         WHERE {n(a, q)} < {n(b, q)} + {n(b, r)} AND {n(b, q)} < {n(a, q)} + {n(a, r)})
SELECT sample_id, round(min(CAST(g AS DOUBLE) / side), 11) AS gap FROM gaps WHERE g > 0 GROUP BY sample_id"""


IOU_SQL = f"""WITH {REGIONS_SQL}, {PAIRS_SQL},
inter AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, "by" + bh) - greatest(ay, "by")) AS i FROM pairs),
mean AS (SELECT sample_id, avg(CAST(i AS DOUBLE) / (aw * ah + bw * bh - i)) AS v FROM inter GROUP BY sample_id)
SELECT k.sample_id, round(coalesce(v, 0.0::DOUBLE), 11) AS mean_iou FROM (SELECT DISTINCT sample_id FROM regions) k LEFT JOIN mean USING (sample_id)"""
UNION_SQL = f"""WITH {REGIONS_SQL},
xs AS (SELECT sample_id, x AS e FROM regions UNION SELECT sample_id, x + w FROM regions),
ys AS (SELECT sample_id, y AS e FROM regions UNION SELECT sample_id, y + h FROM regions),
xi AS (SELECT sample_id, e AS x0, lead(e) OVER (PARTITION BY sample_id ORDER BY e) AS x1 FROM xs),
yi AS (SELECT sample_id, e AS y0, lead(e) OVER (PARTITION BY sample_id ORDER BY e) AS y1 FROM ys),
cells AS (SELECT xi.sample_id, x0, x1, y0, y1 FROM xi JOIN yi ON xi.sample_id = yi.sample_id AND x1 IS NOT NULL AND y1 IS NOT NULL),
covered AS (SELECT * FROM cells c WHERE EXISTS (SELECT 1 FROM regions r WHERE r.sample_id = c.sample_id AND r.x <= x0 AND r.x + r.w >= x1 AND r.y <= y0 AND r.y + r.h >= y1))
SELECT sample_id, round(CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) / (1024 * 1536), 11) AS union_coverage FROM covered GROUP BY sample_id"""
DENSITY_SQL = "SELECT sample_id, count(*) AS region_count, round(CAST(sum(w * h) AS DOUBLE) / (1024 * 1536), 11) AS area_sum_ratio FROM regions GROUP BY sample_id"
DISPERSION_SQL = """SELECT sample_id, round(stddev_pop(CAST(x + w AS DOUBLE) / 2 / iw), 11) AS dispersion_x, round(stddev_pop(CAST(y + h AS DOUBLE) / 2 / ih), 11) AS dispersion_y
FROM regions GROUP BY sample_id"""
PAD_SQL = f"""WITH {REGIONS_SQL},
box AS (SELECT *, greatest(0, CAST(round_even(x - w * 0.05::DOUBLE, 0) AS INT)) AS x0, greatest(0, CAST(round_even(y - h * 0.05::DOUBLE, 0) AS INT)) AS y0,
  least(iw, CAST(round_even(x + w + w * 0.05::DOUBLE, 0) AS INT)) AS x1, least(ih, CAST(round_even(y + h + h * 0.05::DOUBLE, 0) AS INT)) AS y1 FROM regions)
SELECT format('{{}}-r{{:03d}}', sample_id, ord) AS region_id, CAST(x0 AS BIGINT) AS pad_x, CAST(y0 AS BIGINT) AS pad_y, CAST(x1 - x0 AS BIGINT) AS pad_w, CAST(y1 - y0 AS BIGINT) AS pad_h
FROM box"""
CLIP_SQL = f"""WITH {REGIONS_SQL},
box AS (SELECT *, greatest(x - 40, 0) AS x0, greatest(y - 60, 0) AS y0, least(x - 40 + w, 800) AS x1, least(y - 60 + h, 1200) AS y1 FROM regions)
SELECT format('{{}}-r{{:03d}}', sample_id, ord) AS region_id, CAST(x0 AS BIGINT) AS clip_x, CAST(y0 AS BIGINT) AS clip_y, CAST(x1 - x0 AS BIGINT) AS clip_w, CAST(y1 - y0 AS BIGINT) AS clip_h
FROM box WHERE x1 > x0 AND y1 > y0"""
WIDE_COLUMNS = ", ".join(
    f"round({STAT_SQL[s].format(v=f)}, {DIGITS}) AS {f}_{s}" for f in sorted(R.GEOMETRY) for s in R.STATS
)

ORACLE = {
    "geometry_features": f"""WITH {FEATURES_SQL} SELECT sample_id, format('{{}}-r{{:03d}}', sample_id, ord) AS region_id, {', '.join(f'round({f}, 6) AS {f}' for f in R.GEOMETRY)} FROM features""",
    "region_agg8": f"WITH {FEATURES_SQL} SELECT sample_id, feature, {_stats('value', R.STATS)}, count(value) AS valid_count FROM long GROUP BY sample_id, feature",
    "region_wide": f"WITH {FEATURES_SQL} SELECT sample_id, {WIDE_COLUMNS} FROM features GROUP BY sample_id",
    "region_pivot": f"""WITH {FEATURES_SQL} SELECT sample_id, {", ".join(f"round({STAT_SQL[s].format(v=f)}, {DIGITS}) AS {f}_{s}" for f in ("aspect_ratio", "center_y") for s in ("mean", "max"))} FROM features GROUP BY sample_id""",
    "pilot_aggregate": f"WITH {FEATURES_SQL} SELECT sample_id, feature, {_stats('value', ('mean', 'std', 'min', 'max', 'median'))}, count(value) AS valid_count FROM long WHERE feature IN ('area_ratio', 'aspect_ratio') GROUP BY sample_id, feature",
    "pair_iou": IOU_SQL,
    "nearest_gap_h": _gap("x", "w", "y", "h", "iw"),
    "nearest_gap_v": _gap("y", "h", "x", "w", "ih"),
    "union_area": UNION_SQL,
    "region_density": f"WITH {REGIONS_SQL} {DENSITY_SQL}",
    "centroid_dispersion": f"WITH {REGIONS_SQL} {DISPERSION_SQL}",
    "image_layout": f"""WITH {REGIONS_SQL}, d AS ({DENSITY_SQL}), s AS ({DISPERSION_SQL}), u AS ({UNION_SQL}), i AS ({IOU_SQL}),
gx AS ({_gap("x", "w", "y", "h", "iw")}), gy AS ({_gap("y", "h", "x", "w", "ih")})
SELECT o.o_orderkey AS sample_id, coalesce(region_count, 0) AS region_count, area_sum_ratio, union_coverage, mean_iou, dispersion_x, dispersion_y,
       gx.gap AS nearest_gap_x, gy.gap AS nearest_gap_y, CAST(region_count IS NULL AS INT) AS no_detection
FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN d ON o_orderkey = d.sample_id LEFT JOIN s ON o_orderkey = s.sample_id LEFT JOIN u ON o_orderkey = u.sample_id
LEFT JOIN i ON o_orderkey = i.sample_id LEFT JOIN gx ON o_orderkey = gx.sample_id LEFT JOIN gy ON o_orderkey = gy.sample_id""",
    "box_padding": PAD_SQL,
    "box_clip": CLIP_SQL,
    "region_histogram": f"""WITH {REGIONS_SQL}, n AS (SELECT sample_id, count(*) AS regions FROM regions GROUP BY sample_id)
SELECT CASE WHEN sample_id % 3 = 0 THEN 'ai_generated' ELSE 'non_ai_generated' END AS label, regions, count(*) AS images FROM n GROUP BY 1, 2""",
}
