"""Regions of an image: ids, geometry, pairwise measures, and the fixed-width image row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("mean", "median", "std", "iqr", "min", "max", "p10", "p90")
GEOMETRY = ("area_ratio", "width_ratio", "height_ratio", "aspect_ratio", "center_x", "center_y")


def number_regions(boxes: DataFrame, key: str = "sample_id") -> DataFrame:
    """Add ord (from 0, by y, x, h, w) and region_id."""
    w = Window.partitionBy(key).orderBy("y", "x", "h", "w")
    out = boxes.withColumn("ord", F.row_number().over(w) - 1)
    return out.withColumn("region_id", F.format_string("%s-r%03d", F.col(key).cast("string"), F.col("ord")))


def geometry_features(regions: DataFrame) -> DataFrame:
    """The six box features; regions have x, y, w, h and image sides iw, ih."""
    whole = F.greatest(F.lit(1), F.col("iw") * F.col("ih"))
    return regions.withColumns({
        "area_ratio": F.col("w") * F.col("h") / whole,
        "width_ratio": F.col("w") / F.greatest(F.lit(1), F.col("iw")),
        "height_ratio": F.col("h") / F.greatest(F.lit(1), F.col("ih")),
        "aspect_ratio": F.when(F.col("h") > 0, F.col("w") / F.when(F.col("h") > 0, F.col("h")).otherwise(1)),
        "center_x": (F.col("x") + F.col("w") / 2) / F.greatest(F.lit(1), F.col("iw")),
        "center_y": (F.col("y") + F.col("h") / 2) / F.greatest(F.lit(1), F.col("ih")),
    })


def to_long(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value): one generated row per feature, no shuffle."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features))
    return wide.select(*keys, F.inline(cells))


def stat_columns(value: Column) -> dict[str, Column]:
    q = F.percentile(value, F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
    return {
        "mean": F.avg(value), "median": q[2], "std": F.stddev_pop(value), "iqr": q[3] - q[1], "min": F.min(value), "max": F.max(value), "p10": q[0], "p90": q[4],
    }


def aggregate_long(long_: DataFrame, key: str = "sample_id", stats: tuple[str, ...] = STATS) -> DataFrame:
    """Exact statistics over finite values, and valid_count, for each key and feature."""
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    cols = stat_columns(v)
    return long_.groupBy(key, "feature").agg(*(cols[s].alias(s) for s in dict.fromkeys(stats)), F.count(v).alias("valid_count"))


def wide_row(agg: DataFrame, features: list[str], key: str = "sample_id", stats: tuple[str, ...] = STATS, sep: str = ".") -> DataFrame:
    """One row per key: {feature}.{stat}; the value list is given, so no job looks for it."""
    cell = F.struct(*stats)
    p = agg.groupBy(key).pivot("feature", sorted(features)).agg(F.first(cell))
    return p.select(key, *(F.col(f"`{f}`")[s].alias(f"{f}{sep}{s}") for f in sorted(features) for s in stats))


def _quantile(a: Column, n: Column, p: float) -> Column:
    """Linear quantile of a sorted array of n > 0 values."""
    at = (n - 1) * p
    lo = F.floor(at).cast("int")
    x, y = F.get(a, lo), F.get(a, F.least(lo + 1, n - 1))
    return x + (y - x) * (at - lo)


def _gathered_stats(df: DataFrame, features: list[str], key: str) -> tuple[DataFrame, list[str], list[dict[str, Column]]]:
    """(a row for each key, sorted feature names, their statistics as columns of it).

    An image's values are gathered into one array (an image bounds its regions) by one shuffle and
    sorted once for all quantiles, which spares a hash map for each image, feature and quantile.
    """
    names = sorted(features)
    cells = F.struct(*(F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(names)))
    g = df.groupBy(key).agg(F.collect_list(cells).alias("cells"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    g = g.select(key, *(F.array_sort(F.filter(F.transform("cells", lambda c: c[f"f{i}"]), fine)).alias(f"a{i}") for i in range(len(names))))  # noqa: B023
    g = g.select(key, *(F.struct(f"a{i}", (F.aggregate(f"a{i}", F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(f"a{i}"), F.lit(0))).alias("m")).alias(f"a{i}") for i in range(len(names))))
    out = []
    for i in range(len(names)):
        a, m = F.col(f"a{i}.a{i}"), F.col(f"a{i}.m")
        n = F.size(a)
        q = {p: F.when(n > 0, _quantile(a, n, p)) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
        square = F.aggregate(a, F.struct(m.alias("m"), F.lit(0.0).alias("s")), lambda t, v: F.struct(t["m"].alias("m"), (t["s"] + (v - t["m"]) * (v - t["m"])).alias("s")), lambda t: t["s"])
        out.append({
            "mean": m, "median": q[0.5], "std": F.when(n > 0, F.sqrt(square / n)), "iqr": q[0.75] - q[0.25], "min": F.get(a, F.lit(0)), "max": F.get(a, n - 1),
            "p10": q[0.1], "p90": q[0.9], "valid_count": n.cast("long"),
        })
    return g, names, out


def aggregate_wide(df: DataFrame, features: list[str], key: str = "sample_id", stats: tuple[str, ...] = STATS, sep: str = ".") -> DataFrame:
    """The fixed-width row straight from feature columns: no unpivot and pivot."""
    g, names, of = _gathered_stats(df, features, key)
    return g.select(key, *(c[s].alias(f"{f}{sep}{s}") for f, c in zip(names, of, strict=True) for s in stats))


def aggregate_features(df: DataFrame, features: list[str], key: str = "sample_id", stats: tuple[str, ...] = STATS) -> DataFrame:
    """(key, feature, statistics, valid_count) from feature columns; the same as aggregate_long of their long form."""
    g, names, of = _gathered_stats(df, features, key)
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), *(c[s].alias(s) for s in (*stats, "valid_count"))) for f, c in zip(names, of, strict=True)))
    return g.select(key, F.inline(rows))


# --- layout of an image: its boxes are gathered once (they are bounded by the image), the rest happens inside the row


def gathered(regions: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, boxes by (y, x, h, w), iw, ih): the only shuffle of all layout measures."""
    box = F.struct(*(F.col(c).cast("long").alias(c) for c in ("y", "x", "h", "w")))
    return regions.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("boxes"), F.max("iw").alias("iw"), F.max("ih").alias("ih"))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def _over_pairs(start: Column, f) -> Column:
    """Fold f(state, a, b) over all pairs of boxes, the earlier one first."""
    n = F.size("boxes")
    first = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    rest = lambda i: F.slice("boxes", i + 2, n)
    return F.aggregate(first, start, lambda s, i: F.aggregate(rest(i), s, lambda t, b: f(t, F.get("boxes", i), b)))


def _iou(a: Column, b: Column) -> Column:
    ix = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = (ix * iy).cast("double")
    return F.coalesce(F.try_divide(inter, a["w"] * a["h"] + b["w"] * b["h"] - inter), F.lit(0.0))


def mean_iou() -> Column:
    """Mean overlap of all pairs; 0 for a single region."""
    n = F.size("boxes")
    return _over_pairs(F.lit(0.0), lambda s, a, b: s + _iou(a, b)) / F.greatest(F.lit(1), n * (n - 1) / 2)


def least_gap(axis: str) -> Column:
    """Least positive gap along ``axis`` of boxes that overlap across it, over the image side; null if there is none."""
    p, s, q, r, side = ("x", "w", "y", "h", "iw") if axis == "x" else ("y", "h", "x", "w", "ih")

    def step(state: Column, a: Column, b: Column) -> Column:
        across = (a[q] < b[q] + b[r]) & (b[q] < a[q] + a[r])
        gap = F.greatest(b[p] - (a[p] + a[s]), a[p] - (b[p] + b[s]))
        return F.when(across & (gap > 0), F.least(state, gap)).otherwise(state)

    return _over_pairs(F.lit(None).cast("long"), step) / F.greatest(F.lit(1), F.col(side))


def covered() -> Column:
    """Covered share of the image by half-open boxes, by strips between x edges; needs a column xs of these."""

    def strip(i: Column) -> Column:
        x0, x1 = F.get("xs", i), F.get("xs", i + 1)
        inside = F.filter("boxes", lambda b: (b["x"] <= x0) & (b["x"] + b["w"] >= x1))  # still by y
        start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("len"))
        cover = F.aggregate(
            inside, start,
            lambda s, b: F.struct(
                F.greatest(s["end"], b["y"] + b["h"]).alias("end"),
                (s["len"] + F.greatest(F.lit(0).cast("long"), b["y"] + b["h"] - F.greatest(s["end"], b["y"]))).alias("len"),
            ),
            lambda s: s["len"],
        )
        return cover * (x1 - x0)

    area = F.aggregate(F.sequence(F.lit(0), F.size("xs") - 2), F.lit(0).cast("long"), lambda s, i: s + strip(i))
    return area / F.greatest(F.lit(1), F.col("iw") * F.col("ih"))


def _edges(g: DataFrame) -> DataFrame:
    return g.withColumn("xs", F.array_sort(F.array_distinct(F.flatten(F.transform("boxes", lambda b: F.array(b["x"], b["x"] + b["w"]))))))


def spread(p: str, s: str, side: str, fixed_centroid: bool = False) -> Column:
    """Population spread of (p + s) / 2 over the image side, as published; ``fixed_centroid`` takes p + s / 2."""
    mid = lambda b: (b[p] + b[s] / 2 if fixed_centroid else (b[p] + b[s]) / 2) / F.greatest(F.lit(1), F.col(side))
    n = F.size("boxes")
    mean = _sum(F.col("boxes"), mid) / n
    start = F.struct(mean.alias("m"), F.lit(0.0).alias("s"))
    total = F.aggregate("boxes", start, lambda t, b: F.struct(t["m"].alias("m"), (t["s"] + (mid(b) - t["m"]) * (mid(b) - t["m"])).alias("s")), lambda t: t["s"])
    return F.sqrt(total / n)


def pair_iou(regions: DataFrame, key: str = "sample_id") -> DataFrame:
    return gathered(regions, key).select(key, mean_iou().alias("mean_iou"))


def nearest_gap(regions: DataFrame, axis: str, key: str = "sample_id") -> DataFrame:
    """(key, gap); keys without one are left out."""
    return gathered(regions, key).select(key, least_gap(axis).alias("gap")).filter("gap is not null")


def union_area(regions: DataFrame, key: str = "sample_id") -> DataFrame:
    return _edges(gathered(regions, key)).select(key, covered().alias("union_coverage"))


def density(regions: DataFrame, key: str = "sample_id") -> DataFrame:
    whole = F.max(F.greatest(F.lit(1), F.col("iw") * F.col("ih")))
    return regions.groupBy(key).agg(F.count("*").alias("region_count"), (F.sum(F.col("w") * F.col("h")) / whole).alias("area_sum_ratio"))


def centroid_dispersion(regions: DataFrame, key: str = "sample_id", fixed_centroid: bool = False) -> DataFrame:
    g = gathered(regions, key)
    return g.select(key, spread("x", "w", "iw", fixed_centroid).alias("dispersion_x"), spread("y", "h", "ih", fixed_centroid).alias("dispersion_y"))


def _with_rows(g: DataFrame, tolerance: float) -> DataFrame:
    """Add rows: centres (y + h) / 2 over the image height, each in the first row whose running mean is within ``tolerance``."""
    vs = F.array_sort(F.transform("boxes", lambda b: (b["y"] + b["h"]) / 2 / F.greatest(F.lit(1), F.col("ih"))))
    none = F.array().cast("array<struct<sum:double,n:int,vs:array<double>>>")

    def join(rs: Column, x: Column) -> Column:
        near = lambda r: F.abs(x - r["sum"] / r["n"]) <= tolerance
        hit = F.array_position(F.transform(rs, near), True)
        grown = F.transform(
            rs, lambda r, i: F.when(i + 1 == hit, F.struct((r["sum"] + x).alias("sum"), (r["n"] + 1).alias("n"), F.array_append(r["vs"], x).alias("vs"))).otherwise(r)
        )
        fresh = F.concat(rs, F.array(F.struct(x.alias("sum"), F.lit(1).alias("n"), F.array(x).alias("vs"))))
        return F.when(hit > 0, grown).otherwise(fresh)

    return g.withColumn("rows", F.aggregate(vs, none, join))


def row_error() -> Column:
    """Mean distance of the centres from the mean of their row; needs a column rows."""
    off = F.flatten(F.transform("rows", lambda r: F.transform(r["vs"], lambda x: F.abs(x - r["sum"] / r["n"]))))
    return _sum(off, lambda x: x) / F.size("boxes")


def row_alignment(regions: DataFrame, key: str = "sample_id", tolerance: float = 0.02) -> DataFrame:
    return _with_rows(gathered(regions, key), tolerance).select(key, row_error().alias("row_error"))


def image_level(regions: DataFrame, key: str = "sample_id", tolerance: float = 0.02) -> DataFrame:
    """Density and layout features of each image with regions, by their full names."""
    g = _with_rows(_edges(gathered(regions, key)), tolerance)
    whole = F.greatest(F.lit(1), F.col("iw") * F.col("ih"))
    return g.select(
        key, F.size("boxes").cast("double").alias("density.region_count"), (F.aggregate("boxes", F.lit(0).cast("long"), lambda s, b: s + b["w"] * b["h"]) / whole).alias("density.area_sum_ratio"),
        covered().alias("density.union_coverage"), spread("x", "w", "iw").alias("layout.centroid_dispersion_x"), spread("y", "h", "ih").alias("layout.centroid_dispersion_y"),
        mean_iou().alias("layout.overlap_ratio"), least_gap("x").alias("layout.nearest_horizontal_gap"), least_gap("y").alias("layout.nearest_vertical_gap"),
        row_error().alias("layout.row_alignment_error"),
    )


def image_row(regions: DataFrame, images: DataFrame, key: str = "sample_id") -> DataFrame:
    """All box-based columns of an image's row; images without regions have nulls and no_detection 1.

    Three exchanges of regions and images on the key in all: statistics, gathered boxes, image ids.
    """
    wide = aggregate_wide(geometry_features(regions), list(GEOMETRY), key)
    g = _with_rows(_edges(gathered(regions, key)), 0.02)
    whole = F.greatest(F.lit(1), F.col("iw") * F.col("ih"))
    layout = g.select(
        key, F.size("boxes").cast("long").alias("region_count"), (F.aggregate("boxes", F.lit(0).cast("long"), lambda s, b: s + b["w"] * b["h"]) / whole).alias("area_sum_ratio"),
        covered().alias("union_coverage"), mean_iou().alias("mean_iou"), spread("x", "w", "iw").alias("dispersion_x"), spread("y", "h", "ih").alias("dispersion_y"),
        row_error().alias("row_error"), least_gap("x").alias("nearest_gap_x"), least_gap("y").alias("nearest_gap_y"),
    )
    out = images.select(key).distinct().join(layout, key, "left").join(wide, key, "left")
    return out.withColumn("no_detection", F.col("region_count").isNull().cast("int")).withColumn("region_count", F.coalesce("region_count", F.lit(0)))
