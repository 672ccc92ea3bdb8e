"""Region features of rasters: the registry, the batch UDF, and the 282-column schema."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.operators.regions import STATS

# Groups, feature names and formula ids.
REGION_FEATURES = {
    "geometry_density": {
        "geometry.area_ratio": "geometry-area-ratio-v1",
        "geometry.width_ratio": "geometry-width-ratio-v1",
        "geometry.height_ratio": "geometry-height-ratio-v1",
        "geometry.aspect_ratio": "geometry-aspect-ratio-v1",
        "geometry.center_x": "geometry-center-x-v1",
        "geometry.center_y": "geometry-center-y-v1",
        "geometry.orientation": "geometry-orientation-v1",
    },
    "stroke_shape": {
        "stroke.width_median": "stroke-distance-median-v1",
        "stroke.width_std": "stroke-distance-std-v1",
        "stroke.width_iqr": "stroke-distance-iqr-v1",
        "stroke.width_p90": "stroke-distance-p90-v1",
        "stroke.valid_fraction": "stroke-valid-fraction-v1",
        "shape.component_count": "shape-component-count-v1",
        "shape.component_area_median": "shape-component-area-median-v1",
        "shape.component_aspect_median": "shape-component-aspect-median-v1",
        "shape.compactness_mean": "shape-compactness-mean-v1",
        "shape.solidity_mean": "shape-solidity-mean-v1",
        "shape.hole_count": "shape-hole-count-v1",
    },
    "edge_gradient": {
        "edge.canny_density": "edge-canny-density-v1",
        "edge.boundary_continuity": "edge-boundary-component-ratio-v1",
        "gradient.magnitude_mean": "gradient-sobel-mean-v1",
        "gradient.magnitude_std": "gradient-sobel-std-v1",
        "gradient.magnitude_p90": "gradient-sobel-p90-v1",
        "gradient.orientation_entropy": "gradient-orientation-entropy-v1",
    },
    "contrast_sharpness": {
        "contrast.gray_std": "contrast-gray-std-v1",
        "contrast.p10_p90_range": "contrast-p10-p90-v1",
        "contrast.local_ring_delta": "contrast-region-ring-delta-v1",
        "sharpness.laplacian_variance": "sharpness-laplacian-variance-v1",
        "sharpness.tenengrad_mean": "sharpness-tenengrad-mean-v1",
    },
    "texture": {
        "texture.gray_entropy": "texture-gray-entropy-v1",
        "texture.lbp_uniform_fraction": "texture-lbp-uniform-fraction-v1",
        "texture.lbp_entropy": "texture-lbp-entropy-v1",
        "texture.glcm_contrast": "texture-glcm-contrast-v1",
        "texture.glcm_homogeneity": "texture-glcm-homogeneity-v1",
    },
}
IMAGE_FEATURES = {
    "geometry_density": {
        "density.region_count": "density-region-count-v1",
        "density.area_sum_ratio": "density-area-sum-ratio-v1",
        "density.union_coverage": "density-union-coverage-v1",
    },
    "spacing_alignment": {
        "layout.centroid_dispersion_x": "layout-centroid-dispersion-x-v1",
        "layout.centroid_dispersion_y": "layout-centroid-dispersion-y-v1",
        "layout.overlap_ratio": "layout-overlap-ratio-v1",
        "layout.nearest_horizontal_gap": "layout-nearest-horizontal-gap-v1",
        "layout.nearest_vertical_gap": "layout-nearest-vertical-gap-v1",
        "layout.row_alignment_error": "layout-row-alignment-error-v1",
    },
}
INDICATOR, INDICATOR_FORMULA = "quality.no_detection", "quality-no-detection-v1"
GROUPS = list(dict.fromkeys([*REGION_FEATURES, *IMAGE_FEATURES]))
SUBSETS = {
    "geometry_density": ["geometry_density"],
    "geometry_density_layout": ["geometry_density", "spacing_alignment"],
    "stroke_shape": ["stroke_shape"],
    "edge_contrast_sharpness": ["edge_gradient", "contrast_sharpness"],
    "texture": ["texture"],
    "all_enabled": GROUPS,
}


def _named(table: dict[str, dict[str, str]], groups: list[str] | None) -> list[tuple[str, str, str]]:
    """(name, group, formula id) of the enabled groups, in order."""
    return [(n, g, f) for g, names in table.items() if groups is None or g in groups for n, f in names.items()]


def region_registry(groups: list[str] | None = None) -> list[tuple[str, str]]:
    """(name, group) of every region feature of the enabled groups, in order."""
    return [(n, g) for n, g, _ in _named(REGION_FEATURES, groups)]


def image_features(groups: list[str] | None = None) -> list[str]:
    """The image-level features of the enabled groups."""
    return [n for n, _, _ in _named(IMAGE_FEATURES, groups)]


def model_columns(groups: list[str] | None = None) -> list[str]:
    """The columns of the wide row; always with the no-detection indicator."""
    out = [f"{n}.{s}" for n, _ in region_registry(groups) for s in STATS] + image_features(groups)
    return [*sorted(out), INDICATOR]


def feature_dictionary(groups: list[str] | None = None) -> list[dict]:
    """One row for each source feature, each generated column and the diagnostic."""

    def entry(name, group, formula, level, statistic=None):
        return {"name": name, "group": group, "formula_id": formula, "level": level, "statistic": statistic, "model_input": level == "image"}

    region, image = _named(REGION_FEATURES, groups), _named(IMAGE_FEATURES, groups)
    rows = [entry(*r, "region") for r in region] + [entry(f"{n}.{s}", g, f, "image", s) for n, g, f in region for s in STATS]
    return [*rows, *(entry(*r, "image") for r in image), entry(INDICATOR, "quality", INDICATOR_FORMULA, "image")]


def schema_json(groups: list[str] | None = None) -> str:
    return json.dumps({"schema_version": "1", "aggregation_version": "1", "columns": feature_dictionary(groups), "model_columns": model_columns(groups)}, sort_keys=True)


def _finite(values: dict[str, float | None]) -> dict[str, float | None]:
    return {k: None if v is None or not np.isfinite(v) else float(v) for k, v in values.items()}


def region_features(
    gray: np.ndarray, box: tuple[int, int, int, int], image: tuple[int, int], *, polygon: np.ndarray | None = None,
    padded: np.ndarray | None = None, offset: tuple[int, int] | None = None, groups: list[str] | None = None,
) -> dict[str, float | None]:
    """All features of one region: ``gray`` is its crop, ``image`` (height, width), ``padded`` the wider gray crop with
    the crop at ``offset`` (y, x). A feature that has no value is null; kernels of other groups are not run."""
    on = {n.split(".")[0] for n, _ in region_registry(groups)}
    x, y, w, h = box
    ih, iw = image
    out: dict[str, float | None] = {}
    if "geometry" in on:
        out |= {
            "geometry.area_ratio": w * h / max(1, iw * ih), "geometry.width_ratio": w / max(1, iw), "geometry.height_ratio": h / max(1, ih),
            "geometry.aspect_ratio": w / h if h > 0 else None, "geometry.center_x": (x + w / 2) / max(1, iw), "geometry.center_y": (y + h / 2) / max(1, ih),
            "geometry.orientation": K.min_area_angle(polygon) if polygon is not None else None,
        }
    out |= dict.fromkeys(n for n, _ in region_registry(groups) if not n.startswith("geometry."))
    if not gray.size:
        return out
    g64 = gray.astype(np.float64)
    if on & {"edge"}:
        edges = K.canny(gray)
        out["edge.canny_density"] = edges.mean()
        if edges.any():
            labels, _ = K.components(edges)
            touching = np.setdiff1d(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]), [0])
            if len(touching):
                out["edge.boundary_continuity"] = np.bincount(labels.ravel())[touching].max() / edges.sum()
    if on & {"gradient", "sharpness"}:
        gx, gy = K.sobel(gray)
        mag = np.hypot(gx, gy).astype(np.float64)
        if "gradient" in on:
            out |= {"gradient.magnitude_mean": mag.mean(), "gradient.magnitude_std": mag.std(), "gradient.magnitude_p90": np.percentile(mag, 90)}
            live = mag >= 1
            if live.any():
                angle = np.mod(np.arctan2(gy[live], gx[live]) + np.pi, np.pi)
                out["gradient.orientation_entropy"] = K.entropy_bits(np.histogram(angle, bins=8, range=(0, np.pi))[0])
        if "sharpness" in on:
            out["sharpness.laplacian_variance"] = K.laplacian(gray).astype(np.float64).var() if min(gray.shape) >= 3 else None
            out["sharpness.tenengrad_mean"] = (gx.astype(np.float64) ** 2 + gy.astype(np.float64) ** 2).mean()
    if "contrast" in on:
        lo, hi = np.percentile(g64, [10, 90])
        out |= {"contrast.gray_std": g64.std(), "contrast.p10_p90_range": hi - lo}
        if padded is not None and padded.size > gray.size:
            oy, ox = offset if offset is not None else ((padded.shape[0] - gray.shape[0]) // 2, (padded.shape[1] - gray.shape[1]) // 2)
            ring = np.ones(padded.shape, bool)
            ring[oy : oy + gray.shape[0], ox : ox + gray.shape[1]] = False
            if ring.any() and not ring.all():
                out["contrast.local_ring_delta"] = padded[~ring].mean() - padded[ring].mean()
    if on & {"stroke", "shape"}:
        mask = K.text_mask(gray)
        if mask is not None and "stroke" in on:
            width = 2 * K.distance(mask)[K.skeleton(mask)]
            width = width[width > 0]
            if len(width):
                q = np.percentile(width, [25, 50, 75, 90])
                out["stroke.valid_fraction"] = len(width) / gray.size
                out |= {"stroke.width_median": q[1], "stroke.width_std": width.std(), "stroke.width_iqr": q[2] - q[0], "stroke.width_p90": q[3]}
        if mask is not None and "shape" in on:
            out |= _shapes(mask)
    if "texture" in on:
        out["texture.gray_entropy"] = K.entropy_bits(np.bincount(gray.ravel(), minlength=256))
        codes = np.bincount(K.lbp_uniform(gray).ravel(), minlength=10)
        out |= {"texture.lbp_uniform_fraction": codes[:9].sum() / codes.sum(), "texture.lbp_entropy": K.entropy_bits(codes)}
        out["texture.glcm_contrast"], out["texture.glcm_homogeneity"] = K.glcm(gray)
    return _finite(out)


def _shapes(mask: np.ndarray) -> dict[str, float | None]:
    labels, n = K.components(mask)
    areas = np.bincount(labels.ravel(), minlength=n + 1)
    rows = []
    for i in np.flatnonzero(areas[1:] >= 3) + 1:
        ys, xs = np.nonzero(labels == i)
        one = (labels == i)[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        line = K.contour(one)
        solid = K.polygon_area(K.hull(line))
        rows.append((areas[i], one.shape[1] / one.shape[0], K.perimeter(line) ** 2 / areas[i], areas[i] / solid if solid > 0 else None))
    if not rows:
        return {}
    area, aspect, compact, solid = zip(*rows, strict=True)
    solid = [s for s in solid if s is not None]
    return {
        "shape.component_count": float(len(rows)), "shape.component_area_median": float(np.median(area) / mask.size), "shape.component_aspect_median": float(np.median(aspect)),
        "shape.compactness_mean": float(np.mean(compact)), "shape.solidity_mean": float(np.mean(solid)) if solid else None, "shape.hole_count": float(K.holes(mask)),
    }


LONG = "sample_id long, region_id string, feature string, `group` string, value double, status string, formula_id string, reason string, x long, y long, w long, h long, iw long, ih long"
SCHEMA = pa.schema(
    [("sample_id", pa.int64()), *((c, pa.string()) for c in ("region_id", "feature", "group")), ("value", pa.float64()), *((c, pa.string()) for c in ("status", "formula_id", "reason")),
     *((c, pa.int64()) for c in ("x", "y", "w", "h", "iw", "ih"))]
)
FORMULAS = {n: f for table in (REGION_FEATURES, IMAGE_FEATURES) for n, _, f in _named(table, None)}


class _Batch:
    """Rows of the long table for a whole batch of images."""

    def __init__(self):
        self.cols: dict[str, list] = {c: [] for c in SCHEMA.names}

    def add(self, **row) -> None:
        for c, v in self.cols.items():
            v.append(row.get(c))

    def region(self, sample, region: str, values: dict, registry: list, box=(), image=()) -> None:
        """A row that has the box, and one for each feature."""
        self.add(sample_id=sample, region_id=region, status="region", **dict(zip(("x", "y", "w", "h", "ih", "iw"), (*box, *image), strict=True)))
        for name, group in registry:
            v = values.get(name)
            self.add(
                sample_id=sample, region_id=region, feature=name, group=group, value=v, status="ok" if v is not None else "unavailable", formula_id=FORMULAS[name],
                reason=None if v is not None else "no value",
            )

    def arrow(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(self.cols, schema=SCHEMA)


def region_features_of_grays(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Long features of whole gray images (sample_id, height, width, px array<int>), each one region."""
    registry = region_registry(groups)

    def run(batches):
        for b in batches:
            out = _Batch()
            for s, h, w, px in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                gray = np.array(px, np.uint8).reshape(h, w)
                poly = np.array([(0, 0), (w, 0), (w, h), (0, h)], float)
                out.region(s, f"{s}-r000", region_features(gray, (0, 0, w, h), (h, w), polygon=poly, groups=groups), registry, (0, 0, w, h), (h, w))
            yield out.arrow()

    return df.select("sample_id", "height", "width", "px").mapInArrow(run, LONG).filter("status <> 'region'")


def padded_crop(box: tuple[int, int, int, int], height: int, width: int, ratio: float) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1): the edges moved out by a share of the sides, rounded half to even, inside the image."""
    x, y, w, h = box
    return max(0, round(x - w * ratio)), max(0, round(y - h * ratio)), min(width, round(x + w + w * ratio)), min(height, round(y + h + h * ratio))


def extract(images: DataFrame, detector, groups: list[str] | None = None, pad: float = 0.05) -> DataFrame:
    """Long features of every detected region of raw images (sample_id, height, width, rgb binary).

    ``detector(gray)`` gives polygons; without one they are taken from the column ``polygons``. A region has a row of status region with its box, then one for each
    feature. An image without pixels, or one that fails, is a row of status failed with its reason, never an exception.
    """
    registry = region_registry(groups)

    def run(batches):
        for b in batches:
            out = _Batch()
            given = [None] * len(b) if detector else b.column(4).to_pylist()
            for s, h, w, raw, polygons in zip(*(b.column(i).to_pylist() for i in range(4)), given, strict=True):
                if raw is None:
                    out.add(sample_id=s, status="failed", reason="image cannot be decoded")
                    continue
                try:
                    found = []
                    gray = K.gray_fixed(np.frombuffer(raw, np.uint8).reshape(h, w, 3))
                    boxes = sorted(localize(detector(gray) if detector else polygons or [], h, w)[0], key=lambda r: (r["y"], r["x"], r["h"], r["w"]))
                    for r in boxes:
                        x, y, bw, bh = box = r["x"], r["y"], r["w"], r["h"]
                        x0, y0, x1, y1 = padded_crop(box, h, w, pad)
                        v = region_features(gray[y : y + bh, x : x + bw], box, (h, w), polygon=r["polygon"], padded=gray[y0:y1, x0:x1], offset=(y - y0, x - x0), groups=groups)
                        found.append((box, v))
                    for i, (box, v) in enumerate(found):
                        out.region(s, f"{s}-r{i:03d}", v, registry, box, (h, w))
                except Exception as e:  # one bad image is a row
                    out.add(sample_id=s, status="failed", reason=str(e)[:200])
            yield out.arrow()

    return images.select("sample_id", "height", "width", "rgb", *([] if detector else ["polygons"])).mapInArrow(run, LONG)


def localize(polygons: list, height: int, width: int, least: int = 3) -> tuple[list[dict], list[str]]:
    """(boxes inside the image with flags, reasons of the rejected polygons)."""
    out, reasons = [], []
    for p in polygons:
        if not isinstance(p, list | tuple | np.ndarray) or len(p) < 3:
            reasons.append("malformed_polygon")
            continue
        try:
            pts = np.array([(float(q[0]), float(q[1])) for q in p])
        except (TypeError, ValueError, IndexError):
            reasons.append("malformed_point")
            continue
        if not np.isfinite(pts).all():
            reasons.append("malformed_point")
            continue
        side = np.array([width, height])
        low, high = (np.clip(edge, 0, side).astype(int) for edge in (np.floor(pts.min(axis=0)), np.ceil(pts.max(axis=0))))
        if (high <= low).any():
            reasons.append("empty_after_clipping")
            continue
        if (high - low < least).any():
            reasons.append("too_small")
            continue
        inside = np.clip(pts, 0, side)
        x, y, w, h = map(int, (*low, *(high - low)))
        out.append({"x": x, "y": y, "w": w, "h": h, "polygon": inside, "flags": ["clipped_geometry"] if (inside != pts).any() else []})
    return out, reasons


def quality_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add flags: missing:{column} for every null of the wide row, in order."""
    return df.withColumn("flags", F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNull(), F.lit(f"missing:{c}")) for c in columns)))))
