"""Sinks: manifests, features, reports, bundles, run manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import subprocess
import zipfile
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.scalars import finite
from pixelmill.sources.manifest import COLUMNS


def write_manifest(df: DataFrame, path: str, order: str = "sample_id") -> None:
    """The fixed columns as one CSV part; null is empty."""
    df.select(*COLUMNS).orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """All rows with the union of the columns, first seen first."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def without_nan(df: DataFrame) -> DataFrame:
    return df.select(*(finite(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def write_features(long_: DataFrame, wide: DataFrame, path: str) -> None:
    """Long table partitioned by group, wide table by split, both Parquet, and the long one as JSON lines."""
    long_.write.mode("overwrite").partitionBy("group").parquet(f"{path}/region_features")
    w = wide.write.mode("overwrite")
    (w.partitionBy("split") if "split" in wide.columns else w).parquet(f"{path}/image_features")
    without_nan(long_).write.mode("overwrite").json(f"{path}/region_features_jsonl")


def append_checkpoint(df: DataFrame, path: str, batch: str) -> None:
    """One finished batch, written by an atomic job commit; the batch's folder is replaced when it is redone."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(path: str, value: object) -> None:
    with open(path, "w") as f:
        json.dump(value, f, sort_keys=True, indent=2, allow_nan=False)


def csv_bytes(rows: list[dict]) -> bytes:
    """Union of keys, first seen first; null is empty."""
    keys = list(dict.fromkeys(k for r in rows for k in r))
    out = io.StringIO()
    w = csv.DictWriter(out, keys, lineterminator="\n")
    w.writeheader()
    w.writerows({k: "" if r.get(k) is None else r[k] for k in keys} for r in rows)
    return out.getvalue().encode()


def zip_folder(folder: str, path: str) -> list[str]:
    """Deflated bundle of a finished folder, entries sorted."""
    names = sorted(os.path.relpath(os.path.join(top, f), folder) for top, _, files in os.walk(folder) for f in files)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(os.path.join(folder, n), n)
    return names


def draw_boxes(rgb, boxes: list[dict]):
    """A copy of the image with red outlines."""
    out = rgb.copy()
    for b in boxes:
        x0, y0, x1, y1 = b["x"], b["y"], b["x"] + b["w"] - 1, b["y"] + b["h"] - 1
        out[[y0, y1], x0 : x1 + 1] = (255, 0, 0)
        out[y0 : y1 + 1, [x0, x1]] = (255, 0, 0)
    return out


def overlays(images: DataFrame, detector) -> DataFrame:
    """(sample_id, png) of raw images with their detected boxes."""
    import numpy as np

    from pixelmill.functions.kernels import gray_fixed
    from pixelmill.operators.features import localize
    from pixelmill.sources.images import encode_png

    def run(batches):
        for b in batches:
            for s, h, w, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rgb = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                png = encode_png(draw_boxes(rgb, localize(detector(gray_fixed(rgb)), h, w)[0]))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([png], pa.binary())], names=["sample_id", "png"])

    return images.select("sample_id", "height", "width", "rgb").mapInArrow(run, "sample_id long, png binary")


def evaluation_report(metrics: dict, predictions: DataFrame, folder: str) -> None:
    """metrics.json, confusion.csv and summary.md beside the predictions."""
    os.makedirs(folder, exist_ok=True)
    write_json(f"{folder}/metrics.json", metrics)
    with open(f"{folder}/confusion.csv", "wb") as f:
        f.write(csv_bytes([{k: metrics[k] for k in ("tn", "fp", "fn", "tp")}]))
    lines = ["# Evaluation", "", *(f"- {k}: {metrics[k]}" for k in sorted(metrics))]
    with open(f"{folder}/summary.md", "w") as f:
        f.write("\n".join(lines) + "\n")
    write_csv(predictions, f"file://{os.path.abspath(folder)}/predictions")


def load_report(spark, folder: str) -> tuple[dict, DataFrame]:
    """(metrics, predictions) of a report; raises if the metrics don't follow from the predictions."""
    from pixelmill.operators.evaluation import metric_mismatches
    from pixelmill.sources.manifest import read_predictions

    with open(f"{folder}/metrics.json") as f:
        metrics = json.load(f)
    predictions = read_predictions(spark, f"file://{os.path.abspath(folder)}/predictions")
    stated = {k: metrics[k] for k in ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1")}
    bad = metric_mismatches(predictions, stated, "true_label", "predicted_label").collect()
    if bad:
        raise ValueError(f"metrics differ from the predictions: {[r['metric'] for r in bad]}")
    return metrics, predictions


def now_utc() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def source_revision(folder: str) -> str:
    """The commit of a working tree, or a hash of its Python files."""
    got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    if got.returncode == 0:
        return got.stdout.strip()
    h = hashlib.sha256()
    for top, dirs, files in os.walk(folder):
        dirs[:] = sorted(d for d in dirs if d not in ("data", "artifacts", "__pycache__", ".git"))
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(top, f), "rb") as g:
                    h.update(os.path.relpath(os.path.join(top, f), folder).encode() + g.read())
    return "tree-" + h.hexdigest()


def run_manifest(path: str, *, run_id: str, started_at: str, config: dict, counts: dict, status: str = "completed", **extra) -> dict:
    out = {"run_id": run_id, "status": status, "started_at_utc": started_at, "completed_at_utc": now_utc(), "config_sha256": sha256_json(config), "counts": counts, **extra}
    write_json(path, out)
    return out
