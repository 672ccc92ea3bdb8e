"""File inventory and dataset preparation: scan, decode, mark duplicates, balance, write a manifest."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.operators import dedup as D
from pixelmill.sources import manifest as MF
from pixelmill.sources.images import PNG, decode_png, encode_png
from pixelmill.sources.sinks import write_manifest

HEADER = "format string, mode string, width int, height int, status string"


def image_header(data: bytes) -> tuple[str | None, str | None, int | None, int | None]:
    """(format, mode, width, height) of PNG, JPEG and WEBP files from their headers; nulls for others."""
    if data[:8] == PNG and len(data) >= 26:
        w, h, _, color = struct.unpack(">IIBB", data[16:26])
        return "PNG", {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color), w, h
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w, bands = struct.unpack(">HHB", data[at + 5 : at + 10])
                return "JPEG", {1: "L", 3: "RGB", 4: "CMYK"}.get(bands), w, h
            at += 2 + n
        return "JPEG", None, None, None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X" and len(data) >= 30:
            return "WEBP", "RGBA" if data[20] & 16 else "RGB", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        return "WEBP", None, None, None
    return None, None, None, None


def inventory(files: DataFrame) -> DataFrame:
    """path, label, bytes, sha256, format, mode, width, height, aspect (6 digits), status of scanned files."""
    names = ("path", "label", "length", "sha256")

    def run(batches):
        for b in batches:
            head = [image_header(x) for x in b.column(4).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*head, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
            status = pa.array(["ok" if h[2] else "unreadable" for h in head])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols, status], names=[*names, "format", "mode", "width", "height", "status"])

    out = files.select(*names, "content").mapInArrow(run, f"path string, label string, length long, sha256 string, {HEADER}")
    return out.withColumnRenamed("length", "bytes").withColumn("aspect", F.round(F.col("width") / F.nullif("height", F.lit(0)), 6))


NORMAL = "relative_path string, label string, source_sha256 string, source_width int, source_height int, perceptual_hash long, png binary, error string"


def normalized(files: DataFrame, width: int, height: int) -> DataFrame:
    """Decoded files resized to one size; a file that can't be read has its error and no image."""

    def run(batches):
        for b in batches:
            for path, label, sha, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                row = [path, label, sha, None, None, None, None, None]
                try:
                    rgb = decode_png(data)
                    out = K.resize_lanczos(rgb, height, width)
                    h = K.dct_hash(K.gray_rint(out))
                    row[3:7] = rgb.shape[1], rgb.shape[0], h - (1 << 64) if h >> 63 else h, encode_png(out)
                except Exception as e:  # kept as a row
                    row[7] = str(e)[:200]
                types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in NORMAL.split(", ")])

    return files.mapInArrow(run, NORMAL)


def prepare(spark: SparkSession, root: str, folders: dict[str, str], out: str, *, width: int = 1024, height: int = 1536, seed: int = 42, distance: int = 0) -> dict:
    """Scan label folders, normalise, exclude duplicates, review near ones, balance, and write images and manifest.

    Images go to ``out``/images as a Parquet table keyed by sample_id, the manifest to ``out``/manifest.
    """
    inside, skipped = MF.tree(spark, root, folders)
    files = inside.select("relative_path", "label", F.sha2("content", 256).alias("sha"), "content")
    norm = normalized(files, width, height)
    norm.write.mode("overwrite").parquet(f"{out}/normalized")
    norm = spark.read.parquet(f"{out}/normalized")
    good = norm.filter("png is not null")
    ids = D.occurrence_ids(good, F.col("label"), "source_sha256", ["relative_path"]).withColumnRenamed("occurrence_id", "sample_id")
    marked = D.prepare_marks(ids.drop("png"), id_col="sample_id", key="source_sha256", hash_col="perceptual_hash", label="label", order=["relative_path"], distance=distance)
    included = D.balanced_sample(marked.filter("status = 'included'"), "label", "sample_id", seed).select("sample_id", "selected")
    final = marked.join(included, "sample_id", "left").withColumn(
        "inclusion_status", F.when(F.col("status") != "included", F.col("status")).when(F.col("selected"), "included").otherwise("excluded")
    )
    reason = F.when(F.col("status") == "excluded", "exact duplicate").when(F.col("status") == "review", "near duplicate or mixed labels").when(F.col("inclusion_status") == "excluded", "class balance").otherwise("")
    images = final.select("sample_id", "inclusion_status", "relative_path").join(good.select("relative_path", "png"), "relative_path")
    images.filter("inclusion_status = 'included'").select("sample_id", "png", F.sha2("png", 256).alias("sha256")).write.mode("overwrite").parquet(f"{out}/images")
    sums = images.select("sample_id", F.sha2("png", 256).alias("sha256"))
    rows = final.join(sums, "sample_id").select(
        "sample_id", F.concat(F.lit("images/"), F.col("sample_id"), F.lit(".png")).alias("relative_path"), "label", F.lit("receipt").alias("category"),
        F.col("sample_id").alias("source_id"), F.col("source_sha256").alias("group_id"), F.lit("source").alias("provenance_type"), F.lit("file").alias("acquisition_type"),
        F.lit("unknown").alias("generator_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit("PNG").alias("format"), "sha256",
        F.lit("").alias("split"), "inclusion_status", reason.alias("exclusion_reason"),
    )
    write_manifest(rows, f"{out}/manifest")
    counts = {r["inclusion_status"]: r["count"] for r in rows.groupBy("inclusion_status").count().collect()}
    return {"files": inside.count(), "skipped": skipped.count(), "decode_failures": norm.filter("error is not null").count(), **counts}


def packages(spark: SparkSession, root: str) -> DataFrame:
    """Model packages under root/*/package/package.json, the newest first."""
    found = spark.read.format("binaryFile").load(f"{root}/*/package/package.json")
    family = F.get_json_object(F.col("content").cast("string"), "$.state.family")
    return found.select("path", "modificationTime", family.alias("family")).orderBy(F.desc("modificationTime"), F.desc("path"))
