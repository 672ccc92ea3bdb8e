"""Image sources: PNG decoding in numpy, Spark's image source, generated fixtures."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
RASTER = "sample_id long, height int, width int, rgb binary"


def encode_png(rgb: np.ndarray) -> bytes:
    """8-bit RGB without filters, level 6."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = rgb.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes, composite: bool = True) -> np.ndarray:
    """RGB of an 8-bit, not interlaced PNG; alpha over white, or dropped."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, head, body, palette, alpha = 8, None, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("unsupported PNG")
    w, h, _, color, *_ = head
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h, w * bands), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].copy(), out[y - 1] if y else np.zeros(w * bands, np.uint8)
        f = raw[y, 0]
        if f == 2:
            line += up
        elif f == 1:
            line = np.cumsum(line.reshape(-1, bands), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif f in (3, 4):
            left = np.zeros(bands, np.int64)
            corner = np.zeros(bands, np.int64)
            for i in range(0, len(line), bands):
                b = up[i : i + bands].astype(np.int64)
                if f == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
                line[i : i + bands] = (line[i : i + bands] + guess) & 255
                left, corner = line[i : i + bands].astype(np.int64), b
        out[y] = line
    px = out.reshape(h, w, bands)
    if color == 3:
        a = np.full(len(palette), 255, np.uint8)
        if alpha is not None:
            a[: len(alpha)] = alpha
        px = np.concatenate([palette[px[..., 0]], a[px[..., 0]][..., None]], axis=2)
    elif color in (0, 4):
        px = np.concatenate([np.repeat(px[..., :1], 3, axis=2), px[..., 1:]], axis=2)
    if px.shape[2] == 4 and composite:
        a = px[..., 3:].astype(np.float64) / 255
        return np.rint(px[..., :3] * a + 255 * (1 - a)).astype(np.uint8)
    return np.ascontiguousarray(px[..., :3])


def rasters(files: DataFrame, composite: bool = True) -> DataFrame:
    """Rasters of PNG files (sample_id, content); a file that can't be read has null sides and bytes."""

    def run(batches):
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rgb = decode_png(data, composite)
                    row = [[s], [rgb.shape[0]], [rgb.shape[1]], [rgb.tobytes()]]
                except Exception:  # counted by the null row
                    row = [[s], [None], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["sample_id", "height", "width", "rgb"])

    return files.select("sample_id", "content").mapInArrow(run, RASTER)


def from_image_source(images: DataFrame) -> DataFrame:
    """(origin, height, width, rgb) of Spark's image source, whose bytes are blue, green, red."""

    @F.pandas_udf("binary")
    def flip(data, bands):
        return data.combine(bands, lambda d, n: np.frombuffer(d, np.uint8).reshape(-1, n)[:, [2, 1, 0]].tobytes() if n >= 3 else np.repeat(np.frombuffer(d, np.uint8), 3).tobytes())

    return images.select("image.origin", "image.height", "image.width", flip("image.data", "image.nChannels").alias("rgb"))


def fixture_image(index: int, ai: bool, seed: int) -> np.ndarray:
    """A white page with three to five dark bars; sides and bars follow from the index and the seed."""
    rng = np.random.default_rng([seed, index, int(ai)])
    w, h = 320 + 16 * (index % 4), 220 + 12 * (index % 3)
    img = np.full((h, w, 3), 255, np.uint8)
    for k in range(3 + index % 3):
        y, x = 20 + 38 * k, int(rng.integers(15, 60))
        img[y : y + int(rng.integers(8, 16)), x : x + int(rng.integers(80, 220))] = 25
    if ai:
        img = np.roll(img, index % 3 - 1, axis=1)
        if index % 4 == 0:
            soft = (img.astype(np.float64) * 2 + np.roll(img, 1, 0) + np.roll(img, -1, 0)) / 4
            img = np.rint(soft).astype(np.uint8)
    return img


def fixtures(spark: SparkSession, per_label: int = 12, seed: int = 42) -> DataFrame:
    """Generated images: sample_id, label, group_id, height, width, rgb."""

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                ai = i >= per_label
                img = fixture_image(i % per_label, ai, seed)
                row = [[i], ["ai_generated" if ai else "non_ai_generated"], [f"fixture-{i}"], [img.shape[0]], [img.shape[1]], [img.tobytes()]]
                types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["sample_id", "label", "group_id", "height", "width", "rgb"])

    return spark.range(2 * per_label).mapInArrow(run, "sample_id long, label string, group_id string, height int, width int, rgb binary")
