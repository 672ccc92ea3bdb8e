"""Scalar column expressions: labels, paths, ids, numbers, hashes, boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelmill.functions.hamming import average_hashes

# Label aliases of both label vocabularies and their codes.
PROTOTYPE_LABELS = {"real": "non_ai_generated", "non-ai-generated": "non_ai_generated", "ai-generated": "ai_generated", "non_ai_generated": "non_ai_generated", "ai_generated": "ai_generated"}
PILOT_LABELS = {"REAL": "REAL", "AI": "AI_GENERATED", "FAKE": "AI_GENERATED", "AI_GENERATED": "AI_GENERATED", "AI-GENERATED": "AI_GENERATED"}
LABEL_CODES = {"non_ai_generated": 0, "ai_generated": 1, "REAL": 0, "AI_GENERATED": 1}
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes"), ("0", "false", "no", "")


def lookup(table: dict, key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def prototype_label(c: Column, strict: bool = False) -> Column:
    """Canonical label; unknown gives null, or an error with ``strict``."""
    out = lookup(PROTOTYPE_LABELS, F.lower(F.trim(c)))
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c, F.lit("null"))))) if strict else out


def pilot_label(c: Column) -> Column:
    return lookup(PILOT_LABELS, F.upper(F.trim(c)))


def label_code(c: Column) -> Column:
    return lookup(LABEL_CODES, c)


def safe_relative_path(c: Column) -> Column:
    """Whether a path is relative and stays under its root, with backslashes as slashes."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    depth = F.aggregate(
        F.split(p, "/"), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda s, x: F.struct(
            (s["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("d"),
            (s["ok"] & (s["d"] + F.when(x == "..", -1).otherwise(0) >= 0)).alias("ok"),
        ),
    )
    return F.coalesce((F.trim(p) != "") & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & depth["ok"] & (depth["d"] > 0), F.lit(False))


def slug(c: Column) -> Column:
    s = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("image"))


def bool_like(c: Column) -> Column:
    """True, false, or null for a word that is neither."""
    w = F.lower(F.trim(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def number(c: Column) -> Column:
    """A double, null where the text is none."""
    return c.try_cast("double")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def logit(p: Column) -> Column:
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(F.ln(p / F.when((p > 0) & (p < 1), 1 - p).otherwise(1.0)))


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(pixels: Column) -> Column:
    """64 bits of 64 values: value >= mean, the first value highest; null for no values."""
    return F.arrow_udf(_average_hash, "long")(pixels)


def _average_hash(pixels: pa.Array) -> pa.Array:
    out, sizes = np.zeros(len(pixels), np.int64), pixels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, ends = pixels.flatten(), np.cumsum(sizes)
    known, values = flat.is_valid().to_numpy(zero_copy_only=False), flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == n)
        at = (ends[own] - n)[:, None] + np.arange(n)
        out[own] = average_hashes(values[at], known[at])
    return pa.array(out, mask=sizes == 0)


def polygon_box(poly: Column) -> Column:
    """(x0, y0, x1, y1): floor of the least, ceiling of the greatest coordinates of points {x, y}."""
    lo = lambda k: F.floor(F.array_min(F.transform(poly, lambda p: p[k])))
    hi = lambda k: F.ceil(F.array_max(F.transform(poly, lambda p: p[k])))
    return F.struct(lo("x").alias("x0"), lo("y").alias("y0"), hi("x").alias("x1"), hi("y").alias("y1"))


def clip_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box {x, y, w, h} inside the image; null if nothing is left."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def padded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, ratio: float = 0.05) -> Column:
    """The box with its edges moved out by a share of its sides, each edge rounded half to even, inside the image."""
    share = F.lit(ratio)
    x0, y0 = F.greatest(F.bround(x - w * share), F.lit(0)), F.greatest(F.bround(y - h * share), F.lit(0))
    x1, y1 = F.least(F.bround(x + w + w * share), width), F.least(F.bround(y + h + h * share), height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def normalized_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box {x, y, w, h} as shares of the image's sides."""
    return F.struct((x / width).alias("x"), (y / height).alias("y"), (w / width).alias("w"), (h / height).alias("h"))


def normalized_polygon(poly: Column, width: Column, height: Column) -> Column:
    """The points {x, y} as shares of the image's sides."""
    return F.transform(poly, lambda p: F.struct((p["x"] / width).alias("x"), (p["y"] / height).alias("y")))
