"""Small-raster stencils as array expressions: an image is an array of gray values, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _reflect(i: Column, n: int) -> Column:
    """Border index without repeating the edge: -1 is 1, n is n - 2."""
    i = F.abs(i)
    return F.when(i >= n, F.lit(2 * n - 2) - i).otherwise(i)


def _at(px: Column, y: Column, x: Column, h: int, w: int) -> Column:
    return F.get(px, (_reflect(y, h) * w + _reflect(x, w)).cast("int"))


def _each(h: int, w: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: f((i / w).cast("int"), i % w))


def sobel(px: Column, h: int, w: int, axis: str) -> Column:
    """3 x 3 derivative along ``axis``."""

    def at(y: Column, x: Column) -> Column:
        total = F.lit(0).cast("long")
        for d, k in ((-1, 1), (0, 2), (1, 1)):
            a, b = ((y + d, x + 1), (y + d, x - 1)) if axis == "x" else ((y + 1, x + d), (y - 1, x + d))
            total = total + k * (_at(px, *a, h, w) - _at(px, *b, h, w))
        return total

    return _each(h, w, at)


def laplacian(px: Column, h: int, w: int) -> Column:
    """Four-neighbour Laplacian."""
    return _each(h, w, lambda y, x: _at(px, y - 1, x, h, w) + _at(px, y + 1, x, h, w) + _at(px, y, x - 1, h, w) + _at(px, y, x + 1, h, w) - 4 * _at(px, y, x, h, w))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance in two passes."""
    m = mean(a)
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + (v.cast("double") - m) * (v.cast("double") - m)) / F.size(a)


def entropy(a: Column) -> Column:
    """Entropy in bits of the value counts."""
    share = F.transform(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda u: u == v)) / F.size(a))
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def levels(px: Column) -> Column:
    """16 gray levels; store them as a column before ``cooccurrence``, which reads them many times."""
    return F.transform(px, lambda v: F.floor(v * 16 / 256))


def cooccurrence(level: Column, h: int, w: int, weight) -> Column:
    """Mean over four angles of the mean ``weight`` of level differences at distance 1."""
    total = F.lit(0.0)
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        cells = [(y * w + x, (y + dy) * w + x + dx) for y in range(h) for x in range(w) if 0 <= y + dy < h and 0 <= x + dx < w]
        pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cells))
        diff = F.transform(pairs, lambda p: weight((F.get(level, p["a"]) - F.get(level, p["b"])).cast("double")))
        total = total + mean(diff)
    return total / 4
