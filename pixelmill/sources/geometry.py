"""Geometry of other detectors: flattening nested output, regions read from a table."""

from __future__ import annotations

from collections.abc import Iterator
from numbers import Real

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ = (list, tuple, np.ndarray)


def _flat(v: object, least: int) -> bool:
    """A sequence that starts with ``least`` numbers."""
    return isinstance(v, SEQ) and len(v) >= least and all(isinstance(x, Real) for x in v[:least])


def _leaves(tree: object, fits) -> Iterator:
    """The outermost branches that fit, in order; others are entered, what is no branch is left out."""
    todo = [tree]
    while todo:
        v = todo.pop()
        if fits(v):
            yield v
        elif isinstance(v, SEQ):
            todo.extend(reversed(list(v)))


def polygons_of(boxes: object, free: object = ()) -> list[list[tuple[float, float]]]:
    """Polygons of upright boxes (least x, greatest x, least y, greatest y) and of free point lists, however nested."""
    out = []
    for v in _leaves(boxes, lambda v: _flat(v, 4)):
        x0, x1, y0, y1 = map(float, v[:4])
        out.append([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    for v in _leaves(free, lambda v: isinstance(v, SEQ) and len(v) >= 3 and all(_flat(p, 2) for p in v)):
        out.append([(float(p[0]), float(p[1])) for p in v])
    return out


def with_polygons(images: DataFrame, geometry: DataFrame, key: str = "sample_id") -> DataFrame:
    """``images`` with ``polygons``, all (``polygon`` array<array<double>>) rows of ``geometry`` for the image; none: empty.

    An image's polygons are gathered into its row, as extraction takes an image at once.
    """
    per = geometry.filter("polygon is not null").groupBy(key).agg(F.array_sort(F.collect_list("polygon")).alias("polygons"))
    return images.join(per, key, "left").withColumn("polygons", F.coalesce("polygons", F.array().cast("array<array<array<double>>>")))
