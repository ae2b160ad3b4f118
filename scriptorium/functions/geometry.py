"""Boxes and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_box(poly: Column) -> Column:
    """The least box around an array of [x, y] points."""
    x, y = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x_min"), F.array_min(y).alias("y_min"), F.array_max(x).alias("x_max"), F.array_max(y).alias("y_max"))


def box_measures(box: str) -> list[Column]:
    b = F.col(box)
    return [((b.x_min + b.x_max) / 2).alias("cx"), ((b.y_min + b.y_max) / 2).alias("cy"), (b.x_max - b.x_min).alias("width"), (b.y_max - b.y_min).alias("height")]


def crop_box(box: str, width: Column | str, height: Column | str, pad: int = 20) -> Column:
    """The box in whole pixels, padded, inside the image."""
    b = F.col(box)
    w, h = (F.col(x) if isinstance(x, str) else x for x in (width, height))
    low = lambda v: F.greatest(F.lit(0), (v - pad).cast("int"))
    return F.struct(low(b.x_min).alias("x_min"), low(b.y_min).alias("y_min"), F.least(w.cast("int"), (b.x_max + pad).cast("int")).alias("x_max"), F.least(h.cast("int"), (b.y_max + pad).cast("int")).alias("y_max"))


def valid_box(coordinates: Column | str) -> Column:
    return F.size(coordinates) == 4


def whole_box(coordinates: Column | str) -> Column:
    return F.transform(coordinates, lambda v: v.cast("int"))
