"""Bounding boxes as structs (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(k) for c, k in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    either = area(a) + area(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def contained(element: Column, within: Column) -> Column:
    """The share of the element's area that lies within the other box; 0 for an element without area."""
    return F.when(area(element) > 0, intersection(element, within) / area(element)).otherwise(F.lit(0.0))


def vertical_gap(a: Column, b: Column) -> Column:
    """0 where the boxes overlap in height."""
    return F.greatest(F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"]), F.lit(0.0))


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def flipped(b: Column, height: Column) -> Column:
    """From a y axis that points up to one that points down."""
    return box(b["x0"], height - b["y1"], b["x1"], height - b["y0"])


def relative(b: Column, width: Column, height: Column) -> Column:
    return scaled(b, 1 / width, 1 / height)
