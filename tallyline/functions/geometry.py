"""Boxes as structs (x0, y0, x1, y1) and the measures on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def is_valid(b: Column) -> Column:
    """Finite and ordered."""
    finite = F.lit(True)
    for side in ("x0", "y0", "x1", "y1"):
        finite = finite & b[side].isNotNull() & ~F.isnan(b[side]) & (F.abs(b[side]) < float("inf"))
    return finite & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def intersection(a: Column, b: Column) -> Column:
    return horizontal_overlap(a, b) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    return _ratio(shared, area(a) + area(b) - shared)


def ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller box."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def vertical_overlap(a: Column, b: Column) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return _ratio(shared, F.least(height(a), height(b)))


def center_inside(inner: Column, outer: Column) -> Column:
    return center_x(inner).between(outer["x0"], outer["x1"]) & center_y(inner).between(outer["y0"], outer["y1"])


def union_box(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def grid(b: Column, page_width: Column, page_height: Column, cells: int = 64) -> Column:
    """The box in whole cells of a page grid, outwards, kept on the page."""
    low = lambda v, of: F.greatest(F.lit(0), F.least(F.lit(cells), F.floor(v / of * cells))).cast("int")
    high = lambda v, of: F.greatest(F.lit(0), F.least(F.lit(cells), F.ceil(v / of * cells))).cast("int")
    return F.struct(low(b["x0"], page_width).alias("x0"), low(b["y0"], page_height).alias("y0"), high(b["x1"], page_width).alias("x1"), high(b["y1"], page_height).alias("y1"))
