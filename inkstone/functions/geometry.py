"""Boxes as Columns: areas, overlaps and unions of structs with x0, top, x1, bottom, or of [x0, top, x1, bottom]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), bottom - top)


def overlap_ratio(box: Column, bbox: Column) -> Column:
    """The share of a box (struct) that lies in a bbox (array); 0 for an empty box or no bbox."""
    left, upper = F.greatest(box.x0, bbox[0]), F.greatest(box.top, bbox[1])
    right, lower = F.least(box.x1, bbox[2]), F.least(box.bottom, bbox[3])
    own = area(box.x0, box.top, box.x1, box.bottom)
    return F.when((own > 0) & (F.coalesce(F.size(bbox), F.lit(0)) == 4), area(left, upper, right, lower) / own).otherwise(0.0)


def center_inside(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Is the middle of one interval inside another, give or take 1?"""
    return ((a0 + a1) / 2).between(b0 - 1, b1 + 1)


def round_bbox(bbox: Column) -> Column:
    """Two decimals; null unless there are four values."""
    return F.when(F.size(bbox) == 4, F.transform(bbox, lambda v: F.round(v, 2)))


def union_bbox(boxes: Column) -> Column:
    """The bbox around all boxes of an array of structs, null for none."""
    edge = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    return F.when(F.size(boxes) > 0, round_bbox(F.array(edge(F.array_min, "x0"), edge(F.array_min, "top"), edge(F.array_max, "x1"), edge(F.array_max, "bottom"))))
