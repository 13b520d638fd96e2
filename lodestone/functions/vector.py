"""Vector and geometry functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return inner_product(a, b) / F.nullif(F.sqrt(inner_product(a, a) * inner_product(b, b)), F.lit(0.0))


def span_scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max normal form; an empty span counts as one."""
    return (value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def overlap_share(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Area of a's part inside b, as a share of a; 0 for an empty a."""
    w = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    h = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Euclidean distance of a point to a segment; city-block distance where the segment is a point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))))
    qx, qy = px - (ax + t * dx), py - (ay + t * dy)
    return F.when(length == 0, F.abs(px - ax) + F.abs(py - ay)).otherwise(F.sqrt(qx * qx + qy * qy))


def box_distance(px, py, x0, y0, x1, y1) -> Column:
    """City-block distance of a point to a rectangle."""
    out = lambda p, lo, hi: F.greatest(lo - p, F.lit(0.0), p - hi)
    return out(px, x0, x1) + out(py, y0, y1)
