"""Boxes and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def center(prefix: str = "") -> tuple[Column, Column]:
    x1, y1, x2, y2 = box(prefix)
    return (x1 + x2) / 2, (y1 + y2) / 2


def iou(a: str = "a_", b: str = "b_") -> Column:
    """Intersection over union of two boxes; 0 if they don't overlap or have no area, null if either is missing."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = box(a), box(b)
    wide = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    high = F.least(ay2, by2) - F.greatest(ay1, by1)
    both = F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - both
    return F.when(ax1.isNotNull() & bx1.isNotNull(), F.when(union > 0, both / union).otherwise(F.lit(0.0)))


def distance(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))


def box_distance(x: Column, y: Column, prefix: str = "") -> Column:
    """From a point to the nearest point of a box; 0 inside, null if either is missing."""
    x1, y1, x2, y2 = box(prefix)
    near = distance(x, y, F.greatest(x1, F.least(x, x2)), F.greatest(y1, F.least(y, y2)))
    return F.when(x.isNotNull() & y.isNotNull() & x1.isNotNull(), near)


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, k: Column | float) -> Vector:
    return tuple(x * k for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Of length one; a null vector stays as it is."""
    return scale(a, 1 / (norm(a) + 1e-8))


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors; 0 if either is shorter than 1e-6, null if either is missing."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    there = a[0].isNotNull() & b[0].isNotNull()
    return F.when(there & ((norm(a) < 1e-6) | (norm(b) < 1e-6)), F.lit(0.0)).when(there, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def choose(cases: list[tuple[Column, Vector]], other: Vector) -> Vector:
    """The vector of the first case that holds."""
    out = []
    for i in range(3):
        e = other[i]
        for when, v in reversed(cases):
            e = F.when(when, v[i]).otherwise(e)
        out.append(e)
    return tuple(out)


def resizing(policy: str, width: Column, height: Column, to_width: int, to_height: int) -> dict[str, Column]:
    """``scale_x, scale_y, pad_left, pad_top`` of frames brought to a size: ``none``, ``resize`` (each side by itself), ``letterbox`` (fits
    inside, padded evenly) or ``crop_center`` (covers, cut evenly: negative pads).  Sides are cut to whole pixels."""
    across, down = F.lit(float(to_width)) / width, F.lit(float(to_height)) / height
    zero = F.lit(0).cast("long")
    if policy in ("none", "resize"):
        one = F.lit(1.0)
        return {"scale_x": across if policy == "resize" else one, "scale_y": down if policy == "resize" else one, "pad_left": zero, "pad_top": zero}
    if policy not in ("letterbox", "crop_center"):
        raise ValueError(f"no such resizing: {policy}")
    inside = policy == "letterbox"
    k = F.least(across, down) if inside else F.greatest(across, down)

    def pad(side: Column, to: int) -> Column:
        new = (side * k).cast("long")
        return F.floor((F.lit(to) - new) / 2) if inside else -F.floor((new - F.lit(to)) / 2)

    return {"scale_x": k, "scale_y": k, "pad_left": pad(width, to_width), "pad_top": pad(height, to_height)}


def to_original(x: Column, y: Column) -> tuple[Column, Column]:
    """A point of the resized frame in the original one; the columns of ``resizing`` are there."""
    return (x - F.col("pad_left")) / F.col("scale_x"), (y - F.col("pad_top")) / F.col("scale_y")


def to_processed(x: Column, y: Column) -> tuple[Column, Column]:
    return x * F.col("scale_x") + F.col("pad_left"), y * F.col("scale_y") + F.col("pad_top")
