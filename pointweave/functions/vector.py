"""Three-component vector algebra; a vector is a tuple of three Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def vec(x, y, z) -> Vec:
    return tuple(F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def mul(a: Vec, b: Vec) -> Vec:
    return tuple(p * q for p, q in zip(a, b))


def div(a: Vec, b: Vec) -> Vec:
    return tuple(p / q for p, q in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def length2(a: Vec) -> Column:
    return dot(a, a)


def length(a: Vec) -> Column:
    return F.sqrt(length2(a))


def distance2(a: Vec, b: Vec) -> Column:
    return length2(sub(a, b))


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(distance2(a, b))


def normalize(a: Vec) -> Vec:
    """Unit vector; a zero vector stays zero."""
    size = length(a)
    return tuple(F.when(size > 0, p / size).otherwise(F.lit(0.0)) for p in a)


def lerp(a: Vec, b: Vec, t) -> Vec:
    return tuple(p + (q - p) * t for p, q in zip(a, b))


def clamp(value, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def angle_degrees(a: Vec, b: Vec) -> Column:
    """Angle between two unit vectors."""
    return F.degrees(F.acos(clamp(dot(a, b), -1.0, 1.0)))


def is_valid(*coordinates) -> Column:
    """True where every coordinate is present and below the float sentinel."""
    limit = 3.402823466e36  # fixed value: coordinates at or above it mean "no point"
    result = F.lit(True)
    for c in coordinates:
        result = result & c.isNotNull() & ~F.isnan(c) & (c < limit)
    return F.coalesce(result, F.lit(False))
