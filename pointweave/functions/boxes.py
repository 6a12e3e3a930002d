"""Axis-aligned boxes as six Columns, and ray tests against simple shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from pointweave.functions import vector as V


@dataclass(frozen=True)
class Box:
    low: V.Vec
    high: V.Vec

    @staticmethod
    def named(prefix: str = "") -> "Box":
        return Box(
            V.vec(f"{prefix}min_x", f"{prefix}min_y", f"{prefix}min_z"),
            V.vec(f"{prefix}max_x", f"{prefix}max_y", f"{prefix}max_z"),
        )

    @staticmethod
    def literal(low, high) -> "Box":
        return Box(V.vec(*low), V.vec(*high))

    def expand(self, p: V.Vec) -> "Box":
        return Box(
            tuple(F.least(a, b) for a, b in zip(self.low, p)),
            tuple(F.greatest(a, b) for a, b in zip(self.high, p)),
        )

    def inflate(self, amount) -> "Box":
        return Box(tuple(a - amount for a in self.low), tuple(b + amount for b in self.high))

    def merge(self, other: "Box") -> "Box":
        return self.expand(other.low).expand(other.high)

    def contains(self, p: V.Vec) -> Column:
        test = F.lit(True)
        for c, a, b in zip(p, self.low, self.high):
            test = test & (c >= a) & (c <= b)
        return test

    def contains_box(self, other: "Box") -> Column:
        return self.contains(other.low) & self.contains(other.high)

    def intersects(self, other: "Box") -> Column:
        test = F.lit(True)
        for a, b, c, d in zip(self.low, self.high, other.low, other.high):
            test = test & (a <= d) & (c <= b)
        return test

    def center(self) -> V.Vec:
        return tuple((a + b) * 0.5 for a, b in zip(self.low, self.high))

    def lengths(self) -> V.Vec:
        return V.sub(self.high, self.low)

    def volume(self) -> Column:
        size = self.lengths()
        return size[0] * size[1] * size[2]

    def distance2(self, p: V.Vec) -> Column:
        gaps = [F.greatest(a - c, c - b, F.lit(0.0)) for c, a, b in zip(p, self.low, self.high)]
        return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]

    def farthest2(self, p: V.Vec) -> Column:
        gaps = [F.greatest(F.abs(c - a), F.abs(b - c)) for c, a, b in zip(p, self.low, self.high)]
        return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def ray_box(origin: V.Vec, direction: V.Vec, box: Box) -> Column:
    """Entry distance of the slab test (0 from inside); NULL on a miss."""
    enter, leave = F.lit(0.0), F.lit(float("inf"))
    blocked = F.lit(False)
    for o, d, a, b in zip(origin, direction, box.low, box.high):
        flat = F.abs(d) < 1e-12
        step = F.when(flat, F.lit(None).cast("double")).otherwise(d)
        t0, t1 = (a - o) / step, (b - o) / step
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(t0, t1)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t0, t1)))
        blocked = blocked | (flat & ((o < a) | (o > b)))
    return F.when(~blocked & (enter <= leave), enter)


def ray_sphere(origin: V.Vec, direction: V.Vec, center: V.Vec, radius) -> Column:
    """Entry distance along a unit direction; NULL if missed or behind."""
    to_center = V.sub(center, origin)
    along = V.dot(to_center, direction)
    off2 = V.length2(to_center) - along * along
    hit = (along >= 0) & (off2 <= radius * radius)
    return F.when(hit, along - F.sqrt(F.greatest(radius * radius - off2, F.lit(0.0))))


def ray_plane(origin: V.Vec, direction: V.Vec, normal: V.Vec, point: V.Vec) -> Column:
    slope = V.dot(normal, direction)
    safe = F.when(F.abs(slope) > 1e-12, slope)
    t = V.dot(normal, V.sub(point, origin)) / safe
    return F.when(t >= 0, t)


def ray_triangle(origin: V.Vec, direction: V.Vec, a: V.Vec, b: V.Vec, c: V.Vec, eps: float = 1e-12):
    """Barycentric hit: columns (t, u, v), all NULL on a miss."""
    e1, e2 = V.sub(b, a), V.sub(c, a)
    h = V.cross(direction, e2)
    d = V.dot(e1, h)
    inv = F.lit(1.0) / F.when(F.abs(d) > eps, d)
    s = V.sub(origin, a)
    u = V.dot(s, h) * inv
    q = V.cross(s, e1)
    v = V.dot(direction, q) * inv
    t = V.dot(e2, q) * inv
    hit = (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0)
    return F.when(hit, t), F.when(hit, u), F.when(hit, v)
