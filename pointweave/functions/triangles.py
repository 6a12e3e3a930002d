"""Point, segment and triangle predicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

from pointweave.functions import vector as V


def closest_on_segment(p: V.Vec, a: V.Vec, b: V.Vec) -> V.Vec:
    ab = V.sub(b, a)
    size = V.length2(ab)
    t = F.when(size > 0, V.clamp(V.dot(V.sub(p, a), ab) / size, 0.0, 1.0)).otherwise(F.lit(0.0))
    return V.add(a, V.scale(ab, t))


def point_segment_distance(p: V.Vec, a: V.Vec, b: V.Vec) -> Column:
    return V.distance(p, closest_on_segment(p, a, b))


def point_ray_distance(p: V.Vec, origin: V.Vec, direction: V.Vec) -> Column:
    size = V.length2(direction)
    t = F.when(size > 0, F.greatest(F.lit(0.0), V.dot(V.sub(p, origin), direction) / size)).otherwise(F.lit(0.0))
    return V.distance(p, V.add(origin, V.scale(direction, t)))


def point_on_segment(p: V.Vec, a: V.Vec, b: V.Vec, eps: float = 1e-6) -> Column:
    return point_segment_distance(p, a, b) <= eps


def point_on_ray(p: V.Vec, origin: V.Vec, direction: V.Vec, eps: float = 1e-6) -> Column:
    return point_ray_distance(p, origin, direction) <= eps


def closest_on_triangle(p: V.Vec, a: V.Vec, b: V.Vec, c: V.Vec) -> Column:
    """Struct (x, y, z, d2): the nearest point of the triangle.

    Either the foot of the perpendicular, when it falls inside, or the best
    point of the three sides; this covers the seven Voronoi regions.
    """
    n = V.cross(V.sub(b, a), V.sub(c, a))
    n2 = V.length2(n)
    height = F.when(n2 > 0, V.dot(V.sub(p, a), n) / n2)
    foot = V.sub(p, V.scale(n, height))
    inside = n2 > 0
    for s, e in ((a, b), (b, c), (c, a)):
        inside = inside & (V.dot(V.cross(V.sub(e, s), V.sub(foot, s)), n) >= 0)

    def candidate(q):
        return F.struct(
            V.distance2(p, q).alias("d2"), q[0].alias("x"), q[1].alias("y"), q[2].alias("z")
        )

    edges = F.least(*[candidate(closest_on_segment(p, s, e)) for s, e in ((a, b), (b, c), (c, a))])
    return F.when(inside, candidate(foot)).otherwise(edges)


def point_vs_triangle(p: V.Vec, a: V.Vec, b: V.Vec, c: V.Vec, eps: float = 1e-6) -> Column:
    """'vertex', 'edge', 'face' or 'outside'."""
    vertex = (V.distance(p, a) <= eps) | (V.distance(p, b) <= eps) | (V.distance(p, c) <= eps)
    edge = F.lit(False)
    for s, e in ((a, b), (b, c), (c, a)):
        edge = edge | point_on_segment(p, s, e, eps)
    face = F.sqrt(closest_on_triangle(p, a, b, c)["d2"]) <= eps
    return F.when(vertex, "vertex").when(edge, "edge").when(face, "face").otherwise("outside")


def triangle_area(a: V.Vec, b: V.Vec, c: V.Vec) -> Column:
    return 0.5 * V.length(V.cross(V.sub(b, a), V.sub(c, a)))


def segment_triangle(p: V.Vec, q: V.Vec, a: V.Vec, b: V.Vec, c: V.Vec, eps: float = 1e-12) -> Column:
    """Parameter t in [0, 1] where the segment crosses the triangle; NULL if not."""
    from pointweave.functions.boxes import ray_triangle

    t, _, _ = ray_triangle(p, V.sub(q, p), a, b, c, eps)
    return F.when(t <= 1, t)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Separating-axis test for arrays of triangle pairs, shape (n, 3, 3)."""
    ea = np.roll(a, -1, 1) - a
    eb = np.roll(b, -1, 1) - b
    na, nb = np.cross(ea[:, 0], ea[:, 1]), np.cross(eb[:, 0], eb[:, 1])
    axes = [na, nb]
    axes += [np.cross(ea[:, i], eb[:, j]) for i in range(3) for j in range(3)]
    # In-plane side normals decide the coplanar case.
    axes += [np.cross(na, ea[:, i]) for i in range(3)] + [np.cross(nb, eb[:, i]) for i in range(3)]
    hit = np.ones(len(a), bool)
    for axis in axes:
        pa = np.einsum("nij,nj->ni", a, axis)
        pb = np.einsum("nij,nj->ni", b, axis)
        size = np.linalg.norm(axis, axis=1)
        hit &= ~((size > 1e-12) & ((pa.max(1) < pb.min(1)) | (pb.max(1) < pa.min(1))))
    return hit


@F.pandas_udf(BooleanType())
def triangles_intersect(*columns: pd.Series) -> pd.Series:
    """18 coordinate columns: three corners of each triangle."""
    flat = np.column_stack([c.to_numpy(dtype=float) for c in columns]).reshape(-1, 2, 3, 3)
    return pd.Series(_overlap(flat[:, 0], flat[:, 1]))
