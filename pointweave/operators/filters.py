"""Row filters over points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pointweave.functions import matrix as M, vector as V
from pointweave.functions.boxes import Box
from pointweave.operators.sites import XYZ


def within_box(points: DataFrame, low, high) -> DataFrame:
    """Inclusive box filter on living points, in a form parquet statistics can prune."""
    test = F.col("alive") if "alive" in points.columns else F.lit(True)
    for c, a, b in zip(XYZ, low, high):
        test = test & (F.col(c) >= float(a)) & (F.col(c) <= float(b))
    return points.where(test)


def within_posed_box(points: DataFrame, world_to_local: np.ndarray, low, high) -> DataFrame:
    """Keep points whose local position lies in the box."""
    local = M.transform_point(world_to_local, V.vec(*XYZ))
    return points.where(Box.literal(low, high).contains(local))


def mask_outside(points: DataFrame, world_to_local: np.ndarray, low, high) -> DataFrame:
    """Same test, but outside points stay as rows with NULL coordinates."""
    inside = Box.literal(low, high).contains(M.transform_point(world_to_local, V.vec(*XYZ)))
    return points.withColumn("_in", inside).withColumns(
        {c: F.when(F.col("_in"), F.col(c)) for c in XYZ}
    ).drop("_in")


def drop_invalid(points: DataFrame) -> DataFrame:
    return points.where(V.is_valid(*[F.col(c) for c in XYZ]))


def set_alive(points: DataFrame, alive=True) -> DataFrame:
    return points.withColumn("alive", alive if not isinstance(alive, bool) else F.lit(alive))


def living(points: DataFrame) -> DataFrame:
    return points.where(F.col("alive"))


def range_guard(points: DataFrame, limit: float = 1000.0, axes=XYZ) -> DataFrame:
    """Drop points with any |coordinate| above the limit."""
    test = F.lit(True)
    for c in axes:
        test = test & (F.abs(F.col(c)) <= limit)
    return points.where(test)


def upper_guard(points: DataFrame, limit: float = 100000.0, axes=("x",)) -> DataFrame:
    test = F.lit(True)
    for c in axes:
        test = test & (F.col(c) <= limit)
    return points.where(test)


def around_centre(points: DataFrame, other: DataFrame, half: float = 20.0) -> DataFrame:
    """Crop to a cube around the centre of another cloud's bounding box."""
    test = F.lit(True)
    for c in XYZ:
        centre = other.agg(((F.min(c) + F.max(c)) * 0.5).alias("c")).scalar()
        test = test & (F.col(c) >= centre - half) & (F.col(c) <= centre + half)
    return points.where(test)


def drop_outliers(points: DataFrame, mask: DataFrame) -> DataFrame:
    return points.join(mask.where(F.col("is_outlier")).select("point_id"), "point_id", "left_anti")


# Half opening angles of the view, across and up, in radians.
HALF_ACROSS, HALF_UP = 0.523, 0.393


def frustum_planes(position, forward, near: float, far: float, half_h: float = HALF_ACROSS, half_v: float = HALF_UP):
    """Six inward (normal, offset) planes of a view frustum.

    The four corner rays of the view span its sides: each side is the plane through the eye and two neighbouring
    rays, turned so that the viewing direction lies inside.
    """
    eye, axis = np.asarray(position, float), np.asarray(forward, float)
    axis = axis / np.sqrt(axis @ axis)
    # The view is level: its sideways direction is horizontal, or along x when it looks straight up or down.
    level = np.array([-axis[2], 0.0, axis[0]])
    across = level / np.sqrt(level @ level) if level @ level > 0.02 else np.array([1.0, 0.0, 0.0])
    across = across - (across @ axis) * axis
    across /= np.sqrt(across @ across)
    rise = np.cross(across, axis)
    wide, high = np.tan(half_h) * across, np.tan(half_v) * rise
    rays = [axis + sx * wide + sy * high for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1))]
    sides = [np.cross(rays[k], rays[(k + 1) % 4]) for k in range(4)]
    inward = [n / np.sqrt(n @ n) * np.sign(n @ axis) for n in sides]
    through = [(axis, eye + near * axis), (-axis, eye + far * axis), *((n, eye) for n in inward)]
    return [(n, -float(n @ p)) for n, p in through]


def frustum_blocks(blocks: DataFrame, size: float, position, forward, near, far, half_h=HALF_ACROSS, half_v=HALF_UP) -> DataFrame:
    """Blocks (gx, gy, gz) not fully behind any frustum plane."""
    test = F.lit(True)
    for n, offset in frustum_planes(position, forward, near, far, half_h, half_v):
        reach = F.lit(float(offset))
        for g, c in zip(("gx", "gy", "gz"), n):
            corner = (F.col(g) + 0.5) * size + (size * 0.5 if c >= 0 else -size * 0.5)
            reach = reach + corner * float(c)
        test = test & (reach >= 0)
    return blocks.where(test)
