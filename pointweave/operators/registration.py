"""Rigid registration of one cloud onto another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pointweave.functions import matrix as M, vector as V
from pointweave.operators.neighbors import nearest_sites, tiled
from pointweave.operators.sites import XYZ, Sites


def best_rigid(pairs: DataFrame) -> np.ndarray:
    """4x4 motion that takes (x, y, z) closest to (n_x, n_y, n_z) in the mean square.

    One aggregate folds the pairs to a weight, two means and nine products; only these reach the driver.
    """
    w = F.col("w")
    sums = [F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(c) for c in (*XYZ, "n_x", "n_y", "n_z")]]
    sums += [F.sum(w * F.col(a) * F.col(f"n_{b}")).alias(f"{a}{b}") for a in XYZ for b in XYZ]
    row = pairs.agg(*sums).first()
    if not row["w"]:
        return np.eye(4)
    p = np.array([row[c] for c in XYZ]) / row["w"]
    q = np.array([row[f"n_{c}"] for c in XYZ]) / row["w"]
    covariance = np.array([[row[f"{a}{b}"] for b in XYZ] for a in XYZ]) / row["w"] - np.outer(p, q)
    u, _, vt = np.linalg.svd(covariance)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    motion = np.eye(4)
    motion[:3, :3] = vt.T @ flip @ u.T
    motion[:3, 3] = q - motion[:3, :3] @ p
    return motion


REACH, ROUNDS = 0.1, 50  # fixed values: farthest correspondence, and rounds


def register(source: DataFrame, target: DataFrame, rounds: int = ROUNDS, tolerance: float = 1e-10, reach: float = REACH) -> tuple[np.ndarray, DataFrame]:
    """(motion, moved source): iterated closest points until the motion of a round is below the tolerance.

    Points whose nearest target is farther than ``reach`` have no say in a round; without any pair the motion ends.

    Copies of a position are matched once and weigh as many. Rows without a valid position do not take part in the
    fit; their coordinates become NULL or NaN as the motion makes them.
    """
    motion = np.eye(4)
    held = Sites(target)
    tiles = tiled(held, 1) if held.stats.sites else None
    for _ in range(rounds if tiles else 0):
        moved = _moved(source, motion)
        sites, nearest = nearest_sites(target, 1, moved, tiles)
        pairs = nearest.where(F.col("d2") <= reach * reach).join(sites.table.select("site", F.col("n").cast("double").alias("w")), "site")
        step = best_rigid(pairs)
        motion = step @ motion
        if np.abs(step - np.eye(4)).max() < tolerance:
            break
    return motion, _moved(source, motion)


def _moved(cloud: DataFrame, motion: np.ndarray) -> DataFrame:
    return cloud.withColumns(dict(zip(XYZ, M.transform_point(motion, V.vec(*XYZ)))))
