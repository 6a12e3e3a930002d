"""3x3 and 4x4 matrices.

A matrix that is the same for every row is a NumPy array on the driver and ends
up as literals inside the expressions. A matrix stored per row is a
column-major ``ARRAY<DOUBLE>`` column and is unrolled by entry.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from pointweave.functions.vector import Vec


def entries(m, size: int = 4) -> list[list]:
    """Rows of ``m`` as nested lists of literals or entry expressions."""
    if isinstance(m, (Column, str)):
        col = F.col(m) if isinstance(m, str) else m
        return [[col[c * size + r] for c in range(size)] for r in range(size)]
    if isinstance(m, np.ndarray):
        return [[F.lit(float(m[r, c])) for c in range(size)] for r in range(size)]
    return m


def pack(rows) -> Column:
    """Column-major array column from nested rows."""
    size = len(rows)
    return F.array(*[rows[r][c] for c in range(size) for r in range(size)])


def transform_point(m, p: Vec) -> Vec:
    e = entries(m)
    return tuple(e[r][0] * p[0] + e[r][1] * p[1] + e[r][2] * p[2] + e[r][3] for r in range(3))


def transform_direction(m, d: Vec) -> Vec:
    e = entries(m)
    return tuple(e[r][0] * d[0] + e[r][1] * d[1] + e[r][2] * d[2] for r in range(3))


def transform_normal(m: np.ndarray, n: Vec) -> Vec:
    """Normals turn with the inverse transpose of the upper 3x3 block."""
    upper = np.eye(4)
    upper[:3, :3] = np.linalg.inv(m[:3, :3]).T
    return transform_direction(upper, n)


def project_point(m, p: Vec) -> Vec:
    """Transform and divide by w; w = 0 gives NULL."""
    e = entries(m)
    w = e[3][0] * p[0] + e[3][1] * p[1] + e[3][2] * p[2] + e[3][3]
    safe = F.when(w != 0, w)
    return tuple(v / safe for v in transform_point(e, p))


# Per-row algebra on nested rows of Columns -------------------------------------------------


def entrywise(a, b, op) -> list[list]:
    return [[op(x, y) for x, y in zip(ra, rb)] for ra, rb in zip(a, b)]


def matmul(a, b) -> list[list]:
    n = len(a)
    out = []
    for r in range(n):
        row = []
        for c in range(n):
            total = a[r][0] * b[0][c]
            for k in range(1, n):
                total = total + a[r][k] * b[k][c]
            row.append(total)
        out.append(row)
    return out


def transpose(a) -> list[list]:
    return [list(row) for row in zip(*a)]


def trace(a):
    total = a[0][0]
    for i in range(1, len(a)):
        total = total + a[i][i]
    return total


def _minor(a, row: int, col: int):
    return [[v for c, v in enumerate(line) if c != col] for r, line in enumerate(a) if r != row]


def det(a):
    if len(a) == 1:
        return a[0][0]
    if len(a) == 2:
        return a[0][0] * a[1][1] - a[0][1] * a[1][0]
    total = a[0][0] * det(_minor(a, 0, 0))
    for c in range(1, len(a)):
        term = a[0][c] * det(_minor(a, 0, c))
        total = total + term if c % 2 == 0 else total - term
    return total


def inverse(a) -> list[list]:
    """Adjugate over determinant; a singular matrix gives NULL entries."""
    n = len(a)
    d = det(a)
    safe = F.when(d != 0, d)
    return [
        [(det(_minor(a, c, r)) if (r + c) % 2 == 0 else -det(_minor(a, c, r))) / safe for c in range(n)]
        for r in range(n)
    ]


def lerp(a, b, t) -> list[list]:
    return entrywise(a, b, lambda x, y: x + (y - x) * t)


def nearly_equal(a, b, eps: float = 1e-6) -> Column:
    result = F.lit(True)
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            result = result & (F.abs(x - y) <= eps)
    return result


# Builders for constant matrices (driver side) ----------------------------------------------


def translate(x, y, z) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = (x, y, z)
    return m


def scaling(x, y, z) -> np.ndarray:
    return np.diag([x, y, z, 1.0]).astype(float)


def shear(factors) -> np.ndarray:
    """Entry (r, c) of the 3x3 ``factors`` adds that share of axis c to axis r; its diagonal is not read."""
    m = np.eye(4)
    off = ~np.eye(3, dtype=bool)
    m[:3, :3][off] = np.asarray(factors, float)[off]
    return m


def rotate(axis, radians: float) -> np.ndarray:
    """Rodrigues rotation about a non-zero axis."""
    u = np.asarray(axis, float)
    u = u / np.linalg.norm(u)
    skew = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    m = np.eye(4)
    m[:3, :3] = np.eye(3) + np.sin(radians) * skew + (1 - np.cos(radians)) * (skew @ skew)
    return m


def rotate_x(radians: float) -> np.ndarray:
    return rotate((1, 0, 0), radians)


def rotate_y(radians: float) -> np.ndarray:
    return rotate((0, 1, 0), radians)


def rotate_z(radians: float) -> np.ndarray:
    return rotate((0, 0, 1), radians)


def trs(translation, rotation: np.ndarray, scale) -> np.ndarray:
    return translate(*translation) @ rotation @ scaling(*scale)


def look_at(eye, target, up) -> np.ndarray:
    """Right-handed view matrix looking down -Z."""
    eye, target, up = (np.asarray(v, float) for v in (eye, target, up))
    forward = (target - eye) / np.linalg.norm(target - eye)
    right = np.cross(forward, up)
    right /= np.linalg.norm(right)
    m = np.eye(4)
    m[0, :3], m[1, :3], m[2, :3] = right, np.cross(right, forward), -forward
    m[:3, 3] = -m[:3, :3] @ eye
    return m


def perspective(fov_y: float, aspect: float, near: float, far: float) -> np.ndarray:
    f = 1.0 / np.tan(fov_y / 2)
    m = np.zeros((4, 4))
    m[0, 0], m[1, 1] = f / aspect, f
    m[2, 2], m[2, 3] = (far + near) / (near - far), 2 * far * near / (near - far)
    m[3, 2] = -1.0
    return m


def ortho(left, right, bottom, top, near, far) -> np.ndarray:
    m = np.diag([2 / (right - left), 2 / (top - bottom), -2 / (far - near), 1.0])
    m[:3, 3] = (
        -(right + left) / (right - left),
        -(top + bottom) / (top - bottom),
        -(far + near) / (far - near),
    )
    return m


def screen_ray(view: np.ndarray, projection: np.ndarray, px: float, py: float, width: float, height: float):
    """World-space origin and unit direction of the ray through a pixel."""
    ndc = np.array([2 * px / width - 1, 1 - 2 * py / height])
    back = np.linalg.inv(projection @ view)
    near, far = (back @ np.array([ndc[0], ndc[1], z, 1.0]) for z in (-1.0, 1.0))
    near, far = near[:3] / near[3], far[:3] / far[3]
    direction = far - near
    return near, direction / np.linalg.norm(direction)
