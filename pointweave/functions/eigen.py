"""Symmetric 3x3 eigen decomposition in closed form, as plain Columns.

The trigonometric solution keeps plane fitting inside generated code, so no
rows leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pointweave.functions import vector as V


@dataclass(frozen=True)
class Sym3:
    xx: Column
    yy: Column
    zz: Column
    xy: Column
    xz: Column
    yz: Column

    @staticmethod
    def named(prefix: str = "c_") -> "Sym3":
        return Sym3(*[F.col(prefix + n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")])


def with_eigenvalues(df: DataFrame, m: Sym3, prefix: str = "e_") -> DataFrame:
    """Append ``e_0 <= e_1 <= e_2``; staged so that no sub-expression is repeated."""
    q, p, r = prefix + "q", prefix + "p", prefix + "r"
    third = F.lit(1.0 / 3.0)
    df = df.withColumn(q, (m.xx + m.yy + m.zz) * third)
    spread = (
        (m.xx - F.col(q)) * (m.xx - F.col(q))
        + (m.yy - F.col(q)) * (m.yy - F.col(q))
        + (m.zz - F.col(q)) * (m.zz - F.col(q))
        + 2.0 * (m.xy * m.xy + m.xz * m.xz + m.yz * m.yz)
    )
    df = df.withColumn(p, F.sqrt(spread / 6.0))
    a, b, c = (d - F.col(q) for d in (m.xx, m.yy, m.zz))
    det = a * (b * c - m.yz * m.yz) - m.xy * (m.xy * c - m.yz * m.xz) + m.xz * (m.xy * m.yz - b * m.xz)
    size = F.col(p)
    ratio = F.when(size > 0, V.clamp(det / (2.0 * size * size * size), -1.0, 1.0)).otherwise(F.lit(1.0))
    df = df.withColumn(r, F.acos(ratio) * third)
    turn = 2.0943951023931953  # fixed value: 2*pi/3
    return (
        df.withColumn(prefix + "2", F.col(q) + 2.0 * F.col(p) * F.cos(F.col(r)))
        .withColumn(prefix + "0", F.col(q) + 2.0 * F.col(p) * F.cos(F.col(r) + turn))
        .withColumn(prefix + "1", 3.0 * F.col(q) - F.col(prefix + "0") - F.col(prefix + "2"))
        .drop(q, p, r)
    )


def with_smallest_vector(df: DataFrame, m: Sym3, prefix: str = "e_", out: str = "v") -> DataFrame:
    """Append the unit eigenvector of the smallest eigenvalue as ``vx, vy, vz``.

    It is the longest cross product of two rows of ``A - e_0 I``. When that
    matrix has rank one, any direction orthogonal to its longest row serves;
    when it is zero, +Z is returned.
    """
    e = F.col(prefix + "0")
    rows = [
        (m.xx - e, m.xy, m.xz),
        (m.xy, m.yy - e, m.yz),
        (m.xz, m.yz, m.zz - e),
    ]
    crosses = [V.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best, line = prefix + "best", prefix + "line"

    def longest(vectors):
        return F.greatest(
            *[
                F.struct(V.length2(w).alias("n"), w[0].alias("x"), w[1].alias("y"), w[2].alias("z"))
                for w in vectors
            ]
        )

    df = df.withColumn(best, longest(crosses)).withColumn(line, longest(rows))
    row = V.vec(f"{line}.x", f"{line}.y", f"{line}.z")
    # Orthogonal to the row: drop its smallest component and swap the other two.
    zero = F.lit(0.0)
    ax, ay, az = (F.abs(c) for c in row)
    side = (
        F.when((ax <= ay) & (ax <= az), zero).when(ay <= az, -row[2]).otherwise(-row[1]),
        F.when((ax <= ay) & (ax <= az), -row[2]).when(ay <= az, zero).otherwise(row[0]),
        F.when((ax <= ay) & (ax <= az), row[1]).when(ay <= az, row[0]).otherwise(zero),
    )
    tiny = F.col(f"{line}.n") * F.col(f"{line}.n") * 1e-24
    good = F.col(f"{best}.n") > tiny
    pick = [F.when(good, F.col(f"{best}.{k}")).otherwise(s) for k, s in zip("xyz", side)]
    df = df.withColumn(best, F.struct(*[p.alias(k) for p, k in zip(pick, "xyz")]))
    chosen = V.vec(f"{best}.x", f"{best}.y", f"{best}.z")
    size = V.length(chosen)
    for k, default in zip("xyz", (0.0, 0.0, 1.0)):
        df = df.withColumn(out + k, F.when(size > 0, F.col(f"{best}.{k}") / size).otherwise(F.lit(default)))
    return df.drop(best, line)


def covariance_aggregates(x="x", y="y", z="z", prefix: str = "c_"):
    """Means and population covariance of a group, mergeable map-side.

    Uses Spark's own covariance aggregates, which combine partial moments
    without cancellation.
    """
    cols = {"x": F.col(x), "y": F.col(y), "z": F.col(z)}
    out = [F.avg(c).alias(f"m{k}") for k, c in cols.items()]
    for k in ("xx", "yy", "zz", "xy", "xz", "yz"):
        out.append(F.covar_pop(cols[k[0]], cols[k[1]]).alias(prefix + k))
    return out
