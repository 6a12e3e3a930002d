"""Curves through control points, laid onto surfaces.

Control points are rows (curve_id, place, x, y, z). A span needs its two neighbours only, so curves of any length are cut into
rows by a window over (curve_id) that reads three rows at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointweave.functions import vector as V
from pointweave.operators import mesh as M
from pointweave.operators.sites import XYZ
from pointweave.session import cut


def _mix(a: V.Vec, b: V.Vec, ta: Column, tb: Column, t: Column) -> V.Vec:
    """From a at ta to b at tb, at t; a where both times are one."""
    share = F.when(tb > ta, (t - ta) / (tb - ta)).otherwise(F.lit(0.0))
    return V.add(a, V.scale(V.sub(b, a), share))


def smooth_curve(controls: DataFrame, samples: int, closed: bool = False) -> DataFrame:
    """(curve_id, place, step, x, y, z): ``samples`` points from every control point on, on the centripetal Catmull-Rom curve.

    Knots are apart by the square root of the distance of their points, so the curve has no loops between them. At the ends of an open curve the missing
    neighbour is the end mirrored at its own neighbour; its last control point is a row of its own, with step 0. Points
    in one place make a span of no length. A curve of one point is that point.
    """
    row = Window.partitionBy("curve_id").orderBy("place")
    p = {k: V.vec(*[f"{c}{k}" for c in XYZ]) for k in range(4)}
    df = controls.select("curve_id", "place", *XYZ)
    if closed:
        whole = Window.partitionBy("curve_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = {0: lambda c: F.coalesce(F.lag(c).over(row), F.last(c).over(whole)), 1: F.col,
              2: lambda c: F.coalesce(F.lead(c).over(row), F.first(c).over(whole)),
              3: lambda c: F.coalesce(F.lead(c, 2).over(row), F.when(F.lead(c).over(row).isNull(), F.nth_value(c, 2).over(whole)).otherwise(F.first(c).over(whole)), F.col(c))}
        df = df.select("curve_id", "place", *[at[k](c).alias(f"{c}{k}") for k in range(4) for c in XYZ], F.lit(False).alias("is_last"))
    else:
        before, after, second = (lambda c: F.lag(c).over(row)), (lambda c: F.lead(c).over(row)), (lambda c: F.lead(c, 2).over(row))
        nxt = lambda c: F.coalesce(after(c), F.col(c))
        df = df.select("curve_id", "place", *[x.alias(f"{c}{k}") for c in XYZ for k, x in enumerate((
            F.coalesce(before(c), 2.0 * F.col(c) - nxt(c)), F.col(c), nxt(c), F.coalesce(second(c), 2.0 * nxt(c) - F.col(c))))], after("place").isNull().alias("is_last"))
    times = [F.lit(0.0)]
    for k in range(3):
        times.append(times[-1] + F.sqrt(V.distance(p[k], p[k + 1])))
    df = df.withColumns({f"t{k}": t for k, t in enumerate(times)})
    df = df.withColumn("step", F.explode(F.when(F.col("is_last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(samples - 1)))))
    t = [F.col(f"t{k}") for k in range(4)]
    df = df.withColumn("t", t[1] + (t[2] - t[1]) * F.col("step") / float(samples))
    # Three rounds of mixing neighbours; every round is a projection, so that no formula holds another one twice.
    now = F.col("t")
    for name, ends, knots in (("a", [p[0], p[1], p[2], p[3]], [(0, 1), (1, 2), (2, 3)]), ("b", None, [(0, 2), (1, 3)]), ("", None, [(1, 2)])):
        ends = ends or [V.vec(*[f"_{last}{c}{k}" for c in XYZ]) for k in range(len(knots) + 1)]
        df = df.withColumns({f"_{name}{c}{k}": x for k, (i, j) in enumerate(knots) for c, x in zip(XYZ, _mix(ends[k], ends[k + 1], t[i], t[j], now))})
        last = name
    return df.select("curve_id", "place", "step", *[F.col(f"_{c}0").alias(c) for c in XYZ])


def _on_surface(points: DataFrame, placed: DataFrame, reach: float) -> DataFrame:
    """(point_id, face_id, x, y, z): the nearest points of the surface."""
    return M.closest_on_surface(points, placed, reach).select("point_id", "face_id", *XYZ)


def surface_curve(controls: DataFrame, placed: DataFrame, samples: int, reach: float, closed: bool = False) -> DataFrame:
    """(curve_id, place, step, face_id, x, y, z): the smooth curve laid onto the nearest points of the surface."""
    curve = cut(smooth_curve(controls, samples, closed).withColumn("point_id", F.monotonically_increasing_id()))
    laid = _on_surface(curve.select("point_id", *XYZ), placed, reach)
    return curve.select("point_id", "curve_id", "place", "step").join(laid, "point_id").drop("point_id")


def smooth_on_surface(curve: DataFrame, placed: DataFrame, rounds: int, reach: float, step: float = 0.5) -> DataFrame:
    """(curve_id, place, face_id, x, y, z): points on a surface drawn straight, while the ends of every curve stay.

    Every round moves all inner points at once towards the middle of their neighbours, by the share ``step``, and back onto the surface, so a curve nears a shortest
    way between its ends. The points of a curve keep their places.
    """
    row = Window.partitionBy("curve_id").orderBy("place")
    state = cut(curve.select("curve_id", "place", *XYZ).withColumn("point_id", F.monotonically_increasing_id()))
    laid = cut(state.drop(*XYZ).join(_on_surface(state.select("point_id", *XYZ), placed, reach), "point_id"))
    for _ in range(rounds):
        inner = F.lag("place").over(row).isNotNull() & F.lead("place").over(row).isNotNull()
        middle = {c: (F.lag(c).over(row) + F.lead(c).over(row)) / 2.0 for c in XYZ}
        moved = laid.select("point_id", "curve_id", "place", *[F.when(inner, F.col(c) + step * (middle[c] - F.col(c))).otherwise(F.col(c)).alias(c) for c in XYZ])
        moved = cut(moved)
        laid = cut(moved.drop(*XYZ).join(_on_surface(moved.select("point_id", *XYZ), placed, reach), "point_id"))
    return laid.select("curve_id", "place", "face_id", *XYZ)
