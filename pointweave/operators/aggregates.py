"""Cloud summaries, voxel-grid reductions and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pointweave.functions import keys as K, vector as V
from pointweave.functions.eigen import Sym3, covariance_aggregates, with_eigenvalues, with_smallest_vector
from pointweave.operators.neighbors import CELL
from pointweave.operators.sites import XYZ
from pointweave.session import cut


def bounds_aggregates(x="x", y="y", z="z"):
    out = []
    for f in (F.min, F.max):
        out += [f(c).alias(f"{f.__name__}_{n}") for c, n in zip((x, y, z), "xyz")]
    return out


def bounding_box(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return (points.groupBy(*by) if by else points).agg(*bounds_aggregates())


def mean_and_spread(values: DataFrame, column: str) -> DataFrame:
    """Global mean and population deviation, from E[x^2] - mean^2 clamped at 0."""
    c = F.col(column)
    return values.agg(
        F.avg(c).alias("mean"), F.sqrt(F.greatest(F.avg(c * c) - F.avg(c) * F.avg(c), F.lit(0.0))).alias("deviation")
    )


def value_range(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """Mean per voxel of a grid anchored at the cloud's lower corner.

    Normals are renormalised, colors are mean bytes truncated. Only living
    points take part.
    """
    if "alive" in points.columns:
        points = points.where("alive")
    low = {c: points.agg(F.min(c).alias("low")).scalar() for c in XYZ}
    placed = points.select(*XYZ, "nx", "ny", "nz", "r", "g", "b", *[
        F.floor((F.col(c) - low[c]) * (1.0 / size)).cast("long").alias(g) for c, g in zip(XYZ, CELL)
    ])
    sums = placed.groupBy(*CELL).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in XYZ], *[F.sum(c).alias(c) for c in ("nx", "ny", "nz")],
        *[F.least(F.floor(F.avg(c)), F.lit(255)).cast("int").alias(c) for c in "rgb"],
    )
    length = V.length(V.vec("nx", "ny", "nz"))
    return sums.withColumn("_l", length).withColumns(
        {c: F.when(F.col("_l") > 0, F.col(c) / F.col("_l")).otherwise(F.col(c)) for c in ("nx", "ny", "nz")}
    ).drop("_l")


def merge_clouds(points: DataFrame, size: float = 0.1, box=None, limit: float | None = None) -> DataFrame:
    """Mean per absolute grid voxel over all clouds; normals are not renormalised."""
    from pointweave.operators.filters import drop_invalid, range_guard, within_box

    kept = drop_invalid(points)
    if limit is not None:
        kept = range_guard(kept, limit)
    if box is not None:
        kept = within_box(kept, *box)
    placed = kept.withColumns({g: K.cell(F.col(c), size) for c, g in zip(XYZ, CELL)})
    return placed.groupBy(*CELL).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*XYZ, "nx", "ny", "nz", "r", "g", "b")]
    )


def occupied_cells(points: DataFrame, size: float) -> DataFrame:
    """One row: the exact number of distinct occupied cells."""
    return points.select(*[K.cell(F.col(c), size).alias(g) for c, g in zip(XYZ, CELL)]).distinct().agg(
        F.count("*").alias("cells")
    )


def surfels(points: DataFrame, size: float = 0.05, least: int = 2) -> DataFrame:
    """Mean position and unit mean normal of cells with enough support."""
    placed = points.withColumns({g: K.cell(F.col(c), size) for c, g in zip(XYZ, CELL)})
    sums = placed.groupBy(*CELL).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in XYZ], *[F.sum(c).alias(c) for c in ("nx", "ny", "nz")]
    ).where(F.col("n") >= least)
    unit = V.normalize(V.vec("nx", "ny", "nz"))
    return sums.select(*CELL, "n", *XYZ, *[u.alias(c) for u, c in zip(unit, ("nx", "ny", "nz"))])


def cell_statistics(points: DataFrame, size: float) -> DataFrame:
    """Bounds, count, centroid, mean normal and plane normal of each cell."""
    placed = points.withColumns({g: K.cell(F.col(c), size) for c, g in zip(XYZ, CELL)})
    stats = placed.groupBy(*CELL).agg(
        F.count("*").alias("n"), *bounds_aggregates(), *covariance_aggregates(),
        *[F.avg(c).alias(f"mean_{c}") for c in ("nx", "ny", "nz")],
    )
    m = Sym3.named("c_")
    # Written out, so that filters on the result do not copy the eigen formula.
    return cut(with_smallest_vector(with_eigenvalues(stats, m), m, out="plane_"))


def label_counts(points: DataFrame, label: str = "label", fill_gaps: bool = True) -> DataFrame:
    """Points per label; with gaps filled, every label from 0 to the largest has a row."""
    counts = points.groupBy(label).agg(F.count("*").alias("count"))
    if not fill_gaps:
        return counts
    top = points.agg(F.max(label)).first()[0]
    every = points.sparkSession.range(0 if top is None else int(top) + 1).withColumnRenamed("id", label)
    return every.join(counts, label, "left").select(label, F.coalesce("count", F.lit(0)).alias("count"))


def with_label_size(points: DataFrame, label: str = "label") -> DataFrame:
    """Size of the own label on every point; counts are folded before the join."""
    return points.join(label_counts(points, label, fill_gaps=False).withColumnRenamed("count", "label_size"), label)


def weld_exact(vertices: DataFrame, eps: float) -> DataFrame:
    """(vertex_id, welded_id): the smallest id of the same eps cell."""
    placed = vertices.withColumns({g: K.cell(F.col(c), eps) for c, g in zip(XYZ, CELL)})
    first = placed.groupBy(*CELL).agg(F.min("vertex_id").alias("welded_id"))
    return placed.select("vertex_id", *CELL).join(first, CELL).select("vertex_id", "welded_id")


def weld_ball(vertices: DataFrame, eps: float) -> DataFrame:
    """(vertex_id, welded_id): components of vertices closer than eps, transitively."""
    from pointweave.operators.clustering import euclidean_labels

    points = vertices.withColumnRenamed("vertex_id", "point_id")
    below = eps * (1 - 1e-12)
    return euclidean_labels(points, below).select(F.col("point_id").alias("vertex_id"), F.col("label").alias("welded_id"))


def depth_raster(points: DataFrame, size: float) -> DataFrame:
    """Smallest z per (ix, iy) pixel."""
    return points.groupBy(K.cell(F.col("x"), size).alias("ix"), K.cell(F.col("y"), size).alias("iy")).agg(
        F.min("z").alias("depth")
    )


def depth_lookup(points: DataFrame, raster: DataFrame, size: float) -> DataFrame:
    """Raster depth of every point's pixel; NULL off the raster."""
    placed = points.withColumns({"ix": K.cell(F.col("x"), size), "iy": K.cell(F.col("y"), size)})
    return placed.join(raster, ["ix", "iy"], "left")


def erode_pixels(pixels: DataFrame) -> DataFrame:
    """Occupied pixels whose four neighbours are occupied as well."""
    moves = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i, j in
                      ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    seen = pixels.select(F.explode(moves).alias("m"), "ix", "iy").select(
        "m.ix", "m.iy", ((F.col("m.ix") == F.col("ix")) & (F.col("m.iy") == F.col("iy"))).alias("own"))
    counted = seen.groupBy("ix", "iy").agg(F.count("*").alias("c"), F.max("own").alias("own"))
    return counted.where((F.col("c") == 5) & F.col("own")).select("ix", "iy")


def weighted_covariance(rows: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Sum of w * d * d' about the weighted centroid, per group."""
    w = weight
    out = [F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s{c}") for c in XYZ]]
    out += [F.sum(w * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    sums = rows.groupBy(*by).agg(*out)
    return sums.select(
        *by, "w", *[(F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("w")).alias(f"c_{a}{b}")
                    for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    )


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; labels of the appended rows restart at 0."""
    return first.unionByName(second.withColumn("label", F.lit(0).cast("long")))


def combine_masks(left: DataFrame, right: DataFrame, operation: str) -> DataFrame:
    """Union, Intersection or Subtraction of two masks over the same points."""
    a, b = F.col("is_outlier"), F.col("_other")
    both = left.select("point_id", "is_outlier").join(
        right.select("point_id", F.col("is_outlier").alias("_other")), "point_id"
    )
    combined = {"Union": a | b, "Intersection": a & b, "Subtraction": a & ~b}
    return both.select("point_id", combined.get(operation, a).alias("is_outlier"))
