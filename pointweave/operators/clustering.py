"""Distance-based clustering of points, cells and voxels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from pointweave.functions import keys as K, vector as V
from pointweave.functions.boxes import Box
from pointweave.operators import components as C
from pointweave.operators.neighbors import CELL, SLACK, radius_pairs
from pointweave.operators.sites import XYZ, Sites
from pointweave.session import cut

PAIR_WORK = 4096  # point comparisons allowed for one pair of cells before it is refined
BOUNDS = [f"{e}_{c}" for e in ("min", "max") for c in XYZ]


def _bounds():
    return [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]


def _farthest2(a: Box, b: Box):
    gap = [F.greatest(F.abs(q - p), F.abs(s - r)) for p, q, r, s in zip(a.low, b.high, b.low, a.high)]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def _nearest2(a: Box, b: Box):
    gap = [F.greatest(q - p, r - s, F.lit(0.0)) for p, q, r, s in zip(a.high, b.low, a.low, b.high)]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def linked_cells(points: DataFrame, eps: float, side: float) -> tuple[DataFrame, DataFrame]:
    """Which pairs of grid cells hold two points within ``eps`` of each other.

    Returns ``(cells, links)``: cells (cell_id, gx, gy, gz, n) and links (a, b).
    Tight bounds of the cell contents settle most pairs without looking at a
    point. A pair that stays open and would need many comparisons is split into
    sub-cells, again and again, so two crowded cells never meet point by point.
    """
    e2 = eps * eps
    located = points.select("point_id", *XYZ, *[K.cell(F.col(c), side).alias(g) for c, g in zip(XYZ, CELL)])
    cells = cut(
        located.groupBy(*CELL).agg(F.min("point_id").alias("cell_id"), F.count("*").alias("n"), *_bounds()),
        key="cell_id",
    )
    reach = int(math.ceil(eps / side * (1 + SLACK)))
    other = cells.select(*[F.col(g).alias(f"o{g}") for g in CELL], F.col("cell_id").alias("b"),
                         F.col("n").alias("nb"), *[F.col(c).alias(f"b_{c}") for c in BOUNDS])
    mine = cells.select(*CELL, F.col("cell_id").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"a_{c}") for c in BOUNDS])
    near = mine
    for g in CELL:
        near = near.withColumn(f"o{g}", F.explode(F.sequence(F.col(g) - reach, F.col(g) + reach)))
    forward = F.struct(*[F.col(f"o{g}") for g in CELL]) > F.struct(*CELL)
    corner = tuple(F.col(f"o{g}") * side for g in CELL)
    target = Box(corner, tuple(c + side for c in corner)).inflate(side * SLACK)
    near = near.where(forward & (_nearest2(Box.named("a_"), target) <= e2)).drop(*CELL)
    pairs = near.join(other.hint("shuffle_hash"), [f"o{g}" for g in CELL]).drop(*[f"o{g}" for g in CELL])

    boxes = Box.named("a_"), Box.named("b_")
    open_pairs = pairs.where(_nearest2(*boxes) <= e2).withColumn("sure", _farthest2(*boxes) <= e2)
    open_pairs = cut(open_pairs.select("a", "b", "na", "nb", "sure"))
    links = open_pairs.where("sure").select("a", "b")
    todo = open_pairs.where(~F.col("sure"))

    # Sub-cells are numbered by a path of octants below the cell.
    tagged = located.join(cells.select("cell_id", *CELL), CELL).select(
        "point_id", *XYZ, "cell_id", F.lit(0).cast("long").alias("path")
    )
    key_a, key_b = ["a", "pa"], ["b", "pb"]
    todo = todo.select("a", "b", "na", "nb", F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"))
    width = side
    for depth in range(1, 21):
        light = todo.where(F.col("na") * F.col("nb") <= PAIR_WORK)
        links = links.unionByName(_meet(light, tagged, e2))
        heavy = todo.where(F.col("na") * F.col("nb") > PAIR_WORK)
        if heavy.isEmpty():
            return cells, links
        heavy = cut(heavy)
        width /= 2.0
        octant = F.lit(0)
        for i, c in enumerate(XYZ):
            octant = octant + K.cell(F.col(c), width).bitwiseAND(F.lit(1)) * (1 << i)
        tagged = tagged.withColumn("path", F.col("path") * 8 + octant)
        parts = tagged.groupBy("cell_id", "path").agg(F.count("*").alias("n"), *_bounds())
        parts = parts.withColumn("up", F.floor(F.col("path") / 8))

        def side_of(name, prefix):
            return parts.select(
                F.col("cell_id").alias(name), F.col("up").alias(f"p{name}"), F.col("path").alias(f"q{name}"),
                F.col("n").alias(f"m{name}"), *[F.col(c).alias(f"{prefix}{c}") for c in BOUNDS])

        split = heavy.join(side_of("a", "a_"), key_a).join(side_of("b", "b_"), key_b)
        split = split.where(_nearest2(*boxes) <= e2).withColumn("sure", _farthest2(*boxes) <= e2)
        split = cut(split.select("a", "b", "qa", "qb", "ma", "mb", "sure"))
        found = split.where("sure").select("a", "b").distinct()
        links = links.unionByName(found)
        todo = split.join(found, ["a", "b"], "left_anti").select(
            "a", "b", F.col("ma").alias("na"), F.col("mb").alias("nb"), F.col("qa").alias("pa"), F.col("qb").alias("pb")
        )
    # Sub-cells are now a millionth of a cell wide: what is still open is compared point by point.
    return cells, links.unionByName(_meet(todo, tagged, e2))


def _meet(pairs: DataFrame, tagged: DataFrame, e2: float) -> DataFrame:
    """(a, b) of those pairs of sub-cells that hold two points within reach."""
    left = tagged.select(F.col("cell_id").alias("a"), F.col("path").alias("pa"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    right = tagged.select(F.col("cell_id").alias("b"), F.col("path").alias("pb"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    met = pairs.join(left, ["a", "pa"]).join(right, ["b", "pb"])
    return met.where(V.distance2(V.vec("ax", "ay", "az"), V.vec("bx", "by", "bz")) <= e2).select("a", "b").distinct()


def euclidean_labels(points: DataFrame, eps: float) -> DataFrame:
    """(point_id, label): label is the smallest point_id reachable in steps of at most ``eps``.

    The grid cell has a diagonal of ``eps``, so all points of a cell belong
    together and only whole cells need to be linked.
    """
    sites = Sites(points)
    side = eps / math.sqrt(3.0) * (1 - 1e-6)
    grid = sites.table.select(F.col("site").alias("point_id"), *XYZ)
    cells, links = linked_cells(grid, eps, side)
    roots = C.components(cells, links, "cell_id").withColumnRenamed("node", "cell_id")
    rooted = cells.select("cell_id", *CELL).join(roots, "cell_id").select(*CELL, F.col("root").alias("label"))
    placed = grid.select(F.col("point_id").alias("site"), *[K.cell(F.col(c), side).alias(g) for c, g in zip(XYZ, CELL)])
    return sites.spread(placed.join(rooted, CELL).select("site", "label"))


def label_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("size"))


def limit_sizes(labels: DataFrame, low: int = 10, high: int = 100000) -> DataFrame:
    """Label of a cluster outside [low, high] becomes NULL (noise)."""
    keep = label_sizes(labels).where(F.col("size").between(low, high)).select("label", F.lit(True).alias("_in"))
    return labels.join(keep, "label", "left").withColumn("label", F.when(F.col("_in"), F.col("label"))).drop("_in")


def euclidean_clusters(points: DataFrame, radius: float = 0.5, low: int = 10, high: int = 100000) -> DataFrame:
    return limit_sizes(euclidean_labels(points, radius), low, high)


def angle_labels(points: DataFrame, eps: float, min_cos: float) -> DataFrame:
    """(point_id, label): steps of at most ``eps`` between points whose normals agree."""
    near = _normal_pairs(points, eps)
    edges = near.where(_pair_dot() >= min_cos).select(F.col("point_id").alias("a"), F.col("n_id").alias("b"))
    return _label(points, edges)


def _normal_pairs(points: DataFrame, eps: float) -> DataFrame:
    normals = ("nx", "ny", "nz")
    return radius_pairs(points, eps, query_cols=normals, point_cols=normals, half=True)


def _pair_dot():
    return V.dot(V.vec("nx", "ny", "nz"), V.vec("n_nx", "n_ny", "n_nz"))


def _label(points: DataFrame, edges: DataFrame) -> DataFrame:
    found = C.components(points, edges, "point_id")
    return found.select(F.col("node").alias("point_id"), F.col("root").alias("label"))


def planar_edges(
    points: DataFrame,
    radius: float = 0.15,
    min_cos: float = 0.9,
    plane_distance: float = 0.06,
    cell: float = 0.3,
    legacy_window: bool = False,
) -> DataFrame:
    """Edges (a, b) of the command clustering.

    The plane test uses the normal of one point only: within a grid cell of
    side ``cell`` that of the larger id, across cells that of the point in the
    cell with the smaller packed key. ``legacy_window`` additionally requires
    the cells to touch, which matters when ``radius`` exceeds ``cell``.
    """
    pairs = _normal_pairs(points, radius)
    mine = [K.cell(F.col(c), cell) for c in XYZ]
    other = [K.cell(F.col(f"n_{c}"), cell) for c in XYZ]
    key_mine, key_other = K.pack21(*mine), K.pack21(*other)
    first = F.when(key_mine == key_other, F.col("point_id") > F.col("n_id")).otherwise(key_mine < key_other)
    offset = V.sub(V.vec("n_x", "n_y", "n_z"), V.vec(*XYZ))
    height = F.when(first, F.abs(V.dot(V.vec("nx", "ny", "nz"), offset))).otherwise(
        F.abs(V.dot(V.vec("n_nx", "n_ny", "n_nz"), offset))
    )
    pairs = pairs.where((_pair_dot() >= min_cos) & (height <= plane_distance))
    if legacy_window:
        touching = F.lit(True)
        for m, o in zip(mine, other):
            touching = touching & (F.abs(m - o) <= 1)
        pairs = pairs.where(touching)
    return pairs.select(F.col("point_id").alias("a"), F.col("n_id").alias("b"))


def rank_labels(labels: DataFrame) -> DataFrame:
    """(point_id, cluster_id): clusters numbered by size, largest first, ties by label.

    Ranks come from a sort over distinct labels. Range-partitioned running
    counts keep that sort distributed.
    """
    sizes = cut(label_sizes(labels).withColumn("neg", -F.col("size")))
    ranked = dense_numbers(sizes, ["neg", "label"], "cluster_id")
    return labels.join(ranked.select("label", "cluster_id"), "label").select("point_id", "cluster_id")


def dense_numbers(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without one global window.

    Rows are range-partitioned; each partition numbers its rows and adds the
    size of the partitions before it (one row per partition).
    """
    ordered = cut_sorted(table, order)
    per_part = Window.partitionBy("_part").orderBy(*order)
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        ordered.withColumn("_rn", F.row_number().over(per_part) - 1)
        .join(F.broadcast(starts), "_part")  # one row per shuffle partition
        .withColumn(name, (F.col("_rn") + F.col("_start")).cast("long"))
        .drop("_rn", "_start", "_part")
    )


def cut_sorted(table: DataFrame, order: list[str]) -> DataFrame:
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(table.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def planar_clusters(points: DataFrame, radius: float = 0.15, min_cos: float = 0.9, **options) -> DataFrame:
    """(point_id, cluster_id) of the command clustering, largest cluster first."""
    return rank_labels(_label(points, planar_edges(points, radius, min_cos, **options)))


# Block clustering: a cell is always one cluster --------------------------------------------


def block_labels(points: DataFrame, distance: float, cell: float, min_abs_cos: float | None = None) -> DataFrame:
    """(point_id, label) where cells merge if any cross pair is within ``distance``.

    Only touching cells are compared. With ``min_abs_cos`` the pair must also
    have parallel or opposite normals.
    """
    located = points.select("point_id", *[K.cell(F.col(c), cell).alias(g) for c, g in zip(XYZ, CELL)])
    if min_abs_cos is None:
        cells, links = linked_cells(points, distance, cell)
        touching = links.join(_cell_names(cells, "a"), "a").join(_cell_names(cells, "b"), "b")
        links = touching.where(_adjacent()).select("a", "b")
        cells = cells.select("cell_id", *CELL)
    else:
        cells = cut(located.groupBy(*CELL).agg(F.min("point_id").alias("cell_id")), key="cell_id")
        near = _normal_pairs(points, distance).where(F.abs(_pair_dot()) >= min_abs_cos)
        ends = {}
        for g, c in zip(CELL, XYZ):
            ends[f"a_{g}"], ends[f"b_{g}"] = K.cell(F.col(c), cell), K.cell(F.col(f"n_{c}"), cell)
        pairs = near.withColumns(ends).where(_adjacent()).select(*ends).distinct()
        links = pairs.join(_cell_names(cells, "a"), [f"a_{g}" for g in CELL]).join(
            _cell_names(cells, "b"), [f"b_{g}" for g in CELL]).select("a", "b")
    roots = C.components(cells, links, "cell_id").withColumnRenamed("node", "cell_id")
    rooted = cells.join(roots, "cell_id").select(*CELL, F.col("root").alias("label"))
    return located.join(rooted, CELL).select("point_id", "label")


def _cell_names(cells: DataFrame, name: str) -> DataFrame:
    return cells.select(F.col("cell_id").alias(name), *[F.col(g).alias(f"{name}_{g}") for g in CELL])


def _adjacent():
    test = F.lit(True)
    for g in CELL:
        test = test & (F.abs(F.col(f"a_{g}") - F.col(f"b_{g}")) <= 1)
    return test


# Selection by cluster ----------------------------------------------------------------------


def drop_small(labels: DataFrame, least: int = 3) -> DataFrame:
    big = label_sizes(labels).where(F.col("size") >= least).select("label")
    return labels.join(big, "label", "left_semi")


def dominant(labels: DataFrame) -> DataFrame:
    """Rows of the largest cluster; the smaller label wins a tie."""
    best = label_sizes(labels).agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("label"))).alias("best"))
    return labels.join(F.broadcast(best.select(F.col("best.label").alias("label"))), "label", "left_semi")


def drop_touched(labels: DataFrame, bad: DataFrame) -> DataFrame:
    """Drop every cluster that contains at least one point listed in ``bad``."""
    marked = labels.join(bad.select("point_id"), "point_id", "left_semi").select("label").distinct()
    return labels.join(marked, "label", "left_anti")


# Voxel morphology --------------------------------------------------------------------------


def occupied(points: DataFrame, size: float) -> DataFrame:
    return points.select(*[K.cell(F.col(c), size).alias(g) for c, g in zip(XYZ, CELL)]).distinct()


SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def shifted(df: DataFrame, offsets) -> DataFrame:
    """Rows at every offset of their cell."""
    moves = F.array(*[F.struct(*[(F.col(g) + o).alias(g) for g, o in zip(CELL, off)]) for off in offsets])
    rest = [c for c in df.columns if c not in CELL]
    return df.select(*rest, F.explode(moves).alias("_c")).select(*rest, *[F.col(f"_c.{g}").alias(g) for g in CELL])


def erode(voxels: DataFrame, rounds: int = 1) -> DataFrame:
    """Keep voxels all of whose six face neighbours are occupied.

    One count per voxel over its own and its neighbours' announcements; no
    self-join.
    """
    for _ in range(rounds):
        told = shifted(voxels, SIX).withColumn("own", F.lit(0)).unionByName(voxels.withColumn("own", F.lit(1)))
        voxels = told.groupBy(*CELL).agg(F.count("*").alias("c"), F.max("own").alias("o"))
        voxels = cut(voxels.where((F.col("c") == 7) & (F.col("o") == 1)).select(*CELL))
    return voxels


def largest_component(voxels: DataFrame) -> DataFrame:
    """Voxels of the largest face-connected component."""
    named = cut(dense_numbers(voxels, CELL, "node"))
    here = named.select("node", *CELL)
    there = shifted(named.withColumnRenamed("node", "other"), [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    edges = here.join(there, CELL).select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = C.components(here, edges).select(F.col("node").alias("point_id"), F.col("root").alias("label"))
    kept = dominant(cut(roots)).withColumnRenamed("point_id", "node")
    return here.join(kept, "node", "left_semi").select(*CELL)


def near_voxels(points: DataFrame, voxels: DataFrame, size: float, reach: int) -> DataFrame:
    """Points whose cell lies within ``reach`` cells of one of the voxels."""
    span = range(-reach, reach + 1)
    grown = shifted(voxels, [(i, j, k) for i in span for j in span for k in span]).distinct()
    located = points.withColumns({g: K.cell(F.col(c), size) for c, g in zip(XYZ, CELL)})
    return located.join(grown, CELL, "left_semi").drop(*CELL)


def morphology_filter(points: DataFrame, size: float = 0.3, rounds: int = 2, reach: int = 2) -> DataFrame:
    core = largest_component(erode(occupied(points, size), rounds))
    return near_voxels(points, core, size, reach)
