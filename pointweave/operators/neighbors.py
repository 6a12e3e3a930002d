"""Range and nearest-neighbour joins over a uniform or multi-level grid."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pointweave.functions import keys as K, vector as V
from pointweave.functions.boxes import Box
from pointweave.functions.vector import is_valid
from pointweave.operators.sites import XYZ, Sites
from pointweave.operators.tiles import Tiles, ball_sums, counted
from pointweave.session import cut, fan_out

SLACK = 1e-9  # widens cell enumeration so that rounding cannot lose a boundary pair
HOT_ROWS = 50_000  # candidates of a cell that one task builds; a fuller cell is split
CELL = ["gx", "gy", "gz"]


def overlapping_cells(df: DataFrame, reach: Column, size: Column, origin=(0.0, 0.0, 0.0), last: Column | None = None) -> DataFrame:
    """One row per grid cell that the ball of radius ``reach`` around (x, y, z) touches.

    With ``last`` cells are numbered 0 to ``last`` along each axis, and the outer ones have no end.
    """
    wide = reach * (1.0 + SLACK)
    for name, axis, o in zip(CELL, XYZ, origin):
        if last is None:
            low, high = K.cell(F.col(axis) - wide, size, o), K.cell(F.col(axis) + wide, size, o)
        else:
            low, high = (_held((e - o) / size, last) for e in (F.col(axis) - wide, F.col(axis) + wide))
        df = df.withColumn(name, F.explode(F.sequence(low, high)))
    corner = tuple(F.col(g) * size + o for g, o in zip(CELL, origin))
    ends = tuple(c + size for c in corner)
    if last is not None:
        corner = tuple(F.when(F.col(g) == 0, F.lit(-math.inf)).otherwise(c) for g, c in zip(CELL, corner))
        ends = tuple(F.when(F.col(g) == last, F.lit(math.inf)).otherwise(c) for g, c in zip(CELL, ends))
    box = Box(corner, ends)
    fuzz = wide + size * SLACK
    return df.where(box.distance2(V.vec(*XYZ)) <= fuzz * fuzz)


def _held(place, last) -> Column:
    """Whole cell number from 0 to ``last``; places beyond count to the outer cells."""
    return F.greatest(F.lit(0.0), F.least(F.floor(place).cast("double"), (last if isinstance(last, Column) else F.lit(last)).cast("double"))).cast("long")


def hot_cells(celled: DataFrame) -> DataFrame | None:
    """Cells of more than ``HOT_ROWS`` rows, with the number of splits each needs to keep to it.

    A table, not a list: its size is known to the planner, which broadcasts it only where it is small.
    """
    crowded = celled.groupBy(*CELL).count().where(F.col("count") > HOT_ROWS)
    crowded = cut(crowded.select(*CELL, F.ceil(F.col("count") / HOT_ROWS).cast("long").alias("splits")))
    return None if crowded.isEmpty() else crowded


def join_on_cells(queries: DataFrame, candidates: DataFrame, candidate_id: str, split_hot: bool = True) -> DataFrame:
    """Equi-join on the cell; the candidates of a hot cell are dealt over several keys.

    The hint fixes the build side: the planner takes the exploded queries to be
    as small as before the explode and would broadcast or sort them. Candidates
    are not multiplied, and a hot cell is split, so one task builds its share of
    the cloud and streams the queries past it.
    """
    hot = hot_cells(candidates) if split_hot else None
    if hot is None:
        return queries.join(candidates.hint("shuffle_hash"), CELL)
    part = F.when(F.col("splits").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(candidate_id), F.col("splits"))
    )
    dealt = candidates.join(hot, CELL, "left").withColumn("part", part.cast("long")).drop("splits")
    copied = (
        queries.join(hot, CELL, "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("splits", F.lit(1).cast("long")) - 1)))
        .drop("splits")
    )
    return copied.join(dealt.hint("shuffle_hash"), [*CELL, "part"]).drop("part")


def radius_pairs(
    points: DataFrame,
    r: float,
    *,
    queries: DataFrame | None = None,
    query_cols: tuple[str, ...] = (),
    point_cols: tuple[str, ...] = (),
    half: bool = False,
    strict: bool = False,
    split_hot: bool = True,
    spread: bool = True,
) -> DataFrame:
    """Range join: every (point_id, n_id) with distance at most ``r``, self included.

    ``half`` emits each unordered pair of a self-join once and drops the self
    pairs; only half of the neighbour cells are then generated.
    """
    source = points if queries is None else queries
    size = F.lit(float(r))
    found = points.where(is_valid(*[F.col(c) for c in XYZ])).select(
        F.col("point_id").alias("n_id"),
        *[F.col(c).alias(f"n_{c}") for c in (*XYZ, *point_cols)],
        *[K.cell(F.col(c), size).alias(g) for c, g in zip(XYZ, CELL)],
    )
    asked = source.where(is_valid(*[F.col(c) for c in XYZ])).select("point_id", *XYZ, *query_cols)
    own = [K.cell(F.col(c), size) for c in XYZ]
    reach = overlapping_cells(fan_out(asked, "point_id") if spread else asked, F.lit(float(r)), size)
    if half:
        here, there = F.struct(*own), F.struct(*[F.col(g) for g in CELL])
        reach = reach.where(there >= here).withColumn("_same", there == here)
    d2 = V.distance2(V.vec("n_x", "n_y", "n_z"), V.vec(*XYZ))
    pairs = join_on_cells(reach, found, "n_id", split_hot)
    pairs = pairs.where(d2 < r * r if strict else d2 <= r * r)
    if half:
        pairs = pairs.where(~F.col("_same") | (F.col("n_id") > F.col("point_id"))).drop("_same")
    return pairs.withColumn("d2", d2).drop(*CELL)


def radius_join(points: DataFrame, r: float, queries: DataFrame | None = None) -> DataFrame:
    """(point_id, n_id, distance) of all neighbours within ``r``."""
    return radius_pairs(points, r, queries=queries).select("point_id", "n_id", F.sqrt("d2").alias("distance"))


def site_neighbor_sum(sites: Sites, r: float, value: Column, name: str, queries: DataFrame | None = None) -> DataFrame:
    """Sum ``value`` (over n_n copies and d2) within ``r`` of each site.

    The pairs are folded into one partial sum per site inside the join stage;
    no pair is ever shuffled.
    """
    grid = sites.table.withColumnRenamed("site", "point_id")
    asked = None if queries is None else queries.withColumnRenamed("site", "point_id")
    pairs = radius_pairs(grid, r, queries=asked, point_cols=("n",), spread=queries is not None)
    return pairs.groupBy(F.col("point_id").alias("site")).agg(F.sum(value).alias(name))


def ball_counts(sites: Sites, r: float, name: str) -> DataFrame:
    """Points within ``r`` of each site, copies and the site itself included."""
    sums = ball_sums(sites.table, "site", r, counted, [name], "n", whole=True)
    return sums.withColumn(name, F.col(name).cast("long"))


def local_density(points: DataFrame, r: float) -> DataFrame:
    """(point_id, density): neighbours within ``r``, self included."""
    sites = Sites(points)
    return sites.spread(ball_counts(sites, r, "density"))


def kernel_density(points: DataFrame, r: float, h: float | None = None) -> DataFrame:
    """(point_id, kde): unnormalised Gaussian sum truncated at ``r``; h defaults to r/2."""
    width = r / 2.0 if h is None else h
    sites = Sites(points)

    def bell(x, y, n, d2, inside):
        return (np.where(inside, np.exp(-d2 / (width * width)), 0.0) @ n)[:, None]

    return sites.spread(ball_sums(sites.table, "site", r, bell, ["kde"], "n"))


# Nearest neighbours ------------------------------------------------------------------------

STRAYS = 100  # points along each end of each axis that may lie outside the curve's cube
WIDE = 1 << 16  # times the middle nine tenths of a cloud at which its ends are looked at for strays


def _core(table: DataFrame, low: list[float], extent: float) -> tuple[list[float], float]:
    """Corner and side of the cube: of the whole cloud, or of what is left without strays and as much again on all sides.

    A few points very far away would leave the rest of the cloud in one place. They are found by the ``STRAYS`` smallest and largest coordinates.
    """
    middle = table.agg(*[F.percentile_approx(c, [0.05, 0.95]).alias(c) for c in XYZ]).first()
    if extent <= WIDE * max(b - a for a, b in middle):
        return low, extent
    ends = []
    for c in XYZ:
        first, last = (table.select(c).orderBy(o).limit(STRAYS + 1).agg(f(c)).first()[0] for o, f in ((F.col(c).asc(), F.max), (F.col(c).desc(), F.min)))
        ends.append((min(first, last), max(first, last)))
    size = max(b - a for a, b in ends)
    return [a - size for a, _ in ends], 3.0 * size


def tiled(found: Sites, k: int) -> Tiles:
    """The points of a cloud in tiles for searches of k neighbours."""
    s = found.stats
    low = [s[f"min_{c}"] for c in XYZ]
    low, side = _core(found.table, low, max(s[f"max_{c}"] - o for c, o in zip(XYZ, low)))
    return Tiles(found.copies(k), s.rows if s.max_n <= k else min(s.rows, s.sites * k), low, side)


def nearest_sites(points: DataFrame, k: int, queries: DataFrame | None = None, tiles: Tiles | None = None):
    """Exact k nearest points of every distinct query position.

    Returns ``(query_sites, table)`` with table columns site, x, y, z, n_id,
    n_x, n_y, n_z, d2, rank. Ties in distance go to the smaller id. ``tiles`` of the
    points may be given where they are searched several times.
    """
    found = None if tiles else Sites(points)
    asked = found if queries is None else Sites(queries)
    if (found and not found.stats.sites) or not asked.stats.sites or (tiles and not len(tiles.number)):
        empty = asked.table.select("site", *XYZ).limit(0)
        cols = [F.lit(0).cast("long").alias("n_id")]
        cols += [F.lit(0.0).alias(c) for c in ("n_x", "n_y", "n_z", "d2")] + [F.lit(0).alias("rank")]
        return asked, empty.select("*", *cols)
    return asked, (tiles or tiled(found, k)).nearest(asked.table.select("site", *XYZ), k)


def knn(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(point_id, n_id, distance, rank) of the k nearest points, self included."""
    sites, table = nearest_sites(points, k, queries)
    slim = table.select("site", "n_id", F.sqrt("d2").alias("distance"), "rank")
    return sites.spread(slim)


def closest_point(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(point_id, n_id, distance) of the single nearest point of each query."""
    return knn(points, 1, queries).drop("rank")


def neighbor_distance(points: DataFrame, k: int = 30) -> DataFrame:
    """(point_id, nnd): mean distance to the k nearest points, self included."""
    sites, table = nearest_sites(points, k)
    return sites.spread(table.groupBy("site").agg(F.avg(F.sqrt("d2")).alias("nnd")))


def ray_pick(points: DataFrame, origin, direction, radius: float = 0.05) -> DataFrame:
    """The point whose sphere the ray enters first: one row, none when all are missed."""
    from pointweave.functions.boxes import ray_sphere

    unit = np.asarray(direction, float) / np.linalg.norm(direction)
    entry = ray_sphere(V.vec(*map(float, origin)), V.vec(*map(float, unit)), V.vec(*XYZ), radius)
    hits = points.select("point_id", entry.alias("entry")).where(F.col("entry").isNotNull())
    best = hits.agg(F.min(F.struct("entry", "point_id")).alias("best"))
    return best.where(F.col("best").isNotNull()).select("best.point_id", "best.entry")


def shifted_cells(df: DataFrame, reach: int, keep_offset: bool = False) -> DataFrame:
    """Rows repeated at every cell within ``reach`` of their own, along each axis."""
    for g, o in zip(CELL, ("ox", "oy", "oz")):
        df = df.withColumn(o, F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(g, F.col(g) + F.col(o))
    return df if keep_offset else df.drop("ox", "oy", "oz")
