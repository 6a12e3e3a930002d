"""Neighbourhoods searched tile by tile.

A tile is a group of bounded size that one task searches with NumPy: points are halved by their widest axis down to leaves of at most
``LEAF`` rows, and boxes of leaves settle which of them have to be compared. Box distances are computed as those of points are, so
rounding cannot part them: a leaf counts whole, or not at all, exactly when all of its points do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pointweave.functions import keys as K
from pointweave.functions.vector import is_valid
from pointweave.operators.sites import XYZ
from pointweave.session import cut

LEAF = 64  # rows of a leaf
TILE = 32_768  # points of a tile of nearest neighbours, about
ASKED, FOUND = 65_536, 262_144  # points of a tile of balls: those that ask, those that are met
WIDTH = 4096  # columns compared at a time
N_XYZ = ["n_x", "n_y", "n_z"]


def leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by leaf, where leaves begin, with the end behind the last, and their lower and upper corners."""
    order, edges, todo = np.arange(len(p)), [], [(0, len(p))]
    while todo:
        a, z = todo.pop()
        if z - a <= LEAF:
            edges.append(a)
            continue
        part = p[order[a:z]]
        middle = (a + z) // 2
        order[a:z] = order[a:z][np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], middle - a)]
        todo += [(middle, z), (a, middle)]
    at = p[order]
    return order, np.array([*edges, len(p)]), np.minimum.reduceat(at, edges), np.maximum.reduceat(at, edges)


def _length2(d: np.ndarray) -> np.ndarray:
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def gaps(low, high, lows, highs) -> np.ndarray:
    """Least squared distances between a box and each of many."""
    return _length2(np.maximum(0.0, np.maximum(lows - high, low - highs)))


def spans(low, high, lows, highs) -> np.ndarray:
    """Largest squared distances between a box and each of many."""
    return _length2(np.maximum(highs - low, high - lows))


def distances2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, y, z = (q[None, :, i] - p[:, None, i] for i in range(3))
    return x * x + y * y + z * z


def _rows_of(edges: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(edges[i], edges[i + 1]) for i in chosen.tolist()])


def _positions(table, names=XYZ) -> np.ndarray:
    return np.column_stack([table[c].to_numpy().astype(float) for c in names])


# Sums over balls ----------------------------------------------------------------------------


def _swept(p: np.ndarray, q: np.ndarray, n: np.ndarray, r2: float, strict: bool, whole: bool, part, width: int) -> np.ndarray:
    """``width`` sums for each row of ``p`` over the rows of ``q`` in its ball; ``whole`` leaves count by their copies only."""
    out = np.zeros((len(p), width))
    own, own_edges, own_low, own_high = leaves(p)
    order, edges, low, high = leaves(q)
    q, n = q[order], n[order]
    copies = np.add.reduceat(n, edges[:-1])
    for i in range(len(own_edges) - 1):
        rows = own[own_edges[i]:own_edges[i + 1]]
        x = p[rows]
        gap = gaps(own_low[i], own_high[i], low, high)
        near = gap < r2 if strict else gap <= r2
        if whole:
            inner = spans(own_low[i], own_high[i], low, high) <= r2
            out[rows, 0] += copies[inner].sum()
            near &= ~inner
        chosen = np.flatnonzero(near)
        if not len(chosen):
            continue
        met = _rows_of(edges, chosen)
        centre = x.mean(axis=0)
        for a in range(0, len(met), WIDTH):
            at = met[a:a + WIDTH]
            d2 = distances2(x, q[at])
            out[rows] += part(x - centre, q[at] - centre, n[at], d2, d2 < r2 if strict else d2 <= r2)
    return out


def ball_sums(points: DataFrame, key: str, r: float, part, names: list[str], copies: str | None = None, strict: bool = False, whole: bool = False) -> DataFrame:
    """(key, names): sums of ``part`` over the points within ``r`` of each point, itself included.

    ``part(x, y, n, d2, inside)`` gets points and neighbours about a common centre, copies of the neighbours, squared distances and which
    pairs count, and returns one row of sums for each point. With ``whole`` the one sum is that of the copies. Cells are at least four
    radii wide and hold a few thousand points where the cloud allows it; what lies within ``r`` of a cell is sent there too. A crowded
    cell is dealt over several tiles, of those that ask and of those that are met, so a tile is bounded whatever the cloud.
    """
    held = points.where(is_valid(*[F.col(c) for c in XYZ])).select(F.col(key).alias("key"), *XYZ, (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    middle = held.agg(F.count("*").alias("rows"), *[F.percentile_approx(c, [0.05, 0.95]).alias(c) for c in XYZ]).first()
    side = 4.0 * r
    if middle.rows:
        room = math.prod(max(middle[c][1] - middle[c][0], side) for c in XYZ)
        side = max(side, (room * 8192 / middle.rows) ** (1 / 3))
    cell = ["gx", "gy", "gz"]
    own = held.select("key", *XYZ, *[K.cell(F.col(c), side).alias(g) for c, g in zip(XYZ, cell)])
    met, wide = held.select(*XYZ, "n"), r * (1.0 + 1e-9)
    for c, g in zip(XYZ, cell):
        met = met.withColumn(g, F.explode(F.sequence(K.cell(F.col(c) - wide, side), K.cell(F.col(c) + wide, side))))
    most = min(ASKED, max(2048, middle.rows // 48))
    parts = own.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias("p")).join(
        met.groupBy(*cell).agg(F.ceil(F.count("*") / FOUND).cast("int").alias("q")), cell)
    parts = cut(parts.withColumn("cell", F.monotonically_increasing_id()))
    deal = lambda n: F.pmod(F.xxhash64(*XYZ, F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = own.join(parts, cell).select("cell", deal("p").alias("i"), every("q").alias("j"), "key", *XYZ)
    found = met.join(parts, cell).select("cell", every("p").alias("i"), deal("q").alias("j"), *XYZ, "n").toDF("to", "to_i", "to_j", *N_XYZ, "n")  # names of its own, as both sides come from one table
    kind = held.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = np.zeros((left.num_rows, len(names)))
        if left.num_rows and right.num_rows:
            sums = _swept(_positions(left), _positions(right, N_XYZ), right["n"].to_numpy().astype(float), r * r, strict, whole, part, len(names))
        return pa.table([left["key"], *(pa.array(s) for s in sums.T)], names=["key", *names])

    sums = asked.groupBy("cell", "i", "j").cogroup(found.groupBy("to", "to_i", "to_j")).applyInArrow(run, ", ".join([f"key {kind}", *(f"{c} double" for c in names)]))
    return sums.groupBy(F.col("key").alias(key)).agg(*[F.sum(c).alias(c) for c in names])


def counted(x, y, n, d2, inside):
    return (inside @ n)[:, None]


# Nearest neighbours --------------------------------------------------------------------------


def _nearest(p: np.ndarray, bound: np.ndarray, q: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of q, squared distance) of the ``k`` nearest within the bounds, row by row; ties by ``rank``."""
    own, own_edges, own_low, own_high = leaves(p)
    order, edges, low, high = leaves(q)
    q, sizes = q[order], np.diff(edges)
    out = []
    for i in range(len(own_edges) - 1):
        rows = own[own_edges[i]:own_edges[i + 1]]
        x, limit = p[rows], bound[rows]
        gap = gaps(own_low[i], own_high[i], low, high)
        by = np.argsort(gap, kind="stable")
        first = int(np.searchsorted(np.cumsum(sizes[by]), k)) + 1
        met = _rows_of(edges, by[:first])
        d2 = distances2(x, q[met])
        if len(met) >= k:
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
        rest = by[first:]
        rest = rest[gap[rest] <= limit.max()]
        if len(rest):
            more = _rows_of(edges, rest)
            met, d2 = np.concatenate([met, more]), np.concatenate([d2, distances2(x, q[more])], axis=1)
            if len(met) >= k:
                limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1])
        a, b = np.nonzero(d2 <= limit[:, None])
        found = order[met[b]]
        near = d2[a, b]
        by = np.lexsort((rank[found], near, a))
        a, found, near = a[by], found[by], near[by]
        kept = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((rows[a[kept]], found[kept], near[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


class Tiles:
    """Points (n_id, x, y, z) in tiles along a space-filling curve, written once; ``boxes`` has a row for each tile."""

    def __init__(self, points: DataFrame, rows: int, low: list[float], extent: float):
        self.low, self.step = low, (extent if extent > 0 else 1.0) / (1 << 20)
        self.id_type = points.schema["n_id"].dataType.simpleString()
        count = max(1, -(-rows // TILE))
        placed = self.placed(points.select("n_id", *XYZ))
        if count > 1:
            placed = placed.repartitionByRange(count, "curve", *XYZ)
        self.table = cut(placed.withColumn("tile", F.spark_partition_id() if count > 1 else F.lit(0)))
        found = self.table.groupBy("tile").agg(F.min("curve").alias("curve"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]).orderBy("tile").collect()
        self.number = np.array([r.tile for r in found], np.int32)
        self.first = np.array([r.curve for r in found], np.int64)
        self.lows, self.highs = (np.array([[r[f"{f}_{c}"] for c in XYZ] for r in found], float).reshape(-1, 3) for f in ("min", "max"))

    def placed(self, df: DataFrame) -> DataFrame:
        """The rows with their place on the curve; positions outside of its cube take the nearest one on it."""
        low, step = np.array(self.low), self.step
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_curve(_positions(batch), low, step))], names=[*batch.schema.names, "curve"])

        return df.mapInArrow(run, f"{kinds}, curve bigint")

    def home(self, asked: DataFrame) -> DataFrame:
        """The rows with the tile to look into first."""
        first, number, lows, highs = self.first, self.number, self.lows, self.highs
        placed = self.placed(asked)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)

        def run(batches):
            for batch in batches:
                curve = batch["curve"].to_numpy()
                least = np.maximum(np.searchsorted(first, curve, "left") - 1, 0)
                last = np.maximum(np.searchsorted(first, curve, "right") - 1, 0)
                several = np.flatnonzero(last > least)  # tiles that begin at one place of the curve: the nearest box
                if len(several):
                    p = _positions(batch)
                    for i in several.tolist():
                        last[i] = least[i] + gaps(p[i], p[i], lows[least[i]:last[i] + 1], highs[least[i]:last[i] + 1]).argmin()
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "curve"), pa.array(number[last])], names=[*(c for c in batch.schema.names if c != "curve"), "tile"])

        return placed.mapInArrow(run, f"{kinds}, tile int")

    def meet(self, asked: DataFrame, run, schema: str) -> DataFrame:
        """``run`` of the rows that ask in a tile and the points of the tile; many that ask in one tile are dealt over several groups."""
        asked = cut(asked)
        parts = asked.groupBy("tile").agg(F.ceil(F.count("*") / TILE / 2).cast("int").alias("parts"))
        parts = cut(parts)
        dealt = asked.join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64(*XYZ), F.col("parts")).cast("int")).drop("parts")
        points = self.table.drop("curve").join(F.broadcast(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return dealt.groupBy("tile", "part").cogroup(points.groupBy("tile", "part")).applyInArrow(run, schema)

    def nearest(self, asked: DataFrame, k: int) -> DataFrame:
        """(site, x, y, z, n_id, n_x, n_y, n_z, d2, rank): the k nearest points of every (site, x, y, z).

        A first search in the home tile bounds the distance; the tiles whose boxes are nearer than that are searched too.
        """
        number, lows, highs = self.number, self.lows, self.highs
        site = asked.schema["site"].dataType.simpleString()
        shape = f"site {site}, x double, y double, z double, n_id {self.id_type}, n_x double, n_y double, n_z double, d2 double"
        names = ["site", *XYZ, "n_id", *N_XYZ, "d2"]

        def hits(left, right, p, bound):
            ids = right["n_id"].combine_chunks()
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            q = _positions(right)
            a, b, d2 = _nearest(p, bound, q, rank, k)
            columns = [left["site"].combine_chunks().take(pa.array(a)), *(pa.array(c) for c in p[a].T), ids.take(pa.array(b)), *(pa.array(c) for c in q[b].T), pa.array(d2)]
            return a, d2, columns

        def begin(left: pa.Table, right: pa.Table) -> pa.Table:
            p, own = _positions(left), number == (left["tile"][0].as_py() if left.num_rows else -1)
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (left.schema.field("site").type, *[pa.float64()] * 3, right.schema.field("n_id").type, *[pa.float64()] * 4, pa.int32(), pa.bool_(), pa.list_(pa.int32()))],
                                names=[*names, "rank", "open", "others"])
            a, d2, columns = hits(left, right, p, np.full(len(p), np.inf))
            begins = np.r_[True, a[1:] != a[:-1]]
            rank = np.arange(len(a)) - np.maximum.accumulate(np.where(begins, np.arange(len(a)), 0))
            bound = np.full(len(p), np.inf)
            full = rank == k - 1
            bound[a[full]] = d2[full]
            others = [None] * len(p)
            order, edges, low, high = leaves(p)
            for i in range(len(edges) - 1):
                rows = order[edges[i]:edges[i + 1]]
                near = np.flatnonzero((gaps(low[i], high[i], lows, highs) <= bound[rows].max()) & ~own)
                if len(near):
                    reached = _length2(np.maximum(0.0, np.maximum(lows[None, near] - p[rows, None], p[rows, None] - highs[None, near]))) <= bound[rows, None]
                    for row, hit in zip(rows.tolist(), reached):
                        if hit.any():
                            others[row] = number[near[hit]]
            open_ = np.array([o is not None for o in others])
            listed = pa.array([others[i] if f else None for i, f in zip(a.tolist(), begins.tolist())], pa.list_(pa.int32()))
            return pa.table([*columns, pa.array((rank + 1).astype(np.int32)), pa.array(open_[a]), listed], names=[*names, "rank", "open", "others"])

        def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], t) for t in (left.schema.field("site").type, *[pa.float64()] * 3, right.schema.field("n_id").type, *[pa.float64()] * 4)], names=names)
            return pa.table(hits(left, right, _positions(left), left["bound"].to_numpy())[2], names=names)

        first = self.meet(self.home(asked), begin, f"{shape}, rank int, open boolean, others array<int>")
        if len(number) == 1:
            first = first.select(*names, "rank", F.col("site").isNull().alias("open"))
            return _ranked(first, k)
        first = cut(first)
        # The bound of a site stands in the row of its last rank; without that row nothing bounds it.
        reach = first.where("open").groupBy("site", *XYZ).agg(F.max(F.when(F.col("rank") == k, F.col("d2"))).alias("bound"), F.max("others").alias("others"))
        asks = reach.select("site", *XYZ, F.coalesce("bound", F.lit(math.inf)).alias("bound"), F.explode("others").alias("tile"))
        more = self.meet(asks, go_on, shape)
        both = first.select(*names, "rank", (F.col("open") | F.col("site").isNull()).alias("open")).unionByName(
            more.select(*names, F.lit(0).alias("rank"), F.lit(True).alias("open")))
        return _ranked(both, k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """Rows that are open are ranked over all tiles; the others have their rank. Rows without an id are one site."""
    keep = [c for c in rows.columns if c != "open"]
    order = Window.partitionBy("site").orderBy("d2", "n_id")
    again = rows.where("open").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.where("not open").select(*keep).unionByName(again.select(*keep))


def _curve(p: np.ndarray, low: np.ndarray, step: float) -> np.ndarray:
    """Places of positions on a Z-order curve of 20 bits along each axis."""
    out = np.zeros(len(p), np.uint64)
    with np.errstate(over="ignore", invalid="ignore"):
        cells = np.clip(np.nan_to_num((p - low) / step), 0, (1 << 20) - 1).astype(np.uint64)
    for axis in range(3):
        v = cells[:, axis]
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = (v | v << np.uint64(shift)) & np.uint64(mask)
        out |= v << np.uint64(2 - axis)
    return out.view(np.int64)
