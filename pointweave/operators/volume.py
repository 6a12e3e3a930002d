"""Voxel volumes: fusing posed depth frames and extracting surfaces.

A volume is a long table with one row per occupied voxel (vx, vy, vz). Frames
are tables of world-space pixels: frame_id, u, v, x, y, z, nx, ny, nz, r, g, b
and the camera position cx, cy, cz.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointweave.functions import keys as K, matrix as M, vector as V
from pointweave.functions.boxes import Box
from pointweave.operators.neighbors import shifted_cells
from pointweave.operators.sites import XYZ
from pointweave.session import cut, fan_out

VOXEL = ["vx", "vy", "vz"]
NORMAL = ["nx", "ny", "nz"]
CAMERA = ["cx", "cy", "cz"]
TRUNCATION = 10.0  # fixed value: truncation distance in voxels
STEP = 0.8  # fixed value: sampling step in voxels
CAP = 100  # fixed value: weight at which the running mean becomes an exponential one
MIN_COS = 0.1  # fixed value: grazing views below this are skipped

# Fixed order of the six directions: opposite ones are neighbours.
DIRECTIONS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
DIRECTION_THRESHOLD = math.sin(math.pi / 8)  # our choice; no published constant


def pose_frames(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Camera-space pixels to world space with each frame's column-major pose."""
    joined = frames.where(V.is_valid(*[F.col(c) for c in XYZ])).join(poses.select("frame_id", "m"), "frame_id")
    p = M.transform_point("m", V.vec(*XYZ))
    n = M.transform_direction("m", V.vec(*NORMAL))
    keep = [c for c in frames.columns if c not in (*XYZ, *NORMAL)]
    return joined.select(
        *keep, *[c.alias(k) for c, k in zip(p, XYZ)], *[c.alias(k) for c, k in zip(n, NORMAL)],
        *[F.col("m")[12 + i].alias(c) for i, c in enumerate(CAMERA)],
    )


def frame_bounds(frames: DataFrame) -> DataFrame:
    from pointweave.operators.aggregates import bounding_box

    return bounding_box(frames, ["frame_id"])


def _to_voxels(df: DataFrame, size: float, position: V.Vec) -> DataFrame:
    return df.withColumns({k: K.cell(p, size) for k, p in zip(VOXEL, position)})


def _view(frames: DataFrame) -> DataFrame:
    """Distance and unit direction from the camera to the pixel; degenerate pixels drop out."""
    away = V.sub(V.vec(*XYZ), V.vec(*CAMERA))
    df = fan_out(frames, "u").withColumn("dist", V.length(away)).where(F.col("dist") >= 1e-6)
    return df.withColumns({f"d{k}": a / F.col("dist") for k, a in zip("xyz", away)})


def _unit_normals(df: DataFrame) -> DataFrame:
    df = df.withColumn("_l", V.length(V.vec(*NORMAL))).where(F.col("_l") >= 1e-6)
    return df.withColumns({c: F.col(c) / F.col("_l") for c in NORMAL}).drop("_l")


def ray_samples(frames: DataFrame, size: float) -> DataFrame:
    """Samples around the surface along the camera ray, with truncated distance ``s``."""
    band = size * TRUNCATION
    df = _view(frames).withColumn("t0", F.greatest(F.lit(0.0), F.col("dist") - band))
    steps = F.floor((F.col("dist") + band - F.col("t0")) / (size * STEP))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    df = df.withColumn("t", F.col("t0") + F.col("i") * (size * STEP))
    position = V.add(V.vec(*CAMERA), V.scale(V.vec("dx", "dy", "dz"), F.col("t")))
    s = V.clamp((F.col("dist") - F.col("t")) / band, -1.0, 1.0)
    return _to_voxels(df, size, position).withColumn("s", s).withColumn("factor", F.lit(1.0))


def normal_samples(frames: DataFrame, size: float) -> DataFrame:
    """Samples along the surface normal; ``s`` is the distance of the voxel centre
    to the tangent plane and ``factor`` the trust in the view."""
    band = size * TRUNCATION
    df = _unit_normals(_view(frames))
    df = df.withColumn("view_dot", V.dot(V.vec("dx", "dy", "dz"), V.vec(*NORMAL)))
    df = df.where(F.abs("view_dot") >= MIN_COS)
    trust = F.abs("view_dot") * F.least(1.0 / F.greatest(F.col("dist"), F.lit(1e-4)), F.lit(1.0))
    df = df.withColumn("factor", trust)
    last = int(math.floor(2 * TRUNCATION / STEP + 1e-9))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last))))
    t = F.col("i") * (size * STEP) - band
    df = _to_voxels(df, size, V.add(V.vec(*XYZ), V.scale(V.vec(*NORMAL), t)))
    centre = tuple(K.centre(F.col(v), size) for v in VOXEL)
    s = V.dot(V.sub(V.vec(*XYZ), centre), V.vec(*NORMAL)) / band
    return df.withColumn("s", V.clamp(s, -1.0, 1.0))


def _floats(table, names) -> list[np.ndarray]:
    """Columns as doubles, nulls as NaN."""
    return [np.asarray(table[c].to_numpy(zero_copy_only=False) if isinstance(table[c], pa.Array) else table[c].to_numpy(), float) for c in names]


def _seen(table) -> tuple:
    """As ``_view``: which pixels stay, their positions, cameras, distances and directions."""
    p, c = (np.column_stack(_floats(table, names)) for names in (XYZ, CAMERA))
    away = p - c
    dist = np.sqrt(away[:, 0] * away[:, 0] + away[:, 1] * away[:, 1] + away[:, 2] * away[:, 2])
    kept = np.flatnonzero(dist >= 1e-6)
    return kept, p[kept], c[kept], dist[kept], away[kept] / dist[kept, None]


def ray_arrays(table, size: float) -> tuple[np.ndarray, ...]:
    """What ``ray_samples`` gives for the rows of a table: row, i, voxel, s and factor of every sample, row by row."""
    band = size * TRUNCATION
    kept, _, c, dist, d = _seen(table)
    t0 = np.maximum(0.0, dist - band)
    steps = np.floor((dist + band - t0) / (size * STEP)).astype(np.int64) + 1
    at = np.repeat(np.arange(len(kept)), steps)
    i = np.arange(len(at)) - np.repeat(np.cumsum(steps) - steps, steps)
    t = t0[at] + i * (size * STEP)
    voxel = np.floor((c[at] + d[at] * t[:, None]) / size).astype(np.int64)
    s = np.clip((dist[at] - t) / band, -1.0, 1.0)
    return kept[at], i, voxel, s, np.ones(len(at))


def normal_arrays(table, size: float) -> tuple[np.ndarray, ...]:
    """What ``normal_samples`` gives for the rows of a table: row, i, voxel, s and factor, then unit normal and cosine of the view."""
    band = size * TRUNCATION
    kept, p, _, dist, d = _seen(table)
    n = np.column_stack(_floats(table, NORMAL))[kept]
    with np.errstate(divide="ignore", invalid="ignore"):
        long = np.sqrt(n[:, 0] * n[:, 0] + n[:, 1] * n[:, 1] + n[:, 2] * n[:, 2])
        n = n / long[:, None]
        cos = d[:, 0] * n[:, 0] + d[:, 1] * n[:, 1] + d[:, 2] * n[:, 2]
        good = (long >= 1e-6) & (np.abs(cos) >= MIN_COS)
    kept, p, dist, n, cos = kept[good], p[good], dist[good], n[good], cos[good]
    trust = np.abs(cos) * np.minimum(1.0 / np.maximum(dist, 1e-4), 1.0)
    count = int(math.floor(2 * TRUNCATION / STEP + 1e-9)) + 1
    at, i = np.repeat(np.arange(len(kept)), count), np.tile(np.arange(count), len(kept))
    t = i * (size * STEP) - band
    p, n = p[at], n[at]
    voxel = np.floor((p + n * t[:, None]) / size).astype(np.int64)
    off = p - (voxel + 0.5) * size
    s = np.clip((off[:, 0] * n[:, 0] + off[:, 1] * n[:, 1] + off[:, 2] * n[:, 2]) / band, -1.0, 1.0)
    return kept[at], i, voxel, s, trust[at], n, cos[at]


def _numbered(voxel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct voxels and the number of each row's voxel among them."""
    if not len(voxel):
        return voxel, np.zeros(0, np.int64)
    low = voxel.min(axis=0)
    room = voxel.max(axis=0) - low + 1
    if float(room[0]) * float(room[1]) * float(room[2]) > 1 << 62:
        found, number = np.unique(voxel, axis=0, return_inverse=True)
        return found, number.reshape(-1)
    flat = ((voxel[:, 0] - low[0]) * room[1] + voxel[:, 1] - low[1]) * room[2] + voxel[:, 2] - low[2]
    cells = int(room[0] * room[1] * room[2])
    if cells <= 1 << 24:
        held = np.zeros(cells, bool)
        held[flat] = True
        found = np.flatnonzero(held)
        number = (np.cumsum(held) - 1)[flat]
    else:
        found, number = np.unique(flat, return_inverse=True)
    return np.column_stack([found // (room[1] * room[2]), found // room[2] % room[1], found % room[2]]) + low, number


def _gathered(batches, rows: int):
    """Batches as tables of about ``rows`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


CHUNK = 1 << 16  # pixels folded at a time
TURN = ["frame_id", "v", "u"]


def _in_turn(size: int):
    """Pixels that come in order, with ``chunk`` (of about ``size`` rows) and ``turn``; pixels of equal frame, v and u have one turn and stay in one chunk."""

    def run(batches):
        from pyspark import TaskContext

        part, before, turn, chunk, row = TaskContext.get().partitionId() << 32, None, -1, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([pc.fill_null(pc.cast(batch[c], pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False) for c in TURN])
            fresh = np.r_[before is None or (keys[0] != before).any(), (keys[1:] != keys[:-1]).any(axis=1)]
            before = keys[-1]
            turns = turn + np.cumsum(fresh)
            begins = np.where(fresh, row + np.arange(len(keys)), -1)
            begins[0] = begins[0] if fresh[0] else chunk
            begins = np.maximum.accumulate(begins)
            turn, chunk, row = int(turns[-1]), int(begins[-1]), row + len(keys)
            names = [c for c in batch.schema.names if c not in TURN]
            yield pa.RecordBatch.from_arrays([pa.array(part + begins // size), pa.array(turns), *(batch[c] for c in names)], names=["chunk", "turn", *names])

    return run


def _blended(frames: DataFrame, size: float, arrays, columns: list[str]) -> DataFrame:
    """(voxel, blend): v <- v (1 - f/w) + s f/w with w = min(count, CAP) + 1 over the samples of a voxel in the order of frame, v, u and i.

    Pixels, not samples, are ordered: range-partitioned, sorted and numbered in chunks. A first pass counts the samples of each chunk in
    each voxel, whence the count with which the chunk begins there. A second one folds each chunk to a factor by which it leaves what was
    there before, as a logarithm, and to what it adds. No sample leaves the task that makes it.
    """
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{c} double" for c in columns)
    ordered = frames.select(*[F.col(c).cast("long") for c in TURN], *[F.col(c).cast("double") for c in columns]).repartitionByRange(parts, *TURN).sortWithinPartitions(*TURN)
    pixels = cut(ordered.mapInArrow(_in_turn(CHUNK), f"chunk bigint, turn bigint, {kinds}"))

    def count(batches):
        for table in _gathered(batches, CHUNK):
            chunk = table["chunk"].to_numpy()
            for c in np.unique(chunk).tolist():
                found, number = _numbered(arrays(table.filter(pa.array(chunk == c)), size)[2])
                if len(found):
                    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in found.T), pa.array(np.full(len(found), c)), pa.array(np.bincount(number))], names=[*VOXEL, "chunk", "m"])

    counts = pixels.mapInArrow(count, "vx bigint, vy bigint, vz bigint, chunk bigint, m bigint")
    earlier = Window.partitionBy(*VOXEL).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*VOXEL, "chunk", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("k"))

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*VOXEL, "chunk", "kept", "added"]
        row, i, voxel, s, factor = arrays(left, size)[:5]
        if not len(row):
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())] * 2, names=names)
        found, number = _numbered(np.concatenate([voxel, np.column_stack([right[c].to_numpy() for c in VOXEL])]))
        begin = np.zeros(len(found), np.int64)
        begin[number[len(voxel):]] = right["k"].to_numpy()
        number = number[:len(voxel)]
        order = np.lexsort((i, left["turn"].to_numpy()[row], number))
        number, s, factor = number[order], s[order], factor[order]
        edges = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        ends = np.r_[edges[1:], len(number)]
        k = begin[number] + np.arange(len(number)) - np.repeat(edges, ends - edges)
        share = factor / (np.minimum(k, CAP) + 1.0)
        left_over = np.log1p(-np.where(k > 0, share, 0.0))
        total = np.cumsum(left_over)
        later = np.repeat(total[ends - 1], ends - edges) - total
        own = found[number[edges]]
        return pa.table([*(pa.array(v) for v in own.T), pa.array(np.full(len(own), left["chunk"][0].as_py())),
                         pa.array(np.add.reduceat(left_over, edges)), pa.array(np.add.reduceat(s * share * np.exp(later), edges))], names=names)

    folded = pixels.groupBy("chunk").cogroup(starts.toDF(*VOXEL, "at", "k").groupBy("at")).applyInArrow(
        fold, "vx bigint, vy bigint, vz bigint, chunk bigint, kept double, added double")
    after = Window.partitionBy(*VOXEL).orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    late = folded.withColumn("late", F.coalesce(F.sum("kept").over(after), F.lit(0.0)))
    return late.groupBy(*VOXEL).agg(F.sum(F.col("added") * F.exp("late")).alias("blend"))


def _means(samples: DataFrame):
    colors = [F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"]
    return [F.count("*").alias("weight"), *[F.sum(c).alias(c) for c in NORMAL], *colors]


def _finish(volume: DataFrame) -> DataFrame:
    unit = V.normalize(V.vec(*NORMAL))
    return volume.select(*VOXEL, "value", "weight", *[u.alias(c) for u, c in zip(unit, NORMAL)], "r", "g", "b")


def integrate_rays(frames: DataFrame, size: float) -> DataFrame:
    """Running average per voxel: a plain mean up to the cap, exponential beyond.

    Up to CAP + 1 samples the order does not matter and one aggregate suffices; voxels with more take the blend in
    order. Color and normal are plain means.
    """
    samples = ray_samples(frames, size)
    plain = samples.groupBy(*VOXEL).agg(F.avg("s").alias("value"), *_means(samples))
    both = plain.join(_blended(frames, size, ray_arrays, [*XYZ, *CAMERA]), VOXEL, "left")
    return _finish(both.withColumn("value", F.when(F.col("weight") > CAP + 1, F.col("blend")).otherwise(F.col("value"))))


def integrate_normals(frames: DataFrame, size: float) -> DataFrame:
    """Blend of distances to tangent planes, each by the trust in its view, in the order of frames and pixels."""
    samples = normal_samples(frames, size)
    blend = _blended(frames, size, normal_arrays, [*XYZ, *NORMAL, *CAMERA]).withColumnRenamed("blend", "value")
    return _finish(samples.groupBy(*VOXEL).agg(*_means(samples)).join(blend, VOXEL))


def directional_sums(frames: DataFrame, size: float, threshold: float = DIRECTION_THRESHOLD) -> DataFrame:
    """(voxel, dir, sum_wd, sum_w): weighted distances per surface direction, order-free.

    Tasks make the samples of ``CHUNK`` pixels at a time and hand on their sums for each voxel and direction.
    """

    def run(batches):
        for table in _gathered(batches, CHUNK):
            row, _, voxel, s, factor, n, cos = normal_arrays(table, size)
            kept = ~((s < -0.5) & (cos > 0))
            voxel, s, factor, n = voxel[kept], s[kept], factor[kept], n[kept]
            found, number = _numbered(voxel)
            for d, axis in enumerate(DIRECTIONS):
                dot = n @ np.array(axis, float)
                facing = np.flatnonzero(dot > threshold)
                if not len(facing):
                    continue
                w, at = dot[facing] * factor[facing], number[facing]
                hit = np.flatnonzero(np.bincount(at, minlength=len(found)))
                sums = [np.bincount(at, v, len(found))[hit] for v in (w * s[facing], w)]
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in found[hit].T), pa.array(np.full(len(hit), d, np.int32)), *(pa.array(v) for v in sums)],
                                                 names=[*VOXEL, "dir", "sum_wd", "sum_w"])

    pixels = fan_out(frames, "u").select(*[F.col(c).cast("double") for c in (*XYZ, *NORMAL, *CAMERA)])
    rows = pixels.mapInArrow(run, "vx bigint, vy bigint, vz bigint, dir int, sum_wd double, sum_w double")
    return rows.groupBy(*VOXEL, "dir").agg(F.sum("sum_wd").alias("sum_wd"), F.sum("sum_w").alias("sum_w"))


def directional_merge(state: DataFrame | None, sums: DataFrame) -> DataFrame:
    """Fold one batch of sums into (voxel, dir, value, weight); opposite negative pairs are reset."""
    batch = sums.where(F.col("sum_w") >= 1e-9).select(*VOXEL, "dir", F.col("sum_wd").alias("wd"), F.col("sum_w").alias("w"))
    if state is None:
        total = batch
    else:
        old = state.select(*VOXEL, "dir", (F.col("value") * F.col("weight")).alias("wd"), F.col("weight").alias("w"))
        total = old.unionByName(batch)
    merged = total.groupBy(*VOXEL, "dir").agg((F.sum("wd") / F.sum("w")).alias("value"), F.sum("w").alias("weight"))
    pair = Window.partitionBy(*VOXEL, F.floor(F.col("dir") / 2))  # at most two rows per group
    both_behind = (F.count("*").over(pair) == 2) & (F.max("value").over(pair) < 0)
    return merged.withColumn("_drop", both_behind).where(~F.col("_drop")).drop("_drop")


def occupancy(frames: DataFrame, size: float) -> DataFrame:
    """Hits per voxel (count capped at 65535), last color by (frame, v, u), last frame."""
    hit = _to_voxels(frames, size, V.vec(*XYZ))
    last = F.max(F.struct("frame_id", "v", "u", "r", "g", "b"))
    counted = hit.groupBy(*VOXEL).agg(F.count("*").alias("hits"), last.alias("_l"))
    return counted.select(
        *VOXEL, F.col("hits").cast("double").alias("value"), F.least("hits", F.lit(65535)).alias("weight"),
        *[F.col(f"_l.{c}").alias(c) for c in "rgb"], F.col("_l.frame_id").alias("last_frame"),
    )


def centres(volume: DataFrame, size: float) -> DataFrame:
    return volume.withColumns({c: K.centre(F.col(v), size) for c, v in zip(XYZ, VOXEL)})


def extract_occupied(volume: DataFrame, size: float) -> DataFrame:
    return centres(volume.where(F.col("weight") > 0), size)


def extract_near(volume: DataFrame, size: float, band: float = 0.1, least: int = 5) -> DataFrame:
    """Voxels close to the surface with enough support."""
    return centres(volume.where((F.abs("value") < band) & (F.col("weight") >= least)), size)


def within_region(volume: DataFrame, size: float, low, high, block: int = 8) -> DataFrame:
    """Blocks overlapping the box first (prunable on vx, vy, vz), then voxel centres inside it."""
    test = F.lit(True)
    for v, a, b in zip(VOXEL, low, high):
        first = math.floor(a / (size * block)) * block
        last = math.floor(b / (size * block)) * block + block - 1
        test = test & F.col(v).between(first, last)
    inside = Box.literal(low, high).contains(tuple(K.centre(F.col(v), size) for v in VOXEL))
    return volume.where(test & inside)


def _along_axes(volume: DataFrame, fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Each voxel next to its +x, +y and +z neighbour: columns a_*, b_*, axis.

    Every voxel is sent to itself and to its three lower neighbours, and the
    two meet in one grouping; no self-join.
    """
    body = F.struct(*fields)
    sent = []
    for axis, v in enumerate(VOXEL):
        for role, move in (("a", 0), ("b", 1)):
            place = [(F.col(k) - move if k == v else F.col(k)).alias(k) for k in VOXEL]
            empty = F.lit(None).cast(_struct_type(volume, fields))
            sent.append(F.struct(
                F.lit(axis).alias("axis"), *place,
                (body if role == "a" else empty).alias("a"), (body if role == "b" else empty).alias("b"),
            ))
    rows = volume.select(*by, F.explode(F.array(*sent)).alias("s")).select(*by, "s.*")
    met = rows.groupBy(*by, "axis", *VOXEL).agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    return met.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def _struct_type(df: DataFrame, fields: list[str]):
    return df.select(F.struct(*fields).alias("s")).schema["s"].dataType


def zero_crossings(volume: DataFrame, size: float) -> DataFrame:
    """Interpolated surface points between neighbouring voxels of opposite sign.

    The normal is the negated central difference one voxel around the point
    where all six values exist, else the blend of the two voxel normals.
    """
    solid = volume.where(F.col("weight") >= 1)
    pairs = _along_axes(solid, ["value", "weight", *NORMAL]).where(F.col("a.value") * F.col("b.value") < 0)
    mu = V.clamp(-F.col("a.value") / (F.col("b.value") - F.col("a.value")), 0.0, 1.0)
    pairs = pairs.withColumn("mu", mu)
    position = {c: K.centre(F.col(v), size) + F.when(F.col("axis") == i, F.col("mu") * size).otherwise(F.lit(0.0))
                for i, (c, v) in enumerate(zip(XYZ, VOXEL))}
    found = pairs.withColumns(position)
    probes = []
    for i, c in enumerate(XYZ):
        for sign in (1, -1):
            at = [K.cell(F.col(k) + (sign * size if k == c else 0.0), size).alias(f"p{k}") for k in XYZ]
            probes.append(F.struct(F.lit(2 * i + (0 if sign > 0 else 1)).alias("probe"), *at))
    asked = found.select("axis", *VOXEL, F.explode(F.array(*probes)).alias("q")).select("axis", *VOXEL, "q.*")
    values = solid.select(*[F.col(v).alias(f"p{c}") for v, c in zip(VOXEL, XYZ)], F.col("value").alias("pv"))
    answered = asked.join(values, [f"p{c}" for c in XYZ])
    gradients = answered.groupBy("axis", *VOXEL).agg(
        F.count("*").alias("probes"),
        *[F.sum(F.when(F.col("probe") == 2 * i, F.col("pv")).when(F.col("probe") == 2 * i + 1, -F.col("pv"))
                .otherwise(F.lit(0.0))).alias(f"g{c}") for i, c in enumerate(XYZ)],
    ).where(F.col("probes") == 6)
    both = found.join(gradients, ["axis", *VOXEL], "left")
    grad = V.vec("gx", "gy", "gz")
    both = both.withColumns({"_g": V.length(grad), **{
        f"_{n}": F.col(f"a.{n}") + F.col("mu") * (F.col(f"b.{n}") - F.col(f"a.{n}")) for n in NORMAL}})
    both = both.withColumn("_b", V.length(V.vec("_nx", "_ny", "_nz")))
    normals = []
    for n, g, up in zip(NORMAL, grad, (0.0, 1.0, 0.0)):
        from_gradient = F.when(F.col("_g") > 1e-6, -g / F.col("_g")).otherwise(F.lit(up))
        blended = F.when(F.col("_b") > 1e-6, F.col(f"_{n}") / F.col("_b")).otherwise(F.col(f"a.{n}"))
        normals.append(F.when(F.col("probes").isNotNull(), from_gradient).otherwise(blended).alias(n))
    return both.select(*VOXEL, "axis", *XYZ, *normals, F.col("a.weight").alias("weight"))


def directional_crossings(state: DataFrame, size: float) -> DataFrame:
    """Sign changes along each axis, per direction of a directional volume."""
    out = _along_axes(state.where(F.col("weight") > 0), ["value", "weight"], by=("dir",))
    out = out.where(F.col("a.value") * F.col("b.value") < 0)
    mu = F.col("a.value") / (F.col("a.value") - F.col("b.value"))
    return out.select("dir", "axis", *VOXEL, *[
        (K.centre(F.col(v), size) + F.when(F.col("axis") == i, mu * size).otherwise(F.lit(0.0))).alias(c)
        for i, (c, v) in enumerate(zip(XYZ, VOXEL))], F.col("a.weight").alias("weight"))


def ray_voxels(frames: DataFrame, size: float, guard: float = 1.5) -> DataFrame:
    """(voxel, frame_id): the distinct voxels that the camera rays of each frame pass on their way to the surface."""
    step = size * STEP
    df = _view(frames).withColumn("stop", F.col("dist") - size * guard).where(F.col("stop") > step)
    count = F.ceil(F.col("stop") / step) - 1  # samples at step, 2 step, ... below stop
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1)))))
    t = F.col("i") * step
    return _to_voxels(df, size, V.add(V.vec(*CAMERA), V.scale(V.vec("dx", "dy", "dz"), t))).select(*VOXEL, "frame_id").distinct()


def carve_free_space(volume: DataFrame, frames: DataFrame, size: float, guard: float = 1.5, least: int = 4) -> DataFrame:
    """Remove weakly supported voxels that a camera ray passes on its way to the surface."""
    weak = volume.where(F.col("weight") < least).select(*VOXEL)
    carved = ray_voxels(frames, size, guard).select(*VOXEL).distinct().join(weak, VOXEL)
    return volume.join(carved, VOXEL, "left_anti")


def clear(volume: DataFrame) -> DataFrame:
    return volume.limit(0)


def mean_distance_volume(points: DataFrame, size: float = 0.05, reach: int = 3) -> DataFrame:
    """Plain mean of the signed offset along the normal; order-free."""
    rows = fan_out(points, "point_id").withColumn("i", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    t = F.col("i") * size
    unit = V.normalize(V.vec(*NORMAL))
    placed = _to_voxels(rows, size, V.add(V.vec(*XYZ), V.scale(unit, t)))
    s = V.clamp(t / (reach * size), -1.0, 1.0)
    return placed.withColumn("s", s).groupBy(*VOXEL).agg(F.avg("s").alias("value"), F.count("*").alias("weight"))


def near_zero(volume: DataFrame, size: float, least: int = 3, band: float = 0.1) -> DataFrame:
    """Voxel centres with small mean distance; the normal is a fixed +Z."""
    kept = centres(volume.where((F.col("weight") >= least) & (F.abs("value") <= band)), size)
    return kept.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})


# Surface nets ------------------------------------------------------------------------------

CORNERS = [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
EDGES = [(p, q) for p in range(8) for q in range(p + 1, 8)
         if sum(a != b for a, b in zip(CORNERS[p], CORNERS[q])) == 1]


def net_vertices(field: DataFrame, size: float, iso: float = 0.0) -> DataFrame:
    """One vertex per cell whose eight corners exist and change sign: the mean edge crossing.

    A voxel is sent to the eight cells it is a corner of; one grouping collects them.
    """
    sent = F.array(*[
        F.struct(F.lit(c).alias("corner"), *[(F.col(v) - o).alias(v) for v, o in zip(VOXEL, off)])
        for c, off in enumerate(CORNERS)
    ])
    rows = field.select("value", F.explode(sent).alias("s")).select("value", "s.*")
    cells = rows.groupBy(*VOXEL).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        *[F.max(F.when(F.col("corner") == c, F.col("value"))).alias(f"d{c}") for c in range(8)],
    ).where((F.col("n") == 8) & (F.col("low") < iso) & (F.col("high") >= iso))
    crossings = []
    for p, q in EDGES:
        a, b = F.col(f"d{p}"), F.col(f"d{q}")
        t = (iso - a) / (b - a)
        place = [F.lit(float(i)) + t * float(j - i) if i != j else F.lit(float(i)) for i, j in zip(CORNERS[p], CORNERS[q])]
        crossings.append(F.when((a < iso) != (b < iso), F.struct(*[x.alias(c) for x, c in zip(place, XYZ)])))
    hit = cells.withColumn("hits", F.filter(F.array(*crossings), lambda h: h.isNotNull()))
    number = F.size("hits").cast("double")


    def total(axis):
        return F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h[axis])

    mean = {c: (F.col(v) + total(c) / number) * size for c, v in zip(XYZ, VOXEL)}
    return hit.select(*VOXEL, *[m.alias(c) for c, m in mean.items()])


def net_triangles(field: DataFrame, size: float, iso: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles): two triangles per sign-changing grid edge with four cells around it.

    Triangle corners are the cells (ax, ay, az), (bx, ...), (cx, ...) of the vertices.
    """
    vertices = net_vertices(field, size, iso)
    inside_a, inside_b = F.col("a.value") < iso, F.col("b.value") < iso
    edges = _along_axes(field, ["value"]).where(inside_a != inside_b).withColumn("inside", inside_a)
    # The cells around an edge differ from its node by 0 or -1 along the two other axes, taken in cyclic order.
    # Going round as (0,0), (-1,0), (-1,-1), (0,-1) turns positively about the edge.
    around = ((0, 0), (-1, 0), (-1, -1), (0, -1))

    def ring(axis: int) -> Column:
        first, second = (axis + 1) % 3, (axis + 2) % 3
        return _ring([[u if k == first else v if k == second else 0 for k in range(3)] for u, v in around])

    slots = F.when(F.col("axis") == 0, ring(0)).when(F.col("axis") == 1, ring(1)).otherwise(ring(2))
    quads = edges.select("axis", F.struct(*VOXEL).alias("edge"), "inside", F.explode(slots).alias("q")).select(
        "axis", "edge", "inside", "q.slot", "q.vx", "q.vy", "q.vz")
    held = quads.join(vertices.select(*VOXEL), VOXEL, "left_semi")
    full = held.groupBy("axis", "edge", "inside").agg(
        F.count("*").alias("n"),
        *[F.max(F.when(F.col("slot") == i, F.struct(*VOXEL))).alias(f"q{i}") for i in range(4)],
    ).where(F.col("n") == 4)
    # Faces point from inside to outside.
    pick = [F.when(F.col("inside"), F.col(f"q{i}")).otherwise(F.col(f"q{3 - i}")) for i in range(4)]
    two = F.array(F.struct(*[pick[i].alias(n) for i, n in zip((0, 1, 2), "abc")]),
                  F.struct(*[pick[i].alias(n) for i, n in zip((0, 2, 3), "abc")]))
    tri = full.select(F.explode(two).alias("t")).select(
        *[F.col(f"t.{n}.{v}").alias(f"{n}{v[1]}") for n in "abc" for v in VOXEL])
    return vertices, tri


def _ring(cells) -> Column:
    return F.array(*[
        F.struct(F.lit(s).alias("slot"), *[(F.col(v) + o).alias(v) for v, o in zip(VOXEL, off)])
        for s, off in enumerate(cells)
    ])


# Distance-field smoothing ------------------------------------------------------------------


def distance_field(points: DataFrame, size: float, reach: int = 2, padding: float = 5.0) -> DataFrame:
    """(gx, gy, gz, d): nearest distance splatted to the grid nodes around each point.

    Copies of a position are dropped before the splat multiplies the rows.
    """
    low = {c: points.agg((F.min(c) - size * padding).alias("low")).scalar() for c in XYZ}
    own = points.select(*XYZ).distinct().withColumns({f"l{c}": low[c] for c in XYZ})
    own = own.withColumns({g: F.floor((F.col(c) - F.col(f"l{c}")) / size).cast("long")
                           for g, c in zip(("gx", "gy", "gz"), XYZ)})
    spread = shifted_cells(own, reach)
    node = tuple(F.col(f"l{c}") + F.col(g) * size for c, g in zip(XYZ, ("gx", "gy", "gz")))
    return spread.groupBy("gx", "gy", "gz").agg(F.min(V.distance(node, V.vec(*XYZ))).alias("d"))


def smooth_field(field: DataFrame, size: float, rounds: int = 1) -> DataFrame:
    """Box blur over the 27-neighbourhood for nodes within three voxels of the surface."""
    for _ in range(rounds):
        told = shifted_cells(field, 1, keep_offset=True)
        own = (F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0)
        met = told.groupBy("gx", "gy", "gz").agg(
            F.max(F.when(own, F.col("d"))).alias("self"), F.avg(F.when(F.col("d") < 50.0, F.col("d"))).alias("mean"))
        met = met.where(F.col("self").isNotNull())
        blurred = F.when((F.col("self") > size * 3.0) | F.col("mean").isNull(), F.col("self")).otherwise(F.col("mean"))
        field = cut(met.select("gx", "gy", "gz", blurred.alias("d")))
    return field


def field_surface(field: DataFrame, points: DataFrame, size: float, iso_ratio: float = 0.5, padding: float = 5.0) -> DataFrame:
    """Nodes below the iso distance with gradient normals; absent neighbours count as 100."""
    kept = field.where(F.col("d") < size * iso_ratio).select("gx", "gy", "gz")
    moves = [(i, s) for i in range(3) for s in (1, -1)]
    told = F.array(*[
        F.struct(F.lit(2 * i + (0 if s > 0 else 1)).alias("side"),
                 *[(F.col(g) - (s if j == i else 0)).alias(g) for j, g in enumerate(("gx", "gy", "gz"))])
        for i, s in moves
    ])
    sent = field.select("d", F.explode(told).alias("t")).select("d", "t.*").join(kept, ["gx", "gy", "gz"], "left_semi")
    sides = sent.groupBy("gx", "gy", "gz").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == s, F.col("d"))), F.lit(100.0)).alias(f"s{s}") for s in range(6)])
    full = kept.join(sides, ["gx", "gy", "gz"])
    g = tuple(F.col(f"s{2 * i}") - F.col(f"s{2 * i + 1}") for i in range(3))
    full = full.withColumn("_l", V.length(g))
    normals = [F.when(F.col("_l") * F.col("_l") > 1e-6, a / F.col("_l")).otherwise(F.lit(up)).alias(n)
               for a, n, up in zip(g, NORMAL, (0.0, 1.0, 0.0))]
    low = {c: points.agg((F.min(c) - size * padding).alias("low")).scalar() for c in XYZ}
    return full.select("gx", "gy", "gz", *[(low[c] + F.col(gc) * size).alias(c) for c, gc in zip(XYZ, ("gx", "gy", "gz"))], *normals)
