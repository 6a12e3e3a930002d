"""Holes, touching fans, near vertices, polygons and curves against plain versions."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.operators import curves as U, mesh as M, polygons as P, repair as R
from pointweave.session import by_groups

VERTEX, FACE = "mesh_id long, vertex_id long, x double, y double, z double", "mesh_id long, face_id long, v0 long, v1 long, v2 long"


def sheet(n, without=()):
    """Vertices and faces of an n x n sheet; squares named in ``without`` are left out."""
    vertices = [(1, i * 100 + j, float(i), float(j), 0.1 * math.sin(i * j)) for i in range(n + 1) for j in range(n + 1)]
    squares = [i * 100 + j for i in range(n) for j in range(n) if (i, j) not in without]
    return vertices, [f for v in squares for f in ((1, v * 2, v, v + 100, v + 101), (1, v * 2 + 1, v, v + 101, v + 1))]


def brute_area(points):
    """Least area over all triangulations of a rim."""
    if len(points) < 3:
        return 0.0
    size = lambda k: 0.5 * np.linalg.norm(np.cross(points[k] - points[0], points[-1] - points[0]))
    return min(brute_area(points[:k + 1]) + brute_area(points[k:]) + size(k) for k in range(1, len(points) - 1))


def test_holes_close_with_the_least_area():
    rng = np.random.default_rng(3)
    for n in (3, 4, 5, 7, 9):
        points = rng.normal(size=(n, 3))
        tris = R.least_area(points)
        area = sum(0.5 * np.linalg.norm(np.cross(points[b] - points[a], points[c] - points[a])) for a, b, c in tris)
        assert len(tris) == n - 2 and area == pytest.approx(brute_area(points))


def test_small_holes_are_filled_and_large_rims_stay(spark):
    vertices, faces = sheet(8, without={(2, 2), (5, 5), (5, 6)})
    v, f = spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(faces, FACE)
    whole = R.filled(v, f, most=10)
    assert whole.count() == 2 * 64 and whole.select("face_id").distinct().count() == 128
    assert M.edge_valence(whole).where("valence > 2").count() == 0
    assert M.boundary_half_edges(whole).count() == 32  # the outer rim
    shadow = M.with_corners(v, whole).select(F.sum(((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2)).first()[0]
    assert shadow == pytest.approx(64)
    assert R.filled(v, f, most=4).count() == 2 * 62 and R.filled(v, f.limit(0)).count() == 0
    closed = R.filled(v, f, most=32)
    shape = M.diagnostics(v, closed).first()
    assert shape.boundary == shape.non_manifold == shape.duplicate == 0


def test_touching_fans_are_taken_apart(spark):
    vertices, faces = sheet(2, without={(0, 1), (1, 0)})  # two squares that meet in a corner
    v, f = R.split_touching(spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(faces, FACE))
    assert v.count() == 10 and v.select("vertex_id").distinct().count() == 10
    assert M.fan_counts(f).where("fans > 1").count() == 0 and f.count() == 4
    assert v.where("x = 1 and y = 1").count() == 2


def test_fans_of_a_crowded_vertex(spark, monkeypatch):
    ring = lambda start, n: [(1, start + k, 0, 1 + start + k, 1 + start + (k + 1) % n) for k in range(n)]
    faces = spark.createDataFrame(ring(0, 6) + ring(10, 5) + [(1, 20, 0, 30, 31), (1, 21, 0, 31, 32)], FACE)
    want = {0: 3, **{i: 1 for i in [*range(1, 7), *range(11, 16), 30, 31, 32]}}
    assert {r.vertex_id: r.fans for r in M.fan_counts(faces).collect()} == want
    monkeypatch.setattr(M, "MANY", 5)
    assert {r.vertex_id: r.fans for r in M.fan_counts(faces).collect()} == want


def test_near_vertices(spark):
    rng = random.Random(6)
    rows = [(m, 100 * m + i, rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(-1, 1)) for m in (1, 2) for i in range(60)] + [(1, 190, 1.0, 1.0, 0.0), (1, 191, 1.0, 1.0, 0.0)]
    faces = [(1, 1, 100, 101, 102), (2, 2, 200, 201, 202)]
    edges = {frozenset(e) for _, _, a, b, c in faces for e in ((a, b), (b, c), (c, a))}
    want = {(p[1], q[1]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and math.dist(p[2:], q[2:]) < 0.5 and frozenset((p[1], q[1])) not in edges}
    got = M.near_pairs(spark.createDataFrame(rows, VERTEX), spark.createDataFrame(faces, FACE), 0.5).collect()
    assert {(r.v0, r.v1) for r in got} == want and len(got) == len(want)


def area(points, tris):
    return sum(abs(np.cross(points[b] - points[a], points[c] - points[a])[2]) / 2 for a, b, c in tris)


def test_polygons_with_holes_and_corners():
    at = lambda xs: np.array([(x, y, 0.0) for x, y in xs], float)
    star = at([((3 if k % 2 else 9) * math.cos(k * math.pi / 7), (3 if k % 2 else 9) * math.sin(k * math.pi / 7)) for k in range(14)])
    hole, island = at([(1, 1), (-1, 1), (-1, -1), (1, -1)]), at([(.5, .5), (.5, -.5), (-.5, -.5), (-.5, .5)])
    points = np.concatenate([star, hole, island])
    rings = [np.arange(14), np.arange(14, 18), np.arange(18, 22)]
    shoelace = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(star, np.roll(star, -1, axis=0)))) / 2
    assert area(points, P.triangulate(points, rings)) == pytest.approx(shoelace - 4 + 1)
    assert area(points, P.triangulate(points, rings[:1])) == pytest.approx(shoelace)
    comb = at([(0, 0), *[(x, y) for k in range(6) for x, y in ((k, 5), (k + .5, 1))], (6, 0)])
    want = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(comb, np.roll(comb, -1, axis=0)))) / 2
    tris = P.triangulate(comb, [np.arange(len(comb))])
    assert area(comb, tris) == pytest.approx(want) and len(tris) == len(comb) - 2
    touching = at([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1)])  # one ring that meets itself in a corner
    assert area(touching, P.triangulate(touching, [np.arange(6)])) == pytest.approx(2)


def test_polygon_rows_in_any_plane(spark):
    square = [(7, 0, k, 70 + k, 0.0, float(x), float(y)) for k, (x, y) in enumerate(((0, 0), (4, 0), (4, 4), (0, 4)))]
    inner = [(7, 1, k, 80 + k, 0.0, float(x), float(y)) for k, (x, y) in enumerate(((1, 1), (2, 1), (2, 2)))]
    rows = spark.createDataFrame(square + inner + [(8, 0, 0, 1, 0.0, 0.0, 0.0), (8, 0, 1, 2, 1.0, 0.0, 0.0)], "polygon_id long, ring int, place int, vertex_id long, x double, y double, z double")
    tris = P.triangulated(rows).collect()
    at = {r[3]: np.array(r[4:]) for r in square + inner}
    turns = [np.cross(at[t.v1] - at[t.v0], at[t.v2] - at[t.v0])[0] for t in tris]
    assert {t.polygon_id for t in tris} == {7} and sum(turns) / 2 == pytest.approx(16 - 0.5) and min(turns) > 0
    assert P.triangulated(rows.limit(0)).count() == 0


def plain_curve(points, samples):
    p = [np.array(x, float) for x in points]
    p = [2 * p[0] - p[1], *p, 2 * p[-1] - p[-2]]
    out = []
    for k in range(1, len(p) - 2):
        t = [0.0]
        for a, b in zip(p[k - 1:k + 2], p[k:k + 3]):
            t.append(t[-1] + math.sqrt(np.linalg.norm(b - a)))
        for step in range(samples):
            now = t[1] + (t[2] - t[1]) * step / samples
            mix = lambda a, b, ta, tb: a if tb <= ta else a + (now - ta) / (tb - ta) * (b - a)
            a = [mix(p[k - 1 + i], p[k + i], t[i], t[i + 1]) for i in range(3)]
            b = [mix(a[i], a[i + 1], t[i], t[i + 2]) for i in range(2)]
            out.append(mix(b[0], b[1], t[1], t[2]))
    return [*out, p[-2]]


CONTROL = "curve_id long, place int, x double, y double, z double"


def test_smooth_curves(spark):
    rng = random.Random(8)
    points = [tuple(rng.uniform(-3, 3) for _ in range(3)) for _ in range(7)]
    points.insert(3, points[3])  # two control points in one place
    rows = spark.createDataFrame([(1, k, *p) for k, p in enumerate(points)] + [(2, 0, 1.0, 2.0, 3.0)], CONTROL)
    got = U.smooth_curve(rows, 5).orderBy("curve_id", "place", "step").collect()
    assert np.allclose([(r.x, r.y, r.z) for r in got if r.curve_id == 1], plain_curve(points, 5))
    assert [(r.x, r.y, r.z) for r in got if r.curve_id == 2] == [(1.0, 2.0, 3.0)]
    ring = spark.createDataFrame([(1, k, math.cos(k * math.pi / 4), math.sin(k * math.pi / 4), 0.0) for k in range(8)], CONTROL)
    loop = U.smooth_curve(ring, 6, closed=True).collect()
    assert len(loop) == 48 and all(abs(math.hypot(r.x, r.y) - 1) < 0.02 for r in loop)


def test_curves_on_a_sheet(spark):
    vertices, faces = sheet(6)
    flat = [(m, i, x, y, 0.0) for m, i, x, y, _ in vertices]
    placed = M.with_corners(spark.createDataFrame(flat, VERTEX), spark.createDataFrame(faces, FACE))
    controls = spark.createDataFrame([(1, 0, 0.5, 0.5, 1.0), (1, 1, 2.0, 4.0, -1.0), (1, 2, 5.5, 5.0, 2.0)], CONTROL)
    laid = U.surface_curve(controls, placed, 4, 1.0)
    rows = laid.orderBy("place", "step").collect()
    assert np.allclose([(r.x, r.y) for r in rows], [p[:2] for p in plain_curve([(0.5, 0.5, 1.0), (2.0, 4.0, -1.0), (5.5, 5.0, 2.0)], 4)]) and all(r.z == 0 for r in rows)
    curve = laid.select("curve_id", (F.col("place") * 4 + F.col("step")).alias("place"), "x", "y", "z")
    length = lambda df: (lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:])))([(r.x, r.y, r.z) for r in df.orderBy("place").collect()])
    smooth = U.smooth_on_surface(curve, placed, 4, 1.0)
    ends = smooth.orderBy("place").collect()
    assert math.dist((0.5, 0.5), (5.5, 5.0)) <= length(smooth) < length(curve)
    assert (ends[0].x, ends[0].y, ends[-1].x, ends[-1].y) == (0.5, 0.5, 5.5, 5.0)


def test_groups_come_whole_and_many_at_a_call(spark):
    keys = [k for k in range(40) for _ in range(1 + (k * 7) % 11)]
    plain = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # groups begin and end inside batches, and some are longer than one
    try:
        df = spark.createDataFrame([(k, 1) for k in keys], "k long, n long")
        rows = by_groups(df, "k", lambda t: pa.table({"k": t["k"], "n": t["n"], "calls": pa.array([len(set(t["k"].to_pylist()))] * t.num_rows)}).group_by("k").aggregate(
            [("n", "sum"), ("calls", "max")]).rename_columns(["k", "n", "groups"]), "k long, n long, groups long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", plain)
    assert sorted((r.k, r.n) for r in rows) == sorted(collections.Counter(keys).items())
    assert max(r.groups for r in rows) > 1
    assert by_groups(df.limit(0), "k", lambda t: t, "k long, n long").count() == 0


def test_points_are_sent_to_few_cells_of_faces(spark, monkeypatch):
    sizes, plain = [], M.K.cell
    monkeypatch.setattr(M.K, "cell", lambda c, size: sizes.append(size) or plain(c, size))
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0)], "mesh_id long, vertex_id long, x double, y double, z double")
    placed = M.with_corners(v, spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, face_id long, v0 long, v1 long, v2 long"))
    points = spark.createDataFrame([(0, 0.2, 0.2, -0.5), (1, 9.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert sorted((r.point_id, r.distance) for r in M.closest_on_surface(points, placed, 1.0).collect()) == [(0, 0.5), (1, 8.0)]
    assert min(sizes) == 4.0  # a box of twice the reach touches at most two such cells along an axis


def test_a_rim_with_a_missing_place_is_left_open_and_a_mesh_without_a_name_is_filled(spark):
    vertices, faces = sheet(9, {(2, 2), (6, 6)})
    vertices = [(*v[:4], None) if v[1] == 202 else v for v in vertices]
    faces = [(None, *f[1:]) for f in faces]
    new = R.hole_faces(spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(faces, FACE), 12).collect()
    assert len(new) == 2 and {r.mesh_id for r in new} == {None}
    assert {v for r in new for v in (r.v0, r.v1, r.v2)} == {606, 607, 706, 707}
