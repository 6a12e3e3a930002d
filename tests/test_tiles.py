"""Tiles, chunks of pixels and links of faces against brute force on rows of their own."""

import math

import numpy as np
import pytest

from pointweave.operators import components as CC, mesh as M, neighbors as N, outliers as O, tiles as T, volume as W
from pointweave.sources import tables

SCHEMA = "point_id long, x double, y double, z double"


def cloud(spark, p, first=0):
    return spark.createDataFrame([(first + i, *map(float, q)) for i, q in enumerate(p)], SCHEMA)


def lumps(seed, n=400):
    rng = np.random.default_rng(seed)
    p = np.round(np.concatenate([rng.random((n // 2, 3)) * 0.1, rng.random((n - n // 2, 3)) * [1, 1, 0]]), 3)
    p[5:40] = p[5]
    return p


def d2_of(p, q):
    d = (q[None] - p[:, None]) ** 2
    return d[..., 0] + d[..., 1] + d[..., 2]


def test_nearest_of_many_small_tiles_and_of_queries_between_them(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 30)
    p, far = lumps(3), np.random.default_rng(4).random((90, 3)) * 3 - 1
    for queries, found in ((p, N.knn(cloud(spark, p), 5)), (far, N.knn(cloud(spark, p), 5, cloud(spark, far, 1000)))):
        got = {(r.point_id % 1000, r["rank"]): r.n_id for r in found.collect()}
        want = np.lexsort((np.broadcast_to(np.arange(len(p)), (len(queries), len(p))), d2_of(queries, p)), axis=1)[:, :5]
        assert got == {(i, j + 1): want[i, j] for i in range(len(queries)) for j in range(5)}


def test_queries_between_points_do_not_meet_them_all(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 50)
    asked, plain = [], T.Tiles.meet

    def counted(self, queries, run, schema):
        asked.append(queries.count())
        return plain(self, queries, run, schema)

    monkeypatch.setattr(T.Tiles, "meet", counted)
    p = np.random.default_rng(8).random((600, 3))
    rows = N.closest_point(cloud(spark, p), cloud(spark, np.random.default_rng(9).random((40, 3)), 5000)).collect()
    assert len(rows) == 40 and asked[0] == 40 and asked[1] < 40 * 6  # of twelve tiles and more


def test_sums_over_balls_dealt_over_small_tiles_are_those_of_all_pairs(spark, monkeypatch):
    p = lumps(6)
    d2 = d2_of(p, p)
    for small in (False, True):
        if small:
            monkeypatch.setattr(T, "ASKED", 20)
            monkeypatch.setattr(T, "FOUND", 70)
        assert {r.point_id: r.density for r in N.local_density(cloud(spark, p), 0.05).collect()} == dict(enumerate((d2 <= 0.05 * 0.05).sum(axis=1)))
    got = {r.point_id: r.kde for r in N.kernel_density(cloud(spark, p), 0.3, 0.1).collect()}
    want = np.where(d2 <= 0.3 * 0.3, np.exp(-d2 / (0.1 * 0.1)), 0).sum(axis=1)
    assert np.allclose([got[i] for i in range(len(p))], want)


def test_leaves_that_lie_within_a_ball_are_not_compared():
    compared = []

    def part(x, y, n, d2, inside):
        compared.append(d2.size)
        return T.counted(x, y, n, d2, inside)

    p = np.random.default_rng(2).random((4000, 3)) * [1, 0, 0]
    got = T._swept(p, p, np.ones(len(p)), 0.25, False, True, part, 1)
    assert np.array_equal(got[:, 0], (np.abs(p[:, :1] - p[:, 0]) <= 0.5).sum(axis=1)) and sum(compared) < len(p) ** 2 / 8


def pixels(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        normal = rng.normal(size=3)
        rows.append((int(rng.integers(3)), i, int(rng.integers(4)), *map(float, rng.random(3) * 0.2 + [0, 0, 1]), *map(float, normal), 0.0, 0.0, 0.0, i % 7, 1, 2))
    rows.append(rows[3])
    schema = "frame_id long, u long, v long, x double, y double, z double, nx double, ny double, nz double, cx double, cy double, cz double, r int, g int, b int"
    return spark.createDataFrame(rows, schema)


def plain_blend(samples):
    held = {}
    for r in sorted(samples.collect(), key=lambda r: (r.frame_id, r.v, r.u, r.i)):
        value, count = held.get((r.vx, r.vy, r.vz), (0.0, 0))
        share = r.factor / (min(count, W.CAP) + 1.0)
        held[r.vx, r.vy, r.vz] = value * (1 - share) + r.s * share if count else r.s * share, count + 1
    return held


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_chunks_of_pixels_blend_as_samples_one_by_one(spark, monkeypatch, chunk):
    frames = pixels(spark, 150).repartition(3)
    monkeypatch.setattr(W, "CHUNK", chunk)
    for blend, samples in ((W.integrate_rays, W.ray_samples), (W.integrate_normals, W.normal_samples)):
        got = {(r.vx, r.vy, r.vz): (r.value, r.weight) for r in blend(frames, 0.4).collect()}
        want = plain_blend(samples(frames, 0.4))
        assert max(n for _, n in want.values()) > W.CAP + 1 and got.keys() == want.keys()
        for key, (value, weight) in got.items():
            assert weight == want[key][1] and value == pytest.approx(want[key][0], abs=1e-9)


def test_samples_do_not_leave_the_tasks_that_make_them(spark):
    found = W._blended(pixels(spark, 20), 0.1, W.ray_arrays, [*W.XYZ, *W.CAMERA])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


def test_directional_sums_are_those_of_the_samples(spark):
    frames = pixels(spark, 120, 5)
    got = {(r.vx, r.vy, r.vz, r.dir): (r.sum_wd, r.sum_w) for r in W.directional_sums(frames, 0.1).collect()}
    want = {}
    for r in W.normal_samples(frames, 0.1).where("not (s < -0.5 and view_dot > 0)").collect():
        for d, axis in enumerate(W.DIRECTIONS):
            dot = sum(a * b for a, b in zip(axis, (r.nx, r.ny, r.nz)))
            if dot > W.DIRECTION_THRESHOLD:
                a, b = want.get((r.vx, r.vy, r.vz, d), (0.0, 0.0))
                want[r.vx, r.vy, r.vz, d] = a + dot * r.factor * r.s, b + dot * r.factor
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_faces_of_crowded_edges_and_far_ids_are_one_patch(spark, monkeypatch):
    monkeypatch.setattr(CC, "NEAR_BITS", 1)
    faces = [(1, i, 0, 1, 10 + i) for i in range(5)] + [(1, 50 + i, 100 + i, 101 + i, 102 + i) for i in range(20)] + [(1, 99, 7, 8, 7), (1, 7000, 120, 121, 500)]
    got = {r.face_id: r.patch for r in M.face_components(spark.createDataFrame(faces, "mesh_id long, face_id long, v0 long, v1 long, v2 long")).collect()}
    assert got == {**{i: 0 for i in range(5)}, **{50 + i: 50 for i in range(20)}, 99: 99, 7000: 50}


def test_near_vertices_are_sent_to_few_cells(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random((150, 3)) * 4 - 2, 2)
    p[3], p[9] = p[2], [0.0, 0.0, 0.0]
    vertices = spark.createDataFrame([(i % 2, i, *map(float, q)) for i, q in enumerate(p)], "mesh_id long, vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 0, 2, 4)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    found = M.near_pairs(vertices, faces, 0.7)
    got = sorted((r.v0, r.v1) for r in found.collect())
    want = [(i, j) for i in range(150) for j in range(i + 1, 150) if i % 2 == j % 2 and math.sqrt(((p[i] - p[j]) ** 2).sum()) < 0.7 and {i, j} - {0, 2, 4}]
    assert got == want


def test_faces_are_met_in_a_merge_join(spark):
    """A hash table of all faces of a cell range does not fit a task's memory; sorted rows may be spilled."""
    points = spark.createDataFrame([(0, 0.2, 0.2, -1.0)], SCHEMA)
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0)], "mesh_id long, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, face_id long, v0 long, v1 long, v2 long")
    hits = M.ray_hits(points, M.with_corners(v, f))
    assert [(r.face_id, r.t) for r in hits.collect()] == [(0, 1.0)]
    assert "ShuffledHashJoin" not in hits._jdf.queryExecution().sparkPlan().toString()


def test_order_lines_of_large_keys_have_ids_of_their_own(spark, tmp_path):
    large = 53_999_999  # of a table 360 times as large as sf0.1
    keys = [(o, line, p, s) for o in (0, 11_529_213, 11_529_214, large - 1, large, 4_000_000_000) for line in (1, 7) for p, s in ((0, 0), (7_199_999, 359_999), (7_199_999, 3))]
    keys += [(large, 3, None, 1), (large, 3, 1, None), (None, 3, 1, 1), (large, None, 1, 1)]
    rows = spark.createDataFrame([(*k, 1.0, 1.0, 0.05, 0.02) for k in keys], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r)[:4]: r.id for r in rows.withColumn("id", tables.line_id()).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "id").collect()}
    fold = {k: ((k[0] * 8 + k[1]) * 10_000_000 + k[2]) * 10_000 + k[3] for k in keys[:36]}
    assert all(got[k] == fold[k] if fold[k] < 2 ** 63 else got[k] < 0 for k in fold) and len({got[k] for k in fold}) == 36
    assert all(got[k] is None for k in keys[36:])
    assert sorted(r.point_id for r in tables.lineitem_points(spark, str(tmp_path)).select("point_id").where("point_id is not null").collect()) == sorted(got[k] for k in fold)
