"""Small fixtures against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import clustering as C, components as CC, mesh as M, neighbors as N, outliers as O, volume as W
from pointweave.plans.commands import Catalog, Stages, StageFailed, run_command
from pointweave.sources import ply, tables, volumes
from pointweave.streaming import frames as S

RNG = np.random.default_rng(5)


def cloud(spark, p):
    return spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "point_id long, x double, y double, z double")


def roots(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(int(a)), find(int(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_knn_with_copies_clusters_and_far_point(spark):
    p = RNG.random((300, 3))
    p[:100] = p[0]
    p[100:200] = p[100] + RNG.random((100, 3)) * 1e-6
    p[299] = [40, 40, 40]
    got = {}
    for row in N.knn(cloud(spark, p), 6).collect():
        got.setdefault(row.point_id, {})[row["rank"]] = row.n_id
    d = ((p[:, None] - p[None]) ** 2)
    d = d[..., 0] + d[..., 1] + d[..., 2]
    want = np.lexsort((np.broadcast_to(np.arange(300), (300, 300)), d), axis=1)[:, :6]
    assert all([got[i][j + 1] for j in range(6)] == list(want[i]) for i in range(300))


def test_hot_cells_are_split_without_losing_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_ROWS", 10)
    p = np.concatenate([RNG.random((80, 3)) * 0.1, RNG.random((60, 3))])
    got = {(r.point_id, r.n_id) for r in N.radius_pairs(cloud(spark, p), 0.2).select("point_id", "n_id").collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {tuple(map(int, ij)) for ij in np.argwhere(d <= 0.2)}


def test_euclidean_labels_refine_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIR_WORK", 16)
    p = np.concatenate([RNG.random((120, 3)) * 0.01, RNG.random((120, 3)) * 0.01 + [0.1, 0, 0], RNG.random((60, 3))])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for eps in (0.0925, 0.1):
        got = {r.point_id: r.label for r in C.euclidean_labels(cloud(spark, p), eps).collect()}
        assert [got[i] for i in range(len(p))] == roots(len(p), np.argwhere(np.triu(d <= eps, 1)))


def test_components_of_long_chains_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(CC, "CHUNK", 5)
    order = RNG.permutation(120)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(119) if i % 40 != 39]
    nodes = spark.range(120).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in CC.components(nodes, spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert [got[i] for i in range(120)] == roots(120, edges)


def test_plane_outliers_are_those_of_a_plane_fitted_by_brute_force(spark):
    rng = np.random.default_rng(21)
    flat = np.column_stack([rng.random((200, 2)), np.zeros(200)])
    p = np.concatenate([flat, [[0.5, 0.5, 0.3], [0.3, 0.6, -0.3]]])
    order = np.argsort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1, kind="stable")[:, :20]
    away = []
    for i, near in enumerate(order):
        centred = p[near] - p[near].mean(axis=0)
        normal = np.linalg.eigh(centred.T @ centred)[1][:, 0]
        away.append(abs(normal @ (p[i] - p[near].mean(axis=0))))
    got = {r.point_id: r for r in O.plane_fit(cloud(spark, p), 20, 0.085).collect()}
    assert np.allclose([got[i].plane_distance for i in range(len(p))], away, atol=1e-9)
    assert {i for i, r in got.items() if r.is_outlier} == {i for i, d in enumerate(away) if d > 0.085}
    mask = {r.point_id for r in O.radius_mask(cloud(spark, p), 0.25, 5).where("is_outlier").collect()}
    assert mask == {r.point_id for r in O.radius(cloud(spark, p), 0.25, 5).where("is_outlier").collect()} == {200, 201}


def test_empty_and_tiny_clouds(spark):
    none = cloud(spark, np.zeros((1, 3))).limit(0)
    assert N.knn(none, 3).count() == 0
    assert N.knn(cloud(spark, RNG.random((2, 3))), 5).count() == 4
    assert O.plane_fit(cloud(spark, RNG.random((2, 3))), 30).where("is_outlier").count() == 2


def test_box_mesh_is_watertight_and_has_no_rim(spark):
    size = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "mesh_id long, x0 double, y0 double, z0 double, sx double, sy double, sz double")
    v, f = tables.boxes(size)
    row = M.diagnostics(v, f).first()
    assert row.watertight and abs(row.volume - 6.0) < 1e-12 and row.edges == 18
    opened = f.where("face_id != 12")
    order = sorted((r.position, r.vertex_id) for r in M.loop_order(M.boundary_loops(opened)).collect())
    assert [p for p, _ in order] == [0, 1, 2]


def test_closest_point_and_paths_on_a_box(spark):
    size = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "mesh_id long, x0 double, y0 double, z0 double, sx double, sy double, sz double")
    v, f = tables.boxes(size)
    p = RNG.random((20, 3)) * 3 - 1
    got = {r.point_id: r.distance for r in M.closest_on_surface(cloud(spark, p), M.with_corners(v, f), 0.5).collect()}
    gap = np.maximum(np.maximum(-p, p - 1), 0)
    want = np.where((gap == 0).all(1), np.minimum(p, 1 - p).min(1), np.linalg.norm(gap, axis=1))
    assert np.allclose([got[i] for i in range(20)], want)
    far = {r.vertex_id: r.distance for r in M.shortest_paths(v, f, v.where("vertex_id = 0")).collect()}
    assert len(far) == 8 and abs(far[1] - 1.0) < 1e-12


def test_ply_and_stl_round_trip(spark, tmp_path):
    p = cloud(spark, RNG.random((50, 3)))
    ply.write_points(p, str(tmp_path / "cloud"))
    back = ply.read_points(spark, str(tmp_path / "cloud"))
    assert back.count() == 50
    assert abs(back.agg(F.sum("x")).first()[0] - p.agg(F.sum("x")).first()[0]) < 1e-9
    size = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "mesh_id long, x0 double, y0 double, z0 double, sx double, sy double, sz double")
    ply.write_stl(M.with_corners(*tables.boxes(size)).coalesce(1), str(tmp_path / "box"))
    v, f = ply.weld_stl(ply.read_stl(spark, str(tmp_path / "box")))
    assert v.count() == 8 and M.diagnostics(v, f).first().watertight


def test_stream_equals_batch_and_snapshot_round_trip(spark, tmp_path):
    p = RNG.random((90, 3))
    rows = [(i % 3, i, 0, *map(float, q), 0.0, 0.0, 1.0, 0.5, 0.5, -3.0, i, i, i) for i, q in enumerate(p)]
    schema = "frame_id long, u long, v long, x double, y double, z double, nx double, ny double, nz double, cx double, cy double, cz double, r int, g int, b int"
    frames = spark.createDataFrame(rows, schema)
    for k in (2, 0, 1):
        frames.where(F.col("frame_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    stream = S.read_frames(spark, str(tmp_path / "frames"), frames.schema)
    q = S.append_sums(stream, str(tmp_path / "sums"), str(tmp_path / "ck"), 0.2)
    q.processAllAvailable()
    q.stop()
    streamed = S.current_volume(spark, str(tmp_path / "sums"))
    batch = W.directional_merge(None, W.directional_sums(frames, 0.2))
    key = ["vx", "vy", "vz", "dir"]
    both = streamed.join(batch.withColumnRenamed("value", "v2"), key)
    assert both.count() == streamed.count() == batch.count()
    assert both.where(F.abs(F.col("value") - F.col("v2")) > 1e-9).count() == 0
    volumes.save(batch, str(tmp_path / "snap"))
    assert volumes.load(spark, str(tmp_path / "snap")).count() == batch.count()
    with pytest.raises(ValueError):
        volumes.save(batch.drop("weight"), str(tmp_path / "bad"))


def test_commands_and_stages(spark):
    catalog = Catalog()
    number = catalog.add(cloud(spark, np.concatenate([RNG.random((40, 3)) * 0.1, [[9, 9, 9]]])), "c")
    run_command(catalog, '{"Command": "PerformROR", "PointCloudID": 0, "Radius": 0.3, "MinNeighborsInRadius": 3, "DeletePoints": true}')
    assert catalog.get(number).count() == 40
    with pytest.raises(TypeError):
        run_command(catalog, '{"Command": "PerformROR", "PointCloudID": 0, "Radius": "wide"}')
    with pytest.raises(KeyError):
        run_command(catalog, '{"Command": "PerformROR", "PointCloudID": 7}')
    stages = Stages().then("keep", lambda d: d.where("x >= 0")).check("none above 1", lambda d: d.where("x > 1"))
    assert stages.run(catalog.get(number)).count() == 40
    with pytest.raises(StageFailed):
        Stages().check("never", lambda d: d).run(catalog.get(number))


def test_nearest_points_beside_strays(spark):
    import random

    rng = random.Random(12)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 1), rng.gauss(-3, 0.1)) for i in range(400)]
    rows += [(900, 1e30, 0.0, 0.0), (901, 1e30, 1e28, 0.0), (902, -4e25, 3.0, 1e9), (903, 50.0, 0.0, 1e12)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    got = {}
    for r in N.knn(df, 5).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.n_id))
    for i, *p in rows:
        want = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, *q in rows)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_normal_deviation_of_copies_and_repeated_ids_is_that_of_all_pairs(spark, monkeypatch):
    p = np.round(RNG.random((60, 3)) * 2, 1)
    n = RNG.normal(size=(60, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    ids = list(range(60))
    p[10:30], n[10:30] = p[10], n[10]
    ids[40], ids[41], ids[12] = 0, 0, 11
    rows = [(i, *map(float, a), *map(float, b)) for i, a, b in zip(ids, p, n)] + [(None, *map(float, p[0]), *map(float, n[0]))]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    met, plain = [], N.radius_pairs

    def counted(points, *args, **options):
        met.append(points.count())
        return plain(points, *args, **options)

    monkeypatch.setattr(O, "radius_pairs", counted)
    got = {r.point_id: r.deviation for r in O.normal_deviation(df, 0.52).where("point_id is not null").collect()}
    assert met == [41]  # classes, not rows
    near = np.linalg.norm(p[:, None] - p[None], axis=2) <= 0.52
    angle = np.degrees(np.arccos(np.clip(n @ n.T, -1, 1)))
    for i in set(ids):
        found = [angle[a, b] for a in range(60) for b in range(60) if ids[a] == i and ids[b] != i and near[a, b]]
        assert got[i] == pytest.approx(np.mean(found) if found else 0.0, abs=1e-5)


def test_corners_of_exploded_meshes_are_not_broadcast(spark):
    sizes = spark.range(3).selectExpr("id mesh_id", "id * 3.0D x0", "0.0D y0", "0.0D z0", "1.0D sx", "2.0D sy", "3.0D sz")
    placed = M.with_corners(*tables.boxes(sizes))
    assert placed.count() == 36
    assert "Broadcast" not in placed._jdf.queryExecution().sparkPlan().toString()


def test_supplier_meshes_are_made_once(spark, tmp_path):
    rows = [(s, float(q), d / 100, 9970.0 * (q + d)) for s in (1, 2) for q in range(1, 4) for d in range(3)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    vertices, faces = tables.supplier_meshes(spark, str(tmp_path))
    assert vertices.count() == 18 and faces.count() == 16
    assert not any("lineitem" in f for df in (vertices, faces) for f in df.inputFiles())
