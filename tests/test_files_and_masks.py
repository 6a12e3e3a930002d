"""Files read together, masks over invalid points, rims and fans that meet in a vertex."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import aggregates as A, filters as P, mesh as M, outliers as O, volume as W
from pointweave.plans.commands import Catalog, run_command
from pointweave.sources import ply, tables, volumes

HEAD = "ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\n"


def write_mesh(path, corners, faces, color=200):
    lines = [f"{x} {y} {z} {color} 0 255" for x, y, z in corners]
    head = HEAD.format(n=len(corners)) + f"element face {len(faces)}\nproperty uchar flags\nproperty list uchar int vertex_indices\nend_header\n"
    path.write_text(head + "\n".join(lines + [f"7 {len(f)} " + " ".join(map(str, f)) for f in faces]) + "\n")


def test_two_files_polygons_and_byte_colors(spark, tmp_path):
    square = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    write_mesh(tmp_path / "p0.ply", square, [(0, 1, 2, 3)])
    write_mesh(tmp_path / "p1.ply", [(x, y, 5) for x, y, _ in square], [(0, 1, 2), (0, 2, 3)], color=17)
    v, f = ply.read_mesh(spark, str(tmp_path))
    assert v.select("vertex_id").distinct().count() == 8 and f.select("face_id").distinct().count() == 4
    shape = {r.mesh_id: r for r in M.measures(M.with_corners(v, f), ["mesh_id"]).collect()}
    assert shape["p0.ply"].area == shape["p1.ply"].area == 1.0
    assert {r.az for r in M.with_corners(v, f).where("mesh_id = 'p1.ply'").collect()} == {5.0}
    points = ply.read_points(spark, str(tmp_path))
    assert {r.r for r in points.collect()} == {200.0, 17.0} and {r.a for r in points.collect()} == {255.0}
    ply.write_points(points, str(tmp_path / "out"))
    again = ply.read_points(spark, str(tmp_path / "out"))
    assert again.select("point_id").distinct().count() == 8 and {r.r for r in again.collect()} == {200.0, 17.0}
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("._")]


def test_stl_files_share_no_id(spark, tmp_path):
    size = "mesh_id long, x0 double, y0 double, z0 double, sx double, sy double, sz double"
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 0.0, 2.0, 1.0, 1.0)], size)
    ply.write_stl(M.with_corners(*tables.boxes(boxes)).repartition(2, "mesh_id"), str(tmp_path / "two"))
    v, f = ply.weld_stl(ply.read_stl(spark, str(tmp_path / "two")))
    assert f.count() == f.select("face_id").distinct().count() == 24
    assert v.count() == v.select("vertex_id").distinct().count()


def test_masks_have_a_row_for_every_point(spark):
    rng = np.random.default_rng(11)
    rows = [(i, *map(float, p), 0.0, 0.0, 1.0) for i, p in enumerate(rng.random((50, 3)))] + [(50, None, 1.0, 1.0, 0.0, 0.0, 1.0), (51, float("nan"), 1.0, 1.0, 0.0, 0.0, 1.0)]
    cloud = spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    masks = [O.statistical(cloud, 5), O.radius(cloud, 0.3, 3), O.radius_mask(cloud, 0.3, 3), O.plane_fit(cloud, 5), O.curvature(cloud, 5),
             O.normal_deviation(cloud, 0.3)]
    for mask in masks:
        assert sorted(r.point_id for r in mask.collect()) == list(range(52))
    assert A.combine_masks(masks[1], masks[5], "Union").count() == 52
    assert masks[1].where("point_id >= 50 and is_outlier").count() == 2


def test_composite_filter_knows_its_four_steps(spark):
    rng = np.random.default_rng(12)
    rows = [(i, *map(float, p), *map(float, q / np.linalg.norm(q))) for i, (p, q) in enumerate(zip(rng.random((60, 3)) * 0.3, rng.normal(size=(60, 3))))]
    cloud = spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")
    catalog = Catalog()
    number = catalog.add(cloud, "c")
    steps = {"SOR Filter": O.statistical(cloud, 50, 1.0), "ROR Filter": O.radius(cloud, 0.5, 5), "Curvature Analysis": O.curvature(cloud, 30, 0.1),
             "Normal Deviation Analysis": O.normal_deviation(cloud, 0.1, 30.0)}
    bad = lambda df: {r.point_id for r in df.where("is_outlier").collect()}
    for name, mask in steps.items():
        got = run_command(catalog, json.dumps({"Command": "PerformCompositeFilter", "PointCloudID": number, "Pipeline": [{"Operation": "Union", "FilterType": name}]}))
        assert bad(got) == bad(mask)
    run_command(catalog, '{"Command": "RenamePointCloud", "PointCloudID": 0, "NewName": "d"}')
    assert catalog.names[number] == "d"
    run_command(catalog, '{"Command": "PerformNormalDeviationAnalysis", "PointCloudID": 0}')


def test_clouds_load_by_command(spark, tmp_path):
    write_mesh(tmp_path / "a.ply", [(0, 0, 0), (1, 0, 0)], [])
    catalog = Catalog()
    numbers = run_command(catalog, json.dumps({"Command": "LoadPointCloudFromPLY", "FileNames": [str(tmp_path / "a.ply")]}))
    assert numbers == [0] and catalog.names[0] == "a.ply" and catalog.get(0).count() == 2


def tetrahedra(spark, *apexes):
    """Tetrahedra that share vertex 0."""
    vertices, faces = [(0, 0, 0.0, 0.0, 0.0)], []
    for k, s in enumerate(apexes):
        a, b, c = 1 + 3 * k, 2 + 3 * k, 3 + 3 * k
        vertices += [(0, a, s, 0.0, 0.0), (0, b, 0.0, s, 0.0), (0, c, 0.0, 0.0, s)]
        faces += [(0, b, a), (0, a, c), (0, c, b), (a, b, c)]
    faces = [(0, i, *f) for i, f in enumerate(faces)]
    return (spark.createDataFrame(vertices, "mesh_id long, vertex_id long, x double, y double, z double"),
            spark.createDataFrame(faces, "mesh_id long, face_id long, v0 long, v1 long, v2 long"))


def test_closed_fans_that_meet_in_a_vertex_are_a_bow_tie(spark):
    row = M.diagnostics(*tetrahedra(spark, 1.0)).first()
    assert row.bow_tie == 0 and row.watertight
    row = M.diagnostics(*tetrahedra(spark, 1.0, -1.0)).first()
    assert row.bow_tie == 1 and not row.watertight


def test_duplicate_and_degenerate_faces_are_counted(spark):
    v, f = tetrahedra(spark, 1.0)
    more = spark.createDataFrame([(0, 10, 2, 0, 1), (0, 11, 1, 1, 2)], f.schema)
    checks = {r.check: r.n for r in M.validate(M.with_corners(v, f.unionByName(more))).collect()}
    assert checks["duplicate"] == 1 and checks["degenerate"] == 1 and checks["short_edges"] == 1 and checks["non_manifold"] >= 1


def test_rims_that_touch_stay_separate_loops(spark):
    v, f = tetrahedra(spark, 1.0, -1.0)
    opened = f.where("face_id % 4 != 0")  # one face of each tetrahedron away, both rims pass vertex 0
    loops = M.loop_order(M.boundary_loops(opened)).collect()
    by = {}
    for r in loops:
        by.setdefault(r.loop, []).append((r.position, r.vertex_id))
    assert sorted(sorted(x for _, x in places) for places in by.values()) == [[0, 1, 2], [0, 4, 5]]
    assert all(sorted(p for p, _ in places) == [0, 1, 2] for places in by.values())


def test_regions_of_a_snapshot_read_their_slabs_only(spark, tmp_path):
    rng = np.random.default_rng(13)
    rows = [(int(a), int(b), int(c), 0.5, 1) for a, b, c in np.unique(rng.integers(-300, 300, (500, 3)), axis=0)]
    volume = spark.createDataFrame(rows, "vx long, vy long, vz long, value double, weight long")
    volumes.save(volume, str(tmp_path / "snap"), span=4)
    low, high = (-3.0, -20.0, -20.0), (2.0, 20.0, 20.0)
    got = volumes.load_region(spark, str(tmp_path / "snap"), 0.1, low, high)
    want = W.within_region(volume, 0.1, low, high)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slab" in plan.split("PartitionFilters: [")[1].split("]")[0]


BOX = "mesh_id long, x0 double, y0 double, z0 double, sx double, sy double, sz double"


def test_points_of_a_box_are_told_apart_wherever_their_rays_run(spark):
    placed = M.with_corners(*tables.boxes(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], BOX)))
    grid = [(x / 4, y / 4, z / 4) for x in range(-1, 6) for y in range(-1, 6) for z in range(-1, 6)]
    rows = [(i, *map(float, p)) for i, p in enumerate(grid)] + [(9999, None, 0.5, 0.5)]
    cloud = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    got = {r.point_id: r.side for r in M.inside_mesh(cloud, placed).collect()}
    for i, p in enumerate(grid):
        depth = min(min(c, 1 - c) for c in p)
        assert got.get(i) == ("inside" if depth > 0 else "on" if depth == 0 else None), p
    assert 9999 not in got


def test_patches_are_classified_by_side(spark):
    solid = M.with_corners(*tables.boxes(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 4.0, 4.0, 4.0)], BOX)))
    boxes = [(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 9.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    v, f = tables.boxes(spark.createDataFrame(boxes, BOX))
    found = M.classify_patches(M.with_corners(v, f), M.face_components(f), solid)
    assert sorted(r.side for r in found.collect()) == ["inside", "outside"]
    faces = solid.select("mesh_id", "face_id", "v0", "v1", "v2").select("face_id", F.col("face_id").alias("patch"))
    assert {r.side for r in M.classify_patches(solid, faces, solid).collect()} == {"same"}
    turned = solid.select("mesh_id", "face_id", "v0", F.col("v2").alias("v1"), F.col("v1").alias("v2"), *[F.col(f"{n}{c}").alias(f"{m}{c}") for n, m in ("aa", "cb", "bc") for c in "xyz"])
    assert {r.side for r in M.classify_patches(turned, faces, solid).collect()} == {"opposite"}


@pytest.mark.parametrize("forward", [(0, 0, -1), (1, 2, 3), (0, 1, 0), (0, -5, 0.01)])
def test_frustum_holds_what_the_view_angles_allow(forward):
    planes = P.frustum_planes((1, 2, 3), forward, 0.5, 10.0)
    f = np.asarray(forward, float) / np.linalg.norm(forward)
    assert len(planes) == 6 and all(abs(np.linalg.norm(n) - 1) < 1e-12 for n, _ in planes)
    angles = sorted(np.pi / 2 - np.arccos(n @ f) for n, _ in planes[2:])
    assert np.allclose(angles, [0.393, 0.393, 0.523, 0.523])
    inside = lambda p: all(n @ p + o >= -1e-9 for n, o in planes)
    assert inside(np.array([1, 2, 3]) + f * 5) and not inside(np.array([1, 2, 3]) + f * 11) and not inside(np.array([1, 2, 3]) - f)
