"""Set algebra of boxes in every position to each other, sheets trimmed by boxes, and the triangulation of a face."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import exact as X, mesh as M, solids as S
from pointweave.sources.tables import boxes
from queries.solids import shape

BOX = "mesh_id long, x0 double, y0 double, z0 double, sx double, sy double, sz double"


def placed(spark, rows):
    return M.with_corners(*boxes(spark.createDataFrame(rows, BOX))).withColumn("job", F.col("mesh_id"))


def shapes(solids, operation):
    return {r.job: (r.volume, r.open_edges) for r in shape(solids.result(operation), "job").collect()}


def test_boxes_on_a_small_grid_in_all_positions(spark):
    rng = random.Random(4)
    pick = lambda: sorted(rng.sample(range(5), 2))
    cases = [[pick() for _ in range(6)] for _ in range(60)]
    cases += [[[0, 2]] * 6, [[0, 4]] * 3 + [[1, 2]] * 3, [[0, 1]] * 3 + [[2, 3]] * 3, [[0, 1]] * 3 + [[1, 2]] * 3, [[0, 2], [0, 2], [0, 2], [2, 4], [0, 2], [1, 3]]]
    row = lambda i, ends: (i, *[float(a) for a, _ in ends], *[float(b - a) for a, b in ends])
    solids = S.Solids(placed(spark, [row(i, c[:3]) for i, c in enumerate(cases)]), placed(spark, [row(i, c[3:]) for i, c in enumerate(cases)]), 2.0)
    got = {name: shapes(solids, name) for name in ("union", "intersection", "difference")}
    for i, c in enumerate(cases):
        volume = lambda ends: np.prod([b - a for a, b in ends])
        both = np.prod([max(0, min(p[1], q[1]) - max(p[0], q[0])) for p, q in zip(c[:3], c[3:])])
        for name, want in (("union", volume(c[:3]) + volume(c[3:]) - both), ("intersection", both), ("difference", volume(c[:3]) - both)):
            have = got[name].get(i, (0.0, 0))
            assert have[0] == pytest.approx(want, abs=1e-9) and have[1] == 0, (i, c, name, have, want)


def turned(df, angles):
    """The faces turned about the origin."""
    m = np.eye(3)
    for k, a in enumerate(angles):
        turn = np.eye(3)
        i, j = (k + 1) % 3, (k + 2) % 3
        turn[[i, i, j, j], [i, j, i, j]] = np.cos(a), -np.sin(a), np.sin(a), np.cos(a)
        m = turn @ m
    return df.withColumns({f"{n}{c}": sum(float(m[i, j]) * F.col(f"{n}{d}") for j, d in enumerate("xyz")) for i, c in enumerate("xyz") for n in "abc"}), m


def test_turned_boxes_and_their_loops(spark):
    left = placed(spark, [(1, -1.0, -1.0, -1.0, 2.0, 2.0, 2.0)])
    right, m = turned(placed(spark, [(1, -0.7, -1.3, -0.9, 2.1, 1.9, 2.2)]), (0.3, 0.7, 1.1))
    for crowd in (S.CROWD, 6):  # with few faces a face may meet both meshes are quartered first
        solids = S.Solids(left, right, 1.0, crowd=crowd)
        u, i, d = (shapes(solids, name)[1] for name in ("union", "intersection", "difference"))
        assert u[1] == i[1] == d[1] == 0
        assert u[0] + i[0] == pytest.approx(8 + 2.1 * 1.9 * 2.2) and d[0] + i[0] == pytest.approx(8)
        points = np.random.default_rng(0).uniform(-1, 1, (200_000, 3))
        inside = ((points @ m >= (-0.7, -1.3, -0.9)) & (points @ m <= (1.4, 0.6, 1.3))).all(axis=1).mean() * 8
        assert i[0] == pytest.approx(inside, rel=0.02)
        loops = solids.loops().collect()
        assert all(r.next is not None for r in loops)
        ends = {r.edge: (r.q, r.next) for r in loops}
        assert all(q == next(s.p for s in loops if s.edge == n) for q, n in ends.values())


def test_a_sheet_trimmed_along_and_across_its_edges(spark):
    n = 6
    vertices = [(1, i * 10 + j, float(i), float(j), 0.25 * ((i * j) % 3)) for i in range(n) for j in range(n)]
    faces = [f for i in range(n - 1) for j in range(n - 1) for v in [i * 10 + j] for f in ((1, v * 2, v, v + 10, v + 11), (1, v * 2 + 1, v, v + 11, v + 1))]
    sheet = M.with_corners(spark.createDataFrame(vertices, "mesh_id long, vertex_id long, x double, y double, z double"),
                           spark.createDataFrame(faces, "mesh_id long, face_id long, v0 long, v1 long, v2 long"))
    for x0, sx, inside in ((1.0, 2.0, 2 * 2.5), (1.5, 2.25, 2.25 * 2.5), (-1.0, 9.0, 5 * 2.5)):
        left, right = sheet.withColumn("job", F.lit(1)), placed(spark, [(1, x0, 0.5, -1.0, sx, 2.5, 3.0)]).withColumn("job", F.lit(1))
        solids = S.Solids(left, right, 2.0, open_left=True)
        shadow = lambda df: df.select(F.sum(((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2)).first()[0]
        assert shadow(solids.result("intersection")) == pytest.approx(inside) and shadow(solids.result("difference")) == pytest.approx(25 - inside)
        with pytest.raises(ValueError, match="union"):
            solids.result("union")


def test_empty_and_distant_operands(spark):
    one = placed(spark, [(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)])
    far = placed(spark, [(1, 9.0, 0.0, 0.0, 1.0, 1.0, 1.0)])
    assert shapes(S.Solids(one, far, 1.0), "union")[1] == (pytest.approx(2), 0)
    assert shapes(S.Solids(one, far.limit(0), 1.0), "difference")[1] == (pytest.approx(1), 0)
    assert shapes(S.Solids(one.limit(0), far, 1.0), "intersection") == {}
    assert S.Solids(one, far, 1.0).loops().count() == 0


def test_triangulations_keep_their_constraints_and_area():
    rng = random.Random(2)
    for _ in range(60):
        t = X.Triangulation([(0, 0), (X.GRID, 0), (0, X.GRID)])
        points = []
        for _ in range(rng.randint(1, 25)):
            x = rng.randrange(1, X.GRID - 1)
            points.append(t.insert((x, rng.randrange(1, X.GRID - x))))
        order = sorted(set(points), key=lambda n: t.at[n])
        chain = list(zip(order, order[1:]))  # by ascending x, so no two cross
        for a, b in chain:
            t.constrain(a, b)
        tris = t.triangles()
        assert sum(t.turn(*x) for x in tris) == X.GRID ** 2 and all(t.turn(*x) > 0 for x in tris)
        assert all((a, b) in t.apex or (b, a) in t.apex for a, b in chain)
        assert len(tris) == 2 * len(t.at) - 2 - 3


def test_pairs_of_small_meshes_are_held_whole_and_come_out_as_by_joins(spark, monkeypatch):
    rng = random.Random(9)
    at = lambda: [rng.choice((0.0, 0.25, 0.5, rng.random())) for _ in range(3)]
    rows = [[(i, *at(), 1.0, 1.0 + 0.1 * i, 1.5) for i in range(9)] for _ in "lr"]
    left, right = (placed(spark, r) for r in rows)
    right = right.withColumn("job", F.when(F.col("job") == 8, 7).otherwise(F.col("job")).cast("long")).where("job <> 4")  # two boxes, none, and a job of one side
    made, plain = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, key=None: made.append(df) or plain(df, key))

    def everything(pairs):
        monkeypatch.setattr(S, "PAIRS", pairs)
        made.clear()
        solids = S.Solids(left, right, 2.0)
        faces, seams = solids.refined
        parts = {(r.job, r.side, r.parent): round(r.area, 9) for r in faces.groupBy("job", "side", "parent").agg(F.sum(M.T.triangle_area(*M.corners())).alias("area")).collect()}
        assert faces.count() == faces.select("job", "face_id").distinct().count()
        loops = sorted(solids.loops().select("job", "p", "q", *[F.round(c, 9) for c in ("px", "py", "pz", "qx", "qy", "qz")]).collect())
        sizes = {name: {j: (round(v, 9), n) for j, (v, n) in shapes(solids, name).items()} for name in ("difference",)}
        return parts, sorted(seams.distinct().collect()), loops, sizes, len(made)

    whole, joined = (everything(pairs) for pairs in (1 << 18, 100))  # the job of one side is held whole in both
    assert whole[:4] == joined[:4]
    assert len(whole[0]) == 9 * 12 + 8 * 12 and len(whole[2]) > 20
    assert whole[4] <= 5 < joined[4]  # tables written: the operands, the list of large jobs, faces with and without places
