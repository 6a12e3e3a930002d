"""Projections, filters, aggregates and set operations over the order-line points."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import functions as F

from pointweave.functions import boxes as B, color, keys as K, matrix as M, triangles as T, vector as V
from pointweave.operators import aggregates as A, clustering as C, filters as P, outliers as O
from pointweave.operators.sites import XYZ
from pointweave.sources.tables import embedding_points, lineitem_points
from queries.registry import EMB, LI, big, lit, query, r, tidy



def pos():
    return V.vec("x", "y", "z")


def nrm():
    return V.vec("nx", "ny", "nz")


TURN = M.translate(1.5, -2.0, 0.25) @ np.array([[0.6, -0.8, 0, 0], [0.8, 0.6, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]])
ROWS = [[float(v) for v in row] for row in TURN]


def affine(i):
    a = ROWS[i]
    return f"({lit(a[0])}*x + {lit(a[1])}*y + {lit(a[2])}*z + {lit(a[3])})"


def cell(v, size):
    return big(f"FLOOR({v} / {lit(size)})")


@query("f1_point_transform", f"WITH {LI} SELECT point_id, {r(affine(0))} AS tx, {r(affine(1))} AS ty, {r(affine(2))} AS tz FROM li")
def f1(spark, sf):
    t = M.transform_point(TURN, pos())
    return tidy(lineitem_points(spark, sf).select("point_id", *[c.alias(n) for c, n in zip(t, ("tx", "ty", "tz"))]))


@query("f2_normal_transform", f"""WITH {LI} SELECT point_id, {r(f"{lit(0.6)}*nx - {lit(0.8)}*ny")} AS tx,
 {r(f"{lit(0.8)}*nx + {lit(0.6)}*ny")} AS ty, {r('nz')} AS tz FROM li""")
def f2(spark, sf):
    t = M.transform_normal(TURN, nrm())
    return tidy(lineitem_points(spark, sf).select("point_id", *[c.alias(n) for c, n in zip(t, ("tx", "ty", "tz"))]))


PROJ = M.perspective(1.0, 1.5, 1.0, 200.0)
F0, F1_, F2_, F3_ = (lit(float(v)) for v in (PROJ[0, 0], PROJ[1, 1], PROJ[2, 2], PROJ[2, 3]))


@query("f3_projection", f"""WITH {LI} SELECT point_id, {r(f'{F0}*x / -(z+1)')} AS sx, {r(f'{F1_}*y / -(z+1)')} AS sy,
 {r(f'({F2_}*(z+1) + {F3_}) / -(z+1)')} AS sz FROM li""")
def f3(spark, sf):
    t = M.project_point(PROJ, (F.col("x"), F.col("y"), F.col("z") + 1.0))
    return tidy(lineitem_points(spark, sf).select("point_id", *[c.alias(n) for c, n in zip(t, ("sx", "sy", "sz"))]))


@query("f4_vector_algebra", f"""WITH {LI} SELECT point_id, {r('x*nx+y*ny+z*nz')} AS dot, {r('y*nz-z*ny')} AS cx, {r('z*nx-x*nz')} AS cy,
 {r('x*ny-y*nx')} AS cz, {r('SQRT(x*x+y*y+z*z)')} AS size, {r('(x-nx)*(x-nx)+(y-ny)*(y-ny)+(z-nz)*(z-nz)')} AS d2 FROM li""")
def f4(spark, sf):
    c = V.cross(pos(), nrm())
    return tidy(lineitem_points(spark, sf).select(
        "point_id", V.dot(pos(), nrm()).alias("dot"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"),
        V.length(pos()).alias("size"), V.distance2(pos(), nrm()).alias("d2")))


@query("f5_matrix_algebra", f"""WITH {LI}, m AS (SELECT point_id, x+1 AS a, nx AS b, ny AS c, y+2 AS d, nz AS e, z+3 AS f FROM li)
SELECT point_id, {r('a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c)')} AS det, {r('a+d+f')} AS trace,
 {r('(d*f-e*e) / (a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c))')} AS inv00 FROM m""")
def f5(spark, sf):
    m = [[F.col("x") + 1.0, F.col("nx"), F.col("ny")], [F.col("nx"), F.col("y") + 2.0, F.col("nz")], [F.col("ny"), F.col("nz"), F.col("z") + 3.0]]
    return tidy(lineitem_points(spark, sf).select(
        "point_id", M.det(m).alias("det"), M.trace(m).alias("trace"), M.inverse(m)[0][0].alias("inv00")))


@query("f8_cell_index", f"WITH {LI} SELECT point_id, {cell('x', 0.3)} AS gx, {cell('(y - 50)', 0.3)} AS gy, {cell('z', 0.3)} AS gz FROM li")
def f8(spark, sf):
    g = K.cells(pos(), 0.3, (0.0, 50.0, 0.0))
    return lineitem_points(spark, sf).select("point_id", *[c.alias(n) for c, n in zip(g, ("gx", "gy", "gz"))])


def spread_sql(v):
    return "(" + " | ".join(f"((({v}) & {1 << i}) << {2 * i})" for i in range(21)) + ")"


CELLS = f"c AS (SELECT point_id, {cell('(x - 25)', 0.3)} AS gx, {cell('(y - 50)', 0.3)} AS gy, {cell('z', 0.3)} AS gz FROM li)"


@query("f9_packed_key", f"WITH {LI}, {CELLS} SELECT point_id, ((gx & 2097151) << 42) | ((gy & 2097151) << 21) | (gz & 2097151) AS key FROM c")
def f9(spark, sf):
    return lineitem_points(spark, sf).select("point_id", K.pack21(*K.cells(pos(), 0.3, (25.0, 50.0, 0.0))).alias("key"))


@query("f10_morton_key", f"""WITH {LI}, c AS (SELECT point_id, {cell('x', 0.3)} AS gx, {cell('y', 0.3)} AS gy, {cell('z', 0.3)} AS gz FROM li)
SELECT point_id, {spread_sql('gx')} | ({spread_sql('gy')} << 1) | ({spread_sql('gz')} << 2) AS key FROM c""")
def f10(spark, sf):
    return lineitem_points(spark, sf).select("point_id", K.morton(*K.cells(pos(), 0.3)).alias("key"))


@query("f11_signed_morton_key", f"""WITH {LI}, {CELLS}
SELECT point_id, {spread_sql('gx + 1048576')} | ({spread_sql('gy + 1048576')} << 1) | ({spread_sql('gz + 1048576')} << 2) AS key FROM c""")
def f11(spark, sf):
    return lineitem_points(spark, sf).select("point_id", K.morton_signed(*K.cells(pos(), 0.3, (25.0, 50.0, 0.0))).alias("key"))


@query("f10_morton_decode", f"WITH {LI} SELECT point_id, {cell('x', 0.3)} AS gx, {cell('y', 0.3)} AS gy, {cell('z', 0.3)} AS gz FROM li")
def f10_decode(spark, sf):
    key = K.morton(*K.cells(pos(), 0.3))
    return lineitem_points(spark, sf).select("point_id", key.alias("key")).select(
        "point_id", *[c.cast("long").alias(g) for c, g in zip(K.unmorton(F.col("key")), ("gx", "gy", "gz"))])


@query("f11_signed_morton_decode", f"WITH {LI}, {CELLS} SELECT point_id, gx, gy, gz FROM c")
def f11_decode(spark, sf):
    key = K.morton_signed(*K.cells(pos(), 0.3, (25.0, 50.0, 0.0)))
    return lineitem_points(spark, sf).select("point_id", key.alias("key")).select(
        "point_id", *[c.cast("long").alias(g) for c, g in zip(K.unmorton_signed(F.col("key")), ("gx", "gy", "gz"))])


@query("f12_spatial_hash", f"""WITH {LI}, {CELLS}, m AS (SELECT point_id, (gx*73856093) & 4294967295 AS a, (gy*19349663) & 4294967295 AS b, (gz*83492791) & 4294967295 AS c FROM c),
s AS (SELECT point_id, xor(xor(CASE WHEN a >= 2147483648 THEN a - 4294967296 ELSE a END, CASE WHEN b >= 2147483648 THEN b - 4294967296 ELSE b END),
 CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END) AS h FROM m)
SELECT point_id, ((h % 1000000) + 1000000) % 1000000 AS bucket FROM s""")
def f12(spark, sf):
    return lineitem_points(spark, sf).select("point_id", K.spatial_hash(*K.cells(pos(), 0.3, (25.0, 50.0, 0.0))).alias("bucket"))


@query("f13_tsdf_quantize", f"""WITH {LI}, q AS (SELECT point_id, {big('TRUNC(GREATEST(CAST(-1 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), nx)) * CAST(32767 AS DOUBLE))')} AS q FROM li)
SELECT point_id, q, {r('q / CAST(32767 AS DOUBLE)')} AS back FROM q""")
def f13(spark, sf):
    q = lineitem_points(spark, sf).select("point_id", K.tsdf_to_short(F.col("nx")).alias("q"))
    return tidy(q.withColumn("back", K.short_to_tsdf(F.col("q"))))


@query("f14_valid_points", f"WITH {LI} SELECT point_id, x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AS valid FROM li")
def f14(spark, sf):
    return lineitem_points(spark, sf).select("point_id", V.is_valid(F.col("x"), F.col("y"), F.col("z")).alias("valid"))


@query("f15_box_algebra", f"""WITH {LI}, b AS (SELECT cloud_id, MIN(x) AS ax, MAX(x) AS bx, MIN(y) AS ay, MAX(y) AS by_, MIN(z) AS az, MAX(z) AS bz FROM li GROUP BY cloud_id)
SELECT cloud_id, {r('(bx-ax)*(by_-ay)*(bz-az)')} AS volume, {r('(ax+bx)*CAST(0.5 AS DOUBLE)')} AS mid_x, ax <= 10 AND bx >= 10 AND ay <= 20 AND by_ >= 20 AND az <= 3 AND bz >= 3 AS holds,
 {r('GREATEST(ax-60, 60-bx, 0)*GREATEST(ax-60, 60-bx, 0) + GREATEST(ay-20, 20-by_, 0)*GREATEST(ay-20, 20-by_, 0) + GREATEST(az-3, 3-bz, 0)*GREATEST(az-3, 3-bz, 0)')} AS d2,
 ax <= 70 AND bx >= 50 AND ay <= 10 AND by_ >= 0 AND az <= 1 AND bz >= 0 AS meets FROM b""")
def f15(spark, sf):
    b = A.bounding_box(lineitem_points(spark, sf), ["cloud_id"])
    box = B.Box.named()
    return tidy(b.select("cloud_id", box.volume().alias("volume"), box.center()[0].alias("mid_x"),
                         box.contains(V.vec(10, 20, 3)).alias("holds"), box.distance2(V.vec(60, 20, 3)).alias("d2"),
                         box.intersects(B.Box.literal((50, 0, 0), (70, 10, 1))).alias("meets")))


@query("f16_ray_tests", f"""WITH {LI}, s AS (SELECT point_id, x, y, z, x*{lit(0.6)} + y*{lit(0.8)} AS tca, x*x+y*y+z*z AS l2 FROM li)
SELECT point_id, CASE WHEN tca >= 0 AND l2 - tca*tca <= 25 THEN {r('tca - SQRT(25 - (l2 - tca*tca))')} END AS sphere,
 {r(f'(x + y + z) / {lit(0.6 + 0.8)}')} AS plane FROM s""")
def f16(spark, sf):
    o, d = V.vec(0, 0, 0), V.vec(0.6, 0.8, 0.0)
    return tidy(lineitem_points(spark, sf).select(
        "point_id", B.ray_sphere(o, d, pos(), 5.0).alias("sphere"), B.ray_plane(o, d, V.vec(1, 1, 1), pos()).alias("plane")))


SEG = "GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), ((x-10)*30 + (y-20)*40 + (z-2)*5) / CAST(2525 AS DOUBLE)))"


@query("f17_segment_distance", f"""WITH {LI}, t AS (SELECT *, {SEG} AS t FROM li)
SELECT point_id, {r('SQRT((x-10-30*t)*(x-10-30*t) + (y-20-40*t)*(y-20-40*t) + (z-2-5*t)*(z-2-5*t))')} AS away FROM t""")
def f17(spark, sf):
    away = T.point_segment_distance(pos(), V.vec(10, 20, 2), V.vec(40, 60, 7))
    return tidy(lineitem_points(spark, sf).select("point_id", away.alias("away")))


@query("f18_point_on_segment", f"""WITH {LI}, t AS (SELECT *, {SEG} AS t FROM li)
SELECT point_id, SQRT((x-10-30*t)*(x-10-30*t) + (y-20-40*t)*(y-20-40*t) + (z-2-5*t)*(z-2-5*t)) <= 3 AS near FROM t""")
def f18(spark, sf):
    return lineitem_points(spark, sf).select("point_id", T.point_on_segment(pos(), V.vec(10, 20, 2), V.vec(40, 60, 7), 3.0).alias("near"))


@query("f19_orientation", f"""WITH {LI}, f AS (SELECT *, SQRT(nx*nx + ny*ny) AS flat FROM li)
SELECT point_id, {r('CASE WHEN flat > CAST(1e-4 AS DOUBLE) THEN -ny/flat ELSE 1 END', 5)} AS ax, {r('CASE WHEN flat > CAST(1e-4 AS DOUBLE) THEN nx/flat ELSE 0 END', 5)} AS ay,
 {r("CASE WHEN flat > CAST(1e-4 AS DOUBLE) THEN ACOS(GREATEST(-1, LEAST(1, nz))) WHEN nz < CAST(-0.9 AS DOUBLE) THEN PI() ELSE 0 END", 5)} AS angle FROM f""")
def f19(spark, sf):
    ax, ay, _, angle = color.orientation(F.col("nx"), F.col("ny"), F.col("nz"))
    return tidy(lineitem_points(spark, sf).select("point_id", ax.alias("ax"), ay.alias("ay"), angle.alias("angle")), 5)


@query("f20_unit_colors", f"WITH {LI} SELECT point_id, {r('r / CAST(255 AS DOUBLE)')} AS cr, {r('g / CAST(255 AS DOUBLE)')} AS cg, {r('b / CAST(255 AS DOUBLE)')} AS cb FROM li")
def f20(spark, sf):
    return tidy(lineitem_points(spark, sf).select("point_id", *[color.unit_from_byte(F.col(c)).alias(f"c{c}") for c in "rgb"]))


@query("f21_transfer_function", f"""WITH {LI}, t AS (SELECT point_id, x / CAST(50 AS DOUBLE) AS v FROM li)
SELECT point_id, {r('CASE WHEN v <= 0.5 THEN 0 ELSE (v - 0.5) / 0.5 END')} AS cr, {r('CASE WHEN v <= 0.5 THEN v / 0.5 ELSE 1 - (v - 0.5) / 0.5 END')} AS cg,
 {r('CASE WHEN v <= 0.5 THEN 1 - v / 0.5 ELSE 0 END')} AS cb FROM t""")
def f21(spark, sf):
    mapped = color.transfer(F.col("x") / 50.0, color.HEAT)
    return tidy(lineitem_points(spark, sf).select("point_id", *[m.alias(n) for m, n in zip(mapped, ("cr", "cg", "cb"))]))


@query("f22_normal_angle", f"WITH {LI} SELECT point_id, {r('DEGREES(ACOS(GREATEST(-1, LEAST(1, nx*0.6 + ny*0.8))))', 5)} AS angle FROM li")
def f22(spark, sf):
    return tidy(lineitem_points(spark, sf).select("point_id", V.angle_degrees(nrm(), V.vec(0.6, 0.8, 0.0)).alias("angle")), 5)


@query("f23_quantize", f"WITH {LI} SELECT point_id, {big(f'FLOOR(y / {lit(0.25)} + {lit(0.5)})')} AS qy FROM li")
def f23(spark, sf):
    return lineitem_points(spark, sf).select("point_id", K.quantize(F.col("y"), 0.25).alias("qy"))


# Filters -----------------------------------------------------------------------------------

INSIDE = f"{affine(0)} BETWEEN -40 AND 10 AND {affine(1)} BETWEEN 20 AND 60 AND {affine(2)} BETWEEN 2 AND 7"
LOW, HIGH = (-40.0, 20.0, 2.0), (10.0, 60.0, 7.0)


@query("p1_box_filter", f"WITH {LI} SELECT point_id, label FROM li WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 50 AND z BETWEEN 2 AND 6")
def p1(spark, sf):
    return P.within_box(lineitem_points(spark, sf), (10, 20, 2), (30, 50, 6)).select("point_id", "label")


@query("p2_posed_box_filter", f"WITH {LI} SELECT point_id FROM li WHERE {INSIDE}")
def p2(spark, sf):
    return P.within_posed_box(lineitem_points(spark, sf), TURN, LOW, HIGH).select("point_id")


@query("p3_mask_then_compact", f"WITH {LI} SELECT point_id FROM li WHERE {INSIDE}")
def p3(spark, sf):
    return P.drop_invalid(P.mask_outside(lineitem_points(spark, sf), TURN, LOW, HIGH)).select("point_id")


@query("p4_drop_invalid", f"WITH {LI} SELECT point_id FROM li WHERE x >= 5")
def p4(spark, sf):
    holed = lineitem_points(spark, sf).withColumn("x", F.when(F.col("x") >= 5, F.col("x")))
    return P.drop_invalid(holed).select("point_id")


@query("p5_living_points", f"WITH {LI} SELECT point_id FROM li WHERE z < 5")
def p5(spark, sf):
    return P.living(P.set_alive(lineitem_points(spark, sf), F.col("z") < 5)).select("point_id")


@query("p6_range_guard", f"WITH {LI} SELECT point_id FROM li WHERE ABS(x) <= 40 AND ABS(y) <= 40 AND ABS(z) <= 40")
def p6(spark, sf):
    return P.range_guard(lineitem_points(spark, sf), 40.0).select("point_id")


@query("p7_upper_guard", f"WITH {LI} SELECT point_id FROM li WHERE x <= 20")
def p7(spark, sf):
    return P.upper_guard(lineitem_points(spark, sf), 20.0).select("point_id")


@query("p8_crop_around_centre", f"""WITH {LI}, o AS (SELECT (MIN(x)+MAX(x))*0.5 AS cx, (MIN(y)+MAX(y))*0.5 AS cy, (MIN(z)+MAX(z))*0.5 AS cz FROM li WHERE cloud_id = 1)
SELECT point_id FROM li, o WHERE x BETWEEN cx-20 AND cx+20 AND y BETWEEN cy-20 AND cy+20 AND z BETWEEN cz-20 AND cz+20""")
def p8(spark, sf):
    p = lineitem_points(spark, sf)
    return P.around_centre(p, p.where("cloud_id = 1")).select("point_id")


@query("p10_delete_outliers", f"WITH {LI} SELECT point_id FROM li WHERE y <= 80")
def p10(spark, sf):
    p = lineitem_points(spark, sf)
    return P.drop_outliers(p, p.select("point_id", (F.col("y") > 80).alias("is_outlier"))).select("point_id")


@query("p11_size_limits", f"""WITH {LI} SELECT point_id, CASE WHEN COUNT(*) OVER (PARTITION BY big) BETWEEN 500 AND 100000 THEN big END AS label
 FROM (SELECT point_id, l_ AS big FROM (SELECT point_id, CAST(FLOOR(y / 5) AS BIGINT) AS l_ FROM li))""")
def p11(spark, sf):
    labels = lineitem_points(spark, sf).select("point_id", K.cell(F.col("y"), 5.0).alias("label"))
    return C.limit_sizes(labels, 500, 100000).select("point_id", "label")


FRUSTUM = dict(position=(25.0, 50.0, -20.0), forward=(0.2, 0.1, 1.0), near=1.0, far=28.0)


def frustum_sql(size):
    tests = []
    for n, offset in P.frustum_planes(**FRUSTUM):
        terms = [f"(g{a} + 0.5) * {lit(size)} * {lit(float(c))} + {lit(size / 2 * abs(float(c)))}" for a, c in zip("xyz", n)]
        tests.append(f"{lit(float(offset))} + " + " + ".join(terms) + " >= 0")
    return f"""WITH {LI}, b AS (SELECT DISTINCT {cell('x', size)} AS gx, {cell('y', size)} AS gy, {cell('z', size)} AS gz FROM li)
SELECT gx, gy, gz FROM b WHERE """ + " AND ".join(tests)


@query("p15_frustum_blocks", frustum_sql(2.0))
def p15(spark, sf):
    blocks = C.occupied(lineitem_points(spark, sf), 2.0)
    return P.frustum_blocks(blocks, 2.0, **FRUSTUM)


# Aggregates --------------------------------------------------------------------------------

ENDS = ", ".join(f"{f.upper()}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz")
ENDS_R = ", ".join(f"{r(f'{f.upper()}({c})')} AS {f}_{c}" for f in ("min", "max") for c in "xyz")


@query("a1_bounding_box", f"WITH {LI} SELECT {ENDS_R} FROM li")
def a1(spark, sf):
    return tidy(A.bounding_box(lineitem_points(spark, sf)))


@query("a3_mean_and_deviation", f"WITH {LI} SELECT {r('AVG(y)')} AS mean, {r('SQRT(GREATEST(AVG(y*y) - AVG(y)*AVG(y), 0))')} AS deviation FROM li")
def a3(spark, sf):
    return tidy(A.mean_and_spread(lineitem_points(spark, sf), "y"))


def rounded(*names):
    return ", ".join(f"{r(n)} AS {n}" for n in names)


@query("a4_voxel_downsample", f"""WITH {LI}, lo AS (SELECT MIN(x) AS lx, MIN(y) AS ly, MIN(z) AS lz FROM li),
s AS (SELECT {big('FLOOR((x-lx) * 0.4)')} AS gx, {big('FLOOR((y-ly) * 0.4)')} AS gy, {big('FLOOR((z-lz) * 0.4)')} AS gz, COUNT(*) AS n, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z,
 SUM(nx) AS nx, SUM(ny) AS ny, SUM(nz) AS nz, {big('LEAST(FLOOR(AVG(r)), 255)')} AS r, {big('LEAST(FLOOR(AVG(g)), 255)')} AS g, {big('LEAST(FLOOR(AVG(b)), 255)')} AS b FROM li, lo GROUP BY 1, 2, 3),
l AS (SELECT *, SQRT(nx*nx+ny*ny+nz*nz) AS len FROM s)
SELECT gx, gy, gz, n, {rounded('x', 'y', 'z')}, {r('nx/len')} AS nx, {r('ny/len')} AS ny, {r('nz/len')} AS nz, r, g, b FROM l""".replace("0.4)", f"({lit(1.0)} / {lit(2.5)}))"))
def a4(spark, sf):
    return tidy(A.voxel_downsample(lineitem_points(spark, sf), 2.5))


def merge_sql(size, where="TRUE", having="TRUE"):
    means = ", ".join(f"{r(f'AVG({c})')} AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b"))
    return f"""WITH {LI}, c AS (SELECT *, {cell('x', size)} AS gx, {cell('y', size)} AS gy, {cell('z', size)} AS gz FROM li WHERE {where})
SELECT gx, gy, gz, COUNT(*) AS n, {means} FROM c GROUP BY gx, gy, gz HAVING {having}"""


@query("a5_merge_clouds", merge_sql(2.0))
def a5(spark, sf):
    return tidy(A.merge_clouds(lineitem_points(spark, sf), 2.0))


@query("a6_merge_clouds_in_box", merge_sql(2.0, "x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 50 AND z BETWEEN 2 AND 6"))
def a6(spark, sf):
    return tidy(A.merge_clouds(lineitem_points(spark, sf), 2.0, box=((10, 20, 2), (30, 50, 6))))


@query("a7_merge_clouds_guarded", merge_sql(2.0, "ABS(x) <= 60 AND ABS(y) <= 60 AND ABS(z) <= 60"))
def a7(spark, sf):
    return tidy(A.merge_clouds(lineitem_points(spark, sf), 2.0, limit=60.0))


@query("a8_sharded_merge", merge_sql(0.5))
def a8(spark, sf):
    return tidy(A.merge_clouds(lineitem_points(spark, sf), 0.5))


@query("a9_label_counts", f"""WITH {LI}, l AS (SELECT label * 3 AS label FROM li), e AS (SELECT CAST(UNNEST(RANGE(0, (SELECT MAX(label) FROM l) + 1)) AS BIGINT) AS label)
SELECT e.label, COUNT(l.label) AS count FROM e LEFT JOIN l ON e.label = l.label GROUP BY e.label""")
def a9(spark, sf):
    return A.label_counts(lineitem_points(spark, sf).select((F.col("label") * 3).alias("label")))


@query("a10_occupied_cells", f"WITH {LI} SELECT COUNT(*) AS cells FROM (SELECT DISTINCT {cell('x', 0.7)}, {cell('y', 0.7)}, {cell('z', 0.7)} FROM li)")
def a10(spark, sf):
    return A.occupied_cells(lineitem_points(spark, sf), 0.7)


@query("a11_cell_statistics", f"""WITH {LI}, c AS (SELECT *, {cell('x', 5.0)} AS gx, {cell('y', 5.0)} AS gy, {cell('z', 5.0)} AS gz FROM li)
SELECT gx, gy, gz, COUNT(*) AS n, {ENDS_R}, {r('AVG(x)')} AS mx, {r('AVG(y)')} AS my, {r('AVG(z)')} AS mz, {r('AVG(nx)')} AS mean_nx, {r('COVAR_POP(x, y)', 5)} AS c_xy FROM c GROUP BY gx, gy, gz""")
def a11(spark, sf):
    s = A.cell_statistics(lineitem_points(spark, sf), 5.0)
    s = s.select("gx", "gy", "gz", "n", *[f"{f}_{c}" for f in ("min", "max") for c in "xyz"], "mx", "my", "mz", "mean_nx",
                 (F.round("c_xy", 5) + 0.0).alias("c_xy"))
    return tidy(s)


@query("a12_weld_cells", f"""WITH {LI} SELECT point_id AS vertex_id, MIN(point_id) OVER (PARTITION BY {cell('x', 1.5)}, {cell('y', 1.5)}, {cell('z', 1.5)}) AS welded_id FROM li""")
def a12(spark, sf):
    return A.weld_exact(lineitem_points(spark, sf).withColumnRenamed("point_id", "vertex_id"), 1.5)


@query("a16_depth_raster", f"WITH {LI} SELECT {cell('x', 1.5)} AS ix, {cell('y', 1.5)} AS iy, {r('MIN(z)')} AS depth FROM li GROUP BY 1, 2")
def a16(spark, sf):
    return tidy(A.depth_raster(lineitem_points(spark, sf), 1.5))


@query("a17_weighted_covariance", f"""WITH {LI}, m AS (SELECT cloud_id, SUM(g) AS w, SUM(g*x)/SUM(g) AS mx, SUM(g*y)/SUM(g) AS my FROM li GROUP BY cloud_id)
SELECT cloud_id, {r('ANY_VALUE(w) / CAST(1 AS DOUBLE)', 3)} AS w, {r('SUM(g*(x-mx)*(x-mx)) / ANY_VALUE(w)', 3)} AS c_xx, {r('SUM(g*(x-mx)*(y-my)) / ANY_VALUE(w)', 3)} AS c_xy FROM li JOIN m USING (cloud_id) GROUP BY cloud_id""")
def a17(spark, sf):
    c = A.weighted_covariance(lineitem_points(spark, sf), ["cloud_id"], F.col("g"))
    return tidy(c.select("cloud_id", F.col("w").cast("double").alias("w"), (F.col("c_xx") / F.col("w")).alias("c_xx"),
                         (F.col("c_xy") / F.col("w")).alias("c_xy")), 3)


@query("a18_value_range", f"WITH {LI} SELECT {r('MIN(y)')} AS low, {r('MAX(y)')} AS high FROM li")
def a18(spark, sf):
    return tidy(A.value_range(lineitem_points(spark, sf), "y"))


@query("a19_surfels", f"""WITH {LI}, s AS (SELECT {cell('x', 1.2)} AS gx, {cell('y', 1.2)} AS gy, {cell('z', 1.2)} AS gz, COUNT(*) AS n, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z,
 SUM(nx) AS nx, SUM(ny) AS ny, SUM(nz) AS nz FROM li GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2), l AS (SELECT *, SQRT(nx*nx+ny*ny+nz*nz) AS len FROM s)
SELECT gx, gy, gz, n, {rounded('x', 'y', 'z')}, {r('nx/len', 5)} AS nx, {r('ny/len', 5)} AS ny, {r('nz/len', 5)} AS nz FROM l""")
def a19(spark, sf):
    s = A.surfels(lineitem_points(spark, sf), 1.2)
    return tidy(s.withColumns({c: F.round(c, 5) for c in ("nx", "ny", "nz")}))


@query("j16_missing_neighbors", f"""WITH {LI}, v AS (SELECT DISTINCT {cell('x', 3.0)} AS gx, {cell('y', 3.0)} AS gy, {cell('z', 3.0)} AS gz FROM li),
n AS (SELECT gx, gy, gz, 1 AS one FROM v) SELECT v.gx, v.gy, v.gz FROM v LEFT JOIN n a ON a.gx=v.gx+1 AND a.gy=v.gy AND a.gz=v.gz LEFT JOIN n b ON b.gx=v.gx-1 AND b.gy=v.gy AND b.gz=v.gz
 LEFT JOIN n c ON c.gx=v.gx AND c.gy=v.gy+1 AND c.gz=v.gz LEFT JOIN n d ON d.gx=v.gx AND d.gy=v.gy-1 AND d.gz=v.gz
 LEFT JOIN n e ON e.gx=v.gx AND e.gy=v.gy AND e.gz=v.gz+1 LEFT JOIN n f ON f.gx=v.gx AND f.gy=v.gy AND f.gz=v.gz-1
 WHERE a.one IS NOT NULL AND b.one IS NOT NULL AND c.one IS NOT NULL AND d.one IS NOT NULL AND e.one IS NOT NULL AND f.one IS NOT NULL""")
def j16(spark, sf):
    return C.erode(C.occupied(lineitem_points(spark, sf), 3.0))


@query("j17_near_voxels", f"""WITH {LI}, v AS (SELECT DISTINCT {cell('x', 3.0)} AS gx, {cell('y', 3.0)} AS gy, {cell('z', 3.0)} AS gz FROM li WHERE x < 10 AND y < 30)
SELECT point_id FROM li WHERE EXISTS (SELECT 1 FROM v WHERE ABS({cell('li.x', 3.0)}-gx) <= 1 AND ABS({cell('li.y', 3.0)}-gy) <= 1 AND ABS({cell('li.z', 3.0)}-gz) <= 1)""")
def j17(spark, sf):
    p = lineitem_points(spark, sf)
    return C.near_voxels(p, C.occupied(p.where("x < 10 AND y < 30"), 3.0), 3.0, 1).select("point_id")


@query("j18_depth_lookup", f"""WITH {LI}, d AS (SELECT {cell('x', 1.5)} AS ix, {cell('y', 1.5)} AS iy, MIN(z) AS depth FROM li WHERE cloud_id = 2 GROUP BY 1, 2)
SELECT point_id, {r('depth')} AS depth FROM li LEFT JOIN d ON {cell('x', 1.5)} = ix AND {cell('y', 1.5)} = iy""")
def j18(spark, sf):
    p = lineitem_points(spark, sf)
    return tidy(A.depth_lookup(p, A.depth_raster(p.where("cloud_id = 2"), 1.5), 1.5).select("point_id", "depth"))


@query("v16_occupancy_map", f"""WITH {LI}, p AS (SELECT DISTINCT {cell('x', 1.0)} AS ix, {cell('y', 1.0)} AS iy FROM li)
SELECT ix, iy FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.ix=p.ix+1 AND q.iy=p.iy) AND EXISTS (SELECT 1 FROM p q WHERE q.ix=p.ix-1 AND q.iy=p.iy)
 AND EXISTS (SELECT 1 FROM p q WHERE q.ix=p.ix AND q.iy=p.iy+1) AND EXISTS (SELECT 1 FROM p q WHERE q.ix=p.ix AND q.iy=p.iy-1)""")
def v16(spark, sf):
    r_ = A.depth_raster(lineitem_points(spark, sf), 1.0)
    return A.erode_pixels(r_.select("ix", "iy"))


@query("o1_sorted_cells", f"""WITH {LI} SELECT ROW_NUMBER() OVER (ORDER BY {cell('x', 2.0)}, {cell('y', 2.0)}, {cell('z', 2.0)}, point_id) - 1 AS rank, point_id FROM li""")
def o1(spark, sf):
    placed = lineitem_points(spark, sf).select("point_id", *[K.cell(F.col(c), 2.0).alias(g) for c, g in zip(XYZ, ("gx", "gy", "gz"))])
    return C.dense_numbers(placed, ["gx", "gy", "gz", "point_id"], "rank").select("rank", "point_id")


# Set operations ----------------------------------------------------------------------------


def masks(spark, sf):
    p = lineitem_points(spark, sf)
    return p.select("point_id", (F.col("x") > 25).alias("is_outlier")), p.select("point_id", (F.col("y") > 50).alias("is_outlier"))


for _name, _op, _sql in (("u1_mask_union", "Union", "x > 25 OR y > 50"), ("u2_mask_intersection", "Intersection", "x > 25 AND y > 50"),
                         ("u3_mask_subtraction", "Subtraction", "x > 25 AND NOT y > 50")):
    query(_name, f"WITH {LI} SELECT point_id, {_sql} AS is_outlier FROM li")(
        lambda spark, sf, op=_op: A.combine_masks(*masks(spark, sf), op))


@query("u4_concatenate", f"""WITH {LI} SELECT point_id, cloud_id, CASE WHEN cloud_id = 1 THEN label ELSE 0 END AS label, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM li""")
def u4(spark, sf):
    p = lineitem_points(spark, sf)
    columns = ["point_id", "cloud_id", "label", *XYZ]
    clouds = [p.where(F.col("cloud_id") == k).select(*columns) for k in range(1, 8)]  # order lines are numbered 1 to 7
    return tidy(functools.reduce(A.concatenate, clouds))


@query("u5_distinct_voxels", f"WITH {LI} SELECT DISTINCT {cell('x', 3.0)} AS gx, {cell('y', 3.0)} AS gy, {cell('z', 3.0)} AS gz FROM li")
def u5(spark, sf):
    return C.occupied(lineitem_points(spark, sf), 3.0)
