"""Mesh queries over one height field per supplier and one box per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.operators import mesh as M
from pointweave.sources.tables import lineitem_points, part_boxes, supplier_meshes
from queries.registry import LI, big, lit, query, r, tidy

SUP = f"""ln AS (SELECT l_suppkey AS mesh_id, {big('FLOOR(l_quantity)')} AS i, {big('FLOOR(l_discount * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE))')} AS j, l_extendedprice / CAST(9970 AS DOUBLE) AS h FROM lineitem),
grid AS (SELECT mesh_id, i, j, AVG(h) AS z FROM ln GROUP BY mesh_id, i, j),
vert AS (SELECT mesh_id, mesh_id*1000 + i*11 + j AS vertex_id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, z FROM grid),
sq AS (SELECT a.mesh_id, a.mesh_id*1000 + a.i*11 + a.j AS v FROM grid a JOIN grid b ON b.mesh_id=a.mesh_id AND b.i=a.i+1 AND b.j=a.j
 JOIN grid c ON c.mesh_id=a.mesh_id AND c.i=a.i AND c.j=a.j+1 JOIN grid d ON d.mesh_id=a.mesh_id AND d.i=a.i+1 AND d.j=a.j+1),
face AS (SELECT mesh_id, v*2 AS face_id, v AS v0, v+11 AS v1, v+12 AS v2 FROM sq UNION ALL SELECT mesh_id, v*2+1, v, v+12, v+1 FROM sq)"""
PLACED = """placed AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
 FROM face f JOIN vert a ON a.vertex_id = f.v0 JOIN vert b ON b.vertex_id = f.v1 JOIN vert c ON c.vertex_id = f.v2),
meas AS (SELECT *, 0.5*SQRT(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))*((by_-ay)*(cz-az)-(bz-az)*(cy-ay)) + ((bz-az)*(cx-ax)-(bx-ax)*(cz-az))*((bz-az)*(cx-ax)-(bx-ax)*(cz-az))
 + ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))*((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))) AS area,
 (ax*(by_*cz-bz*cy) + ay*(bz*cx-bx*cz) + az*(bx*cy-by_*cx)) / CAST(6 AS DOUBLE) AS vol FROM placed)"""
CORNERS = [n + c for n in "abc" for c in "xyz"]
HE = """he AS (SELECT mesh_id, face_id, v0 AS a, v1 AS b FROM face UNION ALL SELECT mesh_id, face_id, v1, v2 FROM face UNION ALL SELECT mesh_id, face_id, v2, v0 FROM face),
edge AS (SELECT mesh_id, LEAST(a, b) AS a, GREATEST(a, b) AS b, COUNT(*) AS valence FROM he GROUP BY 1, 2, 3)"""


@query("m1_face_corners", f"WITH {SUP}, {PLACED} SELECT face_id, " + ", ".join(f"{r('by_' if c == 'by' else c)} AS {c}_" for c in CORNERS) + " FROM placed")
def m1(spark, sf):
    return tidy(M.with_corners(*supplier_meshes(spark, sf)).select("face_id", *[F.col(c).alias(f"{c}_") for c in CORNERS]))


@query("a13_edge_valence", f"WITH {SUP}, {HE} SELECT * FROM edge")
def a13(spark, sf):
    return M.edge_valence(supplier_meshes(spark, sf)[1])


@query("a14_volume_and_area", f"WITH {SUP}, {PLACED} SELECT mesh_id, {r('SUM(vol)')} AS volume, {r('SUM(area)')} AS area FROM meas GROUP BY mesh_id")
def a14(spark, sf):
    return tidy(M.measures(M.with_corners(*supplier_meshes(spark, sf)), ["mesh_id"]))


@query("m7_boundary_edges", f"WITH {SUP}, {HE} SELECT h.mesh_id, h.a, h.b FROM he h JOIN edge e ON e.mesh_id = h.mesh_id AND e.a = LEAST(h.a, h.b) AND e.b = GREATEST(h.a, h.b) WHERE valence = 1")
def m7(spark, sf):
    return M.boundary_half_edges(supplier_meshes(spark, sf)[1]).select("mesh_id", "a", "b")


def walk(edges, nodes, node):
    """Smallest reachable id by recursion inside each mesh."""
    return f"""bw AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
walk(n, seen) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT w.n, e.b FROM walk w JOIN bw e ON e.a = w.seen),
lab AS (SELECT n, MIN(seen) AS root FROM walk GROUP BY n)"""


RIM = "rim AS (SELECT h.mesh_id, h.a, h.b FROM he h JOIN edge e ON e.mesh_id = h.mesh_id AND e.a = LEAST(h.a, h.b) AND e.b = GREATEST(h.a, h.b) WHERE valence = 1)"


# Half-edges with ids, successors found by turning through the faces around the end vertex, and loops by walking them.
LOOPS = f"""hs AS (SELECT mesh_id, face_id, 0 AS side, v0 AS a, v1 AS b FROM face UNION ALL SELECT mesh_id, face_id, 1, v1, v2 FROM face UNION ALL SELECT mesh_id, face_id, 2, v2, v0 FROM face),
h3 AS (SELECT mesh_id, face_id * 3 + side AS edge, face_id * 3 + (side + 1) % 3 AS onward, a, b FROM hs),
twin AS (SELECT p.edge, q.onward AS over FROM h3 p JOIN h3 q ON q.a = p.b AND q.b = p.a),
turn(edge, cur) AS (SELECT h3.edge, h3.onward FROM h3 WHERE edge NOT IN (SELECT edge FROM twin) UNION SELECT t.edge, w.over FROM turn t JOIN twin w ON w.edge = t.cur),
succ AS (SELECT t.edge, t.cur AS next FROM turn t WHERE t.cur NOT IN (SELECT edge FROM twin)),
round(edge, seen) AS (SELECT edge, next FROM succ UNION SELECT r.edge, s.next FROM round r JOIN succ s ON s.edge = r.seen),
loops AS (SELECT h3.mesh_id, MIN(seen) AS loop, h3.edge, h3.a, h3.b FROM round JOIN h3 USING (edge) GROUP BY 1, 3, 4, 5)"""


@query("x12_boundary_loops", f"WITH RECURSIVE {SUP}, {LOOPS} SELECT mesh_id, loop, edge, next, a, b FROM loops JOIN succ USING (edge)")
def x12(spark, sf):
    return M.boundary_loops(supplier_meshes(spark, sf)[1])


@query("a14_loop_perimeters", f"""WITH RECURSIVE {SUP}, {LOOPS}
SELECT rim.mesh_id, loop, COUNT(*) AS edges, {r('SUM(SQRT((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)))')} AS perimeter
 FROM loops rim JOIN vert p ON p.vertex_id = rim.a JOIN vert q ON q.vertex_id = rim.b GROUP BY 1, 2""")
def a14_loops(spark, sf):
    v, f = supplier_meshes(spark, sf)
    return tidy(M.loop_perimeters(M.boundary_loops(f), v))


@query("m7_loop_order", f"""WITH RECURSIVE {SUP}, {LOOPS}, place(loop, edge, position) AS (SELECT DISTINCT loop, loop, CAST(0 AS BIGINT) FROM loops
 UNION ALL SELECT p.loop, s.next, p.position + 1 FROM place p JOIN succ s ON s.edge = p.edge WHERE s.next <> p.loop)
SELECT p.loop, l.a AS vertex_id, p.position FROM place p JOIN loops l ON l.edge = p.edge""")
def m7_order(spark, sf):
    return M.loop_order(M.boundary_loops(supplier_meshes(spark, sf)[1]))


ADJ = """nb AS (SELECT DISTINCT p.face_id AS a, q.face_id AS b FROM he p JOIN he q ON LEAST(p.a, p.b) = LEAST(q.a, q.b)
 AND GREATEST(p.a, p.b) = GREATEST(q.a, q.b) AND p.face_id < q.face_id WHERE {0})"""


def hop_sql(where, final):
    """Components by iterated label spreading inside DuckDB's recursion, over squares' faces."""
    return f"WITH RECURSIVE {SUP}, {PLACED}, {HE}, {ADJ.format(where)}, {walk('nb', 'face', 'face_id')} {final}"


@query("x10_face_components", hop_sql("TRUE", "SELECT n AS face_id, root AS patch FROM lab"))
def x10(spark, sf):
    return M.face_components(supplier_meshes(spark, sf)[1])


@query("m6_patch_sizes", hop_sql("TRUE", "SELECT root AS patch, COUNT(*) AS faces FROM lab GROUP BY root"))
def m6(spark, sf):
    return M.face_components(supplier_meshes(spark, sf)[1]).groupBy("patch").agg(F.count("*").alias("faces"))


def seams(vertices, faces):
    """Edges running along every fifth quantity line or every second discount line."""
    e = M.edge_valence(faces)
    local_a, local_b = F.col("a") % 1000, F.col("b") % 1000
    along = lambda v, n: F.floor(v / 11) % n == 0
    row = along(local_a, 5) & along(local_b, 5)
    col = ((local_a % 11) % 2 == 0) & ((local_b % 11) % 2 == 0)
    return e.where(row | col)


SEAM = "NOT ((((p.a % 1000) // 11) % 5 = 0 AND ((p.b % 1000) // 11) % 5 = 0) OR (((p.a % 1000) % 11) % 2 = 0 AND ((p.b % 1000) % 11) % 2 = 0))"


@query("x10_seam_patches", hop_sql(SEAM, "SELECT n AS face_id, root AS patch FROM lab"))
def x10_seams(spark, sf):
    v, f = supplier_meshes(spark, sf)
    return M.face_components(f, seams(v, f))


@query("m18_split_by_seam", hop_sql(SEAM, f""", pa AS (SELECT mesh_id, root AS patch, SUM(area) AS area FROM meas JOIN lab ON n = face_id GROUP BY 1, 2)
SELECT mesh_id, patch, {r('area')} AS area, ROW_NUMBER() OVER (PARTITION BY mesh_id ORDER BY pa.area, patch) = 1 AS is_small FROM pa"""))
def m18(spark, sf):
    v, f = supplier_meshes(spark, sf)
    out = M.split_by_seam(M.with_corners(v, f), f, seams(v, f))
    return tidy(out)


@query("a15_largest_face", hop_sql(SEAM, f", pick AS (SELECT root AS patch, face_id, area, ROW_NUMBER() OVER (PARTITION BY root ORDER BY area DESC, face_id) AS k FROM meas JOIN lab ON n = face_id) SELECT patch, {r('area')} AS area FROM pick WHERE k = 1"))
def a15(spark, sf):
    v, f = supplier_meshes(spark, sf)
    return tidy(M.largest_face(M.with_corners(v, f), M.face_components(f, seams(v, f))).select("patch", "area"))


CHECKS = f"""cf AS (SELECT mesh_id, v, face_id FROM (SELECT mesh_id, face_id, UNNEST([v0, v1, v2]) AS v FROM face)),
cn AS (SELECT DISTINCT p.v, p.face_id AS f, q.face_id AS g FROM (SELECT face_id, UNNEST([a, b]) AS v, LEAST(a, b) AS l, GREATEST(a, b) AS h FROM he) p
 JOIN (SELECT face_id, UNNEST([a, b]) AS v, LEAST(a, b) AS l, GREATEST(a, b) AS h FROM he) q ON p.v = q.v AND p.l = q.l AND p.h = q.h AND p.face_id <> q.face_id),
sp(v, f, seen) AS (SELECT v, face_id, face_id FROM cf UNION SELECT s.v, s.f, cn.g FROM sp s JOIN cn ON cn.v = s.v AND cn.f = s.seen),
fan AS (SELECT v, COUNT(DISTINCT root) AS fans FROM (SELECT v, f, MIN(seen) AS root FROM sp GROUP BY 1, 2) GROUP BY v),
bow AS (SELECT mesh_id, COUNT(*) AS bow_tie FROM fan JOIN vert ON vertex_id = v WHERE fans > 1 GROUP BY 1),
dup AS (SELECT mesh_id, CAST(SUM(n - 1) AS BIGINT) AS duplicate FROM (SELECT mesh_id, list_sort([v0, v1, v2]) AS t, COUNT(*) AS n FROM face GROUP BY 1, 2) GROUP BY 1),
flat AS (SELECT mesh_id, COUNT(*) FILTER (v0 = v1 OR v1 = v2 OR v0 = v2 OR area*area*4 < CAST(1e-10 AS DOUBLE)) AS degenerate,
 COUNT(*) FILTER (LEAST((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz), (cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)+(cz-bz)*(cz-bz), (ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz)) < CAST(1e-12 AS DOUBLE)) AS short_edges
 FROM meas GROUP BY 1),
ed AS (SELECT mesh_id, COUNT(*) AS edges, COUNT(*) FILTER (valence = 1) AS boundary, COUNT(*) FILTER (valence > 2) AS non_manifold FROM edge GROUP BY 1)"""


@query("m4_diagnostics", f"""WITH RECURSIVE {SUP}, {PLACED}, {HE}, {CHECKS}, vc AS (SELECT mesh_id, COUNT(*) AS vertices, COUNT(*) FILTER (vertex_id NOT IN (SELECT UNNEST([v0, v1, v2]) FROM face)) AS isolated FROM vert GROUP BY 1),
fc AS (SELECT mesh_id, COUNT(*) AS faces, SUM(vol) AS volume, SUM(area) AS area FROM meas GROUP BY 1)
SELECT mesh_id, vertices, faces, edges, degenerate, CAST(duplicate AS BIGINT) AS duplicate, boundary, non_manifold, COALESCE(bow_tie, 0) AS bow_tie, {r('volume')} AS volume, {r('area')} AS area, isolated,
 boundary = 0 AND COALESCE(bow_tie, 0) = 0 AND degenerate = 0 AS watertight FROM vc JOIN fc USING (mesh_id) JOIN flat USING (mesh_id) JOIN dup USING (mesh_id) JOIN ed USING (mesh_id) LEFT JOIN bow USING (mesh_id)""")
def m4(spark, sf):
    return tidy(M.diagnostics(*supplier_meshes(spark, sf)))


@query("m3_soup_checks", f"""WITH RECURSIVE {SUP}, {PLACED}, {HE}, {CHECKS} SELECT mesh_id, c AS check, n FROM (SELECT mesh_id, UNNEST(['boundary', 'non_manifold', 'bow_tie', 'degenerate', 'short_edges', 'duplicate']) AS c,
 UNNEST([boundary, non_manifold, COALESCE(bow_tie, 0), degenerate, short_edges, duplicate]) AS n FROM ed JOIN flat USING (mesh_id) JOIN dup USING (mesh_id) LEFT JOIN bow USING (mesh_id))""")
def m3(spark, sf):
    return M.validate(M.with_corners(*supplier_meshes(spark, sf)))


@query("m8_skirt_area", f"""WITH {SUP}, {HE}, {RIM} SELECT rim.mesh_id, COUNT(*) * 2 AS faces, {r('SUM(2 * SQRT((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)))')} AS area
 FROM rim JOIN vert p ON p.vertex_id = rim.a JOIN vert q ON q.vertex_id = rim.b GROUP BY 1""")
def m8(spark, sf):
    v, f = supplier_meshes(spark, sf)
    low, side = M.skirt(v, f, (0, 0, -1), 2.0)
    side = side.withColumn("face_id", F.monotonically_increasing_id())
    placed = M.with_corners(v.unionByName(low), side)
    shape = M.measures(placed, ["mesh_id"]).select("mesh_id", "area")
    return tidy(shape.join(side.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id").select("mesh_id", "faces", "area"))


BOX = """b AS (SELECT p_partkey AS mesh_id, p_partkey * CAST(3 AS DOUBLE) AS x0, 1 + p_size / CAST(20 AS DOUBLE) AS sx, p_retailprice / CAST(997 AS DOUBLE) AS sy, 1 + p_size / CAST(50 AS DOUBLE) AS sz FROM part)"""


@query("s17_box_volumes", f"WITH {BOX} SELECT mesh_id, {r('sx*sy*sz')} AS volume, {r('2*(sx*sy+sy*sz+sx*sz)')} AS area FROM b")
def s17(spark, sf):
    return tidy(M.measures(M.with_corners(*part_boxes(spark, sf)), ["mesh_id"]))


@query("j11_faces_in_box", f"WITH {SUP}, {PLACED} SELECT face_id FROM placed WHERE LEAST(ax,bx,cx) <= 20 AND GREATEST(ax,bx,cx) >= 12 AND LEAST(ay,by_,cy) <= 6 AND GREATEST(ay,by_,cy) >= 3 AND LEAST(az,bz,cz) <= 5 AND GREATEST(az,bz,cz) >= 2")
def j11(spark, sf):
    return M.overlapping_faces(M.with_corners(*supplier_meshes(spark, sf)), (12, 3, 2), (20, 6, 5)).select("face_id")


def probes(spark, sf):
    """Order-line points brought into the range of the part boxes."""
    p = lineitem_points(spark, sf)
    return p.select("point_id", (F.col("y") * 20.0 + 0.0371).alias("x"), (F.col("x") / 25.0 + 0.0013).alias("y"), (F.col("z") / 5.0 + 0.0007).alias("z"))


PROBE = f"pr AS (SELECT point_id, y * CAST(20 AS DOUBLE) + {lit(0.0371)} AS x, x / CAST(25 AS DOUBLE) + {lit(0.0013)} AS y, z / CAST(5 AS DOUBLE) + {lit(0.0007)} AS z FROM li)"


@query("j15_points_in_boxes", f"""WITH {LI}, {BOX}, pr AS (SELECT point_id, y * CAST(20 AS DOUBLE) AS x, (x - 1) / CAST(25 AS DOUBLE) AS y, z / CAST(5 AS DOUBLE) AS z FROM li),
near AS (SELECT pr.*, b.* FROM pr JOIN b ON b.mesh_id BETWEEN {big('FLOOR(pr.x / 3)')} - 2 AND {big('FLOOR(pr.x / 3)')} + 1),
d AS (SELECT point_id, mesh_id, LEAST(x - x0, x0 + sx - x, y, sy - y, z, sz - z) AS depth FROM near)
SELECT point_id, mesh_id, CASE WHEN depth > {lit(1e-9)} THEN 'inside' ELSE 'on' END AS side FROM d WHERE depth >= -{lit(1e-9)}""")
def j15(spark, sf):
    p = lineitem_points(spark, sf)  # many of them lie on sides, edges and corners of the boxes
    p = p.select("point_id", (F.col("y") * 20.0).alias("x"), ((F.col("x") - 1.0) / 25.0).alias("y"), (F.col("z") / 5.0).alias("z"))
    return M.inside_mesh(p, M.with_corners(*part_boxes(spark, sf))).drop("face_id")


@query("j14_nearest_hit", f"""WITH {LI}, {BOX}, {PROBE}, near AS (SELECT pr.*, b.* FROM pr JOIN b ON b.mesh_id BETWEEN {big('FLOOR(pr.x / 3)')} - 2 AND {big('FLOOR(pr.x / 3)')}),
hit AS (SELECT point_id, sz - z AS t FROM near WHERE x BETWEEN x0 AND x0 + sx AND y BETWEEN 0 AND sy AND z <= sz) SELECT point_id, {r('MIN(t)')} AS t FROM hit GROUP BY point_id""")
def j14(spark, sf):
    return tidy(M.nearest_hit(probes(spark, sf), M.with_corners(*part_boxes(spark, sf))).select("point_id", "t"))


@query("j12_intersecting_boxes", f"WITH {BOX} SELECT p.mesh_id AS mesh_a, q.mesh_id AS mesh_b FROM b p JOIN b q ON q.mesh_id = p.mesh_id + 1 AND p.x0 + p.sx >= q.x0")
def j12(spark, sf):
    placed = M.with_corners(*part_boxes(spark, sf))
    pairs = M.face_pairs(placed, placed, 1.5)
    named = pairs.select(F.floor(F.col("face_a") / 12).alias("mesh_a"), F.floor(F.col("face_b") / 12).alias("mesh_b"))
    return named.where("mesh_a < mesh_b").distinct()


@query("j13_closest_on_surface", f"""WITH {LI}, {BOX}, {PROBE}, near AS (SELECT pr.*, b.* FROM pr JOIN b ON b.mesh_id BETWEEN {big('FLOOR(pr.x / 3)')} - 6 AND {big('FLOOR(pr.x / 3)')} + 6),
g AS (SELECT point_id, GREATEST(x0-x, x-x0-sx, 0) AS gx, GREATEST(-y, y-sy, 0) AS gy, GREATEST(-z, z-sz, 0) AS gz,
 LEAST(ABS(x-x0), ABS(x-x0-sx), ABS(y), ABS(y-sy), ABS(z), ABS(z-sz)) AS depth FROM near),
d AS (SELECT point_id, CASE WHEN gx = 0 AND gy = 0 AND gz = 0 THEN depth ELSE SQRT(gx*gx+gy*gy+gz*gz) END AS d FROM g)
SELECT point_id, {r('MIN(d)')} AS distance FROM d GROUP BY point_id""")
def j13(spark, sf):
    p = probes(spark, sf)
    return tidy(M.closest_on_surface(p, M.with_corners(*part_boxes(spark, sf)), 1.0).select("point_id", "distance"))


# The faces of a box in the order of the mesh lie on z = 0, z = sz, y = 0, y = sy, x = 0 and x = sx; a closed box is one patch, and its largest face, the
# first of equals, stands for it. The centroid of a triangle has a third or two thirds of each side length.
@query("m13_patch_classes", f"""WITH {BOX}, c AS (SELECT CAST(k AS BIGINT) AS k, UNNEST([0, 2, 3, 0, 3, 1, 4, 5, 7, 4, 7, 6, 0, 1, 5, 0, 5, 4, 2, 6, 7, 2, 7, 3, 0, 4, 6, 0, 6, 2, 1, 3, 7, 1, 7, 5][3*k+1:3*k+3]) AS v FROM range(12) t(k)),
m AS (SELECT k, CAST(SUM(v & 1) AS DOUBLE) / 3 AS fx, CAST(SUM((v >> 1) & 1) AS DOUBLE) / 3 AS fy, CAST(SUM(v >> 2) AS DOUBLE) / 3 AS fz FROM c GROUP BY k),
f AS (SELECT b.*, k, fx * sx AS x, fy * sy AS y, fz * sz AS z, CASE WHEN k < 4 THEN sx*sy WHEN k < 8 THEN sx*sz ELSE sy*sz END AS area FROM b, m),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY mesh_id ORDER BY ROUND(area, 9) DESC, k) AS place FROM f),
o AS (SELECT p.mesh_id, p.x0 + p.x AS x, p.y, p.z FROM p WHERE place = 1)
SELECT o.mesh_id * 12 AS patch, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.mesh_id BETWEEN o.mesh_id - 2 AND o.mesh_id + 1 AND o.x BETWEEN b.x0 + {lit(0.41)} AND b.x0 + b.sx + {lit(0.41)}
 AND o.y BETWEEN {lit(0.013)} AND b.sy + {lit(0.013)} AND o.z BETWEEN {lit(0.013)} AND b.sz + {lit(0.013)}) THEN 'inside' ELSE 'outside' END AS side FROM o""")
def m13(spark, sf):
    v, f = part_boxes(spark, sf)
    placed = M.with_corners(v, f)
    shifted = placed.select("mesh_id", "face_id", "v0", "v1", "v2", *[(F.col(f"{n}{c}") + (0.41 if c == "x" else 0.013)).alias(f"{n}{c}") for n in "abc" for c in "xyz"])
    return M.classify_patches(placed, M.face_components(f), shifted)


@query("x11_shortest_paths", f"""WITH RECURSIVE {SUP}, {HE}, w AS (SELECT e.a, e.b, SQRT((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS size FROM edge e JOIN vert p ON p.vertex_id = e.a JOIN vert q ON q.vertex_id = e.b),
both_ways AS (SELECT a, b, size FROM w UNION ALL SELECT b, a, size FROM w),
best(vertex_id, way) USING KEY (vertex_id) AS (SELECT MIN(vertex_id), CAST(0 AS DOUBLE) FROM vert GROUP BY mesh_id
 UNION SELECT e.b, MIN(t.way + e.size) FROM best t JOIN both_ways e ON e.a = t.vertex_id LEFT JOIN recurring.best o ON o.vertex_id = e.b
 WHERE o.way IS NULL OR t.way + e.size < o.way GROUP BY e.b)
SELECT vertex_id, {r('way')} AS distance FROM best""")
def x11(spark, sf):
    v, f = supplier_meshes(spark, sf)
    start = v.groupBy("mesh_id").agg(F.min("vertex_id").alias("vertex_id"))
    return tidy(M.shortest_paths(v, f, start).select("vertex_id", "distance"))
