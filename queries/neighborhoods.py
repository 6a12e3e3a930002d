"""Neighbour joins, outlier masks and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.functions import matrix as M, vector as V
from pointweave.operators import aggregates as A, clustering as C, components, neighbors as N, outliers as O, registration
from pointweave.sources.tables import embedding_points, lineitem_points
from queries.registry import (EMB, LI, MOMENTS, big, cluster_sql, eigen_sql, knn_sql, lit, pairs_sql, query, r, tidy)

R = 0.11


@query("j1_radius_join", f"WITH {EMB}, {pairs_sql(R)} SELECT point_id, n_id, {r('SQRT(d2)')} AS distance FROM pairs")
def j1(spark, sf):
    return tidy(N.radius_join(embedding_points(spark, sf), R))


@query("j2_knn", f"WITH {EMB}, {knn_sql(8)} SELECT point_id, n_id, {r('SQRT(d2)')} AS distance, rank FROM knn")
def j2(spark, sf):
    return tidy(N.knn(embedding_points(spark, sf), 8))


@query("j3_closest_point", f"""WITH {EMB}, tgt AS (SELECT * FROM emb WHERE label > 4), src AS (SELECT * FROM emb WHERE label <= 4),
{knn_sql(1, 'tgt', 'src')} SELECT point_id, n_id, {r('SQRT(d2)')} AS distance FROM knn""")
def j3(spark, sf):
    p = embedding_points(spark, sf)
    return tidy(N.closest_point(p.where("label > 4"), p.where("label <= 4")))


@query("j4_local_density", f"WITH {EMB}, {pairs_sql(R)} SELECT point_id, COUNT(*) AS density FROM pairs GROUP BY point_id")
def j4(spark, sf):
    return tidy(N.local_density(embedding_points(spark, sf), R))


GRID = """cells AS (SELECT *, CAST(FLOOR(x) AS BIGINT) AS gx, CAST(FLOOR(y) AS BIGINT) AS gy, CAST(FLOOR(z) AS BIGINT) AS gz FROM li),
offs AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k FROM
  (SELECT UNNEST([-1,0,1]) AS i), (SELECT UNNEST([-1,0,1]) AS j), (SELECT UNNEST([-1,0,1]) AS k)),
asked AS (SELECT point_id, x, y, z, gx + i AS gx, gy + j AS gy, gz + k AS gz FROM cells, offs),
near AS (SELECT * FROM (SELECT p.point_id, q.point_id AS n_id,
  (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2
  FROM asked p JOIN cells q ON p.gx = q.gx AND p.gy = q.gy AND p.gz = q.gz) WHERE d2 <= 1)"""


@query("j4_local_density_lines", f"WITH {LI}, {GRID} SELECT point_id, COUNT(*) AS density FROM near GROUP BY point_id")
def j4_lines(spark, sf):
    return tidy(N.local_density(lineitem_points(spark, sf), 1.0))


@query("p9_density_threshold", f"WITH {LI}, {GRID} SELECT point_id, COUNT(*) AS density FROM near GROUP BY point_id HAVING COUNT(*) >= 4")
def p9(spark, sf):
    return tidy(N.local_density(lineitem_points(spark, sf), 1.0).where("density >= 4"))


@query("n6_normal_deviation_lines", f"""WITH {LI}, {GRID}, m AS (SELECT near.point_id,
 AVG(DEGREES(ACOS(GREATEST(CAST(-1 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), p.nx*q.nx + p.ny*q.ny + p.nz*q.nz))))) AS dev
 FROM near JOIN li p ON p.point_id = near.point_id JOIN li q ON q.point_id = n_id WHERE n_id <> near.point_id GROUP BY near.point_id)
SELECT point_id, {r('COALESCE(dev, CAST(0 AS DOUBLE))', 4)} AS deviation, COALESCE(dev, CAST(0 AS DOUBLE)) > 45 AS is_outlier FROM li LEFT JOIN m USING (point_id)""")
def n6_lines(spark, sf):
    return tidy(O.normal_deviation(lineitem_points(spark, sf), 1.0, 45.0).select("point_id", "deviation", "is_outlier"), 4)


@query("j2_knn_lines", f"""WITH {LI}, cells AS (SELECT *, CAST(FLOOR(x / 4) AS BIGINT) AS gx, CAST(FLOOR(y / 4) AS BIGINT) AS gy, CAST(FLOOR(z / 4) AS BIGINT) AS gz FROM li),
asked AS (SELECT point_id, x, y, z, gx + i AS gx, gy + j AS gy, gz + k AS gz FROM cells, (SELECT UNNEST([-1, 0, 1]) AS i), (SELECT UNNEST([-1, 0, 1]) AS j), (SELECT UNNEST([-1, 0, 1]) AS k)),
near AS (SELECT p.point_id, q.point_id AS n_id, (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2
 FROM asked p JOIN cells q ON p.gx = q.gx AND p.gy = q.gy AND p.gz = q.gz),
knn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY d2, n_id) AS rank FROM near WHERE d2 <= 16)
SELECT point_id, rank, n_id, {r('SQRT(d2)')} AS distance FROM knn WHERE rank <= 4""")
def j2_lines(spark, sf):
    return tidy(N.knn(lineitem_points(spark, sf), 4).select("point_id", "rank", "n_id", "distance"))


MOTION = M.translate(0.004, -0.003, 0.002) @ M.rotate((1.0, 2.0, 3.0), 0.01)


@query("j10_registration", f"WITH {EMB} SELECT point_id, {r('x', 4)} AS x, {r('y', 4)} AS y, {r('z', 4)} AS z FROM emb")
def j10(spark, sf):
    """A cloud that was moved a little comes back to where it was."""
    cloud = embedding_points(spark, sf)
    moved = cloud.withColumns(dict(zip(("x", "y", "z"), M.transform_point(MOTION, V.vec("x", "y", "z")))))
    return tidy(registration.register(moved, cloud, 30)[1].select("point_id", "x", "y", "z"), 4)


@query("a12_weld_ball", f"""WITH RECURSIVE {EMB}, {pairs_sql(0.09, strict=True)}, links AS (SELECT point_id AS a, n_id AS b FROM pairs), {cluster_sql('links')}
SELECT point_id AS vertex_id, label AS welded_id FROM labels""")
def a12_ball(spark, sf):
    return A.weld_ball(embedding_points(spark, sf).withColumnRenamed("point_id", "vertex_id"), 0.09)


@query("j5_kernel_density", f"""WITH {EMB}, {pairs_sql(R)}
SELECT point_id, {r(f"SUM(EXP(-d2 / ({lit(R / 2)} * {lit(R / 2)})))")} AS kde FROM pairs GROUP BY point_id""")
def j5(spark, sf):
    return tidy(N.kernel_density(embedding_points(spark, sf), R))


@query("j6_kernel_density_bandwidth", f"""WITH {EMB}, {pairs_sql(0.5)}
SELECT point_id, {r(f"SUM(EXP(-d2 / ({lit(0.1)} * {lit(0.1)})))")} AS kde FROM pairs GROUP BY point_id""")
def j6(spark, sf):
    return tidy(N.kernel_density(embedding_points(spark, sf), 0.5, 0.1))


@query("j7_neighbor_distance", f"WITH {EMB}, {knn_sql(30)} SELECT point_id, {r('AVG(SQRT(d2))')} AS nnd FROM knn GROUP BY point_id")
def j7(spark, sf):
    return tidy(N.neighbor_distance(embedding_points(spark, sf), 30))


def pick_sql(origin, unit, radius):
    o = [lit(float(v)) for v in origin]
    u = [lit(float(v)) for v in unit]
    return f"""WITH {LI}, t AS (SELECT point_id, x-{o[0]} AS lx, y-{o[1]} AS ly, z-{o[2]} AS lz FROM li),
s AS (SELECT point_id, lx*lx+ly*ly+lz*lz AS l2, lx*{u[0]}+ly*{u[1]}+lz*{u[2]} AS tca FROM t),
h AS (SELECT point_id, tca - SQRT({lit(radius)}*{lit(radius)} - (l2 - tca*tca)) AS entry FROM s
  WHERE tca >= 0 AND l2 - tca*tca <= {lit(radius)}*{lit(radius)})
SELECT point_id, {r('entry')} AS entry FROM h ORDER BY h.entry, point_id LIMIT 1"""


PICK = ((0.0, 1.0, 3.0), (0.6, 0.8, 0.0))


@query("j8_ray_pick", pick_sql(*PICK, 0.05))
def j8(spark, sf):
    return tidy(N.ray_pick(lineitem_points(spark, sf), *PICK))


@query("j9_ray_pick_tolerance", pick_sql(*PICK, 0.4))
def j9(spark, sf):
    return tidy(N.ray_pick(lineitem_points(spark, sf), *PICK, radius=0.4))


@query("j19_label_size", f"""WITH {LI} SELECT point_id, label, COUNT(*) OVER (PARTITION BY label) AS label_size FROM li""")
def j19(spark, sf):
    return A.with_label_size(lineitem_points(spark, sf).select("point_id", "label")).select("point_id", "label", "label_size")


# Outliers ----------------------------------------------------------------------------------

SOR = """d AS (SELECT point_id, COALESCE(AVG(CASE WHEN SQRT(d2) > CAST(1e-6 AS DOUBLE) THEN SQRT(d2) END), CAST(0 AS DOUBLE)) AS m
  FROM knn GROUP BY point_id),
g AS (SELECT AVG(m) AS mu, SQRT(GREATEST(AVG(m*m) - AVG(m)*AVG(m), CAST(0 AS DOUBLE))) AS sd FROM d)"""


@query("n1_statistical_outliers", f"""WITH {EMB}, {knn_sql(50)}, {SOR}
SELECT point_id, {r('m')} AS mean_distance, m > mu + CAST(1.5 AS DOUBLE) * sd AS is_outlier FROM d, g""")
def n1(spark, sf):
    return tidy(O.statistical(embedding_points(spark, sf), 50, 1.5))


@query("n2_radius_outliers", f"""WITH {EMB}, {pairs_sql(0.1)}
SELECT point_id, COUNT(*) AS neighbors, COUNT(*) < 6 AS is_outlier FROM pairs GROUP BY point_id""")
def n2(spark, sf):
    return tidy(O.radius(embedding_points(spark, sf), 0.1, 6))


@query("n2_radius_outlier_mask_lines", f"WITH {LI}, {GRID} SELECT point_id, COUNT(*) < 3 AS is_outlier FROM near GROUP BY point_id")
def n2_mask(spark, sf):
    return tidy(O.radius_mask(lineitem_points(spark, sf), 1.0, 3))


PLANES = f"""mom AS (SELECT point_id, ANY_VALUE(x) AS x, ANY_VALUE(y) AS y, ANY_VALUE(z) AS z, COUNT(*) AS found, {MOMENTS}
 FROM knn GROUP BY point_id), {eigen_sql('mom', 'pl', 'point_id, x, y, z, found, mx, my, mz')}"""
AWAY = "ABS(vx*(x-mx) + vy*(y-my) + vz*(z-mz))"


@query("n3_plane_outliers", f"""WITH {EMB}, {knn_sql(30)}, {PLANES}
SELECT point_id, {r(AWAY)} AS plane_distance, found < 3 OR {AWAY} > CAST(0.085 AS DOUBLE) AS is_outlier FROM pl""")
def n3(spark, sf):
    return tidy(O.plane_fit(embedding_points(spark, sf), 30, 0.085))


def n4_sql(size, t):
    g = lambda v: big(f"FLOOR({v} / {lit(size)})")
    return f"""WITH {EMB}, c AS (SELECT *, {g('x')} AS gx, {g('y')} AS gy, {g('z')} AS gz FROM emb),
u AS (SELECT DISTINCT gx, gy, gz FROM c),
mom AS (SELECT u.gx, u.gy, u.gz, COUNT(*) AS found, {MOMENTS.replace('n_x', 'q.x').replace('n_y', 'q.y').replace('n_z', 'q.z')}
  FROM u JOIN c q ON ABS(u.gx-q.gx) <= 1 AND ABS(u.gy-q.gy) <= 1 AND ABS(u.gz-q.gz) <= 1 GROUP BY u.gx, u.gy, u.gz),
{eigen_sql('mom', 'pl', 'gx, gy, gz, found, mx, my, mz')}
SELECT c.point_id, CASE WHEN found >= 3 THEN {r(AWAY)} END AS plane_distance, found < 3 OR {AWAY} > {lit(t)} AS is_outlier
FROM c JOIN pl USING (gx, gy, gz)"""


@query("n4_block_plane_outliers", n4_sql(0.1, 0.05))
def n4(spark, sf):
    return tidy(O.block_plane_fit(embedding_points(spark, sf), 0.1, 0.05))


CURV = "CASE WHEN found < 3 OR e_0+e_1+e_2 <= CAST(1e-9 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE e_0 / (e_0+e_1+e_2) END"


@query("n5_curvature", f"""WITH {EMB}, {knn_sql(30)}, {PLANES}
SELECT point_id, {r(CURV)} AS curvature, {CURV} > CAST(0.1 AS DOUBLE) * CAST(1.0 AS DOUBLE) AS is_outlier FROM pl""")
def n5(spark, sf):
    return tidy(O.curvature(embedding_points(spark, sf), 30, 1.0))


@query("n6_normal_deviation", f"""WITH {EMB}, {pairs_sql(0.1)}, m AS (SELECT point_id,
 AVG(DEGREES(ACOS(GREATEST(CAST(-1 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), nx*n_nx + ny*n_ny + nz*n_nz))))) AS dev
 FROM pairs WHERE n_id <> point_id GROUP BY point_id)
SELECT e.point_id, {r('COALESCE(dev, CAST(0 AS DOUBLE))')} AS deviation, COALESCE(dev, CAST(0 AS DOUBLE)) > 45 AS is_outlier
FROM emb e LEFT JOIN m USING (point_id)""")
def n6(spark, sf):
    return tidy(O.normal_deviation(embedding_points(spark, sf), 0.1, 45.0))


@query("n11_fit_at_point", f"""WITH {EMB}, one AS (SELECT * FROM emb WHERE point_id = 17), {knn_sql(30, 'emb', 'one')}, {PLANES}
SELECT point_id, {r('ABS(vx)')} AS vx, {r('ABS(vy)')} AS vy, {r('ABS(vz)')} AS vz, {r(AWAY)} AS plane_distance,
 found < 3 OR {AWAY} > CAST(0.07 AS DOUBLE) AS is_outlier FROM pl""")
def n11(spark, sf):
    fit = O.fit_at(embedding_points(spark, sf), 17)
    return tidy(fit.withColumns({c: F.abs(c) for c in ("vx", "vy", "vz")}))


def mls_sql(radius, sigma):
    w = f"EXP(-d2 / ({lit(sigma)} * {lit(sigma)}))"
    out, view = [EMB, "s0 AS (SELECT point_id, x, y, z, nx, ny, nz FROM emb)"], "s0"
    for i in (1, 2):
        p = pairs_sql(radius, f"s{i - 1}", strict=True).replace("pairs AS", f"pairs{i} AS")
        out.append(p)
        out.append(f"""w{i} AS (SELECT *, {w} AS w FROM pairs{i}),
cen{i} AS (SELECT point_id, COUNT(*) AS found, SUM(w) AS tw, SUM(w*n_x)/SUM(w) AS mx, SUM(w*n_y)/SUM(w) AS my, SUM(w*n_z)/SUM(w) AS mz
  FROM w{i} GROUP BY point_id),
mom{i} AS (SELECT w{i}.point_id, ANY_VALUE(found) AS found, ANY_VALUE(mx) AS mx, ANY_VALUE(my) AS my, ANY_VALUE(mz) AS mz,
  SUM(w*(n_x-mx)*(n_x-mx)) AS c_xx, SUM(w*(n_y-my)*(n_y-my)) AS c_yy, SUM(w*(n_z-mz)*(n_z-mz)) AS c_zz,
  SUM(w*(n_x-mx)*(n_y-my)) AS c_xy, SUM(w*(n_x-mx)*(n_z-mz)) AS c_xz, SUM(w*(n_y-my)*(n_z-mz)) AS c_yz
  FROM w{i} JOIN cen{i} USING (point_id) WHERE found >= 5 GROUP BY w{i}.point_id)""")
        out.append(eigen_sql(f"mom{i}", f"pl{i}", "point_id, mx, my, mz"))
        out.append(f"""f{i} AS (SELECT s.*, mx, my, mz, CASE WHEN s.nx*vx+s.ny*vy+s.nz*vz < 0 THEN -1 ELSE 1 END * vx AS vx,
  CASE WHEN s.nx*vx+s.ny*vy+s.nz*vz < 0 THEN -1 ELSE 1 END * vy AS vy, CASE WHEN s.nx*vx+s.ny*vy+s.nz*vz < 0 THEN -1 ELSE 1 END * vz AS vz
  FROM s{i - 1} s LEFT JOIN pl{i} USING (point_id)),
s{i} AS (SELECT point_id, COALESCE(x - vx*(vx*(x-mx)+vy*(y-my)+vz*(z-mz)), x) AS x, COALESCE(y - vy*(vx*(x-mx)+vy*(y-my)+vz*(z-mz)), y) AS y,
  COALESCE(z - vz*(vx*(x-mx)+vy*(y-my)+vz*(z-mz)), z) AS z, COALESCE(vx, nx) AS nx, COALESCE(vy, ny) AS ny, COALESCE(vz, nz) AS nz FROM f{i})""")
    cols = ", ".join(f"{r(c, 5)} AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz"))
    return "WITH " + ", ".join(out) + f" SELECT point_id, {cols} FROM s2"


@query("n13_surface_fit", mls_sql(0.2, 0.1))
def n13(spark, sf):
    return tidy(O.surface_fit(embedding_points(spark, sf)), 5)


# Clusters ----------------------------------------------------------------------------------

EPS = 0.075
CLOSE = f"{pairs_sql(EPS)}, edges AS (SELECT point_id AS a, n_id AS b FROM pairs WHERE point_id < n_id)"


@query("x1_components", f"WITH RECURSIVE {EMB}, {CLOSE}, {cluster_sql('edges')} SELECT point_id AS node, label AS root FROM labels")
def x1(spark, sf):
    p = embedding_points(spark, sf)
    edges = N.radius_pairs(p, EPS, half=True).select(F.col("point_id").alias("a"), F.col("n_id").alias("b"))
    return components.components(p, edges, "point_id")


def planar_sql(radius, cos, plane, cell=0.3):
    k = lambda p: " + ".join(f"({big(f'FLOOR({p}{c} / {lit(cell)})')} & 2097151) * {1 << s}" for c, s in zip("xyz", (42, 21, 0)))
    return f"""{pairs_sql(radius)}, keyed AS (SELECT *, {k('')} AS k1, {k('n_')} AS k2 FROM pairs WHERE point_id < n_id),
edges AS (SELECT point_id AS a, n_id AS b FROM keyed WHERE nx*n_nx + ny*n_ny + nz*n_nz >= {lit(cos)} AND
 CASE WHEN CASE WHEN k1 = k2 THEN point_id > n_id ELSE k1 < k2 END
  THEN ABS(nx*(n_x-x) + ny*(n_y-y) + nz*(n_z-z)) ELSE ABS(n_nx*(n_x-x) + n_ny*(n_y-y) + n_nz*(n_z-z)) END <= {lit(plane)})"""


RANKED = """sizes AS (SELECT label, COUNT(*) AS c FROM labels GROUP BY label),
ranks AS (SELECT label, ROW_NUMBER() OVER (ORDER BY c DESC, label) - 1 AS cluster_id FROM sizes)"""


@query("x2_planar_clusters", f"""WITH RECURSIVE {EMB}, {planar_sql(0.15, 0.5, 0.06)}, {cluster_sql('edges')}, {RANKED}
SELECT point_id, cluster_id FROM labels JOIN ranks USING (label)""")
def x2(spark, sf):
    return tidy(C.planar_clusters(embedding_points(spark, sf), 0.15, 0.5))


@query("x3_sized_clusters", f"""WITH RECURSIVE {EMB}, {CLOSE}, {cluster_sql('edges')}, sizes AS (SELECT label, COUNT(*) AS c FROM labels GROUP BY label)
SELECT point_id, CASE WHEN c BETWEEN 3 AND 60 THEN label END AS label FROM labels JOIN sizes USING (label)""")
def x3(spark, sf):
    return C.euclidean_clusters(embedding_points(spark, sf), EPS, 3, 60).select("point_id", "label")


@query("x4_euclidean_clusters", f"WITH RECURSIVE {EMB}, {CLOSE}, {cluster_sql('edges')} SELECT point_id, label FROM labels")
def x4(spark, sf):
    return C.euclidean_labels(embedding_points(spark, sf), EPS).select("point_id", "label")


@query("x5_angle_clusters", f"""WITH RECURSIVE {EMB}, {pairs_sql(0.15)}, edges AS (SELECT point_id AS a, n_id AS b FROM pairs
 WHERE point_id < n_id AND nx*n_nx + ny*n_ny + nz*n_nz >= CAST(0.6 AS DOUBLE)), {cluster_sql('edges')} SELECT point_id, label FROM labels""")
def x5(spark, sf):
    return C.angle_labels(embedding_points(spark, sf), 0.15, 0.6)


def block_sql(distance, cell, extra="TRUE", where="TRUE"):
    g = lambda v: big(f"FLOOR({v} / {lit(cell)})")
    return f"""WITH RECURSIVE {EMB}, base AS (SELECT * FROM emb WHERE {where}), {pairs_sql(distance, 'base')},
near AS (SELECT point_id, n_id FROM pairs WHERE ({extra}) AND ABS({g('x')} - {g('n_x')}) <= 1
  AND ABS({g('y')} - {g('n_y')}) <= 1 AND ABS({g('z')} - {g('n_z')}) <= 1),
cell AS (SELECT point_id, MIN(point_id) OVER (PARTITION BY {g('x')}, {g('y')}, {g('z')}) AS cid FROM base),
edges AS (SELECT point_id AS a, n_id AS b FROM near WHERE point_id <> n_id UNION SELECT point_id AS a, cid AS b FROM cell),
{cluster_sql('edges', 'base')} SELECT point_id, label FROM labels"""


@query("x6_block_clusters", block_sql(0.05, 0.08))
def x6(spark, sf):
    return C.block_labels(embedding_points(spark, sf), 0.05, 0.08).select("point_id", "label")


@query("x7_block_clusters_normals", block_sql(0.06, 0.08, "ABS(nx*n_nx + ny*n_ny + nz*n_nz) >= CAST(0.5 AS DOUBLE)"))
def x7(spark, sf):
    return C.block_labels(embedding_points(spark, sf), 0.06, 0.08, 0.5).select("point_id", "label")


@query("x8_block_clusters_without_outliers", block_sql(
    0.06, 0.08, "ABS(nx*n_nx + ny*n_ny + nz*n_nz) >= CAST(0.5 AS DOUBLE)",
    f"point_id NOT IN (SELECT point_id FROM (WITH {knn_sql(30)}, {PLANES} SELECT point_id FROM pl WHERE found < 3 OR {AWAY} > CAST(0.085 AS DOUBLE)))"))
def x8(spark, sf):
    from pointweave.operators.filters import drop_outliers

    p = embedding_points(spark, sf)
    kept = drop_outliers(p, O.plane_fit(p, 30, 0.085))
    return C.block_labels(kept, 0.06, 0.08, 0.5).select("point_id", "label")


@query("o2_cluster_ranks", f"""WITH RECURSIVE {EMB}, {CLOSE}, {cluster_sql('edges')}, {RANKED}
SELECT point_id, cluster_id FROM labels JOIN ranks USING (label)""")
def o2(spark, sf):
    return C.rank_labels(C.euclidean_labels(embedding_points(spark, sf), EPS))


@query("p12_drop_small_clusters", f"""WITH RECURSIVE {EMB}, {CLOSE}, {cluster_sql('edges')}
SELECT point_id, label FROM labels WHERE label IN (SELECT label FROM labels GROUP BY label HAVING COUNT(*) >= 3)""")
def p12(spark, sf):
    return C.drop_small(C.euclidean_labels(embedding_points(spark, sf), EPS)).select("point_id", "label")


@query("p14_dominant_cluster", f"""WITH {LI} SELECT point_id, label FROM li WHERE label =
 (SELECT label FROM li GROUP BY label ORDER BY COUNT(*) DESC, label LIMIT 1)""")
def p14(spark, sf):
    return C.dominant(lineitem_points(spark, sf).select("point_id", "label")).select("point_id", "label")


@query("p13_drop_touched_clusters", f"""WITH RECURSIVE {EMB}, {CLOSE}, {cluster_sql('edges')}
SELECT point_id, label FROM labels WHERE label NOT IN (SELECT l.label FROM labels l JOIN emb e USING (point_id) WHERE e.x > CAST(0.25 AS DOUBLE))""")
def p13(spark, sf):
    p = embedding_points(spark, sf)
    return C.drop_touched(C.euclidean_labels(p, EPS), p.where("x > 0.25")).select("point_id", "label")


def morph_sql(size, rounds, reach):
    g = lambda v: big(f"FLOOR({v} / {lit(size)})")
    out = [LI, f"v0 AS (SELECT DISTINCT {g('x')} AS gx, {g('y')} AS gy, {g('z')} AS gz FROM li)"]
    for i in range(1, rounds + 1):
        t = f"v{i - 1}"
        tests = " AND ".join(
            f"EXISTS (SELECT 1 FROM {t} w WHERE w.gx = v.gx + {a} AND w.gy = v.gy + {b} AND w.gz = v.gz + {c})"
            for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
        out.append(f"v{i} AS (SELECT * FROM {t} v WHERE {tests})")
    last = f"v{rounds}"
    out.append(f"nodes AS (SELECT *, ROW_NUMBER() OVER (ORDER BY gx, gy, gz) - 1 AS point_id FROM {last})")
    out.append("edges AS (SELECT p.point_id AS a, q.point_id AS b FROM nodes p JOIN nodes q ON "
               "(q.gx = p.gx + 1 AND q.gy = p.gy AND q.gz = p.gz) OR (q.gx = p.gx AND q.gy = p.gy + 1 AND q.gz = p.gz) "
               "OR (q.gx = p.gx AND q.gy = p.gy AND q.gz = p.gz + 1))")
    out.append(cluster_sql("edges", "nodes"))
    out.append("core AS (SELECT gx, gy, gz FROM nodes JOIN labels USING (point_id) WHERE label = "
               "(SELECT label FROM labels GROUP BY label ORDER BY COUNT(*) DESC, label LIMIT 1))")
    return "WITH RECURSIVE " + ", ".join(out) + f""" SELECT point_id FROM li WHERE EXISTS (SELECT 1 FROM core
 WHERE ABS({g('li.x')} - gx) <= {reach} AND ABS({g('li.y')} - gy) <= {reach} AND ABS({g('li.z')} - gz) <= {reach})"""


@query("x9_voxel_morphology", morph_sql(4.0, 1, 1))
def x9(spark, sf):
    return C.morphology_filter(lineitem_points(spark, sf), 4.0, 1, 1).select("point_id")
