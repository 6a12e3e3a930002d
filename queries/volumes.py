"""Voxel volume queries over the order lines seen as posed depth frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.operators import volume as W
from pointweave.sources.tables import lineitem_points, world_frames
from queries.registry import LI, big, lit, query, r, tidy

S = 0.08  # voxel side
d = lit
FR = f"""cam AS (SELECT cloud_id AS frame_id, point_id AS u, label AS v, (x-25)/{d(25.0)} AS px, (y-50)/{d(50.0)} AS py, 2 + z/{d(10.0)} AS pz, nx AS mx, ny AS my, nz AS mz, r, g, b,
 CASE WHEN cloud_id % 2 = 1 THEN {d(0.6)} ELSE {d(1.0)} END AS c, CASE WHEN cloud_id % 2 = 1 THEN {d(0.8)} ELSE {d(0.0)} END AS s,
 cloud_id*{d(0.01)} AS cx, cloud_id*{d(-0.02)} AS cy, cloud_id*{d(0.005)} AS cz FROM li),
fr AS (SELECT frame_id, u, v, c*px - s*py + {d(0.0)}*pz + cx AS x, s*px + c*py + {d(0.0)}*pz + cy AS y, {d(0.0)}*px + {d(0.0)}*py + pz + cz AS z,
 c*mx - s*my AS nx, s*mx + c*my AS ny, mz AS nz, cx, cy, cz, r, g, b FROM cam),
vw AS (SELECT *, SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS dist FROM fr),
vd AS (SELECT *, (x-cx)/dist AS dx, (y-cy)/dist AS dy, (z-cz)/dist AS dz FROM vw WHERE dist >= {d(1e-6)})"""
BAND, STEP = S * 10.0, S * 0.8


def vox(v):
    return big(f"FLOOR({v} / {d(S)})")


RAYS = f"""t0 AS (SELECT *, GREATEST({d(0.0)}, dist - {d(BAND)}) AS t0 FROM vd),
ri AS (SELECT *, UNNEST(RANGE(0, {big(f'FLOOR((dist + {d(BAND)} - t0) / {d(STEP)})')} + 1)) AS i FROM t0), rt AS (SELECT *, t0 + i*{d(STEP)} AS t FROM ri),
rs AS (SELECT {vox('(cx + dx*t)')} AS vx, {vox('(cy + dy*t)')} AS vy, {vox('(cz + dz*t)')} AS vz, frame_id, u, v, i,
 GREATEST({d(-1.0)}, LEAST({d(1.0)}, (dist - t) / {d(BAND)})) AS s FROM rt)"""
NORMALS = f"""nl AS (SELECT *, SQRT(nx*nx+ny*ny+nz*nz) AS l FROM vd), nu AS (SELECT * REPLACE (nx/l AS nx, ny/l AS ny, nz/l AS nz) FROM nl WHERE l >= {d(1e-6)}),
nd AS (SELECT *, dx*nx+dy*ny+dz*nz AS vdot FROM nu), nf AS (SELECT *, ABS(vdot) * LEAST(1 / GREATEST(dist, {d(1e-4)}), 1) AS f FROM nd WHERE ABS(vdot) >= {d(0.1)}),
ni AS (SELECT *, UNNEST(RANGE(0, 26)) AS i FROM nf), nt AS (SELECT *, i*{d(STEP)} - {d(BAND)} AS t FROM ni),
nv AS (SELECT *, {vox('(x + nx*t)')} AS vx, {vox('(y + ny*t)')} AS vy, {vox('(z + nz*t)')} AS vz FROM nt),
ns AS (SELECT *, GREATEST({d(-1.0)}, LEAST({d(1.0)}, ((x - (vx+{d(0.5)})*{d(S)})*nx + (y - (vy+{d(0.5)})*{d(S)})*ny + (z - (vz+{d(0.5)})*{d(S)})*nz) / {d(BAND)})) AS s FROM nv)"""
RANKED = "SELECT *, ROW_NUMBER() OVER w - 1 AS k, COUNT(*) OVER (PARTITION BY vx, vy, vz) AS n FROM {0} WINDOW w AS (PARTITION BY vx, vy, vz ORDER BY frame_id, v, u, i)"
SHARE = f"CASE WHEN n <= 101 THEN 1 / CAST(n AS DOUBLE) ELSE POW({d(100 / 101)}, n - 1 - GREATEST(k, 100)) / {d(101.0)} END"


@query("a2_frame_bounds", f"WITH {LI}, {FR} SELECT frame_id, {r('MIN(x)')} AS min_x, {r('MIN(y)')} AS min_y, {r('MIN(z)')} AS min_z, {r('MAX(x)')} AS max_x, {r('MAX(y)')} AS max_y, {r('MAX(z)')} AS max_z FROM fr GROUP BY frame_id")
def a2(spark, sf):
    return tidy(W.frame_bounds(world_frames(spark, sf)))


@query("s9_frame_range", f"WITH {LI}, {FR} SELECT frame_id, u FROM fr WHERE frame_id BETWEEN 3 AND 5")
def s9(spark, sf):
    return world_frames(spark, sf).where("frame_id between 3 and 5").select("frame_id", "u")


@query("v2_integrate_rays", f"WITH {LI}, {FR}, {RAYS}, k AS ({RANKED.format('rs')}) SELECT vx, vy, vz, {r(f'SUM(s * {SHARE})', 5)} AS value, COUNT(*) AS weight FROM k GROUP BY vx, vy, vz")
def v2(spark, sf):
    return tidy(W.integrate_rays(world_frames(spark, sf), S).select(*W.VOXEL, "value", "weight"), 5)


@query("v3_integrate_normals", f"""WITH {LI}, {FR}, {NORMALS}, k AS ({RANKED.format('ns')}), b AS (SELECT *, f / (LEAST(k, 100) + 1) AS bl FROM k),
g AS (SELECT *, CASE WHEN k > 0 THEN LN(1 - bl) ELSE 0 END AS lg FROM b), c AS (SELECT *, SUM(lg) OVER (PARTITION BY vx, vy, vz ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lt FROM g)
SELECT vx, vy, vz, {r('SUM(s * bl * EXP(COALESCE(lt, 0)))', 5)} AS value, COUNT(*) AS weight FROM c GROUP BY vx, vy, vz""")
def v3(spark, sf):
    return tidy(W.integrate_normals(world_frames(spark, sf), S).select(*W.VOXEL, "value", "weight"), 5)


SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
AXES = " UNION ALL ".join(f"SELECT {i} AS dir, {d(float(a))} AS ax, {d(float(b))} AS ay, {d(float(c))} AS az" for i, (a, b, c) in enumerate(SIX))
DIRSUM = f"""dirs AS ({AXES}), dd AS (SELECT vx, vy, vz, CAST(dir AS BIGINT) AS dir, (nx*ax+ny*ay+nz*az) AS dt, f, s FROM ns, dirs WHERE NOT (s < {d(-0.5)} AND vdot > 0)),
ds AS (SELECT vx, vy, vz, dir, SUM(dt*f*s) AS wd, SUM(dt*f) AS w FROM dd WHERE dt > SIN(PI() / 8) GROUP BY ALL)"""


@query("v4_directional_sums", f"WITH {LI}, {FR}, {NORMALS}, {DIRSUM} SELECT vx, vy, vz, dir, {r('wd', 5)} AS sum_wd, {r('w', 5)} AS sum_w FROM ds")
def v4(spark, sf):
    return tidy(W.directional_sums(world_frames(spark, sf), S), 5)


@query("v5_directional_volume", f"""WITH {LI}, {FR}, {NORMALS}, {DIRSUM}, m AS (SELECT *, wd/w AS value FROM ds WHERE w >= {d(1e-9)}),
p AS (SELECT *, COUNT(*) OVER q AS c, MAX(value) OVER q AS hi FROM m WINDOW q AS (PARTITION BY vx, vy, vz, dir // 2))
SELECT vx, vy, vz, dir, {r('value', 5)} AS value, {r('w', 5)} AS weight FROM p WHERE NOT (c = 2 AND hi < 0)""")
def v5(spark, sf):
    return tidy(W.directional_merge(None, W.directional_sums(world_frames(spark, sf), S)), 5)


@query("v6_occupancy", f"""WITH {LI}, {FR} SELECT {vox('x')} AS vx, {vox('y')} AS vy, {vox('z')} AS vz, CAST(COUNT(*) AS DOUBLE) AS value, LEAST(COUNT(*), 65535) AS weight,
 ARG_MAX(r, (frame_id, v, u)) AS r, ARG_MAX(g, (frame_id, v, u)) AS g, ARG_MAX(b, (frame_id, v, u)) AS b, MAX(frame_id) AS last_frame FROM fr GROUP BY 1, 2, 3""")
def v6(spark, sf):
    return tidy(W.occupancy(world_frames(spark, sf), S))


OCC = f"occ AS (SELECT {vox('x')} AS vx, {vox('y')} AS vy, {vox('z')} AS vz, COUNT(*) AS weight FROM fr GROUP BY 1, 2, 3)"


def mid(v):
    return f"((v{v} + {d(0.5)}) * {d(S)})"


@query("v7_extract_occupied", f"WITH {LI}, {FR}, {OCC} SELECT {r(mid('x'))} AS x, {r(mid('y'))} AS y, {r(mid('z'))} AS z, weight FROM occ")
def v7(spark, sf):
    return tidy(W.extract_occupied(W.occupancy(world_frames(spark, sf), S), S).select("x", "y", "z", "weight"))


@query("v11_region", f"WITH {LI}, {FR}, {OCC} SELECT vx, vy, vz FROM occ WHERE {mid('x')} BETWEEN -0.5 AND 0.6 AND {mid('y')} BETWEEN -0.3 AND 0.9 AND {mid('z')} BETWEEN 2.2 AND 2.8")
def v11(spark, sf):
    return W.within_region(W.occupancy(world_frames(spark, sf), S), S, (-0.5, -0.3, 2.2), (0.6, 0.9, 2.8)).select(*W.VOXEL)


@query("v13_carve_free_space", f"""WITH {LI}, {FR}, {OCC}, st AS (SELECT *, dist - {d(S * 1.5)} AS stop FROM vd), ci AS (SELECT *, UNNEST(RANGE(1, {big(f'CEIL(stop / {d(STEP)})')})) AS i FROM st WHERE stop > {d(STEP)}),
ps AS (SELECT DISTINCT {vox(f'(cx + dx*(i*{d(STEP)}))')} AS vx, {vox(f'(cy + dy*(i*{d(STEP)}))')} AS vy, {vox(f'(cz + dz*(i*{d(STEP)}))')} AS vz FROM ci)
SELECT vx, vy, vz, weight FROM occ WHERE NOT (weight < 4 AND EXISTS (SELECT 1 FROM ps WHERE ps.vx = occ.vx AND ps.vy = occ.vy AND ps.vz = occ.vz))""")
def v13(spark, sf):
    frames = world_frames(spark, sf)
    return tidy(W.carve_free_space(W.occupancy(frames, S), frames, S).select(*W.VOXEL, "weight"))


MEAN = f"""mi AS (SELECT x, y, z, nx, ny, nz, UNNEST([-3,-2,-1,0,1,2,3]) AS i FROM li), mv AS (SELECT {big(f'FLOOR((x + nx*(i*{d(1.5)})) / {d(1.5)})')} AS vx, {big(f'FLOOR((y + ny*(i*{d(1.5)})) / {d(1.5)})')} AS vy,
 {big(f'FLOOR((z + nz*(i*{d(1.5)})) / {d(1.5)})')} AS vz, i*{d(1.5)} / {d(4.5)} AS s FROM (SELECT i, x, y, z, nx/l AS nx, ny/l AS ny, nz/l AS nz FROM (SELECT *, SQRT(nx*nx+ny*ny+nz*nz) AS l FROM mi))),
mt AS (SELECT vx, vy, vz, ROUND(AVG(s), 9) AS value, COUNT(*) AS weight FROM mv GROUP BY 1, 2, 3)"""


def mean_volume(spark, sf):
    """Rounded, so that a mean of exactly zero has no sign of its own."""
    return W.mean_distance_volume(lineitem_points(spark, sf), 1.5).withColumn("value", F.round("value", 9))


@query("v18_mean_distance_volume", f"WITH {LI}, {MEAN} SELECT vx, vy, vz, {r('value')} AS value, weight FROM mt")
def v18(spark, sf):
    return tidy(mean_volume(spark, sf))


@query("v19_near_zero", f"WITH {LI}, {MEAN} SELECT vx, vy, vz, weight FROM mt WHERE weight >= 3 AND ABS(value) <= {d(0.1)}")
def v19(spark, sf):
    return W.near_zero(mean_volume(spark, sf), 1.5).select(*W.VOXEL, "weight")


@query("v12_extract_near", f"WITH {LI}, {MEAN} SELECT vx, vy, vz FROM mt WHERE weight >= 5 AND ABS(value) < {d(0.1)}")
def v12(spark, sf):
    return W.extract_near(mean_volume(spark, sf), 1.5).select(*W.VOXEL)


CROSS = " UNION ALL ".join(
    f"""SELECT a.vx, a.vy, a.vz, CAST({i} AS BIGINT) AS axis, a.weight, a.value AS f0, b.value AS f1 FROM mt a JOIN mt b ON b.vx = a.vx + {m[0]} AND b.vy = a.vy + {m[1]} AND b.vz = a.vz + {m[2]} WHERE a.value * b.value < 0"""
    for i, m in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))))


def probe(n, axis, sign):
    at = [big(f"FLOOR((pt.{v} + {d(1.5 * sign) if k == axis else d(0.0)}) / {d(1.5)})") for k, v in enumerate("xyz")]
    return f"LEFT JOIN mt {n} ON {n}.vx = {at[0]} AND {n}.vy = {at[1]} AND {n}.vz = {at[2]}"


PROBES = " ".join(probe(f"q{2 * a + k}", a, s) for a in range(3) for k, s in enumerate((1, -1)))
POINT = ", ".join(f"(v{v} + {d(0.5)}) * {d(1.5)} + CASE WHEN axis = {a} THEN mu * {d(1.5)} ELSE {d(0.0)} END AS {v}" for a, v in enumerate("xyz"))


def slope(axis, up):
    whole = " AND ".join(f"p{k} IS NOT NULL" for k in range(6))
    size = "SQRT(" + " + ".join(f"(p{2 * a} - p{2 * a + 1}) * (p{2 * a} - p{2 * a + 1})" for a in range(3)) + ")"
    return r(f"CASE WHEN NOT ({whole}) THEN 0 WHEN {size} > 1e-6 THEN (p{2 * axis + 1} - p{2 * axis}) / {size} ELSE {up} END", 4)


@query("v8_zero_crossings", f"""WITH {LI}, {MEAN}, cr AS ({CROSS}), mu AS (SELECT *, -f0/(f1-f0) AS mu FROM cr)
SELECT vx, vy, vz, axis, weight, {r(f"(vx+{d(0.5)})*{d(1.5)} + CASE WHEN axis = 0 THEN mu*{d(1.5)} ELSE 0 END")} AS x, {r(f"(vz+{d(0.5)})*{d(1.5)} + CASE WHEN axis = 2 THEN mu*{d(1.5)} ELSE 0 END")} AS z FROM mu""")
def v8(spark, sf):
    vol = mean_volume(spark, sf).withColumns({c: F.lit(0.0) for c in W.NORMAL})
    return tidy(W.zero_crossings(vol, 1.5).select(*W.VOXEL, "axis", "weight", "x", "z"))


@query("v8_zero_crossing_normals", f"""WITH {LI}, {MEAN}, cr AS ({CROSS}), mu AS (SELECT *, -f0/(f1-f0) AS mu FROM cr), pt AS (SELECT *, {POINT} FROM mu),
pr AS (SELECT pt.*, {', '.join(f'q{k}.value AS p{k}' for k in range(6))} FROM pt {PROBES})
SELECT vx, vy, vz, axis, weight, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z, {slope(0, 0)} AS nx, {slope(1, 1)} AS ny, {slope(2, 0)} AS nz FROM pr""")
def v8_normals(spark, sf):
    vol = mean_volume(spark, sf).withColumns({c: F.lit(0.0) for c in W.NORMAL})
    found = W.zero_crossings(vol, 1.5)
    return tidy(found.withColumns({n: F.round(n, 4) for n in W.NORMAL}))


DIRECTED = f"""mm AS (SELECT *, wd/w AS value FROM ds WHERE w >= {d(1e-9)}),
pp AS (SELECT *, COUNT(*) OVER q AS c, MAX(value) OVER q AS hi FROM mm WINDOW q AS (PARTITION BY vx, vy, vz, dir // 2)),
dv AS (SELECT vx, vy, vz, dir, value, w FROM pp WHERE NOT (c = 2 AND hi < 0) AND w > 0)"""
DIRECTED_CROSS = " UNION ALL ".join(
    f"""SELECT a.dir, CAST({i} AS BIGINT) AS axis, a.vx, a.vy, a.vz, a.w, a.value / (a.value - b.value) AS mu FROM dv a JOIN dv b ON b.dir = a.dir AND b.vx = a.vx + {m[0]} AND b.vy = a.vy + {m[1]} AND b.vz = a.vz + {m[2]} WHERE a.value * b.value < 0"""
    for i, m in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))))


def crossing_at(v, axis):
    return r(f"(v{v} + {d(0.5)}) * {d(S)} + CASE WHEN axis = {axis} THEN mu * {d(S)} ELSE 0 END", 4)


@query("v8_directional_crossings", f"""WITH {LI}, {FR}, {NORMALS}, {DIRSUM}, {DIRECTED}, cx AS ({DIRECTED_CROSS})
SELECT dir, axis, vx, vy, vz, {crossing_at('x', 0)} AS x, {crossing_at('y', 1)} AS y, {crossing_at('z', 2)} AS z, {r('w', 4)} AS weight FROM cx""")
def v8_dir(spark, sf):
    state = W.directional_merge(None, W.directional_sums(world_frames(spark, sf), S))
    return tidy(W.directional_crossings(state, S), 4)


CUBE = [(n & 1, n >> 1 & 1, n >> 2) for n in range(8)]
CUBE_EDGES = [(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)]
CORNER = " UNION ALL ".join(f"SELECT vx - {i} AS vx, vy - {j} AS vy, vz - {k} AS vz, {n} AS c, value FROM mt" for n, (i, j, k) in enumerate(CUBE))


def net_sql():
    ds = ", ".join(f"MAX(CASE WHEN c = {n} THEN value END) AS d{n}" for n in range(8))
    rows = []
    for p, q in CUBE_EDGES:
        t = f"(-d{p} / (d{q} - d{p}))"
        pos = [f"({i} + {t} * {j - i})" for i, j in zip(CUBE[p], CUBE[q])]
        rows.append(f"SELECT vx, vy, vz, {pos[0]} AS px, {pos[1]} AS py, {pos[2]} AS pz FROM ok WHERE (d{p} < 0) <> (d{q} < 0)")
    return f"""WITH {LI}, {MEAN}, co AS ({CORNER}), ce AS (SELECT vx, vy, vz, COUNT(*) AS n, {ds} FROM co GROUP BY 1, 2, 3),
ok AS (SELECT * FROM ce WHERE n = 8), x AS ({' UNION ALL '.join(rows)})
SELECT vx, vy, vz, {r(f'(vx + AVG(px)) * {d(1.5)}')} AS x, {r(f'(vy + AVG(py)) * {d(1.5)}')} AS y, {r(f'(vz + AVG(pz)) * {d(1.5)}')} AS z FROM x GROUP BY vx, vy, vz"""


@query("v9_surface_net_vertices", net_sql())
def v9(spark, sf):
    return tidy(W.net_vertices(mean_volume(spark, sf), 1.5))


# For each axis the cells around an edge, counter-clockwise about the axis, as offsets from the edge's lower node.
AROUND = (((0, 0, 0), (0, -1, 0), (0, -1, -1), (0, 0, -1)), ((0, 0, 0), (0, 0, -1), (-1, 0, -1), (-1, 0, 0)),
          ((0, 0, 0), (-1, 0, 0), (-1, -1, 0), (0, -1, 0)))


def triangles_sql():
    parts = []
    for axis, cells in enumerate(AROUND):
        step = [int(k == axis) for k in range(3)]
        held = " AND ".join(f"EXISTS (SELECT 1 FROM full8 c WHERE c.vx = a.vx + {x} AND c.vy = a.vy + {y} AND c.vz = a.vz + {z})" for x, y, z in cells)
        for inside, split in (("a.value < 0", ((0, 1, 2), (0, 2, 3))), ("a.value >= 0", ((3, 2, 1), (3, 1, 0)))):
            for one, two, three in split:
                at = ", ".join(f"a.v{v} + {cells[c][k]} AS \"{n}{v}\"" for n, c in zip("abc", (one, two, three)) for k, v in enumerate("xyz"))
                parts.append(f"""SELECT {at} FROM mt a JOIN mt b ON b.vx = a.vx + {step[0]} AND b.vy = a.vy + {step[1]} AND b.vz = a.vz + {step[2]}
 WHERE {inside} AND (a.value < 0) <> (b.value < 0) AND {held}""")
    columns = ", ".join(f'"{n}{v}"' for n in "abc" for v in "xyz")
    return f"""WITH {LI}, {MEAN}, full8 AS (SELECT vx, vy, vz FROM ({CORNER}) GROUP BY 1, 2, 3 HAVING COUNT(*) = 8)
""" + " UNION ALL ".join(f"SELECT {columns} FROM ({p})" for p in parts)


def first_corner(df):
    """Triangles turned so that their smallest corner comes first, which keeps their direction."""
    corner = lambda n: F.struct(*[F.col(f"{n}{v}").alias(v) for v in "xyz"])
    turns = [F.array(corner(p), corner(q), corner(s)) for p, q, s in ("abc", "bca", "cab")]
    return df.select(F.array_min(F.array(*turns)).alias("t")).select(
        *[F.col("t")[k][v].alias(f"{n}{v}") for k, n in enumerate("abc") for v in "xyz"])


TURNED_COLUMNS = ", ".join(f"t[{k + 1}][{i + 1}] AS {n}{v}_" for k, n in enumerate("abc") for i, v in enumerate("xyz"))


_A, _B, _C = (f'["{n}x", "{n}y", "{n}z"]' for n in "abc")
TURNS = f"[{_A}, {_B}, {_C}], [{_B}, {_C}, {_A}], [{_C}, {_A}, {_B}]"


@query("n10_surface_net_triangles", f"SELECT {TURNED_COLUMNS} FROM (SELECT LEAST({TURNS}) AS t FROM ({triangles_sql()}))")
def n10(spark, sf):
    found = first_corner(W.net_triangles(mean_volume(spark, sf), 1.5)[1])
    return found.select(*[F.col(c).alias(f"{c}_") for c in found.columns])


FIELD = f"""lo AS (SELECT MIN(x) - {d(10.0)} AS lx, MIN(y) - {d(10.0)} AS ly, MIN(z) - {d(10.0)} AS lz FROM li),
sp AS (SELECT li.x, li.y, li.z, lx, ly, lz, {big(f'FLOOR((x-lx)/{d(2.0)})')} AS bx, {big(f'FLOOR((y-ly)/{d(2.0)})')} AS b_y, {big(f'FLOOR((z-lz)/{d(2.0)})')} AS bz FROM li, lo),
o AS (SELECT CAST(UNNEST([-2,-1,0,1,2]) AS BIGINT) AS k), fd AS (SELECT bx+p.k AS gx, b_y+q.k AS gy, bz+s.k AS gz,
 MIN(SQRT((lx+(bx+p.k)*{d(2.0)}-x)*(lx+(bx+p.k)*{d(2.0)}-x) + (ly+(b_y+q.k)*{d(2.0)}-y)*(ly+(b_y+q.k)*{d(2.0)}-y) + (lz+(bz+s.k)*{d(2.0)}-z)*(lz+(bz+s.k)*{d(2.0)}-z))) AS d FROM sp, o p, o q, o s GROUP BY 1, 2, 3)"""


@query("n14_distance_field", f"WITH {LI}, {FIELD} SELECT gx, gy, gz, {r('d')} AS d FROM fd")
def n14(spark, sf):
    return tidy(W.distance_field(lineitem_points(spark, sf), 2.0))


@query("n14_smoothed_field", f"""WITH {LI}, {FIELD} SELECT a.gx, a.gy, a.gz, {r(f'CASE WHEN ANY_VALUE(a.d) > {d(6.0)} THEN ANY_VALUE(a.d) ELSE AVG(b.d) END')} AS d
 FROM fd a, o p, o q, o s, fd b WHERE ABS(p.k) <= 1 AND ABS(q.k) <= 1 AND ABS(s.k) <= 1 AND b.gx = a.gx + p.k AND b.gy = a.gy + q.k AND b.gz = a.gz + s.k GROUP BY 1, 2, 3""")
def n14_smooth(spark, sf):
    return tidy(W.smooth_field(W.distance_field(lineitem_points(spark, sf), 2.0), 2.0))


def side_sql(axis, sign):
    at = ["gx", "gy", "gz"]
    return f"COALESCE((SELECT n.d FROM sm n WHERE " + " AND ".join(f"n.{g} = k.{g} + {sign if i == axis else 0}" for i, g in enumerate(at)) + "), 100)"


@query("n14_field_surface", f"""WITH {LI}, {FIELD}, sm AS (SELECT a.gx, a.gy, a.gz, CASE WHEN ANY_VALUE(a.d) > {d(6.0)} THEN ANY_VALUE(a.d) ELSE AVG(b.d) END AS d
 FROM fd a, o p, o q, o s, fd b WHERE ABS(p.k) <= 1 AND ABS(q.k) <= 1 AND ABS(s.k) <= 1 AND b.gx = a.gx + p.k AND b.gy = a.gy + q.k AND b.gz = a.gz + s.k GROUP BY 1, 2, 3),
k AS (SELECT * FROM sm WHERE d < {d(1.4)}),
gr AS (SELECT gx, gy, gz, {side_sql(0, 1)} - {side_sql(0, -1)} AS u, {side_sql(1, 1)} - {side_sql(1, -1)} AS v, {side_sql(2, 1)} - {side_sql(2, -1)} AS w FROM k)
SELECT gx, gy, gz, {r(f'lx + gx * {d(2.0)}')} AS x, {r(f'ly + gy * {d(2.0)}')} AS y, {r(f'lz + gz * {d(2.0)}')} AS z,
 {r('CASE WHEN u*u + v*v + w*w > 1e-6 THEN u / SQRT(u*u + v*v + w*w) ELSE 0 END', 4)} AS nx, {r('CASE WHEN u*u + v*v + w*w > 1e-6 THEN v / SQRT(u*u + v*v + w*w) ELSE 1 END', 4)} AS ny,
 {r('CASE WHEN u*u + v*v + w*w > 1e-6 THEN w / SQRT(u*u + v*v + w*w) ELSE 0 END', 4)} AS nz FROM gr, lo""")
def n14_surface(spark, sf):
    p = lineitem_points(spark, sf)
    found = W.field_surface(W.smooth_field(W.distance_field(p, 2.0), 2.0), p, 2.0, 0.7)
    return tidy(found.withColumns({n: F.round(n, 4) for n in ("nx", "ny", "nz")}))
