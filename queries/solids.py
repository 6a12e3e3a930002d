"""Set algebra of meshes: boxes against shifted copies and neighbours, sheets trimmed by boxes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from pointweave.operators import mesh as M, solids as S
from pointweave.session import cut
from pointweave.sources.tables import boxes, part_boxes, supplier_meshes
from queries.meshes import BOX, SUP
from queries.registry import lit, query, r, tidy

SHIFT = (0.41, 0.013, 0.017)
XYZ = "xyz"
SHIFTED = f"""{BOX}, s AS (SELECT *, {lit(SHIFT[0])} AS dx, {lit(SHIFT[1])} AS dy, {lit(SHIFT[2])} AS dz FROM b),
v AS (SELECT *, sx*sy*sz AS vol, 2*(sx*sy+sy*sz+sx*sz) AS surface, (sx-dx)*(sy-dy)*(sz-dz) AS inner_vol,
 2*((sx-dx)*(sy-dy)+(sy-dy)*(sz-dz)+(sx-dx)*(sz-dz)) AS inner_surface FROM s)"""


def shifted(spark, sf):
    """Every part box and its copy moved a little along all axes."""
    left = cut(M.with_corners(*part_boxes(spark, sf)).withColumn("job", F.col("mesh_id")))  # both operands come from it
    right = left.withColumns({f"{n}{c}": F.col(f"{n}{c}") + d for c, d in zip(XYZ, SHIFT) for n in "abc"})
    return S.Solids(left, right, 2.0)


@query("m9_intersection_loops", f"WITH {SHIFTED} SELECT mesh_id AS job, CAST(1 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS open_ends, {r('2*((sx-dx)+(sy-dy)+(sz-dz))')} AS length FROM v")
def m9(spark, sf):
    loops = shifted(spark, sf).loops()
    length = F.sqrt(sum((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in XYZ))
    return tidy(loops.groupBy("job").agg(F.count_distinct("loop").alias("loops"), F.sum(F.when(F.col("next").isNull(), 1).otherwise(0)).alias("open_ends"),
                                         F.sum(length).alias("length")))


@query("m9_loop_edges", f"""WITH {SHIFTED}, e AS (
 SELECT mesh_id AS job, 'z' AS axis, x0+sx AS u, dy AS v, dz AS low, sz AS high FROM v UNION ALL SELECT mesh_id, 'y', x0+sx, dz, dy, sy FROM v
 UNION ALL SELECT mesh_id, 'z', x0+dx, sy, dz, sz FROM v UNION ALL SELECT mesh_id, 'x', sy, dz, x0+dx, x0+sx FROM v
 UNION ALL SELECT mesh_id, 'y', x0+dx, sz, dy, sy FROM v UNION ALL SELECT mesh_id, 'x', dy, sz, x0+dx, x0+sx FROM v)
SELECT job, axis, {r('u')} AS u, {r('v')} AS v, {r('low')} AS low, {r('high')} AS high, {r('high - low')} AS length FROM e""")
def m9_edges(spark, sf):
    """The straight edges of the loops: segments of one line together."""
    run = {c: F.abs(F.col(f"p{c}") - F.col(f"q{c}")) for c in XYZ}
    axis = F.when(run["x"] > 1e-7, "x").when(run["y"] > 1e-7, "y").otherwise("z")
    pick = lambda e, x, y, z: F.when(F.col("axis") == "x", F.col(f"{e}{x}")).when(F.col("axis") == "y", F.col(f"{e}{y}")).otherwise(F.col(f"{e}{z}"))
    rows = shifted(spark, sf).loops().withColumn("axis", axis)
    rows = rows.select("job", "axis", F.round(pick("p", "y", "x", "x"), 6).alias("u"), F.round(pick("p", "z", "z", "y"), 6).alias("v"),
                       pick("p", *XYZ).alias("s"), pick("q", *XYZ).alias("t"))
    return tidy(rows.groupBy("job", "axis", "u", "v").agg(F.min(F.least("s", "t")).alias("low"), F.max(F.greatest("s", "t")).alias("high"),
                                                           F.sum(F.abs(F.col("s") - F.col("t"))).alias("length")))


def net_edges(by):
    """Directed uses of edges summed batch by batch; edges that come out even, as most do where a mesh lies together, are left out."""
    def run(batches):
        for batch in batches:
            a, b = (pa.chunked_array([batch[f"k{(i + s) % 3}"] for i in range(3)]) for s in (0, 1))
            ahead = pc.less(a, b)
            rows = pa.table({**{c: pa.chunked_array([batch[c]] * 3) for c in by}, "a": pc.if_else(ahead, a, b), "b": pc.if_else(ahead, b, a), "n": pc.if_else(ahead, pa.scalar(1, pa.int64()), -1)})
            net = rows.group_by([*by, "a", "b"]).aggregate([("n", "sum")])
            yield from net.filter(pc.not_equal(net["n_sum"], 0)).select([*by, "a", "b", "n_sum"]).rename_columns([*by, "a", "b", "n"]).to_batches()

    return run


def shape(faces, *by):
    """Volume, area and number of edges that faces do not use as often one way as the other."""
    named = faces.select(*by, "face_id", *[F.col(f"k{i}").alias(f"v{i}") for i in range(3)], *S.CORNERS)
    sizes = M.measures(named, list(by))
    kinds = ", ".join(f"{c} {faces.schema[c].dataType.simpleString()}" for c in by)
    edges = faces.select(*by, "k0", "k1", "k2").mapInArrow(net_edges(by), f"{kinds}, a string, b string, n bigint").groupBy(*by, "a", "b").agg(F.sum("n").alias("n"))
    uneven = edges.where("n <> 0").groupBy(*by).agg(F.count("*").alias("open_edges"))
    return sizes.join(uneven, list(by), "left").fillna(0, ["open_edges"])


@query("m11_refined_faces", f"""WITH {SHIFTED}, f AS (SELECT CAST(UNNEST(RANGE(12)) AS BIGINT) AS k), o AS (SELECT UNNEST(['L', 'R']) AS side)
SELECT mesh_id AS job, side, mesh_id * 12 + k AS parent, {r('CASE WHEN k < 4 THEN sx*sy WHEN k < 8 THEN sx*sz ELSE sy*sz END / 2')} AS area FROM v, f, o""")
def m11(spark, sf):
    """The parts of every face have its area."""
    faces, _ = shifted(spark, sf).refined
    return tidy(faces.groupBy("job", "side", "parent").agg(F.sum(M.T.triangle_area(*M.corners())).alias("area")))


@query("m11_refined_meshes", f"""WITH {SHIFTED}, o AS (SELECT UNNEST(['L', 'R']) AS side)
SELECT mesh_id AS job, side, {r('vol')} AS volume, {r('surface')} AS area, CAST(0 AS BIGINT) AS open_edges FROM v, o""")
def m11_meshes(spark, sf):
    """Refined meshes hold what they held and have no gaps."""
    return tidy(shape(shifted(spark, sf).refined[0], "job", "side"))


def results(solids, operations):
    out = None
    for name in operations:
        part = shape(solids.result(name), "job").withColumn("operation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return tidy(out.select("job", "operation", "volume", "area", "open_edges"))


@query("m12_boolean_shifted", f"""WITH {SHIFTED}, o AS (SELECT UNNEST(['union', 'intersection', 'difference']) AS operation)
SELECT mesh_id AS job, operation, {r("CASE operation WHEN 'union' THEN 2*vol - inner_vol WHEN 'intersection' THEN inner_vol ELSE vol - inner_vol END")} AS volume,
 {r("CASE operation WHEN 'union' THEN 2*surface - inner_surface WHEN 'intersection' THEN inner_surface ELSE surface END")} AS area, CAST(0 AS BIGINT) AS open_edges FROM v, o""")
def m12(spark, sf):
    return results(shifted(spark, sf), ("union", "intersection", "difference"))


@query("m12_boolean_neighbors", f"""WITH {BOX}, j AS (SELECT p.mesh_id AS job, p.sx*p.sy*p.sz AS va, q.sx*q.sy*q.sz AS vb, (p.x0+p.sx-q.x0) * LEAST(p.sy, q.sy) * LEAST(p.sz, q.sz) AS vi,
 p.x0+p.sx-q.x0 AS lap FROM b p JOIN b q ON q.mesh_id = p.mesh_id + 1 WHERE p.x0 + p.sx >= q.x0), o AS (SELECT UNNEST(['union', 'intersection', 'difference']) AS operation)
SELECT job, operation, {r("CASE operation WHEN 'union' THEN va + vb - vi WHEN 'intersection' THEN vi ELSE va - vi END")} AS volume, CAST(0 AS BIGINT) AS open_edges FROM j, o
WHERE lap > {lit(1e-9)} OR operation <> 'intersection'""")
def m12_neighbors(spark, sf):
    """Boxes that reach into the next one or touch it; their lower sides lie in one plane."""
    placed = cut(M.with_corners(*part_boxes(spark, sf)))
    left, right = placed.withColumn("job", F.col("mesh_id")), placed.withColumn("job", F.col("mesh_id") - 1)
    ends = lambda df, f, name: df.groupBy("job").agg(f("ax").alias(name))
    jobs = ends(left, F.max, "high").join(ends(right, F.min, "low"), "job").where("high >= low").select("job")
    solids = S.Solids(left.join(jobs, "job", "left_semi"), right.join(jobs, "job", "left_semi"), 2.0)
    return results(solids, ("union", "intersection", "difference")).drop("area")


@query("m12_trimmed_sheets", f"""WITH {SUP}, c AS (SELECT mesh_id, {lit(10.5)} AS x0, {lit(2.25)} AS y0, {lit(19.75)} AS sx, {lit(5.4)} AS sy FROM sq GROUP BY mesh_id),
p AS (SELECT sq.mesh_id, (v % 1000) // 11 AS i, (v % 1000) % 11 AS j, c.* EXCLUDE (mesh_id) FROM sq JOIN c USING (mesh_id)),
a AS (SELECT mesh_id, SUM(GREATEST(0, LEAST(i + 1, x0 + sx) - GREATEST(i, x0)) * GREATEST(0, LEAST(j + 1, y0 + sy) - GREATEST(j, y0))) AS inside, COUNT(*) AS total FROM p GROUP BY mesh_id)
SELECT mesh_id AS job, operation, {r("CASE operation WHEN 'intersection' THEN inside ELSE total - inside END")} AS shadow FROM a, (SELECT UNNEST(['intersection', 'difference']) AS operation)
WHERE CASE operation WHEN 'intersection' THEN inside ELSE total - inside END > 0""")
def m12_trimmed(spark, sf):
    """Open sheets cut by an upright box: the area that what stays throws on the ground."""
    v, f = supplier_meshes(spark, sf)
    left = M.with_corners(v, f).withColumn("job", F.col("mesh_id"))
    size = f.select("mesh_id").distinct().select("mesh_id", *[F.lit(x).alias(n) for n, x in zip(("x0", "y0", "z0", "sx", "sy", "sz"), (10.5, 2.25, -1.5, 19.75, 5.4, 100.0))])
    solids = S.Solids(left, M.with_corners(*boxes(size)).withColumn("job", F.col("mesh_id")), 4.0, open_left=True)
    shadow = F.sum(((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2.0)
    out = [solids.result(name).groupBy("job").agg(shadow.alias("shadow")).withColumn("operation", F.lit(name)) for name in ("intersection", "difference")]
    return tidy(out[0].unionByName(out[1]).select("job", "operation", "shadow"))
