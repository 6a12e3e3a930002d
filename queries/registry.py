"""Query registry and the shared views, once in Spark and once in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Widen integers, round doubles and turn -0.0 into 0.0."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    return f"(ROUND({expr}, {digits}) + CAST(0 AS DOUBLE))"


def lit(value) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


EMB = """emb0 AS (
  SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b,
         CAST(embedding[6] AS DOUBLE) AS c, CAST(label AS BIGINT) AS label FROM embeddings),
emb AS (SELECT point_id, x, y, z, a / SQRT(a*a + b*b + c*c) AS nx, b / SQRT(a*a + b*b + c*c) AS ny,
         c / SQRT(a*a + b*b + c*c) AS nz, label FROM emb0)"""

LI = """li0 AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey) * 10000 + l_suppkey AS point_id,
         l_quantity AS x, l_extendedprice / CAST(997 AS DOUBLE) AS y, l_discount * CAST(100 AS DOUBLE) AS z,
         l_tax * CAST(100 AS DOUBLE) - CAST(4 AS DOUBLE) AS a, l_discount * CAST(100 AS DOUBLE) - CAST(5 AS DOUBLE) AS b,
         l_quantity - CAST(25.5 AS DOUBLE) AS c, CAST(FLOOR(l_tax * CAST(1000 AS DOUBLE)) AS BIGINT) AS r,
         CAST(FLOOR(l_quantity * CAST(5 AS DOUBLE)) AS BIGINT) AS g, l_partkey % 256 AS b8,
         CAST(l_linenumber AS BIGINT) AS cloud_id, l_suppkey % 23 AS label FROM lineitem),
li AS (SELECT point_id, x, y, z, a / SQRT(a*a + b*b + c*c) AS nx, b / SQRT(a*a + b*b + c*c) AS ny,
         c / SQRT(a*a + b*b + c*c) AS nz, r, g, b8 AS b, cloud_id, label FROM li0)"""


def pairs_sql(radius: float, view: str = "emb", strict: bool = False) -> str:
    """CTE ``pairs``: every ordered pair within the radius, by brute force."""
    sign = "<" if strict else "<="
    return f"""pairs AS (SELECT * FROM (
  SELECT p.*, q.point_id AS n_id, q.x AS n_x, q.y AS n_y, q.z AS n_z, q.nx AS n_nx, q.ny AS n_ny, q.nz AS n_nz,
         (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2
  FROM {view} p, {view} q) WHERE d2 {sign} {lit(radius)} * {lit(radius)})"""


def knn_sql(k: int, view: str = "emb", queries: str | None = None) -> str:
    """CTE ``knn``: exact k nearest by brute force, ties by id."""
    return f"""knn AS (SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY d2, n_id) AS rank FROM (
    SELECT p.*, q.point_id AS n_id, q.x AS n_x, q.y AS n_y, q.z AS n_z,
           (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS d2
    FROM {queries or view} p, {view} q)) WHERE rank <= {k})"""


def eigen_sql(source: str, out: str, keep: str) -> str:
    """CTEs from moments c_xx.. to eigenvalues e_0..e_2 and the smallest unit vector vx, vy, vz."""
    d = lambda v: lit(float(v))
    return f"""{out}_q AS (SELECT *, (c_xx + c_yy + c_zz) * ({d(1)} / {d(3)}) AS q FROM {source}),
{out}_p AS (SELECT *, SQRT(((c_xx-q)*(c_xx-q) + (c_yy-q)*(c_yy-q) + (c_zz-q)*(c_zz-q)
   + {d(2)} * (c_xy*c_xy + c_xz*c_xz + c_yz*c_yz)) / {d(6)}) AS p FROM {out}_q),
{out}_r AS (SELECT *, CASE WHEN p > 0 THEN ACOS(GREATEST({d(-1)}, LEAST({d(1)},
   ((c_xx-q) * ((c_yy-q)*(c_zz-q) - c_yz*c_yz) - c_xy * (c_xy*(c_zz-q) - c_yz*c_xz)
    + c_xz * (c_xy*c_yz - (c_yy-q)*c_xz)) / ({d(2)}*p*p*p)))) / {d(3)} ELSE {d(0)} END AS ph FROM {out}_p),
{out}_e AS (SELECT *, q + {d(2)}*p*COS(ph) AS e_2, q + {d(2)}*p*COS(ph + {d(2.0943951023931953)}) AS e_0 FROM {out}_r),
{out}_c AS (SELECT *, {d(3)}*q - e_0 - e_2 AS e_1,
   c_xy*c_yz - c_xz*(c_yy-e_0) AS ux, c_xz*c_xy - (c_xx-e_0)*c_yz AS uy, (c_xx-e_0)*(c_yy-e_0) - c_xy*c_xy AS uz,
   c_xy*(c_zz-e_0) - c_xz*c_yz AS sx, c_xz*c_xz - (c_xx-e_0)*(c_zz-e_0) AS sy, (c_xx-e_0)*c_yz - c_xy*c_xz AS sz,
   (c_yy-e_0)*(c_zz-e_0) - c_yz*c_yz AS tx, c_yz*c_xz - c_xy*(c_zz-e_0) AS ty, c_xy*c_yz - (c_yy-e_0)*c_xz AS tz
   FROM {out}_e),
{out}_b AS (SELECT *, CASE WHEN un >= sn AND un >= tn THEN ux WHEN sn >= tn THEN sx ELSE tx END AS bx,
   CASE WHEN un >= sn AND un >= tn THEN uy WHEN sn >= tn THEN sy ELSE ty END AS "by",
   CASE WHEN un >= sn AND un >= tn THEN uz WHEN sn >= tn THEN sz ELSE tz END AS bz FROM (
   SELECT *, ux*ux+uy*uy+uz*uz AS un, sx*sx+sy*sy+sz*sz AS sn, tx*tx+ty*ty+tz*tz AS tn FROM {out}_c)),
{out} AS (SELECT {keep}, e_0, e_1, e_2, bx / SQRT(bx*bx+"by"*"by"+bz*bz) AS vx,
   "by" / SQRT(bx*bx+"by"*"by"+bz*bz) AS vy, bz / SQRT(bx*bx+"by"*"by"+bz*bz) AS vz FROM {out}_b)"""


MOMENTS = """AVG(n_x) AS mx, AVG(n_y) AS my, AVG(n_z) AS mz, COVAR_POP(n_x, n_x) AS c_xx, COVAR_POP(n_y, n_y) AS c_yy,
 COVAR_POP(n_z, n_z) AS c_zz, COVAR_POP(n_x, n_y) AS c_xy, COVAR_POP(n_x, n_z) AS c_xz, COVAR_POP(n_y, n_z) AS c_yz"""


def cluster_sql(edges: str, nodes: str = "emb", node: str = "point_id") -> str:
    """CTE ``labels(point_id, label)``: smallest id reachable, by recursion over ``edges(a, b)``."""
    return f"""both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
walk(point_id, seen) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT w.point_id, e.b FROM walk w JOIN both_ways e ON e.a = w.seen),
labels AS (SELECT point_id, MIN(seen) AS label FROM walk GROUP BY point_id)"""
