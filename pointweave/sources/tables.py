"""Point, frame and mesh views of the star-schema tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pointweave.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per embedding: dims 0-2 are the position, 3-5 the normal."""
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    size = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        *[c.alias(n) for c, n in zip(e[:3], ("x", "y", "z"))],
        *[(c / size).alias(n) for c, n in zip(e[3:], ("nx", "ny", "nz"))],
        F.col("label").cast("long").alias("label"),
    )


def line_id() -> Column:
    """The four keys of an order line as one number, or null if one of them is null.

    The plain fold ends at order 11,529,214. Where it is too large the id is negative, 63 bits of a hash of the keys: among the 216 million
    lines of a table 360 times as large as sf0.1 two ids are alike by chance once in some 400 such tables.
    """
    keys = [F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey")]
    fold = keys[0]
    for step, key in zip((8, 10000000, 10000), keys[1:]):
        fold = F.try_add(F.try_multiply(fold, F.lit(step)), key)
    wide = F.bitwise_not(F.shiftrightunsigned(F.xxhash64(*keys), 1))
    return F.coalesce(fold, F.when(functools.reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]), wide))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per order line; the id folds its four keys into one number."""
    normal = [F.col("l_tax") * 100.0 - 4.0, F.col("l_discount") * 100.0 - 5.0, F.col("l_quantity") - 25.5]
    size = F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2])
    return table(spark, sf_dir, "lineitem").select(
        line_id().alias("point_id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 997.0).alias("y"),
        (F.col("l_discount") * 100.0).alias("z"),
        *[(c / size).alias(n) for c, n in zip(normal, ("nx", "ny", "nz"))],
        F.floor(F.col("l_tax") * 1000.0).alias("r"),
        F.floor(F.col("l_quantity") * 5.0).alias("g"),
        F.pmod(F.col("l_partkey"), F.lit(256)).alias("b"),
        F.col("l_linenumber").cast("long").alias("cloud_id"),
        F.pmod(F.col("l_suppkey"), F.lit(23)).alias("label"),
    )


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as depth pixels in camera space; the line number is the frame."""
    return lineitem_points(spark, sf_dir).select(
        F.col("cloud_id").alias("frame_id"),
        F.col("point_id").alias("u"),
        F.col("label").alias("v"),
        ((F.col("x") - 25.0) / 25.0).alias("x"),
        ((F.col("y") - 50.0) / 50.0).alias("y"),
        (2.0 + F.col("z") / 10.0).alias("z"),
        "nx", "ny", "nz", "r", "g", "b",
    )


def frame_poses(frames: DataFrame) -> DataFrame:
    """One column-major pose per frame: a quarter-like turn for odd frames and a small shift."""
    f = F.col("frame_id")
    odd = F.pmod(f, F.lit(2)) == 1
    c, s = F.when(odd, 0.6).otherwise(1.0), F.when(odd, 0.8).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(c, s, zero, zero, -s, c, zero, zero, zero, zero, one, zero, f * 0.01, f * -0.02, f * 0.005, one)
    return frames.select("frame_id").distinct().select("frame_id", m.alias("m"))


def world_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.operators.volume import pose_frames

    frames = lineitem_frames(spark, sf_dir)
    return pose_frames(frames, frame_poses(frames))


def supplier_meshes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): one height field per supplier over quantity x discount.

    A grid square becomes two triangles where all four corners have order
    lines, so the meshes have holes, rims and loose parts. Both tables are written once, however often they are read.
    """
    d = F.floor(F.col("l_discount") * 100.0 + 0.5).cast("long")
    q = F.floor("l_quantity").cast("long")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("mesh_id"), q.alias("i"), d.alias("j"), (F.col("l_extendedprice") / 9970.0).alias("h"))
    grid = cut(lines.groupBy("mesh_id", "i", "j").agg(F.avg("h").alias("z")))
    number = F.col("mesh_id") * 1000 + F.col("i") * 11 + F.col("j")
    vertices = grid.select(
        "mesh_id", number.alias("vertex_id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "z")
    corners = F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"))
                        for a in (0, 1) for b in (0, 1)])
    squares = grid.select("mesh_id", F.explode(corners).alias("c")).where("c.j between 0 and 9").groupBy(
        "mesh_id", "c.i", "c.j").count().where("count = 4")
    v = number
    sides = F.array(F.struct((v * 2).alias("face_id"), v.alias("v0"), (v + 11).alias("v1"), (v + 12).alias("v2")),
                    F.struct((v * 2 + 1).alias("face_id"), v.alias("v0"), (v + 12).alias("v1"), (v + 1).alias("v2")))
    faces = squares.select("mesh_id", F.explode(sides).alias("f")).select("mesh_id", "f.*")
    return vertices, cut(faces)


# The twelve triangles of a box whose corner number has bit 0 = x, 1 = y, 2 = z.
BOX_FACES = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4),
             (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]


def boxes(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of one closed box per row of mesh_id, x0, y0, z0, sx, sy, sz."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    c = sizes.withColumn("k", corner)
    vertices = c.select("mesh_id", (F.col("mesh_id") * 8 + F.col("k")).alias("vertex_id"), *[
        (F.col(f"{a}0") + F.shiftright("k", i).bitwiseAND(F.lit(1)) * F.col(f"s{a}")).alias(a) for i, a in enumerate("xyz")])
    tri = F.array(*[F.struct((F.col("mesh_id") * 12 + n).alias("face_id"), *[(F.col("mesh_id") * 8 + v).alias(f"v{i}")
                    for i, v in enumerate(f)]) for n, f in enumerate(BOX_FACES)])
    return vertices, sizes.select("mesh_id", F.explode(tri).alias("f")).select("mesh_id", "f.*")


def part_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One box per part, sized by its size and price, spread along x."""
    size = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mesh_id"), (F.col("p_partkey") * 3.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("z0"),
        (1.0 + F.col("p_size") / 20.0).alias("sx"), (F.col("p_retailprice") / 997.0).alias("sy"), (1.0 + F.col("p_size") / 50.0).alias("sz"))
    return boxes(size)
