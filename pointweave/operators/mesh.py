"""Triangle meshes as vertices (mesh_id, vertex_id, x, y, z) and faces (mesh_id, face_id, v0, v1, v2).

Vertex and face ids are unique over all meshes, so a mesh is never gathered
into one task: edges, loops, patches and paths are joins and groupings.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from pointweave.functions import boxes as B, keys as K, triangles as T, vector as V
from pointweave.operators import components as C
from pointweave.operators.neighbors import CELL
from pointweave.operators.sites import XYZ
from pointweave.session import cut, fan_out


def with_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with corner coordinates ax..cz: three rows per face meet their vertices once.

    Both sides are often exploded, which the planner takes to be small; the hint keeps it from broadcasting all vertices.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"v{i}").alias("vertex_id")) for i in range(3)])
    rows = faces.select("mesh_id", "face_id", F.explode(slots).alias("s")).select("mesh_id", "face_id", "s.slot", "s.vertex_id")
    placed = rows.join(vertices.select("vertex_id", *XYZ).hint("merge"), "vertex_id")
    pick = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{n}{c}") for i, n in enumerate("abc") for c in XYZ]
    ids = [F.max(F.when(F.col("slot") == i, F.col("vertex_id"))).alias(f"v{i}") for i in range(3)]
    return placed.groupBy("mesh_id", "face_id").agg(*ids, *pick)


def corners(prefix: str = ""):
    return tuple(V.vec(*[f"{prefix}{n}{c}" for c in XYZ]) for n in "abc")


def _cross():
    a, b, c = corners()
    return V.cross(V.sub(b, a), V.sub(c, a))


def face_areas(placed: DataFrame) -> DataFrame:
    return placed.select("mesh_id", "face_id", T.triangle_area(*corners()).alias("area"))


def measures(placed: DataFrame, by: list[str]) -> DataFrame:
    """Signed volume and total area per group of faces."""
    a, b, c = corners()
    return placed.groupBy(*by).agg((F.sum(V.dot(a, V.cross(b, c))) / 6.0).alias("volume"),
                                   F.sum(T.triangle_area(a, b, c)).alias("area"))


def half_edges(faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, side, a, b): the directed edges of every face."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b"))
                      for i in range(3)])
    return faces.select("mesh_id", "face_id", F.explode(sides).alias("e")).select("mesh_id", "face_id", "e.*")


def edge_valence(faces: DataFrame) -> DataFrame:
    """(mesh_id, a, b, valence) per undirected edge, a < b; 1 is a rim, 3 or more non-manifold."""
    e = half_edges(faces)
    return e.groupBy("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("valence"))


def boundary_half_edges(faces: DataFrame) -> DataFrame:
    """Directed edges used by one face only, in that face's direction."""
    e = half_edges(faces)
    both = e.groupBy("mesh_id", F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_h")).agg(
        F.count("*").alias("valence"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("face_id").alias("face_id"),
        F.first("side").alias("side"))
    return both.where("valence = 1").select("mesh_id", "face_id", "side", "a", "b")


def corner_fans(faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, corner, fan): corners 3 * face + slot, joined around their vertex over shared edges."""
    corner = lambda slot: F.col("face_id") * 3 + slot
    own = F.array(*[F.struct(F.col(f"v{i}").alias("vertex_id"), corner(i).alias("corner")) for i in range(3)])
    nodes = faces.select("mesh_id", F.explode(own).alias("c")).select("mesh_id", "c.*")
    ends = F.array(F.struct(F.col("a").alias("at"), corner(F.col("side")).alias("corner")),
                   F.struct(F.col("b").alias("at"), corner((F.col("side") + 1) % 3).alias("corner")))
    met = half_edges(faces).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.explode(ends).alias("e")).select(
        "low", "high", "e.*")
    first = met.groupBy("low", "high", "at").agg(F.min("corner").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = met.join(first, ["low", "high", "at"]).where(F.col("corner") != F.col("first"))
    roots = C.component_roots(links.select(F.col("corner").alias("a"), F.col("first").alias("b")), near=True)
    return nodes.join(roots, F.col("corner") == F.col("node"), "left").select(
        "mesh_id", "vertex_id", "corner", F.coalesce("root", "corner").alias("fan"))


def face_components(faces: DataFrame, seams: DataFrame | None = None) -> DataFrame:
    """(face_id, patch): faces joined over shared edges, but not over seam edges (a, b).

    The faces of an edge link to the smallest of them: the largest at once, others, which only an edge of three or
    more faces has, by a join with those edges. An edge of any valence costs one link per face.
    """
    e = half_edges(faces).select("face_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null")
    met = e.groupBy("a", "b").agg(F.min("face_id").alias("first"), F.max("face_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    if seams is not None:
        walls = seams.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = met.join(walls, ["a", "b"], "left_anti")
    met = cut(met)
    links = met.where("first <> last").select(F.col("last").alias("a"), F.col("first").alias("b"))
    several = met.where("n > 2").select("a", "b", "first", "last")
    if not several.isEmpty():
        more = e.join(several, ["a", "b"]).where((F.col("face_id") != F.col("first")) & (F.col("face_id") != F.col("last")))
        links = links.unionByName(more.select(F.col("face_id").alias("a"), F.col("first").alias("b")))
    found = C.components(faces, links, "face_id", near=True)
    return found.select(F.col("node").alias("face_id"), F.col("root").alias("patch"))


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(mesh_id, loop, edge, next, a, b): every boundary half-edge with its successor; loop is the smallest edge.

    Half-edges are 3 * face + side. The successor of an edge leaves its end vertex out of the same fan of faces.
    Only where several rims meet in a vertex do the fans have to be found; elsewhere the vertex says enough.
    """
    rim = cut(boundary_half_edges(faces).withColumn("edge", F.col("face_id") * 3 + F.col("side")))
    meeting = cut(rim.groupBy("a").count().where("count > 1").select("a"))
    slots = faces.select("mesh_id", "face_id", "v0", "v1", "v2", F.explode(F.array("v0", "v1", "v2")).alias("a"))
    near = slots.join(meeting, "a", "left_semi").select("mesh_id", "face_id", "v0", "v1", "v2").distinct()
    fans = cut(corner_fans(near).join(meeting.withColumnRenamed("a", "vertex_id"), "vertex_id", "left_semi").select("corner", "fan"))
    end = F.col("face_id") * 3 + (F.col("side") + 1) % 3
    named = rim.join(fans.select(F.col("corner").alias("edge"), F.col("fan").alias("leaves")), "edge", "left").withColumn("tip", end).join(
        fans.select(F.col("corner").alias("tip"), F.col("fan").alias("enters")), "tip", "left").fillna(-1, ["leaves", "enters"])
    follow = named.select(F.col("a").alias("b"), F.col("leaves").alias("enters"), F.col("edge").alias("next"))
    chain = cut(named.join(follow, ["b", "enters"], "left").select("mesh_id", "edge", "next", "a", "b"))
    roots = C.components(chain.select(F.col("edge").alias("node")), chain.where("next is not null").select(
        F.col("edge").alias("a"), F.col("next").alias("b")), near=True)
    return chain.join(roots.select(F.col("node").alias("edge"), F.col("root").alias("loop")), "edge").select(
        "mesh_id", "loop", "edge", "next", "a", "b")


def loop_order(loops: DataFrame) -> DataFrame:
    """(loop, vertex_id, position) along every loop, starting where its smallest half-edge starts.

    List ranking by doubling: each round every edge learns how far its
    pointer reaches and jumps twice as far, so a loop of length n needs log2 n
    joins, wherever its edges live. An open chain, as faces that disagree in
    direction leave them, is ranked from its own first edge.
    """
    onward = F.when(F.col("next") != F.col("loop"), F.col("next"))  # the edge into the start ends the list
    state = cut(loops.select("loop", "edge", F.col("a").alias("vertex_id"), onward.alias("next"), F.lit(1).cast("long").alias("d")))
    while not state.where("next is not null").isEmpty():
        ahead = state.select(F.col("edge").alias("next"), F.col("next").alias("far"), F.col("d").alias("more"))
        joined = state.join(ahead, "next", "left")
        state = cut(joined.select("loop", "edge", "vertex_id", F.col("far").alias("next"),
                                  (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
    longest = state.groupBy("loop").agg(F.max("d").alias("n"))
    return state.join(longest, "loop").select("loop", "vertex_id", (F.col("n") - F.col("d")).alias("position"))


def loop_perimeters(loops: DataFrame, vertices: DataFrame) -> DataFrame:
    a = vertices.select(F.col("vertex_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    b = vertices.select(F.col("vertex_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    size = V.distance(V.vec("ax", "ay", "az"), V.vec("bx", "by", "bz"))
    return loops.join(a, "a").join(b, "b").groupBy("mesh_id", "loop").agg(
        F.count("*").alias("edges"), F.sum(size).alias("perimeter"))


def skirt(vertices: DataFrame, faces: DataFrame, direction, height: float) -> tuple[DataFrame, DataFrame]:
    """Extrude every rim along a direction: two triangles per boundary edge.

    New vertex ids are the negated rim ids minus one.
    """
    rim = boundary_half_edges(faces)
    rim_ids = rim.select(F.col("a").alias("vertex_id")).union(rim.select("b")).distinct()
    low = vertices.join(rim_ids, "vertex_id", "left_semi").select(
        "mesh_id", (-F.col("vertex_id") - 1).alias("vertex_id"),
        *[(F.col(c) + float(d) * height).alias(c) for c, d in zip(XYZ, direction)])
    a, b, la, lb = F.col("a"), F.col("b"), -F.col("a") - 1, -F.col("b") - 1
    two = F.array(F.struct(b.alias("v0"), a.alias("v1"), la.alias("v2")), F.struct(b.alias("v0"), la.alias("v1"), lb.alias("v2")))
    return low, rim.select("mesh_id", F.explode(two).alias("f")).select("mesh_id", "f.*")


def largest_face(placed: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch, face_id, area): the largest face of each patch, ties to the smaller id."""
    both = face_areas(placed).join(patches, "face_id")
    best = both.groupBy("patch").agg(F.max(F.struct("area", (-F.col("face_id")).alias("neg"))).alias("m"))
    return best.select("patch", (-F.col("m.neg")).alias("face_id"), F.col("m.area").alias("area"))


def split_by_seam(placed: DataFrame, faces: DataFrame, seams: DataFrame) -> DataFrame:
    """(mesh_id, patch, area, is_small): patches between seams; the smallest of a mesh is 'small'."""
    patches = face_components(faces, seams)
    areas = face_areas(placed).join(patches, "face_id").groupBy("mesh_id", "patch").agg(F.sum("area").alias("area"))
    least = areas.groupBy("mesh_id").agg(F.min(F.struct("area", "patch")).alias("m")).select("mesh_id", F.col("m.patch").alias("p"))
    return areas.join(least, "mesh_id").select("mesh_id", "patch", "area", (F.col("patch") == F.col("p")).alias("is_small"))


def _violations(placed: DataFrame, short: float) -> DataFrame:
    """(mesh_id, measure, ..): partial counts in one row shape, to be summed by mesh."""
    faces = placed.select("mesh_id", "face_id", "v0", "v1", "v2")
    bad = F.col("v0").eqNullSafe(F.col("v1")) | F.col("v1").eqNullSafe(F.col("v2")) | F.col("v0").eqNullSafe(F.col("v2"))
    flat = V.length2(_cross()) < 1e-10
    a, b, c = corners()
    brief = (V.distance(a, b) < short) | (V.distance(b, c) < short) | (V.distance(c, a) < short)
    number = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    per_face = placed.groupBy("mesh_id").agg(
        number(bad | flat).alias("degenerate"), number(brief).alias("short_edges"), F.count("*").alias("faces"),
        (F.sum(V.dot(a, V.cross(b, c))) / 6.0).alias("volume"), F.sum(T.triangle_area(a, b, c)).alias("area"))
    copies = faces.groupBy("mesh_id", F.array_sort(F.array("v0", "v1", "v2")).alias("t")).count().groupBy("mesh_id").agg(
        F.sum(F.col("count") - 1).alias("duplicate"))
    edges = edge_valence(faces).groupBy("mesh_id").agg(
        F.count("*").alias("edges"), number(F.col("valence") == 1).alias("boundary"), number(F.col("valence") > 2).alias("non_manifold"))
    fans = fan_counts(faces).groupBy("mesh_id").agg(F.count("*").alias("used"), number(F.col("fans") > 1).alias("bow_tie"))
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (per_face, copies, edges, fans))


def _by_mesh(parts: DataFrame) -> DataFrame:
    """One row per mesh of sums over the rows that hold a measure."""
    return parts.groupBy("mesh_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns if c != "mesh_id"])


def validate(placed: DataFrame, short: float = 1e-6) -> DataFrame:
    """(mesh_id, check, n): violations of each soup check."""
    names = ["degenerate", "short_edges", "duplicate", "boundary", "non_manifold", "bow_tie"]
    return _by_mesh(_violations(cut(placed), short)).unpivot("mesh_id", names, "check", "n")


def near_pairs(vertices: DataFrame, faces: DataFrame, distance: float) -> DataFrame:
    """(mesh_id, v0, v1, distance): pairs of a mesh's vertices closer than ``distance`` that no edge joins, v0 < v1.

    Vertices in one place are pairs of distance zero. Cells are four times as wide as the distance; a vertex is sent to its own and to those
    just below it that it may share with a lower partner, twice as many rows as vertices. A pair meets in the cell of its lower corner.
    """
    side, wide = 4.0 * distance, distance * (1.0 + 1e-9)
    sent = vertices.select("mesh_id", "vertex_id", *XYZ)
    for g, c in zip(CELL, XYZ):
        sent = sent.withColumn(g, F.explode(F.sequence(K.cell(F.col(c) - wide, side), K.cell(F.col(c), side))))
    other = sent.toDF("mesh_id", "v0", "ax", "ay", "az", *CELL)
    met = other.join(sent.hint("merge"), ["mesh_id", *CELL]).where(F.col("v0") < F.col("vertex_id"))
    for g, c in zip(CELL, XYZ):
        met = met.where(F.col(g) == K.cell(F.least(f"a{c}", c), side))
    far = V.distance(V.vec("ax", "ay", "az"), V.vec(*XYZ))
    near = met.where(far < distance).select("mesh_id", F.least("v0", "vertex_id").alias("a"), F.greatest("v0", "vertex_id").alias("b"), far.alias("distance"))
    return near.join(edge_valence(faces), ["mesh_id", "a", "b"], "left_anti").select("mesh_id", F.col("a").alias("v0"), F.col("b").alias("v1"), "distance")


MANY = 4096  # faces at a vertex from which its fans are found by components over all tasks


def _link_parts(batches):
    """Number of connected parts of each row's links: the faces at a vertex, as edges between the other two corners."""
    for batch in batches:
        links = batch["links"]
        sizes = np.diff(links.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.stack([pa.compute.struct_field(links.flatten(), c).to_numpy() for c in ("p", "q")])
        nodes, flat = np.unique(np.stack([np.tile(row, 2), ends.ravel()]), axis=1, return_inverse=True)
        flat = flat.reshape(2, -1)
        joined, _ = C.contract(flat[0], flat[1])
        parts = np.bincount(nodes[0], minlength=len(sizes)) - np.bincount(nodes[0][joined], minlength=len(sizes))
        yield pa.RecordBatch.from_arrays([batch["mesh_id"], batch["vertex_id"], pa.array(parts, pa.int64())], names=["mesh_id", "vertex_id", "fans"])


def fan_counts(faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, fans): fans of faces joined over edges around each vertex, open or closed.

    The faces at one vertex come together in a row; a vertex with more than ``MANY`` is left to components instead.
    """
    slots = F.array(*[F.struct(F.col(f"v{i}").alias("vertex_id"), F.col(f"v{(i + 1) % 3}").alias("p"), F.col(f"v{(i + 2) % 3}").alias("q")) for i in range(3)])
    rows = faces.select("mesh_id", F.explode(slots).alias("s")).select("mesh_id", "s.*")
    crowded = cut(rows.groupBy("vertex_id").count().where(F.col("count") > MANY).select("vertex_id"))
    kind = f"mesh_id {faces.schema['mesh_id'].dataType.simpleString()}, vertex_id {faces.schema['v0'].dataType.simpleString()}, fans bigint"
    if crowded.isEmpty():
        return rows.groupBy("mesh_id", "vertex_id").agg(F.collect_list(F.struct("p", "q")).alias("links")).mapInArrow(_link_parts, kind)
    few = rows.join(crowded, "vertex_id", "left_anti").groupBy("mesh_id", "vertex_id").agg(F.collect_list(F.struct("p", "q")).alias("links")).mapInArrow(_link_parts, kind)
    at = rows.join(crowded, "vertex_id", "left_semi").select(F.explode(F.array("vertex_id", "p", "q")).alias("v0")).distinct()
    near = faces.where("v0 is not null").join(at, "v0", "left_semi")
    rest = corner_fans(near).join(crowded, "vertex_id", "left_semi").groupBy("mesh_id", "vertex_id").agg(F.count_distinct("fan").alias("fans"))
    return few.unionByName(rest)


def diagnostics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row of counts per mesh, with signed volume and a watertight flag.

    Faces with corners are written once. Every measure folds to one row per mesh before they meet in one last grouping; isolated vertices are those
    beyond the ones that faces use.
    """
    placed = cut(with_corners(vertices, faces))
    sizes = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"))
    out = _by_mesh(_violations(placed, 1e-6).unionByName(sizes, allowMissingColumns=True)).where("faces > 0")
    sound = (F.col("boundary") == 0) & (F.col("bow_tie") == 0) & (F.col("degenerate") == 0)
    return out.select("mesh_id", "vertices", "faces", "edges", "degenerate", "duplicate", "boundary", "non_manifold", "bow_tie", "volume", "area",
                      (F.col("vertices") - F.col("used")).alias("isolated"), sound.alias("watertight"))


# Joins with faces --------------------------------------------------------------------------


def face_cells(placed: DataFrame, size: float) -> DataFrame:
    """Faces repeated in every grid cell their bounding box touches."""
    df = fan_out(placed, "face_id")
    for g, c in zip(CELL, XYZ):
        ends = [F.col(f"{n}{c}") for n in "abc"]
        df = df.withColumn(g, F.explode(F.sequence(K.cell(F.least(*ends), size), K.cell(F.greatest(*ends), size))))
    return df


def _box(prefix: str = "") -> B.Box:
    ends = [[F.col(f"{prefix}{n}{c}") for n in "abc"] for c in XYZ]
    return B.Box(tuple(F.least(*e) for e in ends), tuple(F.greatest(*e) for e in ends))


def overlapping_faces(placed: DataFrame, low, high) -> DataFrame:
    """Faces whose bounding box meets the query box."""
    return placed.where(_box().intersects(B.Box.literal(low, high)))


def face_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(face_a, face_b): pairs of triangles that really intersect.

    Both sides are replicated into grid cells; a pair is tested only in the
    cell holding the lower corner of its boxes' overlap, so no pair is tested
    or reported twice.
    """
    a = face_cells(left, size).select(F.col("face_id").alias("face_a"), *CELL, *[F.col(f"{n}{c}").alias(f"p{n}{c}") for n in "abc" for c in XYZ])
    b = face_cells(right, size).select(F.col("face_id").alias("face_b"), *CELL, *[F.col(f"{n}{c}").alias(f"q{n}{c}") for n in "abc" for c in XYZ])
    met = a.join(b.hint("merge"), CELL)
    p, q = _box("p"), _box("q")
    once = F.lit(True)
    for g, s, t in zip(CELL, p.low, q.low):
        once = once & (F.col(g) == K.cell(F.greatest(s, t), size))
    near = met.where(p.intersects(q) & once)
    args = [F.col(f"{s}{n}{c}") for s in "pq" for n in "abc" for c in XYZ]
    return near.where(T.triangles_intersect(*args)).select("face_a", "face_b")


def ray_hits(points: DataFrame, placed: DataFrame, axis: int = 2, size: float = 1.0) -> DataFrame:
    """(point_id, mesh_id, face_id, t): faces above each point along a coordinate axis.

    Point and face meet on the two other axes only: an equi-join on a 2-D cell.
    """
    plane = [i for i in range(3) if i != axis]
    g = [CELL[i] for i in plane]
    df = fan_out(placed, "face_id")
    for i in plane:
        ends = [F.col(f"{n}{XYZ[i]}") for n in "abc"]
        df = df.withColumn(CELL[i], F.explode(F.sequence(K.cell(F.least(*ends), size), K.cell(F.greatest(*ends), size))))
    asked = points.select("point_id", *XYZ, *[K.cell(F.col(XYZ[i]), size).alias(CELL[i]) for i in plane])
    met = asked.join(df.hint("merge"), g)
    direction = V.vec(*[1.0 if i == axis else 0.0 for i in range(3)])
    t, _, _ = B.ray_triangle(V.vec(*XYZ), direction, *corners())
    return met.withColumn("t", t).where(F.col("t").isNotNull()).select("point_id", "mesh_id", "face_id", "t")


def nearest_hit(points: DataFrame, placed: DataFrame, axis: int = 2, size: float = 1.0) -> DataFrame:
    hits = ray_hits(points, placed, axis, size)
    best = hits.groupBy("point_id").agg(F.min(F.struct("t", "face_id")).alias("m"))
    return best.select("point_id", F.col("m.face_id").alias("face_id"), F.col("m.t").alias("t"))


def _covers(px, py, ends) -> Column:
    """Does the triangle's outline wind around (px, py)? Each edge owns its lower end and not its upper one.

    The edge is evaluated from its lower end whichever face asks, so a point on an edge or a vertex falls to the
    same side for all faces there and is counted once, or twice where the surface folds back.
    """
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ends, (*ends[1:], ends[0])):
        low, high = F.least(ay, by), F.greatest(ay, by)
        low_x, high_x = F.when(ay < by, ax).otherwise(bx), F.when(ay < by, bx).otherwise(ax)
        at = F.when(high > low, low_x + (py - low) * (high_x - low_x) / (high - low))
        crossings = crossings + F.when((low <= py) & (py < high) & (px < at), 1).otherwise(0)
    return crossings % 2 == 1


def faces_above(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """For rows of a point and a triangle: is the triangle above the point, by the rule of ``_covers``?"""
    x, y, z = points.T
    normal = np.cross(faces[:, 1] - faces[:, 0], faces[:, 2] - faces[:, 0])
    crossings = np.zeros(len(points), np.int64)
    for k in range(3):
        (ax, ay), (bx, by) = faces[:, k, :2].T, faces[:, (k + 1) % 3, :2].T
        low, high, up = np.minimum(ay, by), np.maximum(ay, by), ay < by
        low_x, high_x = np.where(up, ax, bx), np.where(up, bx, ax)
        at = low_x + (y - low) * (high_x - low_x) / np.where(high > low, high - low, 1)
        crossings += (low <= y) & (y < high) & (x < at)
    slope = np.where(normal[:, 2] != 0, normal[:, 2], 1)
    height = faces[:, 0, 2] - (normal[:, 0] * (x - faces[:, 0, 0]) + normal[:, 1] * (y - faces[:, 0, 1])) / slope
    return (normal[:, 2] != 0) & (height > z) & (crossings % 2 == 1)


def inside_mesh(points: DataFrame, placed: DataFrame, size: float = 1.0, tolerance: float = 1e-9, by: list[str] | None = None) -> DataFrame:
    """(point_id, mesh_id, side, face_id): closed meshes that hold the point, ``inside`` or ``on`` their surface.

    With ``by`` only points and faces that agree in these columns meet.

    face_id is a face that a point on the surface lies on, the one with the largest id, and NULL inside.

    A point within the tolerance of a face is on the surface. For the others the faces above decide by parity, with
    a rule that counts rays through edges and vertices right, so no point needs a nudge. Rows with an invalid
    position are in no mesh.
    """
    by = by or []
    points = points.where(F.coalesce(V.is_valid(*[F.col(c) for c in XYZ]), F.lit(False)))
    above = fan_out(placed, "face_id")
    for g, c in zip(CELL[:2], XYZ[:2]):
        ends = [F.col(f"{n}{c}") for n in "abc"]
        above = above.withColumn(g, F.explode(F.sequence(K.cell(F.least(*ends), size), K.cell(F.greatest(*ends), size))))
    asked = points.select("point_id", *by, *XYZ, *[K.cell(F.col(c), size).alias(g) for c, g in zip(XYZ, CELL)])
    met = asked.drop("gz").join(above.hint("merge"), [*by, *CELL[:2]])
    nx, ny, nz = _cross()
    height = F.when(nz != 0, F.col("az") - (nx * (F.col("x") - F.col("ax")) + ny * (F.col("y") - F.col("ay"))) / nz)
    outline = [(F.col(f"{n}x"), F.col(f"{n}y")) for n in "abc"]
    hit = met.where((height > F.col("z")) & _covers(F.col("x"), F.col("y"), outline))
    odd = hit.groupBy("point_id", "mesh_id").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1)
    touched = fan_out(placed, "face_id")
    for g, c in zip(CELL, XYZ):
        ends = [F.col(f"{n}{c}") for n in "abc"]
        touched = touched.withColumn(g, F.explode(F.sequence(
            K.cell(F.least(*ends) - tolerance, size), K.cell(F.greatest(*ends) + tolerance, size))))
    close = asked.join(touched.hint("merge"), [*by, *CELL]).where(_box().distance2(V.vec(*XYZ)) <= tolerance * tolerance)
    keep = ("point_id", "mesh_id", "face_id")
    kinds = [f"{c} {close.schema[c].dataType.simpleString()}" for c in keep]
    close = close.select(*keep, *XYZ, *[f"{n}{c}" for n in "abc" for c in XYZ]).mapInArrow(
        lambda batches: _nearest_on_faces(batches, keep), ", ".join([*kinds, *(f"{c} double" for c in ("d2", *XYZ))])).where(F.col("d2") <= tolerance * tolerance)
    both = odd.select("point_id", "mesh_id", F.lit("inside").alias("side"), F.lit(None).cast("long").alias("face_id")).unionByName(
        close.select("point_id", "mesh_id", F.lit("on").alias("side"), F.col("face_id").cast("long")))
    return both.groupBy("point_id", "mesh_id").agg(F.max(F.struct("side", "face_id")).alias("m")).select(
        "point_id", "mesh_id", "m.side", "m.face_id")


def _nearest_on_faces(batches, keep=("point_id", "face_id")):
    """Nearest point of the triangle in each row, for whole batches at once, behind the columns to keep.

    As a column the formula repeats its parts so often that it is not compiled.
    """
    dot = lambda u, v: (u * v).sum(axis=1, keepdims=True)
    for batch in batches:
        p, a, b, c = (np.column_stack([batch[f"{n}{k}"].to_numpy() for k in XYZ]) for n in ("", "a", "b", "c"))
        normal = np.cross(b - a, c - a)
        size = dot(normal, normal)
        best = p - normal * (dot(p - a, normal) / np.where(size > 0, size, 1))
        inside = size > 0
        for u, v in ((a, b), (b, c), (c, a)):
            inside &= dot(np.cross(v - u, best - u), normal) >= 0
        least = np.where(inside, dot(p - best, p - best), np.inf)
        for u, v in ((a, b), (b, c), (c, a)):
            length = dot(v - u, v - u)
            at = u + (v - u) * np.clip(dot(p - u, v - u) / np.where(length > 0, length, 1), 0, 1)
            d2 = dot(p - at, p - at)
            best, least = np.where(~inside & (d2 < least), at, best), np.where(~inside, np.minimum(d2, least), least)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(least[:, 0]), *(pa.array(q) for q in best.T)], names=[*keep, "d2", *XYZ])


def closest_on_surface(points: DataFrame, placed: DataFrame, reach: float) -> DataFrame:
    """(point_id, face_id, distance, x, y, z): exact nearest surface point.

    Searches boxes of growing half-width; a point is settled once its best
    distance fits the searched width. The width doubles each round and the
    bounding box of the mesh ends the growth. Cells are four times as wide as
    the half-width, so a point is sent to three or four of them.
    """
    wanted, done, width, placed = points.select("point_id", *XYZ), None, reach, cut(placed)
    ends = placed.agg(*[f(F.col(f"{n}{c}")).alias(f"{f.__name__}_{n}{c}") for f in (F.min, F.max) for n in "abc" for c in XYZ]).first()
    span = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ]).first()
    reachable = 0.0
    for c in XYZ:
        low = min([ends[f"min_{n}{c}"] for n in "abc"] + [span[f"min_{c}"]])
        high = max([ends[f"max_{n}{c}"] for n in "abc"] + [span[f"max_{c}"]])
        reachable += (high - low) ** 2
    reachable = reachable ** 0.5
    while True:
        grid = 4.0 * width
        asked = fan_out(wanted, "point_id")
        for g, c in zip(CELL, XYZ):
            asked = asked.withColumn(g, F.explode(F.sequence(K.cell(F.col(c) - width, grid), K.cell(F.col(c) + width, grid))))
        met = asked.join(face_cells(placed, grid).hint("merge"), CELL)
        # A face within reach is met in several cells; the one with the lower corner of the overlap tests it.
        for g, c, least in zip(CELL, XYZ, _box().low):
            met = met.where(F.col(g) == K.cell(F.greatest(F.col(c) - width, least), grid))
        # The box distance bounds the triangle distance and is far cheaper to test.
        met = met.where(_box().distance2(V.vec(*XYZ)) <= width * width) if width < reachable else met
        kinds = [f"{c} {met.schema[c].dataType.simpleString()}" for c in ("point_id", "face_id")]
        near = met.select("point_id", "face_id", *XYZ, *[f"{n}{c}" for n in "abc" for c in XYZ]).mapInArrow(
            _nearest_on_faces, ", ".join([*kinds, *(f"{c} double" for c in ("d2", *XYZ))]))
        best = near.groupBy("point_id").agg(F.min(F.struct("d2", "face_id", *XYZ)).alias("m"))
        settled = cut(best.where(F.col("m.d2") <= width * width) if width < reachable else best)
        done = settled if done is None else done.unionByName(settled)
        wanted = cut(wanted.join(settled, "point_id", "left_anti"))
        if width >= reachable or wanted.isEmpty():
            return done.select("point_id", "m.face_id", F.sqrt("m.d2").alias("distance"), "m.x", "m.y", "m.z")
        width *= 2


def classify_patches(placed: DataFrame, patches: DataFrame, solid: DataFrame, size: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(patch, side): where the centroid of the patch's largest face lies with regard to the solid.

    ``outside``, ``inside``, or on its surface: ``same`` where the two faces look the same way, ``opposite`` where
    they look at each other. A surface counts before an inside of another mesh of the solid. With ``by`` a patch meets
    only faces that agree with its own in these columns.
    """
    by = by or []
    chosen = largest_face(placed, patches).select("patch", "face_id")
    a, b, c = corners()
    mid = V.scale(V.add(V.add(a, b), c), F.lit(1.0 / 3.0))
    own = [n.alias(k) for n, k in zip(_cross(), ("nx", "ny", "nz"))]
    probes = cut(placed.join(chosen, "face_id").select(F.col("patch").alias("point_id"), *by, *[m.alias(k) for m, k in zip(mid, XYZ)], *own))
    held = inside_mesh(probes.select("point_id", *by, *XYZ), solid, size, by=by).groupBy("point_id").agg(F.max(F.struct("side", "face_id")).alias("m"))
    there = solid.select("face_id", *by, *[n.alias(k) for n, k in zip(_cross(), ("mx", "my", "mz"))])
    both = probes.join(held.select("point_id", "m.side", "m.face_id"), "point_id", "left").join(there, [*by, "face_id"], "left")
    along = V.dot(V.vec("nx", "ny", "nz"), V.vec("mx", "my", "mz")) > 0
    side = F.when(F.col("side").isNull(), "outside").when(F.col("side") == "inside", "inside").when(along, "same").otherwise("opposite")
    return both.select(F.col("point_id").alias("patch"), side.alias("side"))


def shortest_paths(vertices: DataFrame, faces: DataFrame, sources: DataFrame) -> DataFrame:
    """(vertex_id, distance, previous): shortest edge path from the nearest source vertex.

    Frontier relaxation: only vertices improved in the last round send
    distances on, so a round costs the frontier and not the mesh.
    """
    pos = vertices.select("vertex_id", *XYZ)
    e = edge_valence(faces).select("a", "b")
    a = pos.select(F.col("vertex_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    b = pos.select(F.col("vertex_id").alias("b"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    w = V.distance(V.vec("ax", "ay", "az"), V.vec("bx", "by", "bz"))
    one = e.join(a, "a").join(b, "b").select("a", "b", w.alias("w"))
    edges = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    best = cut(sources.select("vertex_id", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("previous")))
    frontier = best
    while not frontier.isEmpty():
        sent = frontier.select(F.col("vertex_id").alias("a"), "distance").join(edges, "a").select(
            F.col("b").alias("vertex_id"), (F.col("distance") + F.col("w")).alias("distance"), F.col("a").alias("previous"))
        offers = sent.groupBy("vertex_id").agg(F.min(F.struct("distance", "previous")).alias("o"))
        merged = best.join(offers, "vertex_id", "full").select(
            "vertex_id", F.when(F.col("distance").isNull() | (F.col("o.distance") < F.col("distance")), F.col("o")).alias("o"),
            "distance", "previous")
        state = cut(merged.select(
            "vertex_id", F.coalesce("o.distance", "distance").alias("distance"),
            F.when(F.col("o").isNotNull(), F.col("o.previous")).otherwise(F.col("previous")).alias("previous"),
            F.col("o").isNotNull().alias("moved")))
        best = state.select("vertex_id", "distance", "previous")
        frontier = state.where("moved").select("vertex_id", "distance")
    return best
