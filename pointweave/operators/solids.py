"""Intersection loops, co-refinement and set algebra of pairs of triangle meshes.

Work goes by *job*: a number that a face of the left and a face of the right operand must share to meet, so any number of
pairs of meshes is one DataFrame job. Operands are faces with corners (job, face_id, v0, v1, v2, ax .. cz); vertex
and face ids are unique within an operand of a job, the two operands may use the same ones.

Where the operands touch, points get names that both sides agree on: a vertex of the left, else a vertex of the
right, else the pair of an edge or face of either side. Names, not coordinates, decide what is the same point: every face around a
point finds the same name, edges share their points with all their faces, and the refined meshes fit without gaps.
Faces are cut one by one by a constrained triangulation with exact arithmetic on a fine grid; all that is around
it are joins and groupings.

Jobs of at most ``crowd`` faces a side and ``PAIRS`` pairs of faces are dealt in bundles of bounded size, and the task that holds a bundle
takes all these steps by the same rules in memory: a pair of small meshes is shuffled once. Larger jobs go by joins. There a face that meets very many others
is quartered together with its mesh first, so the constraints of one face stay bounded.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointweave.functions import keys as K, vector as V
from pointweave.operators import components as C, mesh as M
from pointweave.operators.clustering import dense_numbers
from pointweave.operators.exact import GRID, Triangulation
from pointweave.operators.neighbors import CELL
from pointweave.operators.sites import XYZ
from pointweave.session import cut, fan_out

CORNERS = [f"{n}{c}" for n in "abc" for c in XYZ]
FACES = ["job", "side", "face_id", "parent", "k0", "k1", "k2", *CORNERS]  # columns of refined faces
VERTEX, EDGE, FACE = range(3)  # what part of its face a point lies on
CROSSING, ON_LEFT, ON_RIGHT = range(3)  # a segment cuts both faces, or the side of one lies in the plane of the other
EPS = 1e-9  # relative to the size of the two faces
CROWD = 2000  # faces that a face may meet before its mesh is quartered; jobs of no more faces are held whole
BUNDLE = 8192  # faces of the jobs that a task holds at a time, about
PAIRS = 1 << 18  # pairs of faces of a job that is held whole, and those tested at a time


# Contacts of two faces ----------------------------------------------------------------------


def _features(ids: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, id, other id) of slots 0-2 (vertex), 3-5 (edge, smaller vertex first) or 6 (face)."""
    row = np.arange(len(slot))
    kind = np.where(slot < 3, VERTEX, np.where(slot < 6, EDGE, FACE))
    one, two = ids[row, slot % 3], ids[row, (slot + 1) % 3]
    edge = kind == EDGE
    first = np.where(edge, np.minimum(one, two), np.where(kind == VERTEX, one, 0))
    return kind, first, np.where(edge, np.maximum(one, two), 0)


def _sections(p: np.ndarray, d: np.ndarray, ids: np.ndarray, along: np.ndarray):
    """Where the plane at which the corner distances ``d`` are zero cuts each triangle: two ends with slots, by place along the line."""
    n = len(p)
    where, valid = np.zeros((n, 6, 3)), np.zeros((n, 6), bool)
    where[:, :3], valid[:, :3] = p, d == 0
    for k in range(3):
        i, j = k, (k + 1) % 3
        swap = ids[:, i] > ids[:, j]  # the point of an edge is computed alike for both its faces
        u, v = np.where(swap[:, None], p[:, j], p[:, i]), np.where(swap[:, None], p[:, i], p[:, j])
        du, dv = np.where(swap, d[:, j], d[:, i]), np.where(swap, d[:, i], d[:, j])
        cross = du * dv < 0
        t = np.where(cross, du / np.where(cross, du - dv, 1), 0)
        where[:, 3 + k], valid[:, 3 + k] = u + t[:, None] * (v - u), cross
    row = np.arange(n)
    first, last = valid.argmax(axis=1), 5 - valid[:, ::-1].argmax(axis=1)
    place = np.stack([(where[row, s] * along).sum(axis=1) for s in (first, last)])
    swap = place[0] > place[1]
    slots = np.where(swap, [last, first], [first, last])
    ends = np.stack([where[row, s] for s in slots])
    inner = np.full(n, 6)  # what lies between the ends: the face, an edge if both ends are vertices, or the one point
    for k in range(3):
        inner[np.where(swap, last * 8 + first, first * 8 + last) == k * 8 + (k + 1) % 3] = 3 + k
        inner[np.where(swap, last * 8 + first, first * 8 + last) == (k + 1) % 3 * 8 + k] = 3 + k
    inner = np.where(first == last, first, inner)
    return valid.any(axis=1), ends, np.sort(place, axis=0), slots, inner


def _transversal(p, q, ids_p, ids_q, dp, dq, normal, size):
    """Segments of pairs that are not coplanar: rows, ends, slots on either face."""
    along = np.cross(normal[0], normal[1])
    along /= np.maximum(np.linalg.norm(along, axis=1, keepdims=True), 1e-300)
    ok_p, end_p, at_p, slot_p, in_p = _sections(p, dp, ids_p, along)
    ok_q, end_q, at_q, slot_q, in_q = _sections(q, dq, ids_q, along)
    eps = EPS * size
    keep = ok_p & ok_q & (np.maximum(at_p[0], at_q[0]) <= np.minimum(at_p[1], at_q[1]) + eps)
    ends, slots = [], []
    for k, sign in ((0, 1), (1, -1)):
        mine = sign * (at_p[k] - at_q[k]) >= 0  # the left face bounds the segment here
        ends.append(np.where(mine[:, None], end_p[k], end_q[k]))
        place = np.where(mine, at_p[k], at_q[k])
        part = lambda at, slot, inner: np.where(np.abs(place - at[0]) <= eps, slot[0], np.where(np.abs(place - at[1]) <= eps, slot[1], inner))
        slots.append((part(at_p, slot_p, in_p), part(at_q, slot_q, in_q)))
    return keep, ends, slots


def _clipped(p, q, ids_q, normal, size):
    """Sides of ``q`` inside coplanar triangles ``p``: for each side the rows, ends and slots on either face."""
    eps = EPS * size
    unit = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
    sides = np.roll(p, -1, axis=1) - p
    inward = np.cross(unit[:, None], sides)
    inward /= np.maximum(np.linalg.norm(inward, axis=2, keepdims=True), 1e-300)
    for k in range(3):
        one, two = ids_q[:, k], ids_q[:, (k + 1) % 3]
        swap = (one > two)[:, None]
        u, v = q[:, k], q[:, (k + 1) % 3]
        u, v = np.where(swap, v, u), np.where(swap, u, v)
        du, dv = (((x[:, None] - p) * inward).sum(axis=2) for x in (u, v))
        du, dv = (np.where(np.abs(d) <= eps[:, None], 0, d) for d in (du, dv))
        slope = np.where(du != dv, du - dv, 1)
        t = du / slope
        low = np.where(du < 0, np.where(dv < 0, 2.0, np.where(dv == 0, 1.0, t)), 0.0).max(axis=1)
        high = np.where(dv < 0, np.where(du < 0, -1.0, np.where(du == 0, 0.0, t)), 1.0).min(axis=1)
        long = np.linalg.norm(v - u, axis=1)
        keep = low * long <= high * long + eps
        ends, slots = [], []
        for at in (low, high):
            x = u + np.clip(at, 0, 1)[:, None] * (v - u)
            zero = np.abs(((x[:, None] - p) * inward).sum(axis=2)) <= 4 * eps[:, None]
            count = zero.sum(axis=1)
            edge = 3 + zero.argmax(axis=1)
            corner = np.where(zero[:, 0] & zero[:, 1], 1, np.where(zero[:, 1] & zero[:, 2], 2, 0))
            first, last = at * long <= eps, (1 - at) * long <= eps
            flipped = swap[:, 0]
            vertex = np.where(first, np.where(flipped, (k + 1) % 3, k), np.where(flipped, k, (k + 1) % 3))
            ends.append(x)
            slots.append((np.where(count == 0, 6, np.where(count == 1, edge, corner)), np.where(first | last, vertex, 3 + k)))
        yield keep, ends, slots


def _contact_rows(batches):
    """Segments in which the two faces of each row meet; a point is a segment whose ends have one name."""
    parts = [f"{e}_{c}" for e in "pq" for c in ("left", "left0", "left1", "right", "right0", "right1", *XYZ)]
    for batch in batches:
        p, q = (np.column_stack([batch[f"{s}{c}"].to_numpy() for c in CORNERS]).reshape(-1, 3, 3) for s in ("l", "r"))
        ids_p, ids_q = (np.column_stack([batch[f"{s}v{i}"].to_numpy() for i in range(3)]) for s in ("l", "r"))
        size = np.maximum(np.ptp(p, axis=1).max(axis=1), np.ptp(q, axis=1).max(axis=1))
        normals = [np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0]) for x in (p, q)]
        units = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in normals]

        def distances(x, plane, unit):
            d = ((x - plane[:, :1]) * unit[:, None]).sum(axis=2)
            return np.where(np.abs(d) <= EPS * size[:, None], 0, d)

        dp, dq = distances(p, q, units[1]), distances(q, p, units[0])
        flat = (dp == 0).all(axis=1) | (dq == 0).all(axis=1)
        apart = (dp > 0).all(axis=1) | (dp < 0).all(axis=1) | (dq > 0).all(axis=1) | (dq < 0).all(axis=1)
        found = [(CROSSING, ~flat & ~apart, _transversal(p, q, ids_p, ids_q, dp, dq, units, size))]
        found += [(ON_LEFT, flat, c) for c in _clipped(p, q, ids_q, normals[0], size)]
        found += [(ON_RIGHT, flat, (k, e, [s[::-1] for s in slots])) for k, e, slots in _clipped(q, p, ids_p, normals[1], size)]
        for role, wanted, (keep, ends, slots) in found:
            rows = np.flatnonzero(wanted & keep)
            if not len(rows):
                continue
            columns = []
            for end, (on_p, on_q) in zip(ends, slots):
                columns += [*_features(ids_p[rows], on_p[rows]), *_features(ids_q[rows], on_q[rows]), *end[rows].T]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [taken["job"], taken["lface"], taken["rface"], pa.array(np.full(len(rows), role), pa.int64()), *(pa.array(c) for c in columns)],
                names=["job", "lface", "rface", "role", *parts])


def _name(end: str) -> Column:
    c = lambda part: F.col(f"{end}_{part}").cast("string")
    side = lambda s, face: F.when(F.col(f"{end}_{s}") == EDGE, F.concat(F.lit("e"), c(f"{s}0"), F.lit("-"), c(f"{s}1"))).otherwise(F.concat(F.lit("f"), face.cast("string")))
    return (F.when(F.col(f"{end}_left") == VERTEX, F.concat(F.lit("L"), c("left0")))
            .when(F.col(f"{end}_right") == VERTEX, F.concat(F.lit("R"), c("right0")))
            .otherwise(F.concat(side("left", F.col("lface")), F.lit("|"), side("right", F.col("rface")))))


def contacts(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(job, lface, rface, role, p, q, p_left .. q_z): every segment or point in which a left and a right face meet.

    ``size`` is the side of the grid cells in which boxes of faces meet; it decides the work, not the result.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        cells = M.face_cells(df, size)
        return cells.select("job", *CELL, F.col("face_id").cast("long").alias(f"{s}face"), *[F.col(f"v{i}").cast("long").alias(f"{s}v{i}") for i in range(3)],
                            *[F.col(c).alias(f"{s}{c}") for c in CORNERS])

    met = side(left, "l").join(side(right, "r").hint("merge"), ["job", *CELL])
    p, q = M._box("l"), M._box("r")
    once = F.lit(True)
    for g, s, t in zip(CELL, p.low, q.low):
        once = once & (F.col(g) == K.cell(F.greatest(s, t), size))
    near = met.where(p.intersects(q) & once).drop(*CELL)
    job = left.schema["job"].dataType.simpleString()
    ends = ", ".join(f"{e}_{c} {'double' if c in XYZ else 'bigint'}" for e in "pq" for c in ("left", "left0", "left1", "right", "right0", "right1", *XYZ))
    rows = near.mapInArrow(_contact_rows, f"job {job}, lface bigint, rface bigint, role bigint, {ends}")
    return cut(rows.withColumns({"p": _name("p"), "q": _name("q")}))


def intersection_loops(met: DataFrame) -> DataFrame:
    """(job, loop, edge, next, p, q, px .. qz): directed segments along which the surfaces cross, chained into loops.

    A segment runs along the cross product of the outward normals, left times right. One that several pairs of faces
    report, as along an edge, counts once, and not at all if the surfaces only touch there. ``loop`` is its smallest
    edge; ``next`` is null at the end of a chain that is open. Where several segments leave a point they are taken in
    the order of their names. Numbers of edges are unique within a job.
    """
    crossing = met.where((F.col("role") == CROSSING) & (F.col("p") != F.col("q")))
    ahead = F.col("p") < F.col("q")
    at = lambda e: F.struct(*[F.col(f"{e}_{c}").alias(c) for c in XYZ])
    one = crossing.select("job", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), F.when(ahead, 1).otherwise(-1).alias("sign"),
                          F.when(ahead, at("p")).otherwise(at("q")).alias("x"), F.when(ahead, at("q")).otherwise(at("p")).alias("y"))
    net = one.groupBy("job", "low", "high").agg(F.sum("sign").alias("sign"), F.min("x").alias("x"), F.min("y").alias("y")).where("sign <> 0")
    right = F.col("sign") > 0
    directed = net.select("job", F.when(right, F.col("low")).otherwise(F.col("high")).alias("p"), F.when(right, F.col("high")).otherwise(F.col("low")).alias("q"),
                          F.when(right, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(right, F.col("y")).otherwise(F.col("x")).alias("y"))
    numbered = cut(dense_numbers(directed, ["job", "p", "q"], "edge"))
    turn = lambda node, name: numbered.select("job", F.col(node).alias("node"), F.col("edge").alias(name), F.row_number().over(
        Window.partitionBy("job", node).orderBy("edge")).alias("k"))
    follows = turn("q", "edge").join(turn("p", "next"), ["job", "node", "k"]).select("edge", "next")
    chain = cut(numbered.join(follows, "edge", "left"))
    roots = C.components(chain.select(F.col("edge").alias("node")), chain.where("next is not null").select(F.col("edge").alias("a"), F.col("next").alias("b")))
    named = chain.join(roots.select(F.col("node").alias("edge"), F.col("root").alias("loop")), "edge")
    return named.select("job", "loop", "edge", "next", "p", "q", *[F.col(f"{s}.{c}").alias(f"{e}{c}") for e, s in (("p", "x"), ("q", "y")) for c in XYZ])


# Refinement of faces ------------------------------------------------------------------------


def _cut_face(corners, names, points, segments):
    """(names, seam flags of the sides) of the triangles of one face.

    ``points`` are (name, kind, edge ends, place); points of a side keep their order along it and stay on it exactly.
    """
    corners = np.asarray(corners, float).reshape(3, 3)
    t = Triangulation([(0, 0), (GRID, 0), (0, GRID)])
    number = {n: i for i, n in enumerate(names)}
    label = list(names)
    u, v = corners[1] - corners[0], corners[2] - corners[0]
    uu, uv, vv = u @ u, u @ v, v @ v
    det = uu * vv - uv * uv
    for p in sorted(points, key=lambda p: (p["kind"], p["name"])):
        if p["name"] in number:
            continue
        x = np.array([p["x"], p["y"], p["z"]]) - corners[0]
        if p["kind"] == EDGE:
            i, j = names.index(p["one"]), names.index(p["two"])
            side = corners[j] - corners[i]
            step = round(float(np.clip((x + corners[0] - corners[i]) @ side / (side @ side), 0, 1)) * GRID)
            (ax, ay), (bx, by) = t.at[i], t.at[j]
            place = ax + (bx - ax) // GRID * step, ay + (by - ay) // GRID * step
        else:
            s, r = (vv * (x @ u) - uv * (x @ v)) / det, (uu * (x @ v) - uv * (x @ u)) / det
            place = round(s * GRID), round(r * GRID)
            low, high = (min(max(1, p), GRID - 2) for p in place)  # inside, as the name says
            over = max(0, low + high - GRID + 1)
            place = (low - over, high) if low > high else (low, high - over)
        n = t.insert(place)
        number[p["name"]] = n
        if n == len(label):
            label.append(p["name"])
    for s in segments:
        t.constrain(number[s["p"]], number[s["q"]])
    return [([label[n] for n in tri], [(tri[i], tri[(i + 1) % 3]) in t.fixed for i in range(3)]) for tri in t.triangles()]


def _cut_rows(batches):
    for batch in batches:
        out = {c: [] for c in ("job", "side", "parent", "k0", "k1", "k2", "s0", "s1", "s2")}
        for row in batch.to_pylist():
            for names, seams in _cut_face([row[c] for c in CORNERS], [row["k0"], row["k1"], row["k2"]], row["points"] or [], row["segments"] or []):
                for c, value in zip(out, (row["job"], row["side"], row["parent"], *names, *seams)):
                    out[c].append(value)
        if out["job"]:
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field("job").type) if c == "job" else pa.array(v) for c, v in out.items()], names=list(out))


def _vertex_names(faces: DataFrame, side: str, renamed: DataFrame | None) -> DataFrame:
    """Faces with the names k0, k1, k2 of their corners; vertices of the right that lie on one of the left take its name."""
    out = faces.withColumns({f"k{i}": F.concat(F.lit(side), F.col(f"v{i}").cast("string")) for i in range(3)})
    if renamed is None:
        return out
    for i in range(3):
        other = renamed.select("job", F.col("old").alias(f"k{i}"), F.col("new").alias(f"_n{i}"))
        out = out.join(other, ["job", f"k{i}"], "left").withColumn(f"k{i}", F.coalesce(f"_n{i}", f"k{i}")).drop(f"_n{i}")
    return out


def refine(left: DataFrame, right: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, seams) of both operands cut along each other.

    faces: (job, side, face_id, parent, k0, k1, k2, ax .. cz), side 'L' or 'R', with new face ids and corner names that
    both sides share; a face is inside its parent and looks the same way. seams: (job, a, b), the edges along which the
    operands meet. Faces that meet nothing pass through. Constraints of a face that cross each other, as a right
    operand that cuts itself would give, raise.
    """
    met = cut(met)
    ends = [F.struct(F.col(e).alias("name"), *[F.col(f"{e}_{c}").alias(c) for c in ("left", "left0", "left1", "right", "right0", "right1", *XYZ)]) for e in "pq"]
    seen = met.select("job", "lface", "rface", F.explode(F.array(*ends)).alias("n")).select("job", "lface", "rface", "n.*")
    renamed = cut(seen.where((F.col("left") == VERTEX) & (F.col("right") == VERTEX)).select(
        "job", F.concat(F.lit("R"), F.col("right0").cast("string")).alias("old"), F.col("name").alias("new")).groupBy("job", "old").agg(F.min("new").alias("new")))
    operands = {"L": _vertex_names(left, "L", None), "R": _vertex_names(right, "R", renamed)}
    corners, whole = [], []
    for side, df in operands.items():
        named = cut(df.select("job", F.lit(side).alias("side"), F.col("face_id").cast("long").alias("parent"), "k0", "k1", "k2", *CORNERS))
        whole.append(named)
        corners.append(named.select("job", F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("name"), *[F.col(f"{n}{c}").alias(c) for c in XYZ]) for i, n in enumerate("abc")])).alias("c")).select("job", "c.*"))
    # A vertex has its own place, of the left if two share it; other points take the least of the places computed for them.
    own = corners[0].withColumn("rank", F.lit(0)).unionByName(corners[1].withColumn("rank", F.lit(1))).unionByName(
        seen.select("job", "name", *XYZ, F.lit(2).alias("rank")))
    places = cut(own.groupBy("job", "name").agg(F.min(F.struct("rank", *XYZ)).alias("m")).select("job", "name", *[F.col(f"m.{c}").alias(c) for c in XYZ]))

    def of_side(side: str, named: DataFrame) -> DataFrame:
        word, face = ("left", "lface") if side == "L" else ("right", "rface")
        role = ON_LEFT if side == "L" else ON_RIGHT
        vertex = lambda c: F.concat(F.lit(side), F.col(c).cast("string"))
        on_edge = seen.where(F.col(word) == EDGE).select("job", "name", vertex(f"{word}0").alias("one"), vertex(f"{word}1").alias("two")).distinct()
        if side == "R":
            for c in ("one", "two"):
                other = renamed.select("job", F.col("old").alias(c), F.col("new").alias("_n"))
                on_edge = on_edge.join(other, ["job", c], "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
        sides = named.select("job", "parent", F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("a"), F.col(f"k{(i + 1) % 3}").alias("b")) for i in range(3)])).alias("e")).select(
            "job", "parent", F.least("e.a", "e.b").alias("one"), F.greatest("e.a", "e.b").alias("two"))
        ordered = on_edge.select("job", "name", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
        edge_points = sides.join(ordered, ["job", "one", "two"]).select("job", "parent", "name", F.lit(EDGE).alias("kind"), "one", "two")
        inside = seen.where(F.col(word) == FACE).select("job", F.col(face).alias("parent"), "name", F.lit(FACE).alias("kind"), F.lit("").alias("one"), F.lit("").alias("two")).distinct()
        points = edge_points.unionByName(inside).join(places, ["job", "name"])
        points = points.groupBy("job", "parent").agg(F.collect_list(F.struct("name", "kind", "one", "two", *XYZ)).alias("points"))
        drawn = met.where(F.col("role").isin(CROSSING, role) & (F.col("p") != F.col("q"))).select(
            "job", F.col(face).alias("parent"), F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
        drawn = drawn.groupBy("job", "parent").agg(F.collect_list(F.struct("p", "q")).alias("segments"))
        return named.join(points, ["job", "parent"], "left").join(drawn, ["job", "parent"], "left")

    rows = of_side("L", whole[0]).unionByName(of_side("R", whole[1]))
    changed = F.col("points").isNotNull() | F.col("segments").isNotNull()
    job = left.schema["job"].dataType.simpleString()
    kind = f"job {job}, side string, parent bigint, k0 string, k1 string, k2 string, s0 boolean, s1 boolean, s2 boolean"
    rows = cut(rows)
    new = cut(fan_out(rows.where(changed), "parent").mapInArrow(_cut_rows, kind))  # the sort samples its rows first, so they would be made twice
    same = rows.where(~changed).select("job", "side", "parent", "k0", "k1", "k2", *[F.lit(False).alias(f"s{i}") for i in range(3)])
    faces = cut(dense_numbers(new.unionByName(same), ["job", "side", "parent", "k0", "k1", "k2"], "face_id"))
    edges = F.explode(F.array(*[F.struct(F.col(f"s{i}").alias("seam"), F.col(f"k{i}").alias("a"), F.col(f"k{(i + 1) % 3}").alias("b")) for i in range(3)]))
    seams = faces.select("job", edges.alias("e")).where("e.seam").select("job", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()
    slots = faces.select("job", "face_id", F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(f"k{i}").alias("name")) for i, n in enumerate("abc")])).alias("s")).select("job", "face_id", "s.*")
    placed = slots.join(places, ["job", "name"]).groupBy("job", "face_id").agg(
        *[F.max(F.when(F.col("slot") == n, F.col(c))).alias(f"{n}{c}") for n in "abc" for c in XYZ])
    return cut(faces.drop("s0", "s1", "s2").join(placed, ["job", "face_id"])), cut(seams)


# Set algebra --------------------------------------------------------------------------------

#: For each operation and side: the places of patches that stay, and whether they are turned round. Of two patches that
#: lie on each other the left one stands for both.
KEPT = {
    "union": {"L": (("outside", "same"), False), "R": (("outside",), False)},
    "intersection": {"L": (("inside", "same"), False), "R": (("inside",), False)},
    "difference": {"L": (("outside", "opposite"), False), "R": (("inside",), True)},
}
#: The same for an open left operand that a closed right one trims; a union has no meaning there.
TRIMMED = {
    "intersection": {"L": (("inside", "same", "opposite"), False)},
    "difference": {"L": (("outside",), False)},
}


def _half(faces: DataFrame, side: str) -> DataFrame:
    return faces.where(F.col("side") == side).select("job", F.col("job").alias("mesh_id"), "face_id", *[F.col(f"k{i}").alias(f"v{i}") for i in range(3)], *CORNERS)


def classified(faces: DataFrame, seams: DataFrame, left: DataFrame, right: DataFrame, size: float, sides: str = "LR") -> DataFrame:
    """(face_id, patch, place): refined faces with their patch between seams and where it lies to the other operand."""
    out = None
    for side in sides:
        own = _half(faces, side)
        named = own.withColumns({f"v{i}": F.concat_ws(":", F.col("job").cast("string"), f"v{i}") for i in range(3)})
        walls = seams.select(*[F.concat_ws(":", F.col("job").cast("string"), c).alias(c) for c in "ab"])
        patches = cut(M.face_components(named, walls))
        other = (right if side == "L" else left).withColumn("mesh_id", F.col("job"))
        where = M.classify_patches(own, patches, other, size, by=["job"])
        part = patches.join(where, "patch").select("face_id", "patch", F.col("side").alias("place"))
        out = part if out is None else out.unionByName(part)
    return cut(out)


def select_faces(placed: DataFrame, operation: str, open_left: bool = False) -> DataFrame:
    """(job, side, face_id, parent, k0, k1, k2, ax .. cz): of faces with their ``place`` those of the result, those of a subtracted solid turned round."""
    rules = TRIMMED if open_left else KEPT
    if operation not in rules:
        raise ValueError(f"{operation!r} is none of {sorted(rules)}")
    stays, turned = F.lit(False), F.lit(False)
    for side, (kept, round_) in rules[operation].items():
        own = F.col("side") == side
        stays = stays | (own & F.col("place").isin(*kept))
        turned = turned | (own & F.lit(round_))
    swap = {"k1": "k2", "k2": "k1", **{f"b{c}": f"c{c}" for c in XYZ}, **{f"c{c}": f"b{c}" for c in XYZ}}
    return placed.where(stays).select(*[F.when(turned, F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in FACES])


class _Joined:
    """Jobs of any size by joins."""

    def __init__(self, left: DataFrame, right: DataFrame, size: float, open_left: bool, crowd: int):
        self.size, self.open_left = size, open_left
        self.left, self.right = left, right
        self.met = contacts(self.left, self.right, size)
        while True:
            busy = {s: self._crowded(f, crowd) for s, f in (("left", "lface"), ("right", "rface"))}
            if all(b.isEmpty() for b in busy.values()):
                break
            for name, jobs in busy.items():
                setattr(self, name, cut(quartered(getattr(self, name), jobs)))
            self.met = contacts(self.left, self.right, size)
        self._refined = self._places = None

    def _crowded(self, face: str, crowd: int) -> DataFrame:
        count = self.met.groupBy("job", face).agg(F.count("*").alias("n")).where(F.col("n") > crowd)
        return cut(count.select("job").distinct())

    def loops(self) -> DataFrame:
        return intersection_loops(self.met)

    @property
    def refined(self) -> tuple[DataFrame, DataFrame]:
        if self._refined is None:
            self._refined = refine(self.left, self.right, self.met)
        return self._refined

    @property
    def places(self) -> DataFrame:
        if self._places is None:
            self._places = classified(*self.refined, self.left, self.right, self.size, "L" if self.open_left else "LR")
        return self._places

    def result(self, operation: str) -> DataFrame:
        return select_faces(self.refined[0].join(self.places.select("face_id", "place"), "face_id"), operation, self.open_left)


def quartered(faces: DataFrame, jobs: DataFrame) -> DataFrame:
    """The faces with those of the named jobs cut into four at the middles of their sides; ids of vertices and faces are new there."""
    own = faces.join(jobs, "job", "left_semi")
    mid = {(i, j): [((F.col(f"{m}{c}") + F.col(f"{n}{c}")) / 2).alias(c) for c in XYZ] for i, m in enumerate("abc") for j, n in enumerate("abc") if i < j}
    corner = lambda i: (F.concat(F.lit("v"), F.col(f"v{i}").cast("string")), [F.col(f"{'abc'[i]}{c}").alias(c) for c in XYZ])
    def middle(i, j):
        i, j = min(i, j), max(i, j)
        low, high = F.least(f"v{i}", f"v{j}").cast("string"), F.greatest(f"v{i}", f"v{j}").cast("string")
        return F.concat(F.lit("m"), low, F.lit("-"), high), mid[i, j]
    four = [(corner(0), middle(0, 1), middle(0, 2)), (middle(0, 1), corner(1), middle(1, 2)), (middle(0, 2), middle(1, 2), corner(2)), (middle(0, 1), middle(1, 2), middle(0, 2))]
    parts = F.array(*[F.struct(F.lit(k).alias("part"), *[n.alias(f"k{i}") for i, (n, _) in enumerate(t)],
                               *[x.alias(f"{'abc'[i]}{c}") for i, (_, xs) in enumerate(t) for c, x in zip(XYZ, xs)]) for k, t in enumerate(four)])
    new = cut(own.select("job", "face_id", F.explode(parts).alias("t")).select("job", (F.col("face_id") * 4 + F.col("t.part")).alias("face_id"), *[f"t.k{i}" for i in range(3)], *[f"t.{c}" for c in CORNERS]))
    names = dense_numbers(new.select("job", F.explode(F.array("k0", "k1", "k2")).alias("name")).distinct(), ["job", "name"], "id")
    for i in range(3):
        new = new.join(names.select("job", F.col("name").alias(f"k{i}"), F.col("id").alias(f"v{i}")), ["job", f"k{i}"])
    return faces.join(jobs, "job", "left_anti").unionByName(new.select(faces.columns))


# Jobs held whole ----------------------------------------------------------------------------


def _same_job(number: np.ndarray, first: np.ndarray):
    """(i, j) in portions of bounded size: rows with the places of those of their job, which begin at ``first``."""
    sizes = first[number + 1] - first[number]
    total, start = np.cumsum(sizes), 0
    while start < len(number):
        stop = max(start + 1, int(np.searchsorted(total, total[start] - sizes[start] + PAIRS, "right")))
        n = sizes[start:stop]
        yield np.repeat(np.arange(start, stop), n), np.arange(n.sum()) + np.repeat(first[number[start:stop]] - np.cumsum(n) + n, n)
        start = stop


class _Roots(dict):
    """Smallest member of the set of each number; numbers that were never joined stand for themselves."""

    def find(self, n):
        while self.setdefault(n, n) != n:
            self[n] = n = self[self[n]]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def _chained(segments):
    """Rows of ``intersection_loops`` of one job from (p, q, place, place) of crossing segments."""
    net = {}
    for p, q, x, y in segments:
        low, high, x, y, sign = (p, q, x, y, 1) if p < q else (q, p, y, x, -1)
        have = net.get((low, high), (0, x, y))
        net[low, high] = have[0] + sign, min(have[1], x), min(have[2], y)
    edges = sorted((low, high, x, y) if sign > 0 else (high, low, y, x) for (low, high), (sign, x, y) in net.items() if sign)
    leaving, turns, roots = {}, {}, _Roots()
    for n, edge in enumerate(edges):
        leaving.setdefault(edge[0], []).append(n)
    following = []
    for n, edge in enumerate(edges):
        k = turns[edge[1]] = turns.get(edge[1], -1) + 1
        out = leaving.get(edge[1], ())
        following.append(out[k] if k < len(out) else None)
        if following[n] is not None:
            roots.join(n, following[n])
    return [(roots.find(n), n, following[n], p, q, *x, *y) for n, (p, q, x, y) in enumerate(edges)]


def _refined_job(faces, ends, segments):
    """Rows of ``refine`` of one job: (side, parent, names, seam flags, place of each name), sorted, and the seams.

    faces: (side, face, vertices, corners); ends: (name, place, features of left and right with their faces); segments: (role, lface, rface, p, q).
    """
    renamed, places, named = {}, {}, []
    for name, _, (left, *_), (right, old, *_) in ends:
        if left == VERTEX and right == VERTEX:
            old = f"R{old}"
            renamed[old] = min(renamed.get(old, name), name)
    # A vertex has its own place, of the left if two share it; other points take the least of the places computed for them.
    for side, parent, vertices, corners in faces:
        names = [renamed.get(f"{side}{v}", f"{side}{v}") for v in vertices]
        named.append((side, parent, names, corners))
        for n, place in zip(names, (corners[:3], corners[3:6], corners[6:])):
            places[n] = min(places.get(n, (3,)), (side == "R", *place))
    on_edge, inside, drawn = {}, {}, {}
    for name, place, *parts in ends:
        places[name] = min(places.get(name, (3,)), (2, *place))
        for side, (kind, one, two, face) in zip("LR", parts):
            if kind == EDGE:
                key = side, *sorted(renamed.get(f"{side}{v}", f"{side}{v}") for v in (one, two))
                on_edge.setdefault(key, set()).add(name)
            elif kind == FACE:
                inside.setdefault((side, face), set()).add(name)
    for role, lface, rface, p, q in segments:
        for side, face, own in (("L", lface, ON_LEFT), ("R", rface, ON_RIGHT)):
            if p != q and role in (CROSSING, own):
                drawn.setdefault((side, face), set()).add((min(p, q), max(p, q)))
    out, seams = [], set()
    for side, parent, names, corners in named:
        points = []
        for k in range(3):
            one, two = sorted((names[k], names[(k + 1) % 3]))
            points += [(n, EDGE, one, two) for n in on_edge.get((side, one, two), ())]
        points += [(n, FACE, "", "") for n in inside.get((side, parent), ())]
        lines = sorted(drawn.get((side, parent), ()))
        if not points and not lines:
            out.append((side, parent, *names, False, False, False))
            continue
        points = [dict(zip(("name", "kind", "one", "two", *XYZ), (*p, *places[p[0]][1:]))) for p in points]
        for tri, flags in _cut_face(corners, names, points, [{"p": p, "q": q} for p, q in lines]):
            out.append((side, parent, *tri, *flags))
            seams |= {tuple(sorted((tri[i], tri[(i + 1) % 3]))) for i in range(3) if flags[i]}
    out.sort()
    return out, seams, places


class _Bundle:
    """The faces of whole jobs, sorted by job; jobs go by their numbers in it."""

    def __init__(self, left: pa.Table, right: pa.Table):
        jobs = pc.unique(pa.chunked_array([*left["job"].chunks, *right["job"].chunks], left.schema.field("job").type))
        self.jobs = jobs.take(pc.sort_indices(jobs))
        self.faces, self.number, self.first, self.corners = [], [], [], []
        for table in (left, right):
            number = pc.index_in(table["job"], value_set=self.jobs).to_numpy().astype(np.int64)
            order = np.lexsort((table["face_id"].to_numpy(), number))
            table = table.take(pa.array(order)).combine_chunks()
            self.faces.append(table)
            self.number.append(number[order])
            self.first.append(np.searchsorted(number[order], np.arange(len(self.jobs) + 1)))
            self.corners.append(np.column_stack([table[c].to_numpy() for c in CORNERS]).reshape(-1, 3, 3))
        self.boxes = [(p.min(axis=1), p.max(axis=1)) for p in self.corners]

    def contacts(self) -> dict[int, list]:
        """The rows of ``contacts`` by job: (role, lface, rface, end, end) with ends as ``_refined_job`` takes them."""
        found = {}
        (low, high), (lows, highs) = self.boxes
        for i, j in _same_job(self.number[0], self.first[1]):
            near = ((low[i] <= highs[j]) & (lows[j] <= high[i])).all(axis=1)
            i, j = i[near], j[near]
            columns = {"job": pa.array(self.number[0][i])}
            for s, table, rows in (("l", self.faces[0], i), ("r", self.faces[1], j)):
                rows = table.take(pa.array(rows)).combine_chunks()
                columns |= {f"{s}face": rows["face_id"].cast(pa.int64()), **{f"{s}v{k}": rows[f"v{k}"].cast(pa.int64()) for k in range(3)}, **{f"{s}{c}": rows[c] for c in CORNERS}}
            pairs = pa.table(columns).combine_chunks()
            for batch in _contact_rows(pairs.to_batches()):
                c = {n: batch[n].to_pylist() for n in batch.schema.names}
                ends = []
                for e in "pq":
                    left = list(zip(c[f"{e}_left"], c[f"{e}_left0"], c[f"{e}_left1"], c["lface"]))
                    right = list(zip(c[f"{e}_right"], c[f"{e}_right0"], c[f"{e}_right1"], c["rface"]))
                    ends.append(zip(map(_end_name, left, right), zip(*(c[f"{e}_{x}"] for x in XYZ)), left, right))
                for job, *row in zip(c["job"], c["role"], c["lface"], c["rface"], *ends):
                    found.setdefault(job, []).append(row)
        return found

    def loops(self) -> dict[str, list]:
        rows = []
        for job, met in sorted(self.contacts().items()):
            crossing = [(p[0], q[0], p[1], q[1]) for role, _, _, p, q in met if role == CROSSING and p[0] != q[0]]
            rows += [(job, *row) for row in _chained(crossing)]
        return self._columns(rows, ["job", "loop", "edge", "next", "p", "q", *(f"{e}{c}" for e in "pq" for c in XYZ)])

    def refined(self, sides: str) -> dict[str, list]:
        """Columns of refined faces with their seam flags; faces of the ``sides`` also get their place to the other operand."""
        met = self.contacts()
        listed = [list(zip(t["face_id"].to_pylist(), zip(*(t[f"v{k}"].to_pylist() for k in range(3))), p.reshape(-1, 9).tolist())) for t, p in zip(self.faces, self.corners)]
        rows, roots = [], []
        for job in range(len(self.jobs)):
            faces = [(side, *f) for side, own, first in zip("LR", listed, self.first) for f in own[first[job]:first[job + 1]]]
            mine = met.pop(job, [])
            cut_, seams, places = _refined_job(faces, [e for m in mine for e in m[3:]], [(role, l, r, p[0], q[0]) for role, l, r, p, q in mine])
            roots += _patches(cut_, seams, sides, len(rows))
            rows += [(job, n, *f, *(x for k in f[2:5] for x in places[k][1:])) for n, f in enumerate(cut_)]
        out = self._columns(rows, ["job", "face_id", "side", "parent", "k0", "k1", "k2", "s0", "s1", "s2", *CORNERS])
        out["place"] = self._places(np.array([r[0] for r in rows], np.int64), np.array(roots, np.int64), rows)
        return out

    def _columns(self, rows, names):
        columns = dict(zip(names, zip(*rows))) if rows else {n: () for n in names}
        columns["job"] = self.jobs.take(pa.array(columns["job"], pa.int64()))
        return columns

    def _places(self, number, roots, rows):
        """Place of each row by the largest face of its patch, ties to the smaller id; none for rows without a root."""
        place = np.full(len(rows), None, object)
        asked = np.flatnonzero(roots >= 0)
        if not len(asked):
            return place.tolist()
        corners = np.array([rows[i][10:] for i in asked.tolist()], float).reshape(-1, 3, 3)
        normals = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
        area = 0.5 * np.linalg.norm(normals, axis=1)
        order = np.lexsort((asked, -area, roots[asked]))
        chosen = order[np.r_[True, np.diff(roots[asked][order]) != 0]]  # by ascending root
        left = np.array([rows[i][2] == "L" for i in asked[chosen].tolist()])
        found = np.full(len(chosen), "outside", object)
        for side, own in ((1, left), (0, ~left)):
            at = np.flatnonzero(own)
            pick = chosen[at]
            found[at] = self._held(side, number[asked[pick]], corners[pick].sum(axis=1) * (1.0 / 3.0), normals[pick])
        place[asked] = found[np.searchsorted(roots[asked][chosen], roots[asked])]
        return place.tolist()

    def _held(self, side, number, points, normals, tolerance: float = 1e-9):
        """Where points of a surface with these normals lie to the faces of one side, as ``mesh.classify_patches`` has it."""
        above, touched = np.zeros(len(points), np.int64), np.full(len(points), -1)
        corners, (low, high), ids = self.corners[side], self.boxes[side], self.faces[side]["face_id"].to_numpy()
        for i, j in _same_job(number, self.first[side]):
            x, y, z = points[i].T
            over = (low[j, :2] <= points[i, :2]).all(axis=1) & (points[i, :2] <= high[j, :2]).all(axis=1)
            f, g = i[over], j[over]
            np.add.at(above, f, M.faces_above(points[f], corners[g]))
            gap = np.maximum(0.0, np.maximum(low[j] - points[i], points[i] - high[j]))
            close = (gap * gap).sum(axis=1) <= tolerance * tolerance
            f, g = i[close], j[close]
            batch = {"row": f, "face": g, **dict(zip(XYZ, points[f].T)), **{f"{n}{c}": corners[g, k, m] for k, n in enumerate("abc") for m, c in enumerate(XYZ)}}
            for near in M._nearest_on_faces(pa.table({n: pa.array(v) for n, v in batch.items()}).to_batches(), ("row", "face")):
                on = near["d2"].to_numpy() <= tolerance * tolerance
                for row, face in zip(near["row"].to_numpy()[on].tolist(), near["face"].to_numpy()[on].tolist()):
                    if touched[row] < 0 or ids[face] > ids[touched[row]]:
                        touched[row] = face
        p = corners[touched] if len(corners) else np.zeros((len(points), 3, 3))
        along = (np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) * normals).sum(axis=1) > 0
        return np.where(touched >= 0, np.where(along, "same", "opposite"), np.where(above % 2 == 1, "inside", "outside"))


def _end_name(left, right) -> str:
    """The name of an end from its features (kind, id, id, face), as ``_name`` gives it."""
    if left[0] == VERTEX:
        return f"L{left[1]}"
    if right[0] == VERTEX:
        return f"R{right[1]}"
    return "|".join(f"e{one}-{two}" if kind == EDGE else f"f{face}" for kind, one, two, face in (left, right))


def _patches(faces, seams, sides: str, base: int) -> list[int]:
    """For each face of one job the smallest number, counted from ``base``, of its patch between seams; -1 on other sides."""
    roots, first = _Roots(), {}
    for n, (side, _, *names) in enumerate(faces):
        if side in sides:
            for i in range(3):
                edge = tuple(sorted((names[i], names[(i + 1) % 3])))
                if edge not in seams:
                    roots.join(n, first.setdefault((side, edge), n))
    return [base + roots.find(n) if f[0] in sides else -1 for n, f in enumerate(faces)]


class _Whole:
    """Jobs of few faces, dealt in bundles."""

    def __init__(self, left: DataFrame, right: DataFrame, sides: str):
        self.sides, self._faces = sides, {}
        bundles = max(1, -(-(left.count() + right.count()) // BUNDLE))
        deal = lambda df: fan_out(df.where("job is not null").withColumn("bundle", F.pmod(F.xxhash64("job"), F.lit(bundles))), "bundle").groupBy("bundle")
        self.met = deal(left).cogroup(deal(right))
        self.job = left.schema["job"].dataType.simpleString()

    def _run(self, work, kind: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = work(_Bundle(left, right))
            fields = [(n, t) for n, t in (f.strip().split(" ") for f in kind.split(","))]
            types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
            return pa.table([columns[n] if n == "job" else pa.array(columns[n], types[t]) for n, t in fields], names=[n for n, _ in fields])

        return self.met.applyInArrow(run, kind)

    def loops(self) -> DataFrame:
        return self._run(_Bundle.loops, f"job {self.job}, loop bigint, edge bigint, next bigint, p string, q string, " + ", ".join(f"{e}{c} double" for e in "pq" for c in XYZ))

    def faces(self, placed: bool) -> DataFrame:
        """Refined faces with seam flags and, if asked for, places."""
        if True in self._faces or placed in self._faces:
            return self._faces.get(True, self._faces.get(placed))
        sides = self.sides if placed else ""
        kind = f"job {self.job}, side string, face_id bigint, parent bigint, k0 string, k1 string, k2 string, " + ", ".join(
            [f"{c} double" for c in CORNERS] + [f"s{i} boolean" for i in range(3)] + ["place string"])
        self._faces[placed] = cut(self._run(lambda bundle: bundle.refined(sides), kind))
        return self._faces[placed]

    def result(self, operation: str) -> DataFrame:
        return select_faces(self.faces(True), operation, self.sides == "L")

    @property
    def refined(self) -> tuple[DataFrame, DataFrame]:
        faces = self.faces(False)
        edges = F.explode(F.array(*[F.struct(F.col(f"s{i}").alias("seam"), F.col(f"k{i}").alias("a"), F.col(f"k{(i + 1) % 3}").alias("b")) for i in range(3)]))
        seams = faces.select("job", edges.alias("e")).where("e.seam").select("job", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()
        return faces.select(FACES), seams


class Solids:
    """Two operands, refined once and asked for any number of operations.

    The right operand is closed in every job; a left one that is not (``open_left``) can only be trimmed.
    Faces without area are left out, as they bound nothing. Empty operands give empty contacts; then every mesh is
    one patch. Other columns of the operands are not read. Ids of refined faces are unique within a job.
    """

    def __init__(self, left: DataFrame, right: DataFrame, size: float, open_left: bool = False, crowd: int = CROWD):
        self.open_left = open_left
        columns = ["job", "face_id", "v0", "v1", "v2", *CORNERS]
        left, right = (cut(df.select(*columns).where(V.length2(M._cross()) > 0)) for df in (left, right))
        ones = left.select("job", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("job", F.lit(0).alias("l"), F.lit(1).alias("r")))
        sizes = ones.groupBy("job").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        large = cut(sizes.where((F.greatest("l", "r") > crowd) | (F.col("l") * F.col("r") > PAIRS)).select("job"))
        if large.isEmpty():
            self.parts = [_Whole(left, right, "L" if open_left else "LR")]
        else:
            few, many = ([df.join(large, "job", how) for df in (left, right)] for how in ("left_anti", "left_semi"))
            self.parts = [_Whole(*few, "L" if open_left else "LR"), _Joined(*many, size, open_left, crowd)]

    def _all(self, of) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, map(of, self.parts))

    def loops(self) -> DataFrame:
        return self._all(lambda part: part.loops())

    @property
    def refined(self) -> tuple[DataFrame, DataFrame]:
        return self._all(lambda part: part.refined[0].select(FACES)), self._all(lambda part: part.refined[1])

    def result(self, operation: str) -> DataFrame:
        return self._all(lambda part: part.result(operation).select(FACES))
