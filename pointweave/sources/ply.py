"""PLY and STL files as DataFrames.

Readers split binary files into row ranges, one task per range; an ASCII file is
streamed by one task, as its rows have no fixed length. Ids count on over all files
read together, in the order of their names, by the counts in the headers. Writers
stream rows of one output file in id order and rename it when it is complete, so a
retried task leaves whole files only. Paths must be such that all executors see them.
Colors are bytes, here as in tables and volumes.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# PLY scalar type names and their NumPy codes.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
         "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
LISTS = ("vertex_indices", "vertex_index")
RANGE = 250_000  # rows per input partition


def files_of(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))
    return [path]


def read_header(path: str) -> dict:
    """Format, sections (name, count, properties) and the byte length of the header."""
    sections, fmt = [], None
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path}: header does not end")
            words = line.decode("ascii", "replace").split()
            if not words or words[0] in ("comment", "obj_info"):
                continue
            if words[0] == "format":
                fmt = words[1]
            elif words[0] == "element":
                sections.append((words[1], int(words[2]), []))
            elif words[0] == "property":
                sections[-1][2].append(tuple(words[1:]))
            elif words[0] == "end_header":
                return {"format": fmt, "sections": sections, "offset": f.tell()}


class _Range(InputPartition):
    """Rows of one file; ``before`` and ``total`` number them over all files, ``vertices`` are those of earlier files."""

    def __init__(self, path, first, last, before=0, total=0, vertices=0):
        self.path, self.first, self.last = path, first, last
        self.before, self.total, self.vertices = before, total, vertices


def _scalar(props) -> bool:
    return all(p[0] != "list" for p in props)


class PlyReader(DataSourceReader):
    """Rows of one element; ``element`` is vertex or face."""

    def __init__(self, options, schema):
        self.path, self.element = options["path"], options.get("element", "vertex")
        self.columns = [f.name for f in schema.fields]
        self.rows = int(options.get("rows", RANGE))

    def partitions(self):
        out, before, vertices = [], 0, 0
        heads = [(path, read_header(path)) for path in files_of(self.path)]
        of = lambda head, wanted: next((n for name, n, _ in head["sections"] if name == wanted), 0)
        total = sum(of(head, self.element) for _, head in heads)
        for path, head in heads:
            count = of(head, self.element)
            step = max(1, count) if head["format"] == "ascii" else self.rows
            out += [_Range(path, i, min(i + step, count), before, total, vertices) for i in range(0, count, step)]
            before, vertices = before + count, vertices + of(head, "vertex")
        return out or [_Range(None, 0, 0)]

    def read(self, part):
        if part.path is None or part.last <= part.first:
            return
        head = read_header(part.path)
        skip, props = 0, None
        before = []
        for name, count, p in head["sections"]:
            if name == self.element:
                props = p
                break
            skip += count
            before.append((count, p))
        with open(part.path, "rb") as f:
            f.seek(head["offset"])
            if head["format"] == "ascii":
                for _ in range(skip):
                    f.readline()
                for first in range(part.first, part.last, self.rows):
                    rows = np.arange(first, min(first + self.rows, part.last))
                    yield self._batch(part, rows, self._from_text([f.readline().split() for _ in rows], props))
            else:
                order = "<" if "little" in head["format"] else ">"
                yield self._batch(part, np.arange(part.first, part.last), self._from_bytes(f, part, props, before, order))

    def _from_text(self, lines, props):
        if self.element == "face":
            return _fans([_corner_list(words, props) for words in lines])
        table = np.array(lines, dtype=float)
        return {p[1]: table[:, i] for i, p in enumerate(props)}

    def _from_bytes(self, f, part, props, before, order):
        for count, p in before:
            if not _scalar(p):
                raise ValueError("a list element before the wanted one cannot be skipped")
            f.seek(count * sum(np.dtype(TYPES[t]).itemsize for t, _ in p), 1)
        if self.element == "face":
            lists = [p for p in props if p[0] == "list"]
            if len(lists) != 1 or lists[0][3] not in LISTS:
                raise ValueError("a binary face must have one list, that of its vertices")
            kinds = []
            for p in props:
                kinds += [("n", order + TYPES[p[1]]), ("v", order + TYPES[p[2]], 3)] if p[0] == "list" else [("_" + p[1], order + TYPES[p[0]])]
            row = np.dtype(kinds)
            f.seek(part.first * row.itemsize, 1)
            data = np.frombuffer(f.read((part.last - part.first) * row.itemsize), row)
            if (data["n"] != 3).any():
                raise ValueError("binary faces of other than three corners are not supported; write them as ASCII")
            return {f"v{i}": data["v"][:, i].astype("i8") for i in range(3)}
        row = np.dtype([(name, order + TYPES[t]) for t, name in props])
        f.seek(part.first * row.itemsize, 1)
        data = np.frombuffer(f.read((part.last - part.first) * row.itemsize), row)
        return {name: data[name].astype("f8") for _, name in props}

    def _batch(self, part, rows, data):
        """``id`` is the row's number over all files; triangles behind the first of a polygon count on from there."""
        at, fan = data.pop("at", np.arange(len(rows))), data.pop("fan", 0)
        n = len(at)
        data["row"] = rows[at]
        data["id"] = part.before + rows[at] + fan * part.total
        data["file"] = [os.path.basename(part.path)] * n
        if self.element == "face":
            data |= {v: np.asarray(data[v], np.int64) + part.vertices for v in ("v0", "v1", "v2")}
        arrays = []
        for name in self.columns:
            kind = pa.string() if name == "file" else pa.int64() if name in ("row", "id", "v0", "v1", "v2") else pa.float64()
            arrays.append(pa.array(data[name], kind) if name in data else pa.nulls(n, kind))
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


def _corner_list(words: list[bytes], props) -> list[int]:
    """The vertex list of an ASCII face, wherever it stands in the line."""
    at = 0
    for p in props:
        if p[0] != "list":
            at += 1
            continue
        n = int(words[at])
        if p[3] in LISTS:
            return [int(w) for w in words[at + 1:at + 1 + n]]
        at += 1 + n
    raise ValueError("the faces have no list of vertices")


def _fans(polygons: list[list[int]]) -> dict:
    """Triangles around the first corner of each polygon; one of fewer than three corners has none."""
    sizes = np.array([max(0, len(p) - 2) for p in polygons], np.int64)
    return {"at": np.repeat(np.arange(len(polygons)), sizes),
            "fan": np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0, np.int64),
            "v0": [p[0] for p in polygons for _ in p[2:]], "v1": [v for p in polygons for v in p[1:-1]],
            "v2": [v for p in polygons for v in p[2:]]}


class PlySource(DataSource):
    """``spark.read.format("ply").option("element", "vertex").load(path)``."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        if self.options.get("element", "vertex") == "face":
            return "file string, row long, id long, v0 long, v1 long, v2 long"
        names = []
        for path in files_of(self.options["path"]):
            for name, _, props in read_header(path)["sections"]:
                if name == "vertex":
                    names += [p[1] for p in props if p[0] != "list" and p[1] not in names]
        return "file string, row long, id long, " + ", ".join(f"`{n}` double" for n in names)

    def reader(self, schema):
        return PlyReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points with defaults: no normal becomes zero, no color becomes white."""
    register(spark)
    raw = spark.read.format("ply").option("element", "vertex").load(path)
    have = set(raw.columns)

    def column(name, default):
        return (F.col(name) if name in have else F.lit(default)).cast("double")

    extra = [c for c in raw.columns if c not in ("file", "row", "id", "x", "y", "z", "nx", "ny", "nz", "red", "green", "blue", "alpha")]
    return raw.select(
        "file", F.col("id").alias("point_id"), "x", "y", "z", *[column(c, 0.0).alias(c) for c in ("nx", "ny", "nz")],
        *[column(c, 255.0).alias(a) for c, a in zip(("red", "green", "blue", "alpha"), "rgba")], *extra)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of every file; mesh_id is the file name. Polygons come as fans of triangles."""
    register(spark)
    v = spark.read.format("ply").option("element", "vertex").load(path)
    f = spark.read.format("ply").option("element", "face").load(path)
    return (v.select(F.col("file").alias("mesh_id"), F.col("id").alias("vertex_id"), "x", "y", "z"),
            f.select(F.col("file").alias("mesh_id"), F.col("id").alias("face_id"), "v0", "v1", "v2"))


def write_points(points: DataFrame, path: str) -> None:
    """One ASCII PLY file per partition of the cloud, in id order, below ``path``.

    A directory of files is the scalable form of a cloud; the reader takes it
    back as one. Coalesce first for a single file.
    """
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in points.columns]
    colors = [c for c in "rgb" if c in points.columns]
    long = {"r": "red", "g": "green", "b": "blue"}
    os.makedirs(path, exist_ok=True)

    def save(batches):
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        body, count = os.path.join(path, f"._{number}-{attempt}.body"), 0
        with open(body, "w") as out:  # rows first: the header needs their number
            for batch in batches:
                cols = [batch[c].to_pylist() for c in names + colors]
                for row in zip(*cols):
                    head = " ".join(repr(float(v)) for v in row[: len(names)])
                    tail = " ".join(str(min(255, max(0, int(round(v))))) for v in row[len(names):])
                    out.write((head + " " + tail).rstrip() + "\n")
                count += batch.num_rows
        target = os.path.join(path, f"part-{number:05d}.ply")
        with open(whole := f"{body}.ply", "w") as out, open(body) as rows:
            out.write(f"ply\nformat ascii 1.0\nelement vertex {count}\n")
            out.writelines(f"property double {n}\n" for n in names)
            out.writelines(f"property uchar {long[c]}\n" for c in colors)
            out.write("end_header\n")
            for line in rows:
                out.write(line)
        os.remove(body)
        os.replace(whole, target)
        yield pa.RecordBatch.from_pydict({"n": [count]})

    ordered = points.repartitionByRange("point_id").sortWithinPartitions("point_id").select(*names, *colors)
    ordered.mapInArrow(save, "n long").agg(F.sum("n")).collect()


STL_ROW = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])


class StlReader(DataSourceReader):
    """Facets of binary STL: 80-byte header, count, 50-byte rows."""

    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", RANGE))

    def partitions(self):
        out, before = [], 0
        for path in files_of(self.path):
            with open(path, "rb") as f:
                f.seek(80)
                count = struct.unpack("<I", f.read(4))[0]
            if os.path.getsize(path) != 84 + count * STL_ROW.itemsize:
                raise ValueError(f"{path}: not a binary STL file")
            out += [_Range(path, i, min(i + self.rows, count), before) for i in range(0, count, self.rows)]
            before += count
        return out or [_Range(None, 0, 0)]

    def read(self, part):
        if part.path is None:
            return
        with open(part.path, "rb") as f:
            f.seek(84 + part.first * STL_ROW.itemsize)
            data = np.frombuffer(f.read((part.last - part.first) * STL_ROW.itemsize), STL_ROW)
        cols = {"file": [os.path.basename(part.path)] * len(data), "face_id": part.before + np.arange(part.first, part.last)}
        for i, n in enumerate("abc"):
            for j, c in enumerate("xyz"):
                cols[n + c] = data["p"][:, i, j].astype("f8")
        yield pa.RecordBatch.from_pydict(cols)


class StlSource(DataSource):
    @classmethod
    def name(cls):
        return "stl"

    def schema(self):
        return "file string, face_id long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")

    def reader(self, schema):
        return StlReader(self.options)


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(StlSource)
    return spark.read.format("stl").load(path)


def weld_stl(facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with equal corners merged; a vertex id is 3 * face + slot of its first use."""
    slots = F.array(*[F.struct((F.col("face_id") * 3 + i).alias("id"), *[F.col(f"{n}{c}").alias(c) for c in "xyz"]) for i, n in enumerate("abc")])
    corner = facets.select("file", "face_id", F.explode(slots).alias("s")).select("file", "face_id", "s.*")
    first = corner.groupBy("file", "x", "y", "z").agg(F.min("id").alias("vertex_id"))
    placed = corner.join(first, ["file", "x", "y", "z"])
    faces = placed.groupBy("file", "face_id").agg(*[F.max(F.when(F.col("id") % 3 == i, F.col("vertex_id"))).alias(f"v{i}") for i in range(3)])
    return first.withColumnRenamed("file", "mesh_id"), faces.withColumnRenamed("file", "mesh_id")


def write_stl(placed: DataFrame, path: str) -> None:
    """Binary STL, one file per partition, below ``path``."""
    os.makedirs(path, exist_ok=True)
    names = [f"{n}{c}" for n in "abc" for c in "xyz"]

    def save(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get(), 0
        target = os.path.join(path, f"part-{task.partitionId():05d}.stl")
        with open(whole := os.path.join(path, f"._{task.partitionId()}-{task.taskAttemptId()}.stl"), "wb") as out:
            out.write(b"\0" * 84)
            for batch in batches:
                rows = np.zeros(batch.num_rows, STL_ROW)
                p = np.column_stack([batch[c].to_numpy() for c in names]).reshape(-1, 3, 3)
                normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
                size = np.linalg.norm(normal, axis=1, keepdims=True)
                rows["n"], rows["p"] = normal / np.where(size > 0, size, 1), p
                out.write(rows.tobytes())
                count += len(rows)
            out.seek(80)
            out.write(struct.pack("<I", count))
        os.replace(whole, target)
        yield pa.RecordBatch.from_pydict({"n": [count]})

    placed.select(*names).mapInArrow(save, "n long").agg(F.sum("n")).collect()
