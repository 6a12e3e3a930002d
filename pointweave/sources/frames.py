"""Files of recorded frames: a data source that reads only the frames asked for.

A file holds records one behind the other and ends in an index of (frame number, place, length), so a frame is one range of
bytes. The source ``frames`` has rows (frame_id, tag, data); filters on ``frame_id`` are pushed into it and decide
which ranges become partitions. As a stream it delivers whole files in the order of their names. ``depth_pixels`` and ``labelled_points``
decode the two payloads, ``depth_records`` and ``labelled_records`` build them, one frame at a time.

All numbers are little-endian. Paths may be local or of any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

MAGIC = b"PWFRAME1"
ENTRY = np.dtype([("frame", "<i8"), ("at", "<i8"), ("size", "<i8")])
HEAD = struct.Struct("<qII")  # frame number, bytes of the tag, bytes of the data
FOOT = struct.Struct("<q8s")  # entries of the index in front of it
PART_BYTES = 32 << 20  # of neighbouring frames that one task reads
RECORDS = "frame_id bigint, tag string, data binary"
INVALID = 3.402823466e36  # fixed value: coordinates from here on mean that there is none
DEPTH = ("frame_id bigint, tag string, u int, v int, x double, y double, z double, nx double, ny double, nz double, r bigint, g bigint, b bigint, "
         "m array<double>, voxel_size double")
LABELLED = "frame_id bigint, tag string, point_id bigint, x double, y double, z double, nx double, ny double, nz double, r int, g int, b int, label bigint, mark bigint"
POINT_BYTES = 35  # fixed value: of a labelled point


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The frame files of a folder, by name, or the file itself."""
    system, place = _opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.is_file and f.base_name.endswith(".frames")]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


def read_index(path: str) -> np.ndarray:
    """(frame, at, size) of every record of a file."""
    system, place = _opened(path)
    with system.open_input_file(place) as f:
        size = f.size()
        if size < FOOT.size:
            raise ValueError(f"{path} is no frame file")
        n, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or not 0 <= n * ENTRY.itemsize <= size - FOOT.size:
            raise ValueError(f"{path} is no frame file")
        return np.frombuffer(f.read_at(n * ENTRY.itemsize, size - FOOT.size - n * ENTRY.itemsize), ENTRY)


class _Ranges(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        self.path, self.ranges = path, ranges


def _partitions(paths: list[str], wanted=None) -> list[_Ranges]:
    """Neighbouring wanted records of a file become one range, and ranges of up to ``PART_BYTES`` one partition."""
    out = []
    with ThreadPoolExecutor(16) as pool:
        for path, index in zip(paths, pool.map(read_index, paths)):
            rows = index if wanted is None else index[wanted(index["frame"])]
            ranges, held = [], 0
            for _, at, size in np.sort(rows, order="at").tolist():
                if held and held + size > PART_BYTES:
                    out.append(_Ranges(path, ranges))
                    ranges, held = [], 0
                if ranges and ranges[-1][1] == at:
                    ranges[-1] = (ranges[-1][0], at + size)
                else:
                    ranges.append((at, at + size))
                held += size
            if ranges:
                out.append(_Ranges(path, ranges))
    return out


def _records(part: _Ranges) -> Iterator[pa.RecordBatch]:
    system, place = _opened(part.path)
    with system.open_input_file(place) as f:
        for start, end in part.ranges:
            while start < end:
                frame, tag, size = HEAD.unpack(f.read_at(HEAD.size, start))
                body = f.read_at(tag + size, start + HEAD.size)
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), pa.array([body[:tag].decode()]), pa.array([body[tag:]], pa.binary())],
                                                 names=["frame_id", "tag", "data"])
                start += HEAD.size + tag + size


_TESTS = {EqualTo: np.equal, EqualNullSafe: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_id",) and type(f) in _TESTS and f.value is not None:
                self.tests.append((_TESTS[type(f)], f.value))
            elif getattr(f, "attribute", None) == ("frame_id",) and isinstance(f, In):
                self.tests.append((np.isin, [v for v in f.value if v is not None]))
            else:
                yield f

    def wanted(self, frames: np.ndarray) -> np.ndarray:
        keep = np.ones(len(frames), bool)
        for test, value in self.tests:
            keep &= test(frames, value)
        return keep

    def partitions(self):
        return _partitions(files_of(self.path), self.wanted) or [_Ranges("", [])]

    def read(self, part):
        return _records(part) if part.ranges else iter(())


class FrameStream(DataSourceStreamReader):
    """Whole files in the order of their names, ``filesPerBatch`` at a time; the offset is the last name delivered."""

    def __init__(self, path: str, files_per_batch: int):
        self.path, self.step, self.reached = path, files_per_batch, ""

    def _names(self):
        return [p.rsplit("/", 1)[1] for p in files_of(self.path)]

    def initialOffset(self):
        return {"file": ""}

    def latestOffset(self):
        ahead = [n for n in self._names() if n > self.reached][:self.step]
        return {"file": ahead[-1] if ahead else self.reached}

    def partitions(self, start, end):
        self.reached = max(self.reached, end["file"])
        names = [n for n in self._names() if start["file"] < n <= end["file"]]
        return _partitions([f"{self.path.rstrip('/')}/{n}" for n in names]) or [_Ranges("", [])]

    def read(self, part):
        return _records(part) if part.ranges else iter(())

    def commit(self, end):
        self.reached = max(self.reached, end["file"])


class _Written(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


class FrameWriter(DataSourceArrowWriter):
    """One file for each task. Files get their names when all tasks are done; names ascend from one write to the next."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator):
        from pyspark import TaskContext

        system, folder = _opened(self.path)
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        index, at, out = [], 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(hidden)
                tag, data = (row["tag"] or "").encode(), row["data"] or b""
                out.write(HEAD.pack(row["frame_id"], len(tag), len(data)) + tag + data)
                index.append((row["frame_id"], at, HEAD.size + len(tag) + len(data)))
                at += index[-1][2]
        if out is None:
            return _Written([])
        out.write(np.array(index, ENTRY).tobytes() + FOOT.pack(len(index), MAGIC))
        out.close()
        return _Written([(hidden, f"{TaskContext.get().partitionId():06d}")])

    def commit(self, messages):
        system, folder = _opened(self.path)
        stamp = f"{time.time_ns():020d}"
        for m in messages:
            for hidden, part in m.parts if m else []:
                system.move(hidden, f"{folder}/{stamp}-{part}.frames")

    def abort(self, messages):
        system, _ = _opened(self.path)
        for m in messages:
            for hidden, _ in m.parts if m else []:
                system.delete_file(hidden)


class FrameSource(DataSource):
    """Format ``frames``: option ``path``, for streams also ``filesPerBatch``."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return FrameReader(self.options["path"])

    def streamReader(self, schema):
        return FrameStream(self.options["path"], int(self.options.get("filesPerBatch", 1)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("frame files are only added to a folder; choose another one")
        return FrameWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, tag, data) of all frame files of a folder, or of one file."""
    register(spark)
    return spark.read.format("frames").load(path)


def stream_frames(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    register(spark)
    return spark.readStream.format("frames").option("filesPerBatch", files_per_batch).load(path)


def write_frames(records: DataFrame, path: str, files: int) -> None:
    """Add frame files below ``path``: records sorted by frame, dealt over about ``files`` files by ranges of frames."""
    register(records.sparkSession)
    ranged = records.select("frame_id", "tag", "data").repartitionByRange(files, "frame_id").sortWithinPartitions("frame_id")
    ranged.write.format("frames").mode("append").save(path)


# Payloads -----------------------------------------------------------------------------------


def _optional(values: np.ndarray) -> list[pa.Array]:
    """Coordinate columns, null where the position is invalid."""
    bad = ~(np.abs(values) < INVALID).all(axis=1)
    return [pa.array(c.astype(float), mask=bad) for c in values.T]


def depth_pixels(records: DataFrame) -> DataFrame:
    """(frame_id, tag, u, v, x .. nz, r, g, b, m, voxel_size): every pixel of depth frames, in camera space, with the frame's pose.

    Pixels without depth have null coordinates. A frame of another length than its size says raises.
    """
    def run(batches):
        for batch in batches:
            for frame, tag, data in zip(batch["frame_id"], batch["tag"], batch["data"]):
                raw = data.as_buffer()
                width, height = np.frombuffer(raw, "<u4", 2).tolist()
                n = width * height
                if len(raw) != 8 + 36 * n + 68:
                    raise ValueError(f"frame {frame} has {len(raw)} bytes, not {8 + 36 * n + 68}")
                depth, normal = np.frombuffer(raw, "<f4", 6 * n, 8).reshape(2, n, 3)
                color = np.frombuffer(raw, "<u4", 3 * n, 8 + 24 * n).reshape(n, 3).astype(np.int64)
                last = np.frombuffer(raw, "<f4", 17, 8 + 36 * n).astype(float)
                pose = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 16, pa.int32()), pa.array(np.tile(last[:16], n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([frame.as_py()] * n, pa.int64()), pa.array([tag.as_py()] * n, pa.string()), pa.array((np.arange(n) % max(1, width)).astype(np.int32)),
                     pa.array((np.arange(n) // max(1, width)).astype(np.int32)), *_optional(depth), *(pa.array(c.astype(float)) for c in normal.T),
                     *(pa.array(c) for c in color.T), pose, pa.array(np.full(n, last[16]))],
                    names=["frame_id", "tag", "u", "v", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "m", "voxel_size"])

    return records.mapInArrow(run, DEPTH)


def labelled_points(records: DataFrame) -> DataFrame:
    """(frame_id, tag, point_id, x .. nz, r, g, b, label, mark): the points of labelled frames; point_id counts inside the frame."""
    def run(batches):
        for batch in batches:
            for frame, tag, data in zip(batch["frame_id"], batch["tag"], batch["data"]):
                raw = data.as_buffer()
                n = len(raw) // POINT_BYTES
                if len(raw) % POINT_BYTES:
                    raise ValueError(f"frame {frame} has {len(raw)} bytes, not {POINT_BYTES} for each point")
                place, normal = np.frombuffer(raw, "<f4", 6 * n).reshape(2, n, 3)
                color = np.frombuffer(raw, "u1", 3 * n, 24 * n).reshape(n, 3).astype(np.int32)
                label, mark = np.frombuffer(raw, "<u4", 2 * n, 27 * n).reshape(2, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([frame.as_py()] * n, pa.int64()), pa.array([tag.as_py()] * n, pa.string()), pa.array(np.arange(n)), *_optional(place),
                     *(pa.array(c.astype(float)) for c in normal.T), *(pa.array(c) for c in color.T), pa.array(label), pa.array(mark)],
                    names=["frame_id", "tag", "point_id", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "label", "mark"])

    return records.mapInArrow(run, LABELLED)


def _columns(table: pa.Table, names: str, kind: str) -> np.ndarray:
    return np.column_stack([table[c].to_numpy() for c in names.split()]).astype(kind)


def depth_records(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Records of depth frames from pixels (frame_id, tag, u, v, x .. nz, r, g, b, m, voxel_size); absent pixels have no depth.

    One frame is put together by one task. Pixels outside the frame raise; of two in one place the last sorted one stays.
    """
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("v", "u", "x", "y", "z")])
        place = table["v"].to_numpy() * width + table["u"].to_numpy()
        u, v = table["u"].to_numpy(), table["v"].to_numpy()
        if len(u) and (u.min() < 0 or v.min() < 0 or u.max() >= width or v.max() >= height):
            raise ValueError("a pixel lies outside its frame")
        n = width * height
        depth, normal, color = np.full((n, 3), INVALID, "<f4"), np.zeros((n, 3), "<f4"), np.zeros((n, 3), "<u4")
        depth[place] = np.nan_to_num(_columns(table, "x y z", "<f4"), nan=INVALID)
        normal[place], color[place] = _columns(table, "nx ny nz", "<f4"), _columns(table, "r g b", "<u4")
        pose = np.array(table["m"][0].as_py(), "<f4")
        data = b"".join([np.array([width, height], "<u4").tobytes(), depth.tobytes(), normal.tobytes(), color.tobytes(), pose.tobytes(),
                         np.array([table["voxel_size"][0].as_py()], "<f4").tobytes()])
        return pa.table({"frame_id": table["frame_id"].slice(0, 1), "tag": table["tag"].slice(0, 1), "data": pa.array([data], pa.binary())})

    return pixels.groupBy("frame_id").applyInArrow(one, RECORDS)


def labelled_records(points: DataFrame) -> DataFrame:
    """Records of labelled frames from points (frame_id, tag, point_id, x .. nz, r, g, b, label, mark), in the order of point_id."""
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        data = b"".join([_columns(table, "x y z", "<f4").tobytes(), _columns(table, "nx ny nz", "<f4").tobytes(), _columns(table, "r g b", "u1").tobytes(),
                         table["label"].to_numpy().astype("<u4").tobytes(), table["mark"].to_numpy().astype("<u4").tobytes()])
        return pa.table({"frame_id": table["frame_id"].slice(0, 1), "tag": table["tag"].slice(0, 1), "data": pa.array([data], pa.binary())})

    return points.groupBy("frame_id").applyInArrow(one, RECORDS)
