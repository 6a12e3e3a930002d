"""Frame files, and volumes folded from streams of frames against a plain loop."""

import glob
import math
import random

import pytest
from pyspark.sql import functions as F

from pointweave.operators import volume as W
from pointweave.sources import frames as R
from pointweave.streaming import fold

PIXEL = "frame_id long, tag string, u int, v int, x double, y double, z double, nx double, ny double, nz double, r long, g long, b long, m array<double>, voxel_size double"


def pixels(n_frames=9, width=6, height=4):
    rng = random.Random(1)
    return [(k, f"t{k}", u, v, None if (u + v + k) % 5 == 0 else float(rng.randint(-9, 9)), 0.5 * u, 2.0, 0.0, 0.0, 1.0, rng.randrange(256), 3, 70000,
             [float(i == j) for i in range(4) for j in range(4)], 0.25) for k in range(n_frames) for u in range(width) for v in range(height) if (u, v) != (1, 1)]


def test_depth_frames_come_back_and_filters_read_their_ranges_only(spark, tmp_path):
    rows = pixels()
    path = f"{tmp_path}/depth"
    R.write_frames(R.depth_records(spark.createDataFrame(rows, PIXEL), 6, 4), path, 2)
    back = R.depth_pixels(R.read_frames(spark, path))
    got = {(r.frame_id, r.u, r.v): r for r in back.collect()}
    assert len(got) == 9 * 24
    for k, tag, u, v, x, y, z, nx, ny, nz, r, g, b, m, size in rows:
        row = got[k, u, v]
        assert (row.tag, row.x, row.r, row.g, row.b, row.m, row.voxel_size, row.nz) == (tag, x, r, g, b, m, size, nz)
        assert (row.y, row.z) == ((y, z) if x is not None else (None, None))
    assert all(got[k, 1, 1].x is None for k in range(9))

    files = R.files_of(path)
    assert sum(len(R.read_index(f)) for f in files) == 9
    reader = R.FrameReader(path)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThanOrEqual
    assert list(reader.pushFilters([EqualTo(("tag",), "t1"), GreaterThanOrEqual(("frame_id",), 3), LessThanOrEqual(("frame_id",), 4)])) == [EqualTo(("tag",), "t1")]
    size = {int(e["frame"]): int(e["size"]) for f in files for e in R.read_index(f)}
    assert sum(b - a for p in reader.partitions() for a, b in p.ranges) == size[3] + size[4]
    one = R.FrameReader(path)
    assert not list(one.pushFilters([In(("frame_id",), (7,))]))
    assert [len(p.ranges) for p in one.partitions()] == [1]
    frames = R.read_frames(spark, path)
    assert sorted(r.frame_id for r in frames.where("frame_id between 3 and 5 or frame_id = 8").collect()) == [3, 4, 5, 8]
    assert [r.tag for r in frames.where("frame_id = 7 and tag = 't7'").collect()] == ["t7"]
    assert frames.where("frame_id = 99").count() == 0


def test_labelled_frames_and_broken_files(spark, tmp_path):
    rows = [(k, None, i, float(i), float(-k), 0.25, 0.0, 1.0, 0.0, i % 256, 2, 3, i * 7, 2 ** 32 - 1) for k in (4, 2) for i in range(50)]
    path = f"{tmp_path}/labelled"
    R.write_frames(R.labelled_records(spark.createDataFrame(rows, R.LABELLED)), path, 1)
    back = R.labelled_points(R.read_frames(spark, path))
    assert sorted(tuple(r) for r in back.collect()) == sorted((r[0], "", *r[2:]) for r in rows)
    with pytest.raises(Exception, match="not 35"):
        R.labelled_points(spark.createDataFrame([(1, "", b"x" * 36)], R.RECORDS)).count()
    with pytest.raises(Exception, match="bytes"):
        R.depth_pixels(spark.createDataFrame([(1, "", b"\x01\0\0\0\x01\0\0\0")], R.RECORDS)).count()
    (tmp_path / "bad.frames").write_bytes(b"no frames in here, none at all")
    with pytest.raises(Exception, match="no frame file"):
        R.read_frames(spark, f"{tmp_path}/bad.frames").count()
    assert R.labelled_points(R.read_frames(spark, path).where("frame_id < 0")).count() == 0


def plain(batches, size, carve, prior=(), cap=255):
    """The volume after folding batches of pixels (frame, u, v, x, y, z, s, camera) one by one."""
    voxels, newest, late = {p[:3]: dict(value=p[3], weight=p[4], hits=p[5]) for p in prior}, {}, {}
    for p in prior:
        block = tuple(c // 8 for c in p[:3])
        newest[block] = max(newest.get(block, -1), p[6])
    for batch in batches:
        events = []
        for f, u, v, x, y, z, s in batch:
            at = tuple(math.floor(c / size) for c in (x, y, z))
            events.append((f, 1, v, u, at, s))
        if carve:
            passed = set()
            for f, u, v, x, y, z, s in batch:
                dist = math.sqrt(x * x + y * y + z * z)
                step, stop = size * 0.8, dist - 1.5 * size
                if stop > step:
                    for i in range(1, max(1, math.ceil(stop / step) - 1) + 1):
                        passed.add((f, tuple(math.floor(i * step * c / dist / size) for c in (x, y, z))))
            events += [(f, 0, 0, 0, at, 0.0) for f, at in passed]
        before = dict(newest)
        for f, kind, v, u, at, s in sorted(events):
            block = tuple(c // 8 for c in at)
            if f < before.get(block, f):
                late.setdefault(block, set()).add(f)
                continue
            newest[block] = max(newest.get(block, f), f)
            voxel = voxels.setdefault(at, dict(value=0.0, weight=0, hits=0))
            if kind == 0:
                if voxel["weight"] < 4:
                    voxel.update(value=0.0, weight=0, hits=0)
            else:
                w = voxel["weight"]
                voxel.update(value=(voxel["value"] * w + s) / (w + 1), weight=min(w + 1, cap), hits=voxel["hits"] + 1)
    return {k: (round(v["value"], 9), v["weight"], v["hits"]) for k, v in voxels.items() if v["weight"]}, late


@pytest.mark.parametrize("carve, prior", [(False, ()), (True, ()), (True, ((1, 1, 1, 0.5, 200, 300, 0), (2, 2, 2, 9.0, 2, 2, 0)))])
def test_a_stream_folds_like_a_plain_loop(spark, tmp_path, carve, prior):
    rng = random.Random(7)
    pixel = lambda f, i: (f, i, i % 3, rng.choice([1.1, 1.2, 2.5, 3.0, -2.0]), rng.choice([1.05, 2.2]), rng.choice([1.0, 2.0, 4.0]), rng.random())
    batches = [[pixel(f, i) for f in frames for i in range(700)] for frames in ((1,), (2, 3), (0, 4), (5,), (5, 6))]  # frame 0 comes late
    for k, batch in enumerate(batches):
        df = spark.createDataFrame([(*p, 0.0, 0.0, 0.0, 1, 2, 3) for p in batch], "frame_id long, u int, v int, x double, y double, z double, s double, cx double, cy double, cz double, r int, g int, b int")
        df.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    schema = df.schema
    files = sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=lambda p: __import__("os").stat(p).st_mtime_ns)
    order = [spark.read.parquet(f).agg(F.max("frame_id")).first()[0] for f in files]
    assert order == [1, 3, 4, 5, 6]
    before = None
    if prior:
        before = spark.createDataFrame([(*p[:3], p[3], p[4], p[5], 0.0, 0.0, 0.0, p[6]) for p in prior],
                                       "vx long, vy long, vz long, value double, weight long, hits long, r double, g double, b double, last_frame long")
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fold.run_fold(frames, f"{tmp_path}/out", f"{tmp_path}/check", 1.0, "s", carve=carve, prior=before)
    got = {(r.vx, r.vy, r.vz): (round(r.value, 9), r.weight, r.hits) for r in fold.current_volume(spark, f"{tmp_path}/out").collect()}
    want, late = plain(batches, 1.0, carve, prior)
    changed = {k: v for k, v in want.items() if k in got or k not in {p[:3] for p in prior}}
    assert got == changed and max(h for _, _, h in got.values()) > 255
    counted = spark.read.parquet(f"{tmp_path}/out").groupBy(*[F.floor(F.col(c) / 8).alias(c) for c in W.VOXEL]).agg(F.max("late").alias("late")).collect()
    assert {(r.vx, r.vy, r.vz): r.late for r in counted if r.late} == {k: len(v) for k, v in late.items()}
