"""Frames folded into a voxel volume with state: a running mean that depends on the order of the frames.

State lives in blocks of 8 x 8 x 8 voxels, one value of arrays for each block. Every frame first clears the weakly supported
voxels that its rays pass, then adds its hits in the order of the pixels. A voxel's mean counts each of its first
``WEIGHT_CAP`` hits alike; from then on it moves by a fixed share.

A block folds frames in ascending order. A frame older than the newest that the block has folded in an earlier batch is
late: it cannot be put in its place any more, so it is left out and counted in ``late``. Blocks that a late frame does
not meet out of turn are not affected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from pointweave.functions import vector as V
from pointweave.operators import volume as W
from pointweave.operators.sites import XYZ

WEIGHT_CAP = 255  # fixed value: largest weight of a streamed voxel
LEAST = 4  # fixed value: hits from which a voxel is not cleared any more
GUARD = 1.5  # fixed value: voxels in front of a surface that its rays do not clear
BLOCK = 8  # fixed value: voxels along the side of a block
KEY = ["bx", "by", "bz"]
CLEAR, HIT = 0, 1
VOLUME = "vx bigint, vy bigint, vz bigint, value double, weight bigint, hits bigint, r double, g double, b double, last_frame bigint, late bigint"
_STATE = ("slot array<int>, value array<double>, weight array<bigint>, hits array<bigint>, r array<double>, g array<double>, b array<double>, "
          "last_frame array<bigint>, newest bigint, late bigint")
_EVENT = ["slot", "frame_id", "kind", "v", "u", "s", "r", "g", "b"]


def events(frames: DataFrame, size: float, value: str, carve: bool) -> DataFrame:
    """(bx, by, bz, slot, frame_id, kind, v, u, s, r, g, b): what frames do to voxels.

    ``value`` names the column that a hit adds. With ``carve`` rays from (cx, cy, cz) also clear what they pass.
    """
    hits = W._to_voxels(frames, size, V.vec(*XYZ)).select(
        *W.VOXEL, "frame_id", F.lit(HIT).alias("kind"), F.col("v").cast("long"), F.col("u").cast("long"), F.col(value).cast("double").alias("s"),
        *[F.col(c).cast("double").alias(c) for c in "rgb"])
    if carve:
        zero = [F.lit(0).cast("long").alias(c) for c in "vu"] + [F.lit(0.0).alias(c) for c in ("s", "r", "g", "b")]
        passed = W.ray_voxels(frames, size, GUARD).select(*W.VOXEL, "frame_id", F.lit(CLEAR).alias("kind"), *zero)
        hits = hits.unionByName(passed)
    slot = F.lit(0)
    for c in W.VOXEL:
        slot = slot * BLOCK + F.pmod(F.col(c), F.lit(BLOCK))
    return hits.withColumns({**{k: F.floor(F.col(c) / BLOCK) for k, c in zip(KEY, W.VOXEL)}, "slot": slot.cast("int")}).select(*KEY, *_EVENT)


_NARROW = {"slot": np.int16, "kind": np.int8}
PIECE = 1 << 17  # events folded at a time, about


def _packed(rows) -> dict[str, np.ndarray]:
    """The columns of all events of a block; every frame of rows is given back as soon as it is read."""
    held = [{c: np.ascontiguousarray(part[c].to_numpy(), _NARROW.get(c)) for c in _EVENT} for part in rows]
    out = {}
    for c in _EVENT:
        out[c] = np.concatenate([h.pop(c) for h in held])
    return out


class Fold:
    """The voxels of one block: arrays by slot."""

    def __init__(self, state=None):
        n = BLOCK ** 3
        self.value, self.r, self.g, self.b = (np.zeros(n) for _ in range(4))
        self.weight, self.hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.last = np.full(n, -1)
        self.newest, self.late = None, 0
        if state is not None:
            slot = np.array(state[0], int)
            for own, given in zip((self.value, self.weight, self.hits, self.r, self.g, self.b, self.last), state[1:8]):
                own[slot] = given
            self.newest, self.late = state[8], state[9]

    def add(self, rows, cap: int) -> np.ndarray:
        """Fold events, columns by name, in order; the slots that changed. Frames go by in pieces, so that only their columns are held whole."""
        frame = np.asarray(rows["frame_id"])
        due = np.full(len(frame), True) if self.newest is None else frame >= self.newest
        self.late += int(len(np.unique(frame[~due])))
        at = np.flatnonzero(due)
        if not len(at):
            return np.zeros(0, int)
        at = at[np.argsort(frame[at], kind="stable")]
        edges = np.flatnonzero(np.r_[True, frame[at[1:]] != frame[at[:-1]], True])  # where frames begin
        changed, a = [], 0
        while a < len(at):
            z = int(edges[min(np.searchsorted(edges, a + PIECE), len(edges) - 1)])
            changed.append(self._fold({c: np.asarray(rows[c])[at[a:z]] for c in _EVENT}, cap))
            a = z
        self.newest = max(int(frame[at[-1]]), self.newest if self.newest is not None else int(frame[at[0]]))
        return np.unique(np.concatenate(changed))

    def _fold(self, rows: dict[str, np.ndarray], cap: int) -> np.ndarray:
        order = np.lexsort((rows["u"], rows["v"], rows["kind"], rows["frame_id"]))
        slot, kind, frame, s, r, g, b = (rows[c][order] for c in ("slot", "kind", "frame_id", "s", "r", "g", "b"))
        slot = slot.astype(np.int64)
        # The events of different slots do not meet, so the k-th event of every slot is applied at once.
        by_slot = np.argsort(slot, kind="stable")
        sorted_slot = slot[by_slot]
        turn = np.arange(len(slot)) - np.searchsorted(sorted_slot, sorted_slot)
        by_turn = by_slot[np.argsort(turn, kind="stable")]
        edges = np.r_[0, np.cumsum(np.bincount(turn))]
        for a, z in zip(edges[:-1], edges[1:]):
            at = by_turn[a:z]
            clear, hit = at[kind[at] == CLEAR], at[kind[at] == HIT]
            weak = slot[clear][self.weight[slot[clear]] < LEAST]
            for column in (self.value, self.weight, self.hits, self.r, self.g, self.b):
                column[weak] = 0
            k = slot[hit]
            w = self.weight[k]
            for column, new in ((self.value, s), (self.r, r), (self.g, g), (self.b, b)):
                column[k] = (column[k] * w + new[hit]) / (w + 1)
            self.weight[k] = np.minimum(w + 1, cap)
            self.hits[k] += 1
            self.last[k] = frame[hit]
        return np.unique(slot)

    def state(self) -> tuple:
        slot = np.flatnonzero((self.weight > 0) | (self.last >= 0))
        columns = (self.value, self.weight, self.hits, self.r, self.g, self.b, self.last)
        return (slot.tolist(), *(c[slot].tolist() for c in columns), int(self.newest if self.newest is not None else -(1 << 62)), int(self.late))

    def rows(self, key, slot: np.ndarray) -> pd.DataFrame:
        out = {c: int(k) * BLOCK + slot // BLOCK ** (2 - i) % BLOCK for i, (c, k) in enumerate(zip(W.VOXEL, key))}
        return pd.DataFrame(out | {"value": self.value[slot], "weight": self.weight[slot], "hits": self.hits[slot], "r": self.r[slot], "g": self.g[slot],
                                   "b": self.b[slot], "last_frame": self.last[slot], "late": np.full(len(slot), self.late)})


class BlockFold(StatefulProcessor):
    """Keyed by block; rows out are the voxels that a batch changed, with weight 0 where it cleared them."""

    def __init__(self, cap: int = WEIGHT_CAP):
        self.cap = cap

    def init(self, handle):
        self.held = handle.getValueState("block", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        block = Fold(self.held.get() if self.held.exists() else None)
        changed = block.add(_packed(rows), self.cap)
        self.held.update(block.state())
        yield block.rows(key, changed)

    def handleInitialState(self, key, initialState, timerValues):
        block = Fold()
        slot = initialState["slot"].to_numpy()
        for c in ("value", "weight", "hits", "r", "g", "b"):
            getattr(block, c)[slot] = initialState[c].to_numpy()
        block.last[slot] = initialState["last_frame"].to_numpy()
        block.newest = int(initialState["last_frame"].max())
        self.held.update(block.state())

    def close(self):
        pass


def prior_blocks(volume: DataFrame) -> DataFrame:
    """An earlier volume (columns of ``VOLUME`` but ``late``) as initial state; its blocks go on from their newest frame."""
    slot = F.lit(0)
    for c in W.VOXEL:
        slot = slot * BLOCK + F.pmod(F.col(c), F.lit(BLOCK))
    return volume.select(*[F.floor(F.col(c) / BLOCK).alias(k) for k, c in zip(KEY, W.VOXEL)], slot.cast("int").alias("slot"), "value", "weight", "hits", "r", "g", "b", "last_frame")


def fold_stream(frames: DataFrame, size: float, value: str, carve: bool = False, prior: DataFrame | None = None, cap: int = WEIGHT_CAP) -> DataFrame:
    """Changed voxels (``VOLUME``) of every batch of a stream of posed frames, in update mode."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    initial = None if prior is None else prior_blocks(prior).groupBy(*KEY)
    return events(frames, size, value, carve).groupBy(*KEY).transformWithStateInPandas(
        BlockFold(cap), outputStructType=VOLUME, outputMode="Update", timeMode="None", initialState=initial)


def run_fold(frames: DataFrame, path: str, checkpoint: str, size: float, value: str, **options) -> None:
    """Fold what is there and stop: every batch adds the voxels it changed below ``path``, under its number."""
    def save(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = fold_stream(frames, size, value, **options)
    running = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).start()
    try:
        running.processAllAvailable()  # all batches, also those of sources that show their data bit by bit
    finally:
        running.stop()


def current_volume(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every voxel that is not cleared."""
    rows = spark.read.parquet(path).groupBy(*W.VOXEL).agg(F.max_by(F.struct("value", "weight", "hits", "r", "g", "b", "last_frame"), "batch").alias("m"))
    return rows.select(*W.VOXEL, "m.*").where("weight > 0")
