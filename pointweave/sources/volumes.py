"""Snapshots of voxel volumes as partitioned parquet."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointweave.operators import volume as W

BLOCK = 8  # voxels per block side
REQUIRED = {"vx", "vy", "vz", "value", "weight"}


def save(volume: DataFrame, path: str, span: int = 64) -> None:
    """Partition by slabs of blocks along x, so that ``load_region`` reads only the slabs it needs."""
    missing = REQUIRED - set(volume.columns)
    if missing:
        raise ValueError(f"volume lacks {sorted(missing)}")
    slab = F.floor(F.col("vx") / (BLOCK * span))
    volume.withColumns({"span": F.lit(span), "slab": slab}).write.mode("overwrite").partitionBy("span", "slab").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    volume = spark.read.parquet(path)
    missing = REQUIRED - set(volume.columns)
    if missing:
        raise ValueError(f"not a voxel snapshot: lacks {sorted(missing)}")
    return volume.drop("span", "slab")


def load_region(spark: SparkSession, path: str, size: float, low, high) -> DataFrame:
    """Voxels whose centre lies in the box. The slabs are a condition on partition columns, so others are not read."""
    width = F.col("span") * BLOCK
    first, last = (F.floor(F.lit(math.floor(x / size)) / width) for x in (low[0], high[0]))
    near = spark.read.parquet(path).where(F.col("slab").between(first, last))
    return W.within_region(near, size, low, high, BLOCK).drop("span", "slab")
