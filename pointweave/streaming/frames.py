"""Streams of frames folded into voxel volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pointweave.operators import volume as W


def read_frames(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Frame files in arrival order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


WEIGHT_CAP = 255  # fixed value: largest weight of a streamed voxel


def occupancy_stream(frames: DataFrame, size: float, cap: int = WEIGHT_CAP) -> DataFrame:
    """Running hits, capped weight, mean colors and last frame per voxel; the state is one row per voxel.

    Counts and means commute, so late frames change nothing but the order of arrival.
    """
    hit = W._to_voxels(frames, size, (F.col("x"), F.col("y"), F.col("z")))
    return hit.groupBy(*W.VOXEL).agg(
        F.count("*").alias("hits"), F.least(F.count("*"), F.lit(cap)).alias("weight"), *[F.avg(c).alias(c) for c in "rgb"], F.max("frame_id").alias("last_frame"))


def directional_stream(frames: DataFrame, size: float) -> DataFrame:
    """Running weighted distance sums per voxel and direction."""
    return W.directional_sums(frames, size)


def start(table: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the volume as an in-memory table that every batch replaces (for small runs and tests)."""
    return (table.writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).start())


def append_sums(frames: DataFrame, path: str, checkpoint: str, size: float) -> StreamingQuery:
    """Write each batch's directional sums below ``path`` under its batch number.

    Rewriting a batch folder makes a repeated batch harmless; ``current_volume``
    folds the batches, so no batch ever rewrites the whole volume.
    """
    def save(batch: DataFrame, number: int):
        W.directional_sums(batch, size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()


def current_volume(spark: SparkSession, path: str) -> DataFrame:
    sums = spark.read.parquet(path).groupBy(*W.VOXEL, "dir").agg(
        F.sum("sum_wd").alias("sum_wd"), F.sum("sum_w").alias("sum_w"))
    return W.directional_merge(None, sums)


def evict(volume: DataFrame, current_frame: int, unseen: int) -> DataFrame:
    """Drop voxels not touched for ``unseen`` frames."""
    return volume.where(F.col("last_frame") >= current_frame - unseen)
