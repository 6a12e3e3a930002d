"""Session settings and lineage cutting shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets AQE turn a sort-merge join into a hash join once every shuffled
    # partition has been measured to be small enough to build in memory.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pointweave", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of its own, because there every task sees that disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="pointweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fan_out(df: DataFrame, key: str) -> DataFrame:
    """Deal rows evenly over all shuffle partitions.

    Used in front of steps that multiply rows: there the work follows the row
    count, while files and AQE coalescing follow bytes and would leave a small
    but expensive input to one or two tasks. A fixed number is not coalesced.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cut(df: DataFrame, key: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from that table.

    A written table survives lost executors, is computed once however often it
    is read, and gives the planner true sizes for the joins that follow. With
    ``key`` the rows are dealt evenly over the files.
    """
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    (df if key is None else fan_out(df, key)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_groups(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """``run`` of Arrow tables that hold all rows of their groups, many small groups in one table.

    For groups so small that a call for each would cost more than its work. Groups come in ascending order of the
    integer ``key``, which is not null; a task holds one batch and one group.
    """
    def whole(batches):
        held = []
        for batch in batches:
            keys = batch[key].to_numpy()
            at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on in the next batch
            if at:
                yield from run(pa.Table.from_batches([*held, batch.slice(0, at)])).to_batches()
                held = []
            held.append(batch.slice(at))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return fan_out(df, key).sortWithinPartitions(key).mapInArrow(whole, schema)
