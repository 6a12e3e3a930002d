"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pointweave.session import cut

SLICE_BYTES = 1 << 20  # text handled at a time inside a task; one longer text makes a slice of its own
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hand_back() -> None:
    """Return freed memory to the system: an idle worker may live beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


_kept: dict = {}  # of this worker: the tables of the operator that worked in it last


def kept(key: Hashable, make: Callable):
    """What ``make`` gives, kept from task to task until tables of another key, or a task without any, take its place."""
    if key not in _kept:
        let_go(key)
        _kept[key] = make()
    return _kept[key]


def let_go(but: Hashable = None) -> None:
    """Drop the kept tables unless they are those of ``but``: a worker outlives its stage and serves later ones."""
    if _kept.keys() - {but}:
        _kept.clear()
        hand_back()


def sliced(batches, column: str, limit: int = SLICE_BYTES, keeping: Hashable = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each slice stays within ``limit`` bytes, one row at least.

    At the start of a task kept tables of a key other than ``keeping`` are dropped; at its end freed memory goes back
    to the system.
    """
    let_go(keeping)
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    hand_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null becomes the empty text."""
    return [t or "" for t in batch[column].to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t or b"" for t in batch[column].cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The slice with more columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def schema_with(df: DataFrame, **kinds: str) -> str:
    """DDL of ``df`` with more columns behind its own; a clash of names is an error of the caller."""
    clash = {c.lower() for c in df.columns} & {k.lower() for k in kinds}
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}; select or rename its columns first")
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, *(f"`{k}` {v}" for k, v in kinds.items())])


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def one_of_components(df: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that name their component in the written table ``marked`` (key, component_id).

    Of repeated rows with that key one stays. Rows with a null key cannot be named, so all of them stay.
    """
    removed = marked.where(F.col(key) != F.col("component_id")).select(key).distinct()
    stay = df.join(removed, key, "left_anti").select(*df.columns)
    repeated = cut(marked.where(F.col(key) == F.col("component_id")).groupBy(key).count().where("count > 1").select(key))
    if repeated.isEmpty():
        return stay
    several = stay.join(repeated, key, "left_semi").dropDuplicates([key])
    return stay.join(repeated, key, "left_anti").unionByName(several)


def running_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """Add ``before_<value>``: the sum of that column over all rows in front, in the order of the whole table.

    Rows are range-sorted over the shuffle partitions; each partition adds up its own rows, and the sums of the
    partitions, one row for each, give every partition its start. ``order`` should tell any two rows apart, so
    that no key is too frequent to be split. Null values count as zero.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as partitions
    starts = sums.select("__part", *[F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__{v}") for v in values])
    front = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"__{v}") + F.coalesce(F.sum(v).over(front), F.lit(0))).alias(f"before_{v}") for v in values]
    return ranged.join(F.broadcast(starts), "__part").select(*df.columns, *before)
