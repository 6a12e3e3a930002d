"""Token counts through a cache of content digests.

The cache is a Parquet folder of (content, tokenizer, n_tokens). Contents are joined to it by the digest of
their normalised bytes and of the tokenizer's version; only distinct contents that it does not hold are
encoded, and their counts are appended. Copies meet as digests, after a partial aggregation in the map tasks,
so a text that fills a third of the table is sent once by each task and encoded once.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pointweave.llm.common import SLICE_BYTES, sliced, texts_of

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


@functools.lru_cache(maxsize=2)
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def tokenizer_version(path: str) -> str:
    """Digest of the model file and of the library's version: both decide the counts."""
    with open(path, "rb") as model:
        return hashlib.sha256(sentencepiece.__version__.encode() + b"\0" + model.read()).hexdigest()


def normalised(text: Column) -> Column:
    """What the digest is taken of. The count depends on every character, so only null and empty are one."""
    return F.coalesce(text, F.lit(""))


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; an absent folder counts as empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def _encode_counts(path: str):
    def run(batches):
        for batch in sliced(batches, "text", SLICE_BYTES):
            ids = _processor(path).encode(texts_of(batch), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch["content"], pa.array([len(i) for i in ids], pa.int64())],
                                             names=["content", "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, cache: str, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens`` to every row, keeping ``cache`` up to date.

    The cache folder must be one that all executors share. A failed run leaves the cache as it was or with
    more right counts, since an append is committed as a whole; two runs that append the same digest agree,
    and duplicates are folded on reading. Null and empty texts count zero; repeated rows stay; a text of any
    length is encoded whole; an empty table gives an empty one. Columns of the input pass through, whatever
    they are called but for ``n_bytes``, ``n_tokens``, ``content`` and ``tokenizer``, which are refused.
    """
    spark = df.sparkSession
    if clash := {"n_bytes", "n_tokens", "content", "tokenizer", "__content"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    version = tokenizer_version(path)
    keyed = df.withColumn("__content", F.sha2(normalised(F.col(f"`{text}`")), 256))
    contents = keyed.groupBy(F.col("__content").alias("content")).agg(F.first(normalised(F.col(f"`{text}`"))).alias("text"))
    held = stored_counts(spark, cache).where(F.col("tokenizer") == version)
    misses = contents.join(held.select("content"), "content", "left_anti")
    counted = misses.mapInArrow(_encode_counts(path), "content string, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # Folded by both columns, so that the join deals the counts out itself and may split a digest with many rows.
    counts = stored_counts(spark, cache).where(F.col("tokenizer") == version).groupBy("content", "tokenizer").agg(
        F.max("n_tokens").alias("n_tokens"))
    return (keyed.withColumn("n_bytes", F.octet_length(normalised(F.col(f"`{text}`"))).cast("long"))
            .join(counts, F.col("__content") == F.col("content"), "left").drop("__content", "content", "tokenizer"))
