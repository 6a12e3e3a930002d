"""The corpus pipeline: documents go through the stages in order, each written before the next reads it.

Stages but the last return the columns of documents. Rows with a null id cannot be named by a result of pairs, so
they pass deduplication and decontamination unchanged; null texts count as empty and stay null.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pointweave.llm import bpe, overlaps, pii, quality, simhash, tiling
from pointweave.llm.common import held_out, one_of_components, table
from pointweave.session import cut, scratch_root


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the smallest id of all that SimHash links within three bits, as in op7, and of all that 5-word shingles link.

    SimHash alone leaves most texts that share four fifths of their shingles, so both run over all documents.
    """
    linked, shared = cut(simhash.near_duplicates(docs).select("doc_id", "component_id")), cut(overlaps.near_copies(docs))
    return one_of_components(one_of_components(docs, linked, "doc_id"), shared, "doc_id")


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced in their texts."""
    masked = pii.redact(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to.

    Small memories and slices: the workers share an executor with what the stages before have left in it.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.encode_and_decode(docs.select("doc_id", "text"), path, pattern, remembered=8 << 20, at_a_time=1 << 19)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("personal_data", mask_personal_data),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None  # classifier, fingerprints, tiling and BPE are outside SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
